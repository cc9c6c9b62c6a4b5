"""Language-model scoring with Brown class-based n-grams.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). Classes come from exchange clustering: words move to the class that
raises the likelihood of the corpus's class bigrams most. All counts cover all documents:

1. Word counts: sorted and summed within tasks, one shuffle by word.
2. The core: the ``CORE`` most frequent words. Their bigrams (a matrix of a fixed size) are counted and brought to the
   driver, where words are exchanged one by one with exact counts, each round in the order of their frequency, until none
   moves or ``ROUNDS`` are over. No move lowers the likelihood. All words beside the core are one fixed class meanwhile.
3. Every other word of the corpus moves to its class in the same way, all at once, the classes of its neighbours being
   held fixed: tasks gather how often each word meets each class on either side, one shuffle by word.
4. Classes and counts come back to the documents. Words with a share of at least ``SHARE`` of all words (at most 1 / SHARE
   of them, whatever the input) are broadcast; the occurrences of all others are joined by word and sent back by document.
5. Class bigrams and class frequencies are counted anew over the classes of all words, and every document is scored with
   them (a small matrix), smoothed towards class frequencies. So every word has its own class and its own count.

Defined results:

- NULL text: NULL scores. A text without words is the bare transition from beginning to end. Very long texts are scored
  whole. NULL doc_id: scored like others.
- Case and punctuation don't count. Words are told apart by 56 bits of a hash. Ties between classes: the lower class; of
  equally frequent words the one with the lower hash comes first. Repeated rows count and score repeatedly.
- Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .textops import Words, word_chunks

#: Words that are exchanged one by one.
CORE = 2048
CLASSES, ROUNDS = 64, 8
#: Least share of all words of a word whose class is broadcast.
SHARE = 5e-7
#: Counts that the smoothing adds in proportion to class frequency.
PRIOR = 5.0
#: Distinct keys that a task gathers before it passes them on.
HELD = 2_000_000
#: Rows that a task gathers before it moves their words.
MOVED = 200_000

#: Fixed classes: the border of documents, and meanwhile all words beside the core.
BORDER, OTHER = 0, 1
FIRST = 2
#: A word's key leaves eight bits for a side and a class.
_KEY = ~np.uint64(255)
_MOST = 1 << 24


def _gather(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of (keys, counts) by key, passed on whenever too many are held."""
    keys, counts, size = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k = np.concatenate(keys)
        o = np.argsort(k, kind="stable")
        k = k[o]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        return k[start], np.add.reduceat(np.concatenate(counts)[o], start)

    for k, n in parts:
        if not len(k):
            continue
        keys.append(k)
        counts.append(n)
        size += len(k)
        if size > HELD:
            k, n = merged()
            if len(k) > HELD // 2:
                yield k, n
                keys, counts, size = [], [], 0
            else:
                keys, counts, size = [k], [n], len(k)
    if keys:
        yield merged()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts():
        for b in batches:
            for _, _, w in word_chunks(b.column(0)):
                yield np.unique(w.hash & _KEY, return_counts=True)

    for k, n in _gather(parts()):
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["word", "n"])


class Lexicon:
    """Words by key, with an array of values for each name and a value for all words that it hasn't."""

    def __init__(self, keys: np.ndarray, **values: tuple[np.ndarray, float]):
        o = np.argsort(keys)
        self.keys = keys[o]
        self.values = {k: np.append(v[o], np.asarray(d, v.dtype)) for k, (v, d) in values.items()}

    def find(self, w: Words) -> np.ndarray:
        """Index of each word's values."""
        key, n = w.hash & _KEY, len(self.keys)
        if not n:
            return np.zeros(len(key), np.int64)
        at = np.searchsorted(self.keys, key)
        at[at == n] = 0
        return np.where(self.keys[at] == key, at, n)


def _between(w: Words, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the words of all texts with a border before each text and one at the end; where each text's border is;
    where the words are."""
    first = w.first + np.arange(len(w.first))
    inside = np.ones(len(w.hash) + len(w.first), bool)
    inside[first] = False
    out = np.full(len(inside), BORDER, values.dtype)
    out[inside] = values
    return out, first, np.flatnonzero(inside)


def _core_pairs(shared):
    """Bigrams of the core, the border and all other words as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, v = shared.value
        total, held, size = np.zeros(v * v, np.int64), [], 0
        for b in batches:
            for _, _, w in word_chunks(b.column(0)):
                s, _, _ = _between(w, lexicon.values["id"][lexicon.find(w)])
                held.append(s[:-1] * np.int32(v) + s[1:])
                size += len(s)
                if size > HELD:
                    total += np.bincount(np.concatenate(held), minlength=v * v)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=v * v)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(met: np.ndarray) -> float:
    """Of class bigrams, up to a constant of the words."""
    return float(_xlogx(met).sum() - _xlogx(met.sum(0)).sum() - _xlogx(met.sum(1)).sum())


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each word of a matrix of bigrams (the fixed ones first, then by frequency), the class bigrams, and the
    likelihood before the first round and after each."""
    v, k = len(pairs), FIRST + classes
    member = np.arange(v)
    member[FIRST:] = FIRST + np.arange(v - FIRST) % classes
    flipped, own = np.ascontiguousarray(pairs.T), np.diagonal(pairs)
    hot = np.zeros((v, k))
    hot[np.arange(v), member] = 1
    after, before = pairs @ hot, flipped @ hot
    n = hot.T @ after
    rows, cols, phi = n.sum(1), n.sum(0), _xlogx(n)
    history = [likelihood(n)]
    for _ in range(rounds):
        moved = False
        for w in range(FIRST, v):
            a, s, r, l = member[w], own[w], after[w].copy(), before[w].copy()
            r[a] -= s
            l[a] -= s
            nr, nl = r.sum() + s, l.sum() + s

            def put(c: int, sign: int) -> None:
                n[c] += sign * r
                n[:, c] += sign * l
                n[c, c] += sign * s
                rows[c] += sign * nr
                cols[c] += sign * nl
                phi[c], phi[:, c] = _xlogx(n[c]), _xlogx(n[:, c])

            put(a, -1)
            i, j, d = np.flatnonzero(r), np.flatnonzero(l), np.diagonal(n)
            gain = (_xlogx(n[:, i] + r[i]) - phi[:, i]).sum(1) + (_xlogx(n[j] + l[j, None]) - phi[j]).sum(0)
            gain += _xlogx(d + r + l + s) - _xlogx(d + r) - _xlogx(d + l) + _xlogx(d)  # the pairs within a class
            gain -= _xlogx(rows + nr) - _xlogx(rows) + _xlogx(cols + nl) - _xlogx(cols)
            gain[:FIRST] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9 * abs(gain[a]):  # rounding is no reason to move
                b = a
            put(b, 1)
            if a != b:
                moved = True
                member[w] = b
                for side, m in ((after, flipped), (before, pairs)):
                    side[:, a] -= m[w]
                    side[:, b] += m[w]
        history.append(likelihood(n))
        if not moved:
            break
    return member, n, history


def _contexts(shared):
    """Of each word beside the core the classes before it (codes from 0) and after it (codes from k), counted: rows of
    (word, packed codes and counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, k = shared.value

        def parts():
            for b in batches:
                for _, _, w in word_chunks(b.column(0)):
                    own = lexicon.values["class"][lexicon.find(w)]
                    c, _, at = _between(w, own)
                    other = own == OTHER
                    key, at = w.hash[other] & _KEY, at[other]
                    yield np.unique(np.concatenate([key | c[at - 1].astype(np.uint64), key | (c[at + 1].astype(np.uint64) + np.uint64(k))]), return_counts=True)

        for key, n in _gather(parts()):
            if (n >= _MOST).any():
                times = n // _MOST + 1
                rest = n % _MOST
                key = np.repeat(key, times)
                n = np.full(len(key), _MOST - 1, np.int64)
                n[np.cumsum(times) - 1] = rest + times - 1
            start = np.flatnonzero(np.append(True, (key[1:] ^ key[:-1]) > np.uint64(255)))
            cells = (key & np.uint64(255)).astype(np.uint32) | (n << 8).astype(np.uint32)
            for lo in range(0, len(start), MOVED):
                part = np.append(start[lo : lo + MOVED], start[lo + MOVED] if lo + MOVED < len(start) else len(key))
                packed = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer(((part - part[0]) * 4).astype(np.int32)), pa.py_buffer(cells[part[0] : part[-1]].copy())])
                yield pa.RecordBatch.from_arrays([pa.array((key[part[:-1]] & _KEY).view(np.int64)), packed], names=["word", "cells"])

    return run


def best_classes(which: np.ndarray, code: np.ndarray, n: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class in which each word raises the likelihood most, and the word's count. Of each cell, sorted by word:
    index of the word (all have one), code (class before, or k + class after), count."""
    k = len(met)
    start = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    count = np.add.reduceat(np.where(code < k, n, 0), start)
    rows, cols = met.sum(1)[FIRST:], met.sum(0)[FIRST:]
    sizes, inv = np.unique(count, return_inverse=True)
    loss = _xlogx(rows + sizes[:, None]) - _xlogx(rows) + _xlogx(cols + sizes[:, None]) - _xlogx(cols)
    side = np.concatenate([met[:, FIRST:], met[FIRST:].T])  # by code: what the class has met so far
    kinds, kind = np.unique(n * 256 + code, return_inverse=True)
    table = _xlogx(side[kinds % 256] + (kinds // 256)[:, None]) - _xlogx(side[kinds % 256])
    gain = np.add.reduceat(table[kind], start, axis=0) - loss[inv]
    return FIRST + np.argmax(gain, 1), count


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = shared.value
        held, size = [], 0

        def settle(rows: pa.Table) -> pa.RecordBatch:
            word, packed = rows["word"].to_numpy(), rows["cells"].combine_chunks()
            cells = np.frombuffer(b"".join(packed.to_pylist()), np.uint32)
            new = np.append(True, word[1:] != word[:-1])
            which = np.repeat(np.cumsum(new) - 1, np.diff(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]) // 4)
            # cells of one word from several tasks are summed
            cell = which.astype(np.int64) << 8 | (cells & np.uint32(255))
            o = np.argsort(cell, kind="stable")
            cell, n = cell[o], (cells >> np.uint32(8)).astype(np.int64)[o]
            start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            c, count = best_classes(cell[start] >> 8, cell[start] & 255, np.add.reduceat(n, start), met)
            return pa.RecordBatch.from_arrays([pa.array(word[new]), pa.array(c.astype(np.int32)), pa.array(count)], names=["word", "class", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size > MOVED:
                rows = pa.Table.from_batches(held).combine_chunks()
                word = rows["word"].to_numpy()
                whole = int(np.searchsorted(word, word[-1]))  # the last word may go on
                if whole:
                    yield settle(rows.slice(0, whole))
                held, size = rows.slice(whole).to_batches(), len(word) - whole
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def transitions(met: np.ndarray) -> np.ndarray:
    """log P(class | class before) from counts of class bigrams."""
    seen = (met.sum(0) + 1) / (met.sum() + len(met))
    return np.log((met + PRIOR * seen) / (met.sum(1, keepdims=True) + PRIOR))


class Clustering:
    """What exchange gives."""

    def __init__(self, core: np.ndarray, count: np.ndarray, member: np.ndarray, met: np.ndarray, history: list[float], others: DataFrame, frequent: float):
        """core: keys of words; count, member: count and class of each; met: class bigrams; others: (word, class, n) of
        all other words; frequent: least count of a word that is broadcast."""
        self.core, self.count, self.member, self.met, self.history, self.others, self.frequent = core, count, member, met, history, others, frequent


def cluster(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, share: float = SHARE, core: int = CORE, scratch: Scratch | None = None) -> Clustering:
    if 2 * (FIRST + classes) > 256:
        raise ValueError("at most 126 classes")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "brown")
    text = docs.select("text").filter("text IS NOT NULL")
    counted = scratch.keep(text.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    most = counted.orderBy(F.desc("n"), "word").limit(core).toArrow()
    keys, count = most["word"].to_numpy().view(np.uint64), most["n"].to_numpy()
    scratch.drop(counted)
    v = FIRST + len(keys)
    pairs = np.zeros(v * v)
    shared = spark.sparkContext.broadcast((Lexicon(keys, id=(np.arange(FIRST, v, dtype=np.int32), OTHER)), v))
    seen = text.mapInArrow(_core_pairs(shared), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # v * v at most
    pairs[seen["pair"].to_numpy()] = seen["n"].to_numpy()
    del seen
    shared.destroy()
    member, met, history = exchange(pairs.reshape(v, v), classes, rounds)
    shared = spark.sparkContext.broadcast((Lexicon(keys, **{"class": (member[FIRST:].astype(np.uint8), OTHER)}), FIRST + classes))
    cells = text.mapInArrow(_contexts(shared), "word long, cells binary").repartition("word").sortWithinPartitions("word")
    others = scratch.keep(cells.mapInArrow(_assign(spark.sparkContext.broadcast(met)), "word long, class int, n long"))
    shared.destroy()
    return Clustering(keys, count, member[FIRST:], met, history, others, share * total)


def _sequences(shared):
    """Each document's classes, the border first, the sum of its frequent words' log counts, and all its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        key = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(1)
            for lo, hi, w in word_chunks(texts):
                at = lexicon.find(w)
                c, first, place = _between(w, lexicon.values["class"][at])
                logn = np.zeros(len(c))
                logn[place] = lexicon.values["logn"][at]
                seldom = np.flatnonzero(at == len(lexicon.keys))
                doc = np.searchsorted(w.first, seldom, "right") - 1
                tails = pa.StructArray.from_arrays([pa.array((w.hash[seldom] & _KEY).view(np.int64)), pa.array((place[seldom] - first[doc]).astype(np.int32))], names=["word", "place"])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key + np.arange(hi - lo)),
                        part.column(0),
                        pa.array([c[i:j].tobytes() if there else None for there, i, j in zip(part.column(1).is_valid().to_pylist(), first, first[1:])], pa.binary()),
                        pa.array(np.add.reduceat(logn, first[:-1])),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(seldom, w.first).astype(np.int32)), tails),
                    ],
                    names=["key", "doc_id", "seq", "known", "tails"],
                )
                key += hi - lo

    return run


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes the classes of the other words (class + 256 * place) into the sequences."""
    for b in batches:
        doc, seq, logn, tails = b.columns
        texts = seq.to_pylist()
        c = np.frombuffer(b"".join(x or b"" for x in texts), np.uint8).copy()
        first = np.cumsum([0, *(len(x or b"") for x in texts)])
        row = np.repeat(np.arange(len(seq)), tails.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = tails.flatten().to_numpy(zero_copy_only=False)
        c[first[row] + (flat >> 8)] = flat & 255
        whole = [c[i:j].tobytes() if x is not None else None for x, i, j in zip(texts, first, first[1:])]
        yield pa.RecordBatch.from_arrays([doc, pa.array(whole, pa.binary()), logn], names=["doc_id", "seq", "logn"])


def _steps(seq: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all texts one after another, those that follow them, and where each text begins. A null is a border."""
    if isinstance(seq, pa.ChunkedArray):
        seq = seq.combine_chunks()
    texts = [x or bytes([BORDER]) for x in seq.to_pylist()]
    c = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    return c, np.append(c[1:], BORDER), np.cumsum([0, *map(len, texts)])


def _class_bigrams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for b in batches:
            if b.num_rows:
                x, y, _ = _steps(b.column(0).drop_null())
                total += np.bincount(x * k + y, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


def perplexities(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, share: float = SHARE, core: int = CORE) -> DataFrame:
    """doc_id, n_words, log_prob (natural), perplexity (per word and end of text); a row for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "brown")
    m = cluster(docs, classes, rounds, share, core, scratch)
    k = FIRST + classes
    # at most 1 / share words beside the core, whatever the input
    often = m.others.filter(F.col("n") >= m.frequent).toArrow()
    keys = np.concatenate([m.core, often["word"].to_numpy().view(np.uint64)])
    members = np.concatenate([m.member, often["class"].to_numpy()]).astype(np.uint8)
    logn = np.log(np.concatenate([m.count, often["n"].to_numpy()]))
    shared = spark.sparkContext.broadcast(Lexicon(keys, **{"class": (members, OTHER), "logn": (logn, 0.0)}))
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = scratch.keep(docs.select("doc_id", "text").mapInArrow(_sequences(shared), f"key long, doc_id {kind}, seq binary, known double, tails array<struct<word: bigint, place: int>>"))
    shared.destroy()
    seldom = parts.select("key", F.explode("tails").alias("t")).select("t.word", "key", "t.place")
    rest = m.others.filter(F.col("n") < m.frequent).select("word", "class", F.ln("n").alias("logn"))
    moved = seldom.join(rest.hint("merge"), "word").select("key", (F.col("place").cast("long") * 256 + F.col("class")).alias("tail"), "logn")
    back = moved.groupBy("key").agg(F.collect_list("tail").alias("tails"), F.sum("logn").alias("more"))
    whole = parts.drop("tails").join(back, "key", "left").select("doc_id", "seq", (F.col("known") + F.coalesce("more", F.lit(0.0))).alias("logn"), "tails")
    whole = scratch.keep(whole.mapInArrow(_fill, f"doc_id {kind}, seq binary, logn double"))
    scratch.drop(parts)
    scratch.drop(m.others)

    met = np.zeros(k * k)
    for r in whole.select("seq").mapInArrow(_class_bigrams(k), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        met[r["cell"]] = r["n"]
    met = met.reshape(k, k)
    weight = np.log(np.maximum(met.sum(0), 1))
    weight[BORDER] = 0.0  # a border is sure in its class
    last = spark.sparkContext.broadcast(transitions(met) - weight)

    def run(seq: pa.Array, logn: pa.Array) -> pa.Array:
        x, y, first = _steps(seq)
        if not len(seq):
            return pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], names=["n_words", "log_prob", "perplexity"])
        logp, n = np.add.reduceat(last.value[x, y], first[:-1]) + logn.to_numpy(zero_copy_only=False), np.diff(first) - 1
        null = np.asarray(seq.is_null())
        return pa.StructArray.from_arrays([pa.array(v, mask=null) for v in (n, logp, np.exp(-logp / (n + 1)))], names=["n_words", "log_prob", "perplexity"])

    s = F.arrow_udf(run, "struct<n_words: bigint, log_prob: double, perplexity: double>")
    return whole.select("doc_id", s("seq", "logn").alias("s")).select("doc_id", "s.n_words", "s.log_prob", "s.perplexity")
