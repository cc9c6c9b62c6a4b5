"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over windows, exact edit verification.

A document is contaminated by a benchmark item if some run of its words is within ``floor(max_edits * words of the
item)`` word edits (insert, delete, replace) of the item.

The CGK embedding walks over a sequence of words with shared random bits: step j writes the word under the pointer, and
the pointer advances if bit j of that word's hash is set. Two sequences within edit distance k then differ in O(k)
steps or so with good probability, so that sampling steps is a locality-sensitive hash for edit distance. Each
repetition has bits and sampled steps of its own.

Walks that meet stay together, so the walks of *all* windows of a document are computed at once, from the last step to
the first, with one vectorised choice per step: ``H_j[i] = H_{j+1}[i + bit_j(i)]``, mixed with word i where step j is
sampled. Every word of every document begins a window, and every word of an item an anchor; a document window that
agrees with an anchor gives the place of an item-sized window, which Sellers' algorithm then verifies exactly. Walks at
any of an item's anchors suffice, which carries recall: an anchor agrees with the probability that no sampled step is
out of line, and the more words an item has, the more anchors.

The number of repetitions follows from ``RECALL``: for each length of an item, random items are edited as often as they
may be, at random places, and as many repetitions are needed as find that share of them (``repetitions``). All items of
an index get as many as the neediest.

Items of fewer than ``SHORT`` words have too few anchors for that. They are cut into one more run of words than there may
be edits, so that one of these runs occurs word for word wherever the item does: they are all found.

The index of the items is built and broadcast in parts of at most ``PART`` anchors, one after another, each with a pass
over the documents of its own after which it is freed, so that memory stays bounded for a benchmark of any size.

Defined results:

- NULL or empty text, text without words: contaminated by nothing. NULL doc_id: checked like any other.
- An item without words, or with NULL text or item_id, contaminates nothing; an item of fewer than five words must
  occur word for word.
- Case and punctuation don't count, in any script; in scripts without spaces each character is a word. Very long texts are searched whole.
- Several occurrences: the one with the least edits, then the earliest. Repeated rows give repeated results; repeated
  items are one item for each item_id.
- Empty tables give an empty result. Extra columns, whatever their names, pass ``drop_contaminated`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, sized
from .textops import frugal, mix, release, word_chunks, words

MAX_EDITS = 0.2
#: Steps of a walk, sampled steps; for items of at least SHORT words.
STEPS, SAMPLED = 16, 7
#: Share of the items, edited as often as they may be, that the walks are to find; trials by which it is measured.
RECALL, TRIALS = 0.998, 2000
#: Words of the longest items that are tried.
MODEL = 64
#: Shorter items are searched by runs of words.
SHORT = 18
#: Anchors in one broadcast index.
PART = 2_000_000
#: Candidate windows verified at once.
VERIFY = 4096
#: Words of a worker's batch that are kept until their candidates are verified together.
HELD = 4_000_000

_PAD, _MUL = 0x2D4C957F, 0x9E3779B1


def _plan(seed: int, steps: int, sampled: int) -> tuple[np.uint64, set[int]]:
    rng = np.random.default_rng(seed)
    return np.uint64(rng.integers(0, 1 << 63)), set(rng.choice(steps, min(sampled, steps), replace=False).tolist())


def _padding(steps: int, take: set[int]) -> list[int]:
    """Signature from step j on of a walk that is past the end of its text."""
    out = [_PAD]
    for j in range(steps - 1, -1, -1):
        x = out[-1]
        if j in take:
            x = ((x ^ _PAD) * _MUL) & 0xFFFFFFFF
            x ^= x >> 15
        out.append(x)
    return out[::-1]


def walk(h: np.ndarray, end: np.ndarray, steps: int, sampled: int, seed: int) -> np.ndarray:
    """32-bit signature of the sampled steps of the walk from every word. h: word hashes; end: for each word, where its
    text ends; beyond it a walk writes padding."""
    salt, take = _plan(seed, steps, sampled)
    pads, n = _padding(steps, take), len(h)
    if not n:
        return np.zeros(0, np.uint32)
    bits = mix(h ^ salt)
    word, bits = (bits >> np.uint64(32)).astype(np.uint32), (bits & np.uint64((1 << 32) - 1)).astype(np.uint32)
    last = np.append(np.flatnonzero(end[1:] != end[:-1]), n - 1)
    sig = np.full(n + 1, _PAD, np.uint32)  # sig[i]: of the walk that is at word i before step j
    for j in range(steps - 1, -1, -1):
        sig[-1] = pads[j + 1]
        go = (bits & np.uint32(1 << j % 32)) != 0
        new = np.where(go, sig[1:], sig[:-1])
        new[last] = np.where(go[last], np.uint32(pads[j + 1]), sig[last])
        if j in take:
            new ^= word
            new *= np.uint32(_MUL)
            new ^= new >> np.uint32(15)
        sig[:-1] = new
    return sig[:-1]


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """32-bit signature of the ``size`` words from every word on. Runs that cross the end of a text are no candidates
    that stand verification."""
    sig = np.zeros(len(h), np.uint64)
    for j in range(size):
        sig = mix(sig * np.uint64(3) + np.append(h[j:], np.zeros(min(j, len(h)), np.uint64)))
    return (sig >> np.uint64(32)).astype(np.uint32)


def _seed(repetition: int, steps: int = STEPS) -> int:
    return 1000 * (steps // 2) + repetition


def _inside(size: int, steps: int = STEPS) -> int:
    """Anchors of an item: a walk that may run past the item depends on what follows it in a document."""
    return max(1, size - steps // 2 + 1)


@cache
def repetitions(size: int, edits: int, recall: float = RECALL, steps: int = STEPS, sampled: int = SAMPLED) -> int:
    """Repetitions that find the share ``recall`` of items of so many words with so many edits, be they words inserted,
    replaced, left out or a mixture: the least of these four shares counts."""
    rng = np.random.default_rng(size)
    items = rng.integers(1, 1 << 63, (TRIALS, size)).astype(np.uint64)
    edited = []
    for t, item in enumerate(items.tolist()):
        # places are those of distinct words, the last ones first
        for at in sorted(rng.choice(size, edits, replace=False).tolist(), reverse=True):
            kind = t % 4 if t % 4 < 3 else rng.integers(3)
            item[at : at + (kind > 0)] = [] if kind == 2 else [int(rng.integers(1, 1 << 63))]
        edited.append(item)
    h = np.array(list(chain(*edited)), np.uint64)
    n = np.array([len(x) for x in edited])
    trial, end = np.repeat(np.arange(TRIALS), n), np.repeat(np.cumsum(n), n)
    missed = np.ones(TRIALS, bool)
    for r in range(64):
        anchors = walk(items.reshape(-1), np.repeat(np.arange(1, TRIALS + 1) * size, size), steps, sampled, _seed(r, steps)).reshape(TRIALS, size)[:, : _inside(size, steps)]
        there = np.isin(anchors.astype(np.uint64) | (np.arange(TRIALS, dtype=np.uint64) << np.uint64(32))[:, None], walk(h, end, steps, sampled, _seed(r, steps)).astype(np.uint64) | trial.astype(np.uint64) << np.uint64(32))
        missed &= ~there.any(1)
        if missed.reshape(-1, 4).mean(0).max() <= 1 - recall:
            break
    return r + 1


def distances(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sellers' algorithm on many windows (windows x width) at once: the least number of edits between the item and a
    run of a window, and where the first such run ends. A zero in a window is no word."""
    n, width = windows.shape
    col = np.tile(np.arange(len(item) + 1, dtype=np.int32), (n, 1))
    best, where = col[:, -1].copy(), np.zeros(n, np.int64)
    ramp = np.arange(len(item) + 1, dtype=np.int32)
    for k in range(width):
        cost = (windows[:, k : k + 1] != item[None, :]).astype(np.int32)
        new = np.empty_like(col)
        new[:, 0] = 0
        new[:, 1:] = np.minimum(col[:, :-1] + cost, col[:, 1:] + 1)
        new = np.minimum.accumulate(new - ramp, axis=1) + ramp  # deletions
        col = new
        better = col[:, -1] < best
        best[better], where[better] = col[better, -1], k + 1
    return best, where


class Index:
    """Anchors of benchmark items by signature."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float = MAX_EDITS, steps: int = STEPS, sampled: int = SAMPLED, recall: float = RECALL, short: int = SHORT):
        self.ids, self.words, self.edits = [], [], []
        for k, text in items:
            b = np.frombuffer(text.encode(), np.uint8)
            h = words(b, np.array([0, len(b)])).hash if len(b) else np.zeros(0, np.uint64)
            if len(h):
                self.ids.append(k)
                self.words.append(h)
                self.edits.append(int(max_edits * len(h)))
        #: Families of walks or, without sampled steps, runs: (steps, sampled, seed), then sorted signatures with the
        #: item and the anchor of each.
        self.families = []
        self.n = 0
        found: dict[tuple[int, int, int], list[tuple[np.ndarray, int, np.ndarray]]] = {}
        # the longer an item, the more easily it is found
        kinds = sorted({min(len(h), MODEL) for h in self.words if len(h) >= short})[:8]
        repeats = max((repetitions(n, int(max_edits * n), recall, steps, sampled) for n in kinds), default=0)
        for k, h in enumerate(self.words):
            if len(h) < short:
                cuts = np.arange(self.edits[k] + 2) * len(h) // (self.edits[k] + 1)
                for x, y in zip(cuts[:-1], cuts[1:]):
                    found.setdefault((int(y - x), 0, 0), []).append((runs(h[x:y], int(y - x))[:1], k, np.array([x])))
                continue
            for r in range(repeats):
                sig = walk(h, np.full(len(h), len(h)), steps, sampled, _seed(r, steps))[: _inside(len(h), steps)]
                found.setdefault((steps, sampled, _seed(r, steps)), []).append((sig, k, np.arange(len(sig))))
        for family, rows in sorted(found.items()):
            sig, item, anchor = np.concatenate([x[0] for x in rows]), np.concatenate([np.full(len(x[0]), x[1]) for x in rows]), np.concatenate([x[2] for x in rows])
            o = np.argsort(sig, kind="stable")
            self.families.append((*family, sig[o], item[o], anchor[o]))
            self.n += len(sig)
        self.maps = []
        for *_, sig, _, _ in self.families:
            m = np.zeros(1 << 20, bool)
            m[sig >> np.uint32(12)] = True
            self.maps.append(m)

    def candidates(self, h: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place where the item would begin, word that agrees) of all agreements."""
        found = [np.zeros((3, 0), np.int64)]
        for (steps, sampled, seed, sig, item, anchor), seen in zip(self.families, self.maps):
            x = walk(h, end, steps, sampled, seed) if sampled else runs(h, steps)
            at = np.flatnonzero(seen[x >> np.uint32(12)])
            lo = np.searchsorted(sig, x[at])
            n = np.searchsorted(sig, x[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            found.append(np.stack([item[k], at - anchor[k], at]))
        return tuple(np.concatenate(found, axis=1))

    def verify(self, h: np.ndarray, first: np.ndarray, item: np.ndarray, begin: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) -> (edits, index of the word after the passage) of the candidates within the item's edits.
        h: words of a run of texts; first: where each begins. An item may reach over either border of the text of the
        word that agrees (at)."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        text = np.searchsorted(first, at, "right") - 1
        every = np.unique(np.stack([item, text, begin - first[text] + (1 << 40)]), axis=1) if len(item) else np.zeros((3, 0), np.int64)
        cut = np.flatnonzero(np.diff(every[0])) + 1
        for one in np.split(every, cut, axis=1) if every.shape[1] else []:
            k = int(one[0, 0])
            word, most = self.words[k], self.edits[k]
            known = np.sort(word)
            for part in range(0, one.shape[1], VERIFY):
                doc = one[1, part : part + VERIFY]
                p = one[2, part : part + VERIFY] - (1 << 40) + first[doc]
                # an alignment may shift by as many words as there are edits before and after its anchor
                at = (p - 2 * most)[:, None] + np.arange(len(word) + 4 * most)
                ok = (at >= first[doc][:, None]) & (at < first[doc + 1][:, None])
                win = np.where(ok, h[np.clip(at, 0, len(h) - 1)], np.uint64(0))
                # no run can be near enough that lacks more of the item's words than there may be edits
                near = (known[np.minimum(np.searchsorted(known, win), len(known) - 1)] == win).sum(1) >= len(word) - most
                if near.any():
                    e, stop = distances(word, win[near])
                    for x, y, s in zip(doc[near].tolist(), e.tolist(), (at[near][:, 0] + stop).tolist()):
                        if y <= most:
                            now = (y, s - int(first[x]))
                            best[x, k] = min(now, best.get((x, k), now))
        return best

    def matches(self, texts: pa.Array) -> pa.Array:
        """For each text the list of {item_id, edits, word_end}."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        rows, held, size = [], [], 0

        def settle() -> None:
            h = np.concatenate([x[1] for x in held])
            base = np.concatenate([[0], np.cumsum([len(x[1]) for x in held])])
            first = np.concatenate([*(x[2][:-1] + o for x, o in zip(held, base)), base[-1:]])
            item = np.concatenate([x[3] for x in held])
            begin, at = (np.concatenate([x[k] + o for x, o in zip(held, base)]) for k in (4, 5))
            for (t, k), (e, stop) in self.verify(h, first, item, begin, at).items():
                rows.append((held[0][0] + t, self.ids[k], e, stop))
            held.clear()

        for a, _, w in word_chunks(texts) if self.families else ():
            held.append((a, w.hash, w.first, *self.candidates(w.hash, np.repeat(w.first[1:], np.diff(w.first)))))
            size += len(w.hash)
            if size > HELD:
                settle()
                size = 0
        if held:
            settle()
        rows.sort()
        off = np.concatenate([[0], np.cumsum(np.bincount([r[0] for r in rows], minlength=len(texts)))]) if rows else np.zeros(len(texts) + 1)
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
        return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.StructArray.from_arrays(cols, names=["item_id", "edits", "word_end"]))


def _parts(benchmark: DataFrame, max_edits: float, part: int) -> Iterator[Index]:
    """Indices of some ``part`` anchors or a single item, over all items, one at a time. The benchmark is read row by row."""
    held, n = [], 0
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text")).orderBy("item_id")
    for r in rows.toLocalIterator():
        size = len(r["text"].split()) * repetitions(SHORT, int(max_edits * SHORT))
        if held and n + size > part:
            yield Index(held, max_edits)
            held, n = [], 0
        held.append((r["item_id"], r["text"]))
        n += size
    if held:
        yield Index(held, max_edits)


def _matcher(shared):
    @frugal
    def run(texts: pa.Array) -> pa.Array:
        release()
        return shared.value.matches(texts)

    return F.arrow_udf(run, "array<struct<item_id: bigint, edits: bigint, word_end: bigint>>")


def _passes(docs: DataFrame, parts: Iterator[Index], search) -> DataFrame | None:
    """search(docs, matcher of texts) for each part of the benchmark. Where there are several, each result is written
    and its index freed before the next is built."""
    spark = docs.sparkSession
    first = next(parts, None)
    if first is None:
        return None
    second = next(parts, None)
    if second is None:
        return search(docs, _matcher(spark.sparkContext.broadcast(first)))
    scratch, out = Scratch(spark, "leaks"), None
    for index in chain([first, second], parts):
        shared = spark.sparkContext.broadcast(index)
        found = scratch.keep(search(docs, _matcher(shared)))
        out = found if out is None else out.unionByName(found)
        shared.destroy()
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, part: int = PART) -> DataFrame:
    """doc_id, item_id, edits, word_end (words of the document up to the end of the passage), a row for each document
    and each item that it holds."""
    search = lambda d, match: d.select("doc_id", F.explode(match("text")).alias("m")).select("doc_id", "m.item_id", "m.edits", "m.word_end")
    found = _passes(docs.select("doc_id", "text"), _parts(benchmark, max_edits, part), search)
    return found if found is not None else docs.select("doc_id").limit(0).selectExpr("doc_id", "0L AS item_id", "0L AS edits", "0L AS word_end")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, part: int = PART) -> DataFrame:
    """docs without those that hold an item; all columns. Where the benchmark has several parts, contaminated texts are
    told by 64 bits of a hash."""
    parts = _parts(benchmark, max_edits, part)
    few = [x for _, x in zip(range(2), parts)]
    if len(few) < 2:
        for index in few:
            docs = docs.filter(F.size(_matcher(docs.sparkSession.sparkContext.broadcast(index))(docs["text"])) == 0)
        return docs
    (h,) = fresh(docs.columns, "leak_hash")
    gone = _passes(docs.select("text"), chain(few, parts), lambda d, match: d.filter(F.size(match("text")) > 0).select(F.xxhash64("text").alias(h)).distinct())
    gone = sized(Scratch(docs.sparkSession, "leaks").keep(gone.distinct()))
    return docs.join(gone, F.xxhash64(docs["text"]) == gone[h], "left_anti")
