"""Toxicity by noisy-channel deobfuscation.

Texts are written through a channel that swaps letters for look-alike signs, spells words letter by letter and repeats
letters. Tokens that show its traces become lattices of the letters that each sign may stand for; Viterbi decoding under
a character trigram model, counted over all documents, restores the likeliest reading, and the restored text is scored.

Scoring rests on words and word stems (first 4 to 6 letters) whose association with toxic labels is far beyond chance
(``LLR``); their occurrences count once for each context (the words around), so that thousands of copies of one toxic
text teach no more than one. The log odds of a document's distinct words of this kind are summed, and a logistic rule on
that sum and the document's length gives the score; a document is toxic if it exceeds 0. The rule is fitted on at most
``LABELLED`` labelled documents, those with the least hash of doc_id; all else covers all documents and all their text.

Clean tokens have a single path through the lattice, so they are looked up by hash, vectorised; only tokens with traces
of the channel are decoded in Python, each distinct one once for a worker.

Defined results:

- NULL or empty text, text without words: the score of a text without evidence, not toxic. Very long texts are read whole.
- NULL doc_id: scored like any other; can't be a labelled example. Labels with NULLs are ignored; of contradictory
  labels of a document the larger counts.
- No labels, or no toxic ones: no features, nothing is toxic. Empty tables give an empty result.
- Ties (a score of exactly 0) are not toxic. Repeated rows give repeated results.
- Extra columns, whatever their names, pass ``drop_toxic`` untouched.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least_hash
from .textops import Filter, Words, chunks, frugal, held, lower, of_texts, raw, word_chunks, words

#: Labelled documents that the scoring rule is fitted on, at most.
LABELLED = 20_000
#: Log-likelihood ratio of a feature's association; chance exceeds it once in some 100,000 features.
LLR = 22.0
STEMS = (4, 5, 6)
#: Letters a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l"}
#: Log probabilities of the channel: a sign read as itself, as a letter; a repeated letter kept whole.
AS_SIGN, AS_LETTER, AS_IS = -6.0, -1.0, -2.0
#: Readings that a worker keeps at a time, besides those of the chunk at hand.
KEPT = 100_000
#: Signs of trigrams: 64 classes of bytes.
CLASSES = 64

_CLASS = np.zeros(256, np.int32)
for _b in range(256):
    if 97 <= _b <= 122:
        _CLASS[_b] = _b - 96
    elif 48 <= _b <= 57:
        _CLASS[_b] = 27
    elif _b >= 128:
        _CLASS[_b] = 28 + _b % 36
_SIGNS = re.escape("".join(LEET))
_ONE = rf"(?:[^\W\d_]|[{_SIGNS}])"
_SPACED = re.compile(rf"(?<!\w){_ONE}(?:([ .\-_*]){_ONE})(?:\1{_ONE})+(?!\w)")
_TRACE = re.compile(rf"[{_SIGNS}]|([^\W\d_])\1")
#: Signs of the channel: of one byte by that byte, the others as their bytes.
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET if c.isascii()]] = True
_WIDE = [c.encode() for c in LEET if not c.isascii()]
_DOUBLE = re.compile(r"(.)\1", re.S)
_BETWEEN = re.compile(rf"[^\w{_SIGNS}]+")
_NOISE = re.compile(r"([^\w\s])\1{2,}$|[!.,;:?)\]}'\"|(]+$")


# -- character model ------------------------------------------------------------------------------------------------


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for b in batches:
        data, off = raw(b.column(0))
        for x, y in chunks(off):
            c = _CLASS[lower(data[off[x] : off[y]])]
            if len(c) > 2:
                total += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["gram", "n"])


def char_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) of all documents, interpolated with bigrams and unigrams; CLASSES**3 numbers at most are
    collected, whatever the input."""
    counts = np.zeros(CLASSES**3)
    seen = docs.select("text").mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts[seen["gram"].to_numpy()] = seen["n"].to_numpy()
    c3 = counts.reshape(CLASSES, CLASSES, CLASSES)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + CLASSES)
    p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2[None]) / (c3.sum(2, keepdims=True) + 20)
    return np.log(p3)


# -- decoding -------------------------------------------------------------------------------------------------------


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """The readings of each sign or run of signs of a token in lower case, with their channel log probabilities."""
    out: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m.group(1), len(m.group())
        letters = LEET.get(c, "")
        if c.isalpha():
            # once, twice, or as written
            out.append([(c, 0.0)] if n == 1 else [(c, AS_LETTER), (c * 2, 0.0)] if n == 2 else [(c, AS_LETTER), (c * 2, AS_LETTER), (c * n, AS_IS)])
        elif letters:
            out.append([(x, AS_LETTER) for x in letters] + ([(x * 2, AS_LETTER) for x in letters] if n > 1 else []) + [(c * n, AS_SIGN * n)])
        else:
            out.append([("", AS_LETTER), (c * n, AS_SIGN)])
    return out


def _steps(token: str) -> list[list[tuple[str, float]]]:
    """The lattice, in which neighbours of a single reading are one step, and its end."""
    out: list[list[tuple[str, float]]] = []
    for options in [*lattice(token), [("\0", 0.0)]]:
        if len(options) == 1 and out and len(out[-1]) == 1:
            out[-1] = [(out[-1][0][0] + options[0][0], 0.0)]
        else:
            out.append(options)
    return out


_CLASSES_OF = [0, *_CLASS.tolist()[1:]]


class Decoder:
    def __init__(self, logp: np.ndarray):
        self.rows = logp.tolist()

    def decode(self, token: str) -> str:
        """The likeliest reading: Viterbi over the lattice; a state is the last two signs written."""
        rows, states = self.rows, {(0, 0): (0.0, "")}
        for options in _steps(token):
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for emit, cost in options:
                classes = [_CLASSES_OF[b] for b in emit.encode()]
                for (x, y), (s, text) in states.items():
                    s += cost
                    for k in classes:
                        s += rows[x][y][k]
                        x, y = y, k
                    if (x, y) not in new or s > new[x, y][0]:
                        new[x, y] = (s, text + emit)
            states = new
        return max(states.values())[1].rstrip("\0")

    def restore(self, token: str) -> str:
        """The reading of a token with traces of the channel; noise around it doesn't count."""
        core = _NOISE.sub("", token)
        if not _TRACE.search(core):
            return token
        # letters of which none is doubled have a single reading
        single = lambda x: x.isalpha() and not _DOUBLE.search(x)
        return " ".join(x if single(x) else self.decode(x) for x in _BETWEEN.split(core) if x)


def _signs(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last bytes of the channel's signs."""
    first = _SIGN[low]
    last = first.copy()
    for sign in _WIDE:
        at = np.flatnonzero(low[: len(low) - len(sign) + 1] == sign[0])
        for k, x in enumerate(sign):
            at = at[low[at + k] == x]
        first[at] = last[at + len(sign) - 1] = True
    return first, last


def _flags(w: Words, data: np.ndarray) -> np.ndarray:
    """Bytes at which a token shows traces of the channel: a sign beside a letter, or a second letter in a row."""
    low = w.low
    first, last = _signs(low)
    letter = ((low - np.uint8(97)) < 26) | (low >= 128)
    flag = np.zeros(len(low), bool)
    if len(low) > 1:
        flag[1:] |= first[1:] & letter[:-1]
        flag[:-1] |= last[:-1] & letter[1:]
        flag[1:] |= letter[1:] & (low[1:] == low[:-1]) & (low[1:] < 128)
        # a letter of two bytes
        flag[3:] |= (low[3:] == low[1:-2]) & (low[2:-1] == low[:-3]) & (low[2:-1] >= 0xC0)
    return flag


def noisy(data: np.ndarray, off: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end) of all tokens with traces of the channel."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    black = np.concatenate([[False], data > 32, [False]])
    starts, ends = np.flatnonzero(black[1:] & ~black[:-1]), np.flatnonzero(black[:-1] & ~black[1:])
    # a token ends with its text
    at = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    at = np.unique(at[black[at] & black[at + 1]])
    starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
    flagged = np.unique(np.searchsorted(starts, np.flatnonzero(_flags(w, data)), "right") - 1)
    start, end = starts[flagged], ends[flagged]
    return np.searchsorted(off, start, "right") - 1, start, end


def spelled(off: np.ndarray, w: Words) -> Iterator[tuple[int, str]]:
    """(text, token in lower case) of all words spelled one letter or sign at a time."""
    # three characters in a row with one between them
    lead = np.flatnonzero((w.low & 0xC0) != 0x80)
    low = w.low[lead]
    sign = _signs(w.low)[0][lead]
    one = ((low - np.uint8(97)) < 26) | (low >= 0xC0) | sign
    gap = np.isin(low, np.frombuffer(b" .-_*", np.uint8))
    wordy = ((low - np.uint8(97)) < 26) | ((low - np.uint8(48)) < 10) | (low == 95)
    run = one[:-4] & gap[1:-3] & one[2:-2] & (low[1:-3] == low[3:-1]) & one[4:] if len(low) > 4 else np.zeros(0, bool)
    run[1:] &= ~wordy[: len(run[1:])]
    run[:-1] &= ~wordy[5:]
    docs = np.unique(np.searchsorted(off, lead[:-4][run], "right") - 1) if run.any() else []
    for t in docs:
        for m in _SPACED.finditer(w.low[off[t] : off[t + 1]].tobytes().decode("utf-8", "ignore")):
            yield int(t), m.group().replace(m.group(1), "")


# -- scoring rule ---------------------------------------------------------------------------------------------------


@dataclass
class Rule:
    #: of the logistic rule: constant, sum of weights, log of the number of words
    coef: tuple[float, float, float] = (-20.0, 0.0, 0.0)
    #: hash of a word or stem (see ``features``) -> log odds
    weights: dict[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        keys = np.fromiter(self.weights, np.uint64, len(self.weights))
        self.filter = Filter(keys)
        self.values = np.array([self.weights[k] for k in self.filter.keys.tolist()])


def features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, hash) of all words and their stems; a stem's hash is set apart from a word's."""
    at = np.arange(len(w.hash))
    yield at, w.hash
    size = w.end - w.start
    for n in STEMS:
        # a stem ends at the beginning of a character
        ok = np.flatnonzero(size > n)
        ok = ok[(w.low[w.start[ok] + n] & 0xC0) != 0x80]
        yield ok, w.part(w.start[ok], w.start[ok] + n) * np.uint64(2 * n + 1)


def _examples(batches: Iterator[pd.DataFrame], keep: np.ndarray | None) -> Iterator[pd.DataFrame]:
    """Without keep: (feature, toxic, documents). With keep: (feature, toxic, context) of the features kept."""
    count = {0: Counter(), 1: Counter()}
    only = Filter(keep) if keep is not None else None
    for b in batches:
        toxic = b["toxic"].to_numpy()
        for a, _, w in word_chunks(pa.array(b["text"], pa.string())):
            text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
            around = np.zeros(len(w.hash), np.uint64)
            if len(w.hash):
                around[1:] += w.hash[:-1]
                around[:-1] += w.hash[1:] * np.uint64(3)
            for at, h in features(w):
                if only is not None:
                    hit = only.find(h)
                    yield pd.DataFrame({"feature": h[hit].view(np.int64), "toxic": toxic[a + text[at[hit]]].astype(np.int64), "n": around[at[hit]].view(np.int64)})
                    continue
                once = np.unique(of_texts(text[at], h), return_index=True)[1]
                label = toxic[a + text[at[once]]]
                for y in (0, 1):
                    count[y].update(h[once][label == y].tolist())
    if only is None:
        for y in (0, 1):
            keys = np.fromiter(count[y].keys(), np.uint64, len(count[y]))
            yield pd.DataFrame({"feature": keys.view(np.int64), "toxic": y, "n": np.fromiter(count[y].values(), np.int64, len(keys))})


def _llr(a, b, na, nb):
    """Log-likelihood ratio and log odds of a feature seen a times in na and b times in nb."""
    xlog = lambda x, y: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / y), 0)
    p = (a + b) / (na + nb)
    return 2 * (xlog(a, na * p) + xlog(b, nb * p)), np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients by Newton's method with a ridge penalty on all but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pen @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + pen + 1e-6 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return w


def fit(docs: DataFrame, labels: DataFrame, bound: int, logp: np.ndarray, scratch: Scratch) -> Rule:
    every = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = scratch.keep(least_hash(every, "doc_id", bound))  # at most ``bound`` rows, so that it can be broadcast
    texts = scratch.keep(docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")))
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Rule()
    schema = "feature long, toxic long, n long"
    split = lambda d: d.groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    p = (F.col("a") + F.col("b")) / (n1 + n0)
    part = lambda x, m: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / (m * p))).otherwise(0.0)
    likely = split(texts.mapInPandas(lambda it: _examples(it, None), schema)).filter((2 * (part("a", n1) + part("b", n0)) >= LLR) & (F.col("a") * n0 > 3 * F.col("b") * n1))
    keep = np.array([r["feature"] for r in likely.select("feature").collect()], np.int64).view(np.uint64)
    if not len(keep):
        return Rule()
    seen = split(texts.mapInPandas(lambda it: _examples(it, keep), schema).distinct().withColumn("n", F.lit(1))).toPandas()
    a, b = seen["a"].to_numpy(float), seen["b"].to_numpy(float)
    llr, odds = _llr(a, b, n1, n0)
    good = (llr >= LLR) & (odds > np.log(8))
    ids = seen["feature"].to_numpy(np.int64).view(np.uint64)
    rule = Rule(weights=dict(zip(ids[good].tolist(), odds[good].tolist())))
    if not rule.weights:
        return Rule()
    evidence = F.arrow_udf(_holder(texts.sparkSession.sparkContext.broadcast((rule, logp)), "evidence"), "struct<weight: double, words: double, restored: bigint>")
    x = texts.select(evidence("text").alias("e"), "toxic").select("e.weight", "e.words", "toxic").toPandas()
    rule.coef = tuple(_logistic(x[["weight", "words"]].to_numpy(float), x["toxic"].to_numpy(float)).tolist())
    return rule


# -- application ----------------------------------------------------------------------------------------------------


#: Results of tokens without weights, by whether they read differently; shared by all of them.
_PLAIN = ((False, None), (True, None))


class Scorer:
    def __init__(self, rule: Rule, logp: np.ndarray):
        self.rule, self.decoder = rule, Decoder(logp)
        self.seen: dict[int | str, tuple[bool, dict[int, float] | None]] = {}

    def hits(self, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, feature, weight) of the features found."""
        for at, h in features(w):
            hit = self.rule.filter.find(h)
            if len(hit):
                yield at[hit], h[hit], self.rule.values[np.searchsorted(self.rule.filter.keys, h[hit])]

    def weights(self, texts: list[str]) -> list[dict[int, float] | None]:
        """Weights of the strongest features of the distinct words of each text; None where there are none."""
        parts = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        w = words(np.frombuffer(b"".join(parts), np.uint8), off)
        best: list[dict[int, float] | None] = [None] * len(texts)
        for at, _, v in self.hits(w):
            for t, k, x in zip((np.searchsorted(w.first, at, "right") - 1).tolist(), w.hash[at].tolist(), v.tolist()):
                mine = best[t] = best[t] or {}
                mine[k] = max(x, mine.get(k, 0.0))
        return best

    def restored(self, tokens: dict[int | str, str]) -> dict[int | str, tuple[bool, dict[int, float] | None]]:
        """All readings kept, by key: whether a token reads differently, and the weights of its words; those of tokens
        (key -> token) are among them."""
        new = {k: t for k, t in tokens.items() if k not in self.seen}
        if new:
            read = [self.decoder.restore(t) for t in new.values()]
            for key, x, t, weights in zip(new, read, new.values(), self.weights(read)):
                self.seen[key] = _PLAIN[x != t] if weights is None else (x != t, weights)
        return self.seen

    def evidence(self, texts: pa.Array) -> pa.Array:
        """{weight, words, restored}: summed weights of the distinct words of a text after restoration, log of the
        number of words, tokens that were decoded to something else."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        total, size, changed = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        data, off = raw(texts)
        for a, b in chunks(off):
            part, cut = data[off[a] : off[b]], off[a : b + 1] - off[a]
            w = words(part, cut)
            size[a:b] = np.log1p(np.diff(w.first))
            found: dict[tuple[int, int], float] = {}
            for at, _, v in self.hits(w):
                for t, k, x in zip((np.searchsorted(w.first, at, "right") - 1).tolist(), w.hash[at].tolist(), v.tolist()):
                    found[t, k] = max(x, found.get((t, k), 0.0))
            where, start, end = noisy(part, cut, w)
            keys, first, which = np.unique(w.part(start, end), return_index=True, return_inverse=True)
            text = lambda i: w.low[start[i] : end[i]].tobytes().decode("utf-8", "ignore").strip()
            keys = keys.tolist()
            apart = list(spelled(cut, w))
            tokens = {k: text(i) for k, i in zip(keys, first.tolist()) if k not in self.seen} | {x: x for _, x in apart}
            if len(self.seen) + len(tokens) > KEPT:
                self.seen.clear()
                tokens |= {k: text(i) for k, i in zip(keys, first.tolist())}
            seen = self.restored(tokens)
            changed[a:b] += np.bincount(where[np.array([seen[k][0] for k in keys], bool)[which]], minlength=b - a)
            heavy = np.array([seen[k][1] is not None for k in keys], bool)[which]
            hits = [(t, keys[k]) for t, k in zip(where[heavy].tolist(), which[heavy].tolist())]
            for t, k in hits + apart:
                different, weights = seen[k]
                if isinstance(k, str):
                    changed[a + t] += different
                for k, x in (weights or {}).items():
                    found[t, k] = max(x, found.get((t, k), 0.0))
            for (t, _), x in found.items():
                total[a + t] += x
        return pa.StructArray.from_arrays([pa.array(total), pa.array(size), pa.array(changed)], names=["weight", "words", "restored"])

    def score(self, texts: pa.Array) -> pa.Array:
        """{score, toxic, restored}: log odds, decision, tokens that were decoded to something else."""
        e = self.evidence(texts)
        c, weight, size = self.rule.coef, e.field(0).to_numpy(False), e.field(1).to_numpy(False)
        s = c[0] + c[1] * weight + c[2] * size
        return pa.StructArray.from_arrays([pa.array(s), pa.array((s > 0) & (weight > 0)), e.field(2)], names=["score", "toxic", "restored"])


def scorer_of(key: str, shared) -> Scorer:
    """The scorer of a Python worker, kept from task to task until the worker is put to other use."""
    return held(("toxicity", key), lambda: Scorer(*shared.value))


def _holder(shared, method: str):
    key = uuid.uuid4().hex

    @frugal
    def run(texts: pa.Array) -> pa.Array:
        return getattr(scorer_of(key, shared), method)(texts)

    return run


_SCHEMA = "struct<score: double, toxic: boolean, restored: bigint>"


def scorer(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED):
    """A column function text -> {score, toxic, restored}."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxic")
    logp = char_model(docs)
    rule = fit(docs, labels, labelled, logp, scratch)
    return F.arrow_udf(_holder(spark.sparkContext.broadcast((rule, logp)), "score"), _SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, score, toxic, restored; a row for each row of docs."""
    s = scorer(docs, labels, labelled)
    return docs.select("doc_id", s("text").alias("s")).select("doc_id", "s.score", "s.toxic", "s.restored")


def drop_toxic(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """docs without the toxic ones; all columns."""
    return docs.filter(~scorer(docs, labels, labelled)(docs["text"])["toxic"])
