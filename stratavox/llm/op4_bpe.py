"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every byte prefix of a piece has exactly one BPE encoding, hence a unique last token. ``Prefixes`` stores that token for
each prefix: token t ends prefix i if it matches there and BPE would not merge across its border with the last token of
prefix i - len(t) (``Vocabulary.compatible``); exactly one t does. Following last tokens back gives the encoding. Appending
bytes extends the table and never revises it; an edit needs the table only from the edit on, and only until two consistent
tables meet.

Texts are first split by the vocabulary's pattern into pieces that BPE never merges across. A Python worker encodes each
distinct piece once (sorted, so that neighbours share the table of their common prefix) and keeps its tokens as packed
bytes; a text is the concatenation of its pieces. The cache is emptied when it holds ``CACHED`` pieces. No shuffle.

The vocabulary is read from a file of ranks (base64 token and rank a line), whose path is a parameter; every executor
reads it once. It is not part of this package and nothing is trained.

Defined results:

- NULL text: NULL tokens. Empty text: no tokens. Very long texts and pieces are encoded whole (a piece's time is linear).
- Strings that look like special tokens are ordinary text. Text is UTF-8, as Spark holds it; decoding gives it back
  byte for byte, and ``round_trip`` says that it did.
- Repeated rows give repeated results; empty tables an empty result; extra columns are ignored by ``encode``.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import frugal, held

#: Where the vocabulary is, unless said otherwise.
RANKS = os.environ.get("STRATAVOX_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces that a worker keeps.
CACHED = 250_000
#: Pairs of tokens whose compatibility is kept.
PAIRS = 400_000
#: Texts encoded together.
TEXTS = 256


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, k in ranks.items():
            self.tokens[k] = t
        #: Token -> the two tokens whose merge makes it; a byte is its own halves.
        self.halves: list[tuple[int, int]] = [(k, k) for k in range(len(self.tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        for t, k in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1 and (ab := self._split(t, k)):
                self.halves[k] = ab
                self.merged[ab] = k
        self.reachable = [len(t) == 1 or self.halves[k] != (k, k) for k, t in enumerate(self.tokens)]
        self.trie = ahocorasick.Automaton()
        for t, k in ranks.items():
            if self.reachable[k]:
                self.trie.add_word(t.decode("latin-1"), k)
        self.trie.make_automaton()
        self.size = [len(t) for t in self.tokens]
        self.longest = max(self.size)
        self.fits: dict[int, bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last merge of a token: BPE of its bytes with merges of lower rank leaves two parts, or it isn't made."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= rank:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a then b gives exactly a, b. Undoes the merges on both sides of the border, the
        latest first; a merge across the border that would have come earlier rules the pair out."""
        known = self.fits.get(key := a * 1_000_003 + b)
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        merged, halves = self.merged, self.halves
        later = 1 << 60  # rank of the merge that was undone last; of equal ranks the left one comes first
        left_was = False
        while True:
            m = merged.get((a, b))
            if m is not None and (m < later or (m == later and not left_was)):
                return False
            if halves[a][1] == a and halves[b][0] == b:
                return True
            # a merge on the right happens after one of equal rank on the left
            if halves[b][0] == b or (halves[a][1] != a and a > b):
                later, left_was, a = a, True, halves[a][1]
            else:
                later, left_was, b = b, False, halves[b][0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The unique last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [0]
        self.append(data)

    def _extend(self, data: bytes, keep: int, old: list[int] | None = None, shift: int = 0) -> None:
        """Fills the table from prefix ``keep`` on. With ``old``, a table of a string that ends as this one does,
        ``shift`` bytes displaced, it stops as soon as the rest must be equal."""
        v, last = self.v, self.last
        del last[keep + 1 :]
        last += [-1] * (len(data) - keep)
        longest, equal = v.longest, 0
        start = max(0, keep - longest)
        size, fits = v.size, v.compatible
        for end, t in v.trie.iter(data[start:].decode("latin-1")):
            i = start + end + 1
            if i <= keep:
                continue
            if old is not None and equal > longest and last[i - 1] >= 0:
                last[i:] = old[i - shift :]
                break
            if last[i] < 0:
                j = i - size[t]
                if j == 0 or fits(last[j], t):
                    last[i] = t
                    equal = equal + 1 if old is not None and 0 < i - shift < len(old) and old[i - shift] == t and i > self._same else 0
        self.data = data

    _same = 0

    def append(self, data: bytes) -> None:
        self._extend(self.data + data, len(self.data))

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Replaces bytes start..end; prefixes before the edit stand, and after it only as many are worked out as differ."""
        old, new = self.last[:], self.data[:start] + data + self.data[end:]
        self._same = start + len(data)
        self._extend(new, start, old, len(data) - (end - start))

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        i, out = len(self.data) if end is None else end, []
        while i > 0:
            out.append(self.last[i])
            i -= self.v.size[self.last[i]]
        return out[::-1]


class Encoder(dict):
    """Piece -> its tokens, packed as 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        super().__init__()
        self.v, self.pattern, self.table = vocabulary, regex.compile(pattern), Prefixes(vocabulary)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        k = self.v.ranks.get(data)
        if k is not None and self.v.reachable[k]:
            out = np.array([k], np.int32).tobytes()
        else:
            old = self.table.data
            n = len(os.path.commonprefix([old, data]))
            self.table._extend(data, n)
            out = np.array(self.table.tokens(), np.int32).tobytes()
        self[piece] = out
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(t) for t in texts]
        if len(self) > CACHED:
            self.clear()
        for piece in sorted({p for s in split for p in s if p not in self}):
            self[piece]
        return [b"".join(map(self.__getitem__, s)) for s in split]


def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    """The encoder of a Python worker, kept from task to task until the worker is put to other use."""
    return held(("bpe", path, pattern), lambda: Encoder(Vocabulary.read(path), pattern))


_SCHEMA = "struct<tokens: array<int>, n_tokens: bigint, round_trip: boolean>"


def _encode(path: str, pattern: str):
    @frugal
    def run(texts: pa.Array) -> pa.Array:
        enc = encoder(path, pattern)
        packed: list[bytes] = []
        same: list[bool | None] = []
        for k in range(0, len(texts), TEXTS):
            some: list[str | None] = texts.slice(k, TEXTS).to_pylist()
            for text, ids in zip(some, enc.encode([t or "" for t in some])):
                packed.append(ids)
                same.append(None if text is None else enc.v.decode(memoryview(ids).cast("i")) == text.encode())
        off = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        flat = pa.Array.from_buffers(pa.int32(), int(off[-1]), [None, pa.py_buffer(b"".join(packed))])
        null = pa.array([s is None for s in same], pa.bool_())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(off), flat, mask=null), pa.array([None if s is None else len(p) // 4 for s, p in zip(same, packed)], pa.int64()), pa.array(same, pa.bool_())],
            names=["tokens", "n_tokens", "round_trip"],
        )

    return run


def encode(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, tokens, n_tokens, round_trip (decoding gave the text back); a row for each row of docs."""
    e = F.arrow_udf(_encode(path, pattern), _SCHEMA)
    return docs.select("doc_id", e("text").alias("e")).select("doc_id", "e.tokens", "e.n_tokens", "e.round_trip")


def _decode(path: str):
    @frugal
    def run(tokens: pa.Array) -> pa.Array:
        v = encoder(path).v
        return pa.array([None if t is None else v.decode(t) for t in tokens.to_pylist()], pa.binary())

    return run


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, text of encoded documents (doc_id, tokens). NULL tokens give NULL text."""
    return encoded.select("doc_id", F.arrow_udf(_decode(path), "binary")("tokens").cast("string").alias("text"))
