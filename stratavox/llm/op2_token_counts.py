"""Token counts under a unigram tokenizer, by dynamic programming over a trie of distinct pre-tokens.

A text is split at white space; each word, with the mark of a word's beginning before it, is a pre-token that pieces
never cross. The tokenization of a pre-token is its likeliest segmentation into pieces. Forward scores depend on
prefixes only: new distinct pre-tokens are walked in the order of a trie (sorted), each state of the forward pass is
computed once for a shared prefix, and the count at each terminal is stored. A worker keeps the counts of up to
``CACHED`` pre-tokens; a text's count is a sum of look-ups. No shuffle, nothing depends on other documents.

The pieces come from a SentencePiece model file, whose path is a parameter. Its scores are ranks, so a piece's log
probability follows Zipf's law: -log(rank + 1), in millionths and as an integer, so that ties are exact.

Defined results:

- NULL text: NULL counts. Empty or blank text: 0. Very long texts and words are counted whole.
- Ties of score: the segmentation with fewer tokens. A character that is no piece costs its UTF-8 bytes, a token each.
- Repeated rows give repeated results; empty tables an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = os.environ.get("STRATAVOX_UNIGRAM_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BEGIN = "▁"
CACHED = 500_000
TEXTS = 512
UNIT = 1_000_000


def pieces(path: str) -> tuple[dict[str, int], int]:
    """Piece -> score, and the score of a byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    rank = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return {p: -round(UNIT * math.log(i + 1)) for p, i in rank.items()}, -round(UNIT * math.log(n + 1))


class TrieCounter(dict):
    """Pre-token -> number of tokens."""

    def __init__(self, scores: dict[str, int], byte: int):
        super().__init__()
        self.byte, self.root = byte, {}
        for p, s in scores.items():
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = s
        #: Of the prefix being walked, by length: the last pre-token, best scores, counts, unfinished pieces.
        self.word, self.best, self.count, self.open = "", [0], [0], [[]]

    def add(self, word: str) -> int:
        """Walks to a pre-token from its common prefix with the one before."""
        best, count, live, root = self.best, self.count, self.open, self.root
        keep = 0
        for a, b in zip(word, self.word):
            if a != b:
                break
            keep += 1
        del best[keep + 1 :], count[keep + 1 :], live[keep + 1 :]
        for i in range(keep, len(word)):
            c, top, n, still = word[i], None, 0, []
            for start, node in [*live[i], (i, root)]:
                if (child := node.get(c)) is None:
                    continue
                still.append((start, child))
                if (s := child.get("")) is not None:
                    s, k = best[start] + s, count[start] + 1
                    if top is None or s > top or (s == top and k < n):
                        top, n = s, k
            if (one := root.get(c)) is None or "" not in one:
                b = len(c.encode())
                s, k = best[i] + b * self.byte, count[i] + b
                if top is None or s > top or (s == top and k < n):
                    top, n = s, k
            best.append(top)
            count.append(n)
            live.append(still)
        self.word = word
        return count[-1]

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        split = [t.split() for t in texts]
        if len(self) > CACHED:
            self.clear()
        for w in sorted({w for s in split for w in s if w not in self}):
            self[w] = self.add(BEGIN + w)
        return [(len(s), sum(map(self.__getitem__, s))) for s in split]


_counters: dict[str, TrieCounter] = {}


def counter(path: str) -> TrieCounter:
    if path not in _counters:
        _counters[path] = TrieCounter(*pieces(path))
    return _counters[path]


def _count(path: str):
    def run(texts: pa.Array) -> pa.Array:
        c = counter(path)
        out = []
        for k in range(0, len(texts), TEXTS):
            some = texts.slice(k, TEXTS).to_pylist()
            out += [(None, None) if t is None else x for t, x in zip(some, c.counts([t or "" for t in some]))]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_words, n_tokens; a row for each row of docs."""
    c = F.arrow_udf(_count(path), "struct<n_words: bigint, n_tokens: bigint>")
    return docs.select("doc_id", c("text").alias("c")).select("doc_id", "c.n_words", "c.n_tokens")
