"""Pairs of neighbouring characters, by numbers: in a Python worker a text costs about as much as sorting its characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold() -> np.ndarray:
    """What ``text.flat`` makes of each code point, 0 where it leaves it out. Beyond A-Z
    only İ and the sign for kelvin have a kept character in their small letters."""
    to = np.zeros(0x110000, np.uint32)
    for a, b in ("09", "az", "가힣"):
        to[ord(a) : ord(b) + 1] = np.arange(ord(a), ord(b) + 1)
    to[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    to[0x130], to[0x212A] = ord("i"), ord("k")
    return to


_FOLD = _fold()


def codes(text: bytes | None) -> np.ndarray:
    """The distinct pairs of a text in UTF-8, in the order of their characters, each as a number of 32 bits."""
    points = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    kept = _FOLD[points]
    kept = kept[kept > 0]
    return np.unique(kept[:-1] << 16 | kept[1:])


def _bigrams(texts: pa.Array) -> pa.Array:
    found = [codes(x.as_py()) for x in texts]
    flat = np.concatenate([np.zeros(0, np.uint32), *found])
    strings = np.ascontiguousarray(np.stack([flat >> 16, flat & 0xFFFF], axis=1).astype("<u4")).view("<U2").ravel()
    at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(strings, pa.string()))


def bigrams(c: Column) -> Column:
    """``text.bigrams`` in the order of their characters."""
    return F.arrow_udf(_bigrams, "array<string>")(c.cast("binary"))
