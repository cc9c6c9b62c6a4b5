"""Vectorised text primitives over Arrow string buffers: no Python object per word or character."""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from functools import cache, wraps

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the working memory of a worker. A longer text is a chunk by itself.
CHUNK = 1 << 18

_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """What make() gives, kept in a Python worker from task to task until another key is asked for: a worker that runs one
    stage after another keeps the tables of one of them."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drops what an earlier stage has left in this worker."""
    _held.clear()


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Returns memory that is free to the system: workers wait for their next task, and those of an executor add up."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def frugal(f: Callable) -> Callable:
    """f, each call of which gives free memory back."""

    @wraps(f)
    def run(*args):
        try:
            return f(*args)
        finally:
            give_back()

    return run


_B = 0x9E3779B97F4A7C15 | 1
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_B**i and _B**-i modulo 2**64 for i <= n."""
    if len(_pow[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        for k, base in enumerate((_B, pow(_B, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and each text's offset in them. A null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bufs, n = texts.buffers(), len(texts)
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


#: Scripts that are written without spaces: each of their characters is a word.
SOLO = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3040, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
#: Kinds of characters: part of a word; a mark, which never begins a word of a script without spaces; a word by itself.
PART, MARK, ALONE, ALONE_MARK = 1, 2, 3, 4


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind of every code point (0: between words), and its lower case where that takes as many bytes."""
    kind, small = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in [*range(0x80, 0x20000), *range(0xE0100, 0xE01F0)]:
        x = chr(c)
        group = unicodedata.category(x)
        if group[0] in "LN":
            kind[c] = PART
        elif group[0] == "M" or c in (0x200C, 0x200D):
            kind[c] = MARK
        if group[0] == "L" or group in ("Nl", "So"):
            y = x.lower()
            if len(y) == 1 and len(y.encode()) == len(x.encode()):
                small[c] = ord(y)
    small[0x3C2] = 0x3C3  # the two small forms of one Greek letter
    kind[0x20000:0x40000] = PART
    for a, b in SOLO:
        part = kind[a : b + 1]
        kind[a : b + 1] = np.where(part == PART, ALONE, np.where(part == MARK, ALONE_MARK, part))
    return kind, small


def _decoded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the characters beyond ASCII begin, their bytes, and their code points. data is valid UTF-8."""
    at = np.flatnonzero(data >= 0xC0)
    b = data[at].astype(np.uint32)
    size = np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, 4))
    code = np.where(size == 2, b & 31, np.where(size == 3, b & 15, b & 7))
    for k in (1, 2, 3):
        more = size > k
        code[more] = code[more] << np.uint32(6) | (data[at[more] + k] & np.uint8(63))
    return at, size, code


def _lowered(data: np.ndarray, at: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    low = data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)
    if len(at):
        small = _characters()[1][code]
        big = np.flatnonzero(small != code)
        at, size, small = at[big], size[big], small[big]
        for k in range(4):  # the last byte first
            more = size > k
            first = np.where(size == 2, 0xC0, np.where(size == 3, 0xE0, 0xF0))[more]
            x = small[more]
            low[at[more] + size[more] - 1 - k] = np.where(size[more] == k + 1, first | x, 0x80 | (x & 63))
            small = small >> np.uint32(6)
    return low


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case, in all scripts; but for the few letters whose small form takes another number of bytes."""
    return _lowered(data, *_decoded(data))


@dataclass
class Words:
    """Words of a run of texts, in lower case: maximal runs of letters, digits and marks of any script; in scripts
    without spaces each character (with its marks) is a word."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  #: index of each text's first word, and the number of words at the end
    prefix: np.ndarray  #: prefix sums of the polynomial hash
    low: np.ndarray

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self.prefix[end] - self.prefix[start]) * _powers(len(self.low))[1][start])


def words(data: np.ndarray, off: np.ndarray) -> Words:
    n = len(data)
    isw = (((data | np.uint8(32)) - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10)
    at, size, code = _decoded(data)
    cut = np.zeros(n + 1, bool)  # where a word begins though the byte before belongs to one
    cut[off] = True
    if len(at):
        kind = _characters()[0][code]
        for k in range(4):
            isw[at[size > k] + k] = kind[size > k] > 0
        cut[at[kind == ALONE]] = True
        alone = (kind == ALONE) | (kind == ALONE_MARK)
        after = at[alone] + size[alone]
        mark = np.zeros(n + 1, bool)
        mark[at[(kind == MARK) | (kind == ALONE_MARK)]] = True
        cut[after[~mark[after]]] = True
    begin, stop = isw.copy(), isw.copy()
    begin[1:] &= ~isw[:-1] | cut[1:-1]
    stop[:-1] &= ~isw[1:] | cut[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    low = _lowered(data, at, size, code)
    up, _ = _powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    w = Words(np.zeros(0, np.uint64), start, end, np.searchsorted(start, off), prefix, low)
    w.hash = w.part(start, end)
    return w


def word_chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    data, off = raw(texts)
    for a, b in chunks(off, size):
        yield a, b, words(data[off[a] : off[b]], off[a : b + 1] - off[a])


def hash_word(word: str) -> int:
    """The hash that ``words`` gives to this word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(words(b, np.array([0, len(b)])).hash[0])


def of_texts(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """64-bit keys of hashes within their texts."""
    return mix(h ^ mix(text.astype(np.uint64) + np.uint64(1)))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over values[first[i]:first[i + 1]], 0 for empty ranges."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


class Filter:
    """Membership of 64-bit hashes in a small set: a bitmap on the top bits, then an exact search."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys = np.unique(np.asarray(keys, np.uint64))
        self.shift = np.uint64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Indices of the members among h."""
        at = np.flatnonzero(self.map[(h >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0]
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        return at[self.keys[k] == h[at]]
