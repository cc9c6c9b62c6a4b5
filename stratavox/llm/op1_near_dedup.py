"""Near-duplicate removal with SetSketch.

A document is the set of its word 3-grams. Its sketch has ``M`` registers; register i holds the exponentially spaced,
truncated minimum of the set's i-th exponential hash, ``clip(floor(1 - log_b(min / A)), 0, Q + 1)``. Registers merge by
maximum and agree the more often the more alike the sets are.

1. Documents with the same words in the same order form a class; its least doc_id stands for it in all that follows, so
   that copies are never paired.
2. Banding: ``BANDS`` bands of ``ROWS`` registers. In each bucket every document is paired with the least doc_id of
   the bucket, so that a bucket of any size costs its length, not its square.
3. The joint likelihood of the two sketches gives an estimate of the Jaccard similarity; pairs that can't reach the
   threshold (``SLACK`` standard errors) go. The rest is verified on the exact 3-gram sets, and verified pairs are closed
   to components.
4. A bucket that still holds more than one component has pairs not yet tried. The sketches of its documents are compared
   there and then, and only pairs that agree in enough registers leave the task; they are estimated and verified like
   the others, and components are closed again. Buckets are cut into blocks of some ``BLOCK`` documents: those of the
   bucket's largest component on one side, of all others on the other, so that a bucket of one large component and a few
   strangers costs its length, and no task ever holds more than two blocks. Pairs within a component can't change the
   result. So nothing is capped, and every pair that shares a bucket is either compared or immaterial.

A pair at the threshold shares a bucket with probability 1 - (1 - t**ROWS)**BANDS: 0.92 at 0.5, 0.98 at 0.55, 0.997 at 0.6.

Defined results:

- NULL doc_id, NULL text, or a text without words: like nothing else; kept, its own group.
- Fewer than three words: the set has one member, all the words. Very long texts are sketched whole.
- Case and punctuation don't count, in any script; in scripts without spaces each character is a word. Texts equal but
  for these are near copies.
- Ties: the least doc_id of a group is kept. Rows with one doc_id are one document: one of them is kept
  (``drop_near_copies``: the first in the order of all columns).
- An empty table gives an empty result. Extra columns, whatever their names, pass ``drop_near_copies`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, one_of_each, only, sized, without
from .textops import frugal, give_back, mix, release, word_chunks

THRESHOLD = 0.5
ROWS, BANDS = 4, 40
M = ROWS * BANDS
#: Base of the register scale, rate of the exponentials, largest register.
BASE, RATE, Q = 1.02, 20.0, 4094
#: Standard errors by which an estimate may fall short of the threshold before a pair is dropped unverified.
SLACK = 3.0
#: Documents in one block of a bucket.
BLOCK = 1024
#: Pairs that a task compares, and rows that it gathers, at once.
PAIRS, GATHERED = 200_000, 20_000

_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 32, M, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_C = _rng.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def shingles(texts: pa.Array):
    """Runs of documents as (first document, hashes of their word 3-grams, offsets of each document's)."""
    for a, _, w in word_chunks(texts):
        h, first = w.hash, w.first
        end = np.repeat(first[1:], np.diff(first))
        at = np.arange(len(h))
        one, two = np.append(h[1:], np.uint64(0))[: len(h)], np.append(h[2:], np.zeros(2, np.uint64))[: len(h)]
        s = h * np.uint64(0x9E3779B97F4A7C15) + np.where(at + 1 < end, one, 0) * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(at + 2 < end, two, 0) * np.uint64(0x165667B19E3779F9)
        lead = np.zeros(len(h), bool)
        lead[first[:-1][np.diff(first) > 0]] = True
        valid = (at + 2 < end) | lead
        s = mix(s[valid])
        count = np.concatenate([[0], np.cumsum(valid)])
        yield a, s, count[first]


def registers(minima: np.ndarray) -> np.ndarray:
    """Registers from minimal 32-bit hashes: -log(1 - u) of a uniform u is exponential, and the minimum goes along."""
    x = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Registers (documents x M), whether a document has any word, and a digest of its words in their order."""
    regs, some, digest = np.zeros((len(texts), M), np.uint16), np.zeros(len(texts), bool), np.zeros(len(texts), np.uint64)
    for a, s, first in shingles(texts):
        full = np.flatnonzero(np.diff(first))
        if not len(full):
            continue
        low = np.empty((M, len(full)), np.uint32)
        at = first[full]
        place = np.arange(len(s)) - np.repeat(first[:-1], np.diff(first))
        digest[a + full] = np.add.reduceat(mix(s + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at)
        s = (s >> np.uint64(32)).astype(np.uint32)
        for k in range(M):
            low[k] = np.minimum.reduceat(s * _A[k] + _C[k], at)
        regs[a + full], some[a + full] = registers(low).T, True
    return regs, some, digest


def _fixed(rows: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """A binary array of equally long rows of bytes."""
    rows = np.ascontiguousarray(rows).view(np.uint8)
    size = np.full(len(rows), rows.shape[1]) if there is None else there * rows.shape[1]
    data = rows if there is None else rows[there]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


@frugal
def _sketch(texts: pa.Array) -> pa.Array:
    """{digest, regs}; regs is empty for a document without words."""
    release()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    regs, some, digest = sketches(texts)
    return pa.StructArray.from_arrays([pa.array(digest.view(np.int64)), _fixed(regs, some)], names=["digest", "regs"])


def _matrix(x: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), kind).reshape(-1, width)


@frugal
def _bands(regs: pa.Array) -> pa.Array:
    if isinstance(regs, pa.ChunkedArray):
        regs = regs.combine_chunks()
    four = _matrix(regs, np.uint16, M).reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = mix((four[..., 0] | four[..., 1] << np.uint64(16) | four[..., 2] << np.uint64(32) | four[..., 3] << np.uint64(48)) ^ _BAND)
    return pa.ListArray.from_arrays(pa.array((np.arange(len(regs) + 1) * BANDS).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))


@frugal
def _signature(regs: pa.Array) -> pa.Array:
    """The low bytes of the registers; they differ by less than 256 wherever they matter."""
    return _fixed((_matrix(regs, np.uint16, M) & 255).astype(np.uint8))


@frugal
def _sets(texts: pa.Array) -> pa.Array:
    release()
    parts = []
    for _, s, first in shingles(texts):
        parts += [np.unique(s[x:y]) for x, y in zip(first[:-1], first[1:])]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs of sketches (pairs x M each): joint in the counts of registers
    in which x exceeds, y exceeds and both agree, with the cardinalities that the registers themselves give."""
    power = np.power(BASE, -np.arange(Q + 2, dtype=np.float64))
    nx, ny = 1 / power[x].sum(1), 1 / power[y].sum(1)
    u, v = nx / (nx + ny), ny / (nx + ny)
    more, less = (x > y).sum(1), (x < y).sum(1)
    same = M - more - less
    p = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(a + tiny) + less * np.log(b + tiny) + same * np.log(np.maximum(1 - a - b, tiny))

    lo, hi = np.zeros(len(x)), np.minimum(u / v, v / u)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(30):  # golden section; the likelihood is unimodal
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = fit(c) > fit(d)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2


@frugal
def _estimate(x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array(estimate(_matrix(x, np.uint16, M), _matrix(y, np.uint16, M)) if len(x) else np.zeros(0))


def _least(threshold: float) -> float:
    return max(0.0, threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / M)))


def compared(group: np.ndarray, comp: np.ndarray, block: np.ndarray, doc: np.ndarray, sig: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents of a group (rows are sorted by group, then component), of different components and, in a group
    of two blocks, of different blocks, that agree in at least so many registers."""
    n = len(group)
    new = np.append(True, group[1:] != group[:-1])
    start = np.flatnonzero(new)
    end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    run = np.flatnonzero(new | np.append(True, comp[1:] != comp[:-1]))
    after = np.repeat(np.append(run[1:], n), np.diff(np.append(run, n)))  # where the next component begins
    one = np.minimum.reduceat(block, start) == np.maximum.reduceat(block, start)
    one = np.repeat(one, np.diff(np.append(start, n)))
    many = end - after
    edges = np.concatenate([[0], np.cumsum(many)])
    k = 0
    while k < n:
        e = max(k + 1, int(np.searchsorted(edges, edges[k] + PAIRS, "right")) - 1)
        m = many[k:e]
        x = np.repeat(np.arange(k, e), m)
        y = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(after[k:e], m)
        ok = one[x] | (block[x] != block[y])
        x, y = x[ok], y[ok]
        ok = (sig[x] == sig[y]).sum(1) >= least
        x, y = doc[x[ok]], doc[y[ok]]
        yield np.minimum(x, y), np.maximum(x, y)
        k = e


def _compare(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def columns(rows: pa.Table) -> tuple[np.ndarray, ...]:
            key, lo, hi = (rows[c].to_numpy() for c in ("key", "lo", "hi"))
            new = np.append(True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            return np.cumsum(new), rows["comp"].to_numpy(), rows["block"].to_numpy(), rows["doc_id"].to_numpy()

        def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for x, y in compared(*columns(rows), _matrix(rows["sig"], np.uint8, M), least):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size > GATHERED:
                rows = pa.Table.from_batches(held)
                group = columns(rows)[0]
                whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if whole:
                    yield from settle(rows.slice(0, whole))
                held, size = rows.slice(whole).to_batches(), len(group) - whole
        if held:
            yield from settle(pa.Table.from_batches(held))
        del held
        give_back()

    return run


def untried(shared: DataFrame, comp: DataFrame, sketch: DataFrame, threshold: float, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Pairs (x, y) of documents of different components that share a bucket and whose sketches are alike enough.
    shared: key, doc_id of all buckets of several documents."""
    named = scratch.keep(shared.join(comp, "doc_id", "left").select("key", "doc_id", F.coalesce("comp", "doc_id").alias("comp")))
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("big"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    mixed = sizes.filter(F.col("big.n") < F.col("n")).select("key", F.col("big.comp").alias("big"), blocks(F.col("big.n")).alias("nb"), blocks(F.col("n") - F.col("big.n")).alias("ns"))
    mixed = scratch.keep(mixed)
    h, big = F.xxhash64("doc_id"), F.col("comp") == F.col("big")
    own = F.when(big, F.col("ns") + F.pmod(h, F.col("nb"))).otherwise(F.pmod(h, F.col("ns"))).cast("int")
    members = named.join(sized(mixed), "key").select("key", "doc_id", "comp", own.alias("block"), F.when(big, F.col("ns")).otherwise(F.col("ns") + F.col("nb")).alias("cells"))
    regs = sketch.select("doc_id", F.arrow_udf(_signature, "binary")("regs").alias("sig"))
    cells = members.join(regs, "doc_id").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cells = cells.select("key", F.least("block", "cell").alias("lo"), F.greatest("block", "cell").alias("hi"), "comp", "block", "doc_id", "sig")
    cells = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "comp")
    return scratch.keep(cells.mapInArrow(_compare(int(np.floor(M * _least(threshold)))), "x long, y long").filter("x < y").distinct())


def verified(pairs: DataFrame, sketch: DataFrame, docs: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (x, y) whose exact similarity reaches the threshold."""
    est = F.arrow_udf(_estimate, "double")
    regs = sketch.select("doc_id", "regs")
    near = (
        pairs.join(regs.withColumnsRenamed({"doc_id": "x", "regs": "rx"}), "x")
        .join(regs.withColumnsRenamed({"doc_id": "y", "regs": "ry"}), "y")
        .select("x", "y", est("rx", "ry").alias("j"))
        .filter(F.col("j") >= _least(threshold))
        .select("x", "y")
    )
    near = scratch.keep(near)
    ids = scratch.keep(near.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct())
    sets = scratch.keep(only(docs.select("doc_id", "text"), ids).select("doc_id", F.arrow_udf(_sets, "array<bigint>")("text").alias("set")))
    both = near.join(sets.withColumnsRenamed({"doc_id": "x", "set": "sx"}), "x").join(sets.withColumnsRenamed({"doc_id": "y", "set": "sy"}), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    out = scratch.keep(both.filter(common >= threshold * (F.size("sx") + F.size("sy") - common)).select("x", "y").distinct())
    for x in (near, ids, sets):
        scratch.drop(x)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, comp (the least doc_id of its component), of every document of an edge (x, y). Labels sink to the least
    neighbour, then jump to their label's label; a component of diameter d takes about log2(d) rounds."""
    both = scratch.keep(edges.union(edges.select("y", "x")).toDF("doc_id", "to"))
    label = scratch.keep(both.groupBy("doc_id").agg(F.least(F.min("to"), F.col("doc_id")).alias("comp")))
    while True:
        seen = both.join(label.withColumnsRenamed({"doc_id": "to"}), "to").groupBy("doc_id").agg(F.min("comp").alias("near"))
        low = label.join(seen, "doc_id").select("doc_id", "comp", F.least("comp", "near").alias("low"))
        jump = label.select(F.col("doc_id").alias("low"), F.col("comp").alias("far"))
        after = scratch.keep(low.join(jump, "low", "left").select("doc_id", F.least("low", "far").alias("comp"), (F.least("low", "far") < F.col("comp")).alias("moved")))
        done = after.filter("moved").isEmpty()
        scratch.drop(label)
        label = after
        if done:
            return label.select("doc_id", "comp")


def groups(docs: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """comp: (doc_id, comp) of every document that has a near copy, comp being the least doc_id of its group; the
    verified pairs (x, y) that make the groups; and (doc_id, rid) of all rows of docs."""
    scratch = scratch or Scratch(docs.sparkSession, "near")
    docs = docs.select("doc_id", "text")
    made = F.arrow_udf(_sketch, "struct<digest: bigint, regs: binary>")("text")
    every = scratch.keep(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), made.alias("s")).select("doc_id", "rid", "s.digest", "s.regs"))
    rows = every.select("doc_id", "rid")
    sketch = every.filter(F.col("doc_id").isNotNull() & (F.length("regs") > 0))
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # classes of equal sequences of words
    twins = scratch.keep(sketch.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last").select("digest", "rep"))
    in_class = sketch.select("doc_id", "digest", "regs").join(sized(twins), "digest", "left")
    same = scratch.keep(in_class.filter("rep < doc_id").select(F.col("rep").alias("x"), F.col("doc_id").alias("y")).distinct())
    heads = in_class.filter("rep IS NULL OR rep = doc_id")
    bands = heads.select("doc_id", F.explode(F.arrow_udf(_bands, "array<bigint>")("regs")).alias("key"))
    # no window: a hot bucket is summed map-side, and its members needn't meet in one task
    full = bands.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last").select("key", "least")
    full = scratch.keep(full)
    shared = scratch.keep(bands.join(sized(full), "key").select("key", "doc_id", "least"))
    star = scratch.keep(shared.filter("doc_id > least").select(F.col("least").alias("x"), F.col("doc_id").alias("y")).distinct())
    edges = scratch.keep(verified(star, sketch, docs, threshold, scratch).unionByName(same))
    comp = components(edges, scratch)
    cross = scratch.keep(untried(shared.select("key", "doc_id"), comp, sketch, threshold, scratch).join(star, ["x", "y"], "left_anti"))
    for x in (shared, star, full):
        scratch.drop(x)
    if not cross.isEmpty():
        more = verified(cross, sketch, docs, threshold, scratch)
        if not more.isEmpty():
            edges = scratch.keep(edges.unionByName(more))
            comp = components(edges, scratch)
    return comp, edges, rows


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, group_id (the document that stays for the group), kept, links (verified pairs of the document: with its
    class's head, with the least document of a bucket, or between groups that became one); a row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "near")
    comp, edges, rows = groups(docs, threshold, scratch)
    links = edges.select(F.explode(F.array("x", "y")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("links"))
    known = scratch.keep(comp.join(links, "doc_id", "left"))
    again = scratch.keep(rows.groupBy("doc_id").agg(F.min("rid").alias("first"), F.count("*").alias("n")).filter("doc_id IS NOT NULL AND n > 1").select("doc_id", "first"))
    out = rows.join(sized(known), "doc_id", "left").join(sized(again), "doc_id", "left")
    group = F.coalesce("comp", "doc_id")
    kept = F.col("doc_id").isNull() | ((group == F.col("doc_id")) & F.coalesce(F.col("rid") == F.col("first"), F.lit(True)))
    return out.select("doc_id", group.alias("group_id"), kept.alias("kept"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group; all columns."""
    scratch = Scratch(docs.sparkSession, "near")
    comp, _, rows = groups(docs, threshold, scratch)
    again = scratch.keep(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id IS NOT NULL AND n > 1").select("doc_id"))
    gone = scratch.keep(comp.filter("comp < doc_id").select("doc_id"))
    out = without(docs, gone)
    if again.isEmpty():
        return out
    return without(out, again).unionByName(one_of_each(only(out, again), docs["doc_id"]))
