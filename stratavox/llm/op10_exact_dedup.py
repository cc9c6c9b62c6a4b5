"""Exact deduplication with a heavy-hitter split.

Every text is reduced to its SHA-256 digest. A Misra-Gries summary per partition, merged over partitions, names every
digest that more than one row in ``HEAVY`` carries; an exact count verifies them. Their winners (at most ``HEAVY`` of
them, whatever the input) are broadcast and their copies removed map-side, so that a text repeated millions of times
never lands on one reducer. All remaining digests are shuffled as usual.

Defined results:

- NULL text or NULL doc_id: nothing to compare or to name; the row is kept and is its own keeper.
- Empty and very long texts are texts like others: equal ones are copies.
- Ties: the row with the least doc_id is kept; of rows that repeat a doc_id with the same text, one.
- One doc_id with different texts: different documents.
- An empty table gives an empty result. Extra columns, whatever their names, pass ``drop_copies`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, one_of_each, sized

#: A digest is a heavy hitter if more than one row in so many carries it.
HEAVY = 4096
#: Counters of a summary. The merged error is at most rows / COUNTERS, well under rows / HEAVY.
COUNTERS = 4 * HEAVY


class MisraGries:
    """Mergeable frequent-items summary: counts are low by at most ``error``."""

    def __init__(self, counters: int):
        self.counters, self.error = counters, 0
        self.counts = pd.Series(dtype=np.int64)

    def add(self, counts: pd.Series) -> None:
        total = self.counts.add(counts, fill_value=0).astype(np.int64)
        if len(total) > self.counters:
            cut = int(np.partition(total.to_numpy(), len(total) - self.counters - 1)[len(total) - self.counters - 1])
            total = total[total > cut] - cut
            self.error += cut
        self.counts = total

    def update(self, keys: pd.Series) -> None:
        self.add(keys.value_counts())


def _summaries(counters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summary = MisraGries(counters)
        for b in batches:
            summary.update(b["key"])
        yield pd.DataFrame({"key": summary.counts.index.to_numpy(np.int64), "n": summary.counts.to_numpy(np.int64)})

    return run


def heavy_hitters(digests: DataFrame, rows: int, heavy: int, counters: int) -> DataFrame:
    """(digest, least (doc_id, rid) as win) of every digest that over rows / heavy rows carry. digests: digest, key,
    doc_id, rid, key being 64 bits of the digest."""
    least = rows / heavy - rows / counters  # a heavy digest keeps at least so much of its count in the merged summary
    few = digests.select("key").mapInPandas(_summaries(counters), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > least).select("key")
    # at most 4/3 * heavy keys can pass, whatever the number of rows
    return digests.join(F.broadcast(few), "key").groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid")).alias("win")).filter(F.col("n") > rows / heavy).select("digest", "win")


def decide(docs: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, keeper_id, kept, and h (64 bits of the text), a row for each row of docs with a doc_id and a text."""
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    digests = scratch.keep(
        docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select("doc_id", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), F.xxhash64("text").alias("h"))
        .select("*", F.xxhash64("digest").alias("key"), F.monotonically_increasing_id().alias("rid"))
    )
    winners = scratch.keep(heavy_hitters(digests, digests.count(), heavy, counters))
    marked = digests.join(F.broadcast(winners), "digest", "left")
    frequent = marked.filter(F.col("win").isNotNull()).select("doc_id", F.col("win.doc_id").alias("keeper_id"), (F.col("rid") == F.col("win.rid")).alias("kept"), "h")
    same = Window.partitionBy("digest").orderBy("doc_id", "rid")
    rest = marked.filter(F.col("win").isNull()).select("doc_id", F.first("doc_id").over(same).alias("keeper_id"), (F.row_number().over(same) == 1).alias("kept"), "h")
    return frequent.unionByName(rest)


def exact_duplicates(docs: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keeper_id (the document that stays for it), kept; a row for each row of docs."""
    docs = docs.select("doc_id", "text")
    alone = docs.filter(F.col("doc_id").isNull() | F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("keeper_id"), F.lit(True).alias("kept"))
    return decide(docs, heavy, counters).drop("h").unionByName(alone)


def drop_copies(docs: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """docs with one row for each text; all columns."""
    scratch = Scratch(docs.sparkSession, "exact")
    fate = scratch.keep(decide(docs, heavy, counters, scratch).groupBy("doc_id", "h").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")))
    i, h = fresh(docs.columns, "copy_id", "copy_hash")
    named = lambda d: sized(d.select(F.col("doc_id").alias(i), F.col("h").alias(h)))
    match = lambda d: (docs["doc_id"] == d[i]) & (F.xxhash64(docs["text"]) == d[h])
    gone = named(fate.filter((F.col("kept") == 0) | (F.col("n") > 1)))
    out = docs.join(gone, match(gone), "left_anti")
    again = fate.filter((F.col("kept") > 0) & (F.col("n") > 1))
    if again.isEmpty():
        return out
    again = named(again)
    return out.unionByName(one_of_each(docs.join(again, match(again), "left_semi"), docs["doc_id"], docs["text"]))


ORACLE_SQL = """
SELECT doc_id,
       CASE WHEN text IS NULL OR doc_id IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keeper_id,
       text IS NULL OR doc_id IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS kept
FROM documents
"""
