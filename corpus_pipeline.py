"""A corpus pipeline of the training-data operators, each stage on what its predecessor kept.

Each stage does what its operator's docstring states. For the whole that means:

- NULL text: toxic never, copy of nothing, contaminated by nothing; it stays, with NULL tokens. An empty text has no tokens.
- NULL doc_id: an example never, copy of nothing; toxic and contaminated texts go all the same.
- Rows with one doc_id: equal texts are one document after exact dedup, all the others after near dedup; of these rows
  the first in the order of all columns stays. Otherwise the least doc_id of a group stays.
- Very long texts are worked on whole. Extra columns, whatever their names, pass all stages but the last.
- Empty documents give an empty result; empty labels or an empty benchmark let every document pass those stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratavox.llm import op1_near_dedup, op3_toxicity, op4_bpe, op8_decontaminate, op10_exact_dedup
from stratavox.llm.common import Scratch, prepare, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return op3_toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text."""
    return op10_exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return op1_near_dedup.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return op8_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, n_tokens, round_trip."""
    return op4_bpe.encode(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("decontamination", decontaminate), ("byte-level BPE", bpe)]
#: Sketches and edit distances are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written to the shared folder and read again. What a stage and
    its predecessor wrote is deleted once its result is there."""
    prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        own = len(Scratch.made)
        after = scratch.keep(stage(spark, docs, sf_dir))
        Scratch.sweep(own)
        if k:
            scratch.drop(docs)
        docs = after
    return docs
