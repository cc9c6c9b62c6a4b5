"""What the operators share: durable intermediate tables, size-checked joins, worker set-up."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long column that are broadcast at most; a larger side is joined by a shuffled hash join.
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset and all runs in one process (tests),
    a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stratavox-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no recomputation from the start.

    ``drop`` removes tables that no later plan reads. The other tables of an operator are needed as long as its result
    is; ``sweep`` removes them once that has been written."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/stratavox-{name}-{uuid.uuid4().hex[:12]}", 0
        Scratch.made.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    @classmethod
    def sweep(cls, since: int = 0) -> None:
        """Deletes all tables of those made after the first ``since``."""
        for x in cls.made[since:]:
            x._delete(x.root)
        del cls.made[since:]


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """These names, changed as far as needed to be unlike the names taken and each other; case doesn't count."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        out.append(n)
    return out


def fits(ids: DataFrame) -> bool:
    """Whether a table of ids, already written, is small enough to broadcast."""
    return ids.count() <= BROADCAST_ROWS


def sized(ids: DataFrame) -> DataFrame:
    """ids with the join hint its size allows: broadcast, or the build side of a shuffled hash join, so that long
    texts on the other side are never sorted."""
    return F.broadcast(ids) if fits(ids) else ids.hint("shuffle_hash")


def without(docs: DataFrame, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs but for those whose doc_id is in ids (written, distinct, one column). Rows without a doc_id stay."""
    (name,) = fresh(docs.columns, "gone_id")
    ids = sized(ids.select(F.col(ids.columns[0]).alias(name)))
    return docs.join(ids, docs["doc_id"] == ids[name], how)


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids."""
    return without(docs, ids, "left_semi")


def one_of_each(docs: DataFrame, *keys: Column) -> DataFrame:
    """Of the rows with equal keys the first in the order of all columns. Tasks pass on one row for each key, so that a
    key of any number of rows is no burden."""
    names = fresh([], *(f"k{i}" for i in range(len(keys))))
    key = [k.alias(n) for k, n in zip(keys, names)]
    return docs.groupBy(*key).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(*order_of(docs.columns))).alias("row")).select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_of(cols: list[str]) -> list[Column]:
    """A total order of rows up to equal ones."""
    return [F.col(f"`{c}`").cast("string") for c in cols]


def least_hash(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows of df, whose keys are distinct: those with the least hash of the key. A cut on the hash
    leaves about as many rows before any sort, so that no task or driver gets more as df grows."""
    h, n = F.xxhash64(key), df.count()
    share = 1.0 if n <= bound else 1.5 * bound / n
    few = df if share >= 1 else df.filter(h <= F.lit(int(-(2**63) + share * 2**64)))
    return few.orderBy(h, key).limit(bound)
