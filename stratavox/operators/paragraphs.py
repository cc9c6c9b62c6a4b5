"""Speech: segments to paragraphs, an ordered fold within each lecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T

_DONE = "array<struct<start_s: double, text: string, bad: boolean>>"


def _step(a: Column, s: Column) -> Column:
    """Folds a segment into the state: paragraphs done, and text, start, end and flag of the open one, and whether it ends
    in a sentence's end. A fold is interpreted, so it has no regular expression and decides once."""
    is_open = a["start"].isNotNull()
    long = s["end_s"] - a["start"]
    over = (long >= K.SOFT_S) | (F.length(a["cur"]) >= K.SOFT_CHARS)
    forced = (F.length(a["cur"]) >= K.HARD_CHARS) | (long >= K.HARD_S)
    close = is_open & ((s["start_s"] - a["end"] >= K.GAP_S) | forced | (over & a["ends"]))
    closed = F.struct(a["start"].alias("start_s"), a["cur"].alias("text"), a["bad"].alias("bad"))

    def after(close: Column) -> Column:
        fresh = close | ~is_open
        return F.struct(
            F.when(close, F.concat(a["done"], F.array(closed))).otherwise(a["done"]).alias("done"),
            F.when(fresh, s["text"]).otherwise(F.concat(a["cur"], F.lit(" "), s["text"])).alias("cur"),
            F.when(fresh, s["start_s"]).otherwise(a["start"]).alias("start"),
            s["end_s"].alias("end"),
            F.when(fresh, s["bad"]).otherwise(a["bad"] | s["bad"]).alias("bad"),
            s["ends"].alias("ends"),
        )

    return T.let(close, after)


def paragraphs(segments: DataFrame) -> DataFrame:
    """lecture_id, para_no, start_s, text, suspect of segments (lecture_id, seq, start_s, end_s, text, avg_logprob,
    no_speech_prob). One shuffle by lecture; a lecture's segments are folded in order within the JVM. Blank segments go
    before their flags are looked at."""
    s = segments.select("lecture_id", "seq", "start_s", "end_s", T.strip(F.col("text")).alias("text"), T.suspect(F.col("avg_logprob"), F.col("no_speech_prob")).alias("bad")).filter("text <> ''")
    # a segment is stripped and follows a blank, so a text ends as its last segment does
    s = s.withColumn("ends", T.ends_sentence(F.col("text")))
    ordered = s.groupBy("lecture_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start_s", "end_s", "text", "bad", "ends"))).alias("segs"))
    start = F.struct(F.array().cast(_DONE).alias("done"), F.lit("").alias("cur"), F.lit(None).cast("double").alias("start"), F.lit(0.0).alias("end"), F.lit(False).alias("bad"), F.lit(False).alias("ends"))
    last = lambda a: F.concat(a["done"], F.array(F.struct(a["start"].alias("start_s"), a["cur"].alias("text"), a["bad"].alias("bad"))))
    folded = ordered.select("lecture_id", F.posexplode(F.aggregate("segs", start, _step, last)).alias("para_no", "p"))
    return folded.select("lecture_id", "para_no", "p.start_s", "p.text", (F.col("p.bad") | T.hallucinated(F.col("p.text"))).alias("suspect"))


def gaps(segments: DataFrame) -> DataFrame:
    """segments with gap_s, the silence before each, and whether it ends a paragraph."""
    w = Window.partitionBy("lecture_id").orderBy("seq")
    gap = F.col("start_s") - F.lag("end_s").over(w)
    return segments.withColumn("gap_s", gap).withColumn("breaks", F.coalesce(F.col("gap_s") >= K.GAP_S, F.lit(False)))
