"""Relations of lectures derived from the supplied tables, which hold none. Times are whole milliseconds until the end, so
that any engine gets equal numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def segments(t: Tables) -> DataFrame:
    """Turns of conversations in chunks of eight words."""
    words = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
    c = t.conversations.select("conv_id", "turn", words.alias("w")).filter(F.size("w") > 0)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 8).cast("int")), lambda i: F.array_join(F.slice("w", i * 8 + 1, 8), " "))
    c = c.select("conv_id", "turn", F.posexplode(chunks).alias("k", "text"))
    dur = F.length("text") * 80
    gap = F.when((F.col("k") == 0) & (F.col("turn") % 3 == 2), 2000).otherwise(300)
    w = Window.partitionBy("conv_id").orderBy("turn", "k")
    c = c.withColumn("seq", F.row_number().over(w)).withColumn("end_ms", F.sum(dur + gap).over(w))
    return c.select(
        F.col("conv_id").alias("lecture_id"),
        "seq",
        ((F.col("end_ms") - dur) / 1000.0).alias("start_s"),
        (F.col("end_ms") / 1000.0).alias("end_s"),
        "text",
        (-((F.col("conv_id") * 7 + F.col("turn") * 13 + F.col("k") * 5) % 93) / F.lit(100.0)).alias("avg_logprob"),
        (((F.col("conv_id") * 5 + F.col("turn") * 3 + F.col("k")) % 123) / F.lit(200.0)).alias("no_speech_prob"),
    )


def slides(t: Tables) -> DataFrame:
    """Documents as the screens of a lecture for each source."""
    no = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return t.documents.select(F.col("source").alias("lecture_id"), no.alias("slide_no"), F.split("text", "\n").alias("lines")).select("lecture_id", "slide_no", (F.col("slide_no") * 30.0).alias("t_s"), "lines")


def benchmark_pages(t: Tables) -> DataFrame:
    """Benchmark items as the pages of every lecture."""
    p = t.benchmark.select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("page_idx"), "text")
    p = p.withColumn("label", F.concat((F.col("page_idx") + 1).cast("string"), F.lit("쪽")))
    return t.documents.select(F.col("source").alias("lecture_id")).distinct().crossJoin(F.broadcast(p))


def screens(t: Tables) -> DataFrame:
    """Screens among the speech of v_segments: every fourth segment is burnt in as a subtitle, others show slides."""
    s = segments(t)
    upper = F.array(F.translate("text", "aeiou", "AEIOU"), F.concat(F.lit("Slide number "), (F.col("seq") % 7).cast("string")), F.lit("further points"))
    lines = F.when(F.col("seq") % 4 == 0, F.array("text")).otherwise(upper)
    label = F.when(F.col("seq") % 8 == 5, F.concat(F.col("seq").cast("string"), F.lit("쪽")))
    return s.select("lecture_id", F.col("seq").alias("slide_no"), F.col("start_s").alias("t_s"), lines.alias("lines"), label.alias("page_label"))


def kinds(t: Tables) -> DataFrame:
    """Events as screens: views and clicks are subtitles."""
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))
    kind = F.when(F.col("event_type").isin("view", "click"), "자막").otherwise("슬라이드")
    return t.events.select(F.col("user_id").alias("lecture_id"), no.alias("slide_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), kind.alias("kind")).select("lecture_id", "slide_no", (F.col("us") / 1e6).alias("t_s"), "kind")


def info(t: Tables) -> DataFrame:
    """What a recogniser tells of each lecture of v_segments."""
    last = segments(t).groupBy("lecture_id").agg(F.max("end_s").alias("duration_s"))
    lid = F.col("lecture_id")
    return last.select(
        "lecture_id",
        "duration_s",
        F.concat(F.lit("회계"), (lid % 5).cast("string"), F.lit(" "), (lid % 16 + 1).cast("string"), F.lit("-"), (lid % 3 + 1).cast("string"), F.lit("강")).alias("stem"),
        F.concat(F.lit("f"), lid.cast("string"), F.lit(".mp4")).alias("file"),
        F.when(lid % 2 == 0, "ko").otherwise("en").alias("language"),
        F.when(lid % 3 > 0, (lid % 100) / F.lit(100.0)).alias("language_probability"),
        F.when(lid % 4 > 0, F.col("duration_s") * (lid % 11) / F.lit(10.0)).alias("duration_after_vad_s"),
        F.when(lid % 5 == 0, F.lit("교재.pdf")).alias("materials"),
    )


def media(t: Tables) -> DataFrame:
    """Pages of the web as media files in folders; names clash often."""
    p = F.col("page_id")
    ext = F.element_at(F.array(*map(F.lit, ("mp4", "MP3", "wav", "txt", "pdf"))), (p % 5 + 1).cast("int"))
    name = F.concat(F.when(p % 17 == 3, "~").otherwise(""), F.when(p % 2 == 0, F.lit("Lec ")).otherwise("lec "), (p % 23).cast("string"))
    path = F.concat(F.when(p % 3 == 0, F.lit("week/")).otherwise(""), name, F.when(p % 29 == 5, F.lit(" (mp4)")).otherwise(""), F.when(p % 37 == 4, F.lit(" (mp4) (2)")).otherwise(""), F.lit("."), ext)
    return t.pages.groupBy(path.alias("rel_path")).agg(F.max(F.length("html")).cast("long").alias("bytes"))


def materials(t: Tables) -> DataFrame:
    """Names of documents for the lectures of v_info."""
    n = F.col("s_suppkey")
    stem = F.when(n % 3 == 0, F.concat(F.lit("회계"), (n % 5).cast("string"), F.lit(" "), (n % 17).cast("string"), F.lit("주차"))).when(n % 3 == 1, F.concat(F.lit("회계"), (n % 7).cast("string"), F.lit(" 교재"))).otherwise(F.concat(F.lit("Notes "), (n % 11).cast("string"), F.lit("-"), (n % 4).cast("string"), F.lit("강")))
    return t.supplier.select(F.concat(n.cast("string"), F.lit(".pdf")).alias("name"), stem.alias("stem"))


def ocr_tokens(t: Tables) -> DataFrame:
    """Words of benchmark items as a recogniser's table, in two passes; some of the values are unusable."""
    w = t.benchmark.select("item_id", F.posexplode(F.split("text", "[ \n]")).alias("row_no", "word")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass_no"))
    line = F.floor(F.col("row_no") / 6)
    h = (F.col("item_id") * 31 + F.col("row_no") * 17 + F.col("pass_no") * 7) % 100
    conf = F.when(h % 29 == 1, "x").when(h % 31 == 2, "-1").otherwise((h / 2 + 45).cast("string"))
    text = F.when(h % 23 == 5, "  ").when(h % 19 == 6, "#%@").otherwise(F.col("word"))
    return w.select(F.col("item_id").alias("lecture_id"), F.lit(0.0).alias("frame_s"), "pass_no", "row_no", F.lit("1").alias("block_num"), F.lit("1").alias("par_num"), line.cast("string").alias("line_num"), (line * 40 + F.col("pass_no") * 12).cast("string").alias("top"), conf.alias("conf"), text.alias("text"))


def ocr_plain(t: Tables) -> DataFrame:
    """The text output that goes with ``ocr_tokens``: complete for even items, one line too many for odd ones."""
    o = ocr_tokens(t)
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda x: x["text"]), " ")
    usable = o.withColumn("c", F.col("conf").try_cast("double")).filter((F.col("c") >= 0) & (F.trim("text") != ""))
    lines = usable.groupBy("lecture_id", "frame_s", "pass_no", F.col("line_num").cast("int").alias("line_no")).agg(F.lower(rows).alias("text"))
    extra = lines.filter("lecture_id % 2 = 1 AND line_no = 0").select("lecture_id", "frame_s", "pass_no", F.lit(-1).alias("line_no"), F.lit("extra").alias("text"))
    return lines.unionByName(extra)
