"""Screens: recognised lines, merging of passes and of repeated screens, labels, playback spans, ends, contents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T

#: Rows that a worker holds as Python objects at a time.
_ROWS = 256


def recognised_lines(tokens: DataFrame, plain: DataFrame) -> DataFrame:
    """lecture_id, frame_s, pass_no, line_no, top, text, conf of the lines worth keeping. tokens: rows of the recogniser's
    table, in order row_no; plain: non-blank lines of its text output (lecture_id, frame_s, pass_no, line_no, text). A
    frame whose two outputs differ in their number of lines takes its texts from the words."""
    frame = ["lecture_id", "frame_s", "pass_no"]
    t = tokens.select(*frame, "row_no", "block_num", "par_num", "line_num", F.col("top").try_cast("int").alias("top"), F.col("conf").try_cast("double").alias("conf"), T.strip(F.coalesce("text", F.lit(""))).alias("word"))
    t = t.filter((F.col("conf") >= 0) & (F.col("word") != ""))
    rows = F.array_sort(F.collect_list(F.struct("row_no", "conf", "word")))
    lines = t.groupBy(*frame, "block_num", "par_num", "line_num").agg(rows.alias("rows"), F.min("row_no").alias("first"), F.coalesce(F.min("top"), F.lit(0)).alias("top"))
    # summed in row order, so that the mean doesn't hang on the order of arrival
    mean = F.aggregate("rows.conf", F.lit(0.0), lambda s, x: s + x) / F.size("rows")
    by = Window.partitionBy(*frame)
    lines = lines.select(*frame, "top", mean.alias("conf"), F.array_join("rows.word", " ").alias("joined"), F.row_number().over(by.orderBy("first")).alias("line_no"), F.count("*").over(by).alias("n"))
    p = plain.filter(T.strip(F.col("text")) != "")
    p = p.select(*frame, F.col("text").alias("plain"), F.row_number().over(by.orderBy("line_no")).alias("line_no"), F.count("*").over(by).alias("m"))
    both = lines.join(p, [*frame, "line_no"], "left")
    line = T.strip(F.regexp_replace(F.when(F.col("n") == F.col("m"), F.col("plain")).otherwise(F.col("joined")), r"(?U)\s{2,}", " "))
    body = F.regexp_replace(line, r"(?U)\s+", "")
    signs = re.sub(r"([\[\]\\^\-])", r"\\\1", K.SIGNS)
    content = F.length(F.regexp_replace(body, rf"[^\p{{L}}\p{{N}}{signs}]", ""))
    keep = (F.length(body) > 0) & (F.length(line) >= 2) & (F.col("conf") >= K.MIN_CONF) & (F.try_divide(content, F.length(body)) >= F.lit(K.MIN_CONTENT))
    return both.filter(keep).select(*frame, "line_no", "top", line.alias("text"), "conf")


def merge_passes(lines: DataFrame) -> DataFrame:
    """lecture_id, frame_s, lines: the best reading of each line of a frame over all passes. A step takes the next line
    of every pass whose height is within tolerance of the highest, and keeps the one that scores best."""
    lines = lines.withColumn("score", T.line_score(F.col("text"), F.col("conf")))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["top", "line_no"], kind="stable")
        queues = [list(zip(g["top"], g["text"], g["score"])) for _, g in sorted(frame.groupby("pass_no"))]
        at, out = [0] * len(queues), []
        while live := [k for k, q in enumerate(queues) if at[k] < len(q)]:
            top = min(queues[k][at[k]][0] for k in live)
            step = [k for k in live if len(queues) == 1 or queues[k][at[k]][0] - top <= K.TOP_TOLERANCE]
            best = max(step, key=lambda k: (queues[k][at[k]][2], -k))
            out.append(queues[best][at[best]][1])
            for k in step:
                at[k] += 1
        return pd.DataFrame({"lecture_id": [frame["lecture_id"].iloc[0]], "frame_s": [frame["frame_s"].iloc[0]], "lines": [out]})

    kind = lines.schema["lecture_id"].dataType.simpleString()
    return lines.groupBy("lecture_id", "frame_s").applyInPandas(merge, f"lecture_id {kind}, frame_s double, lines array<string>")


def pick_crop(probes: DataFrame) -> DataFrame:
    """lecture_id, cropped: whether the cropped picture yields more lines. probes: lecture_id, variant (full, crop), lines."""
    n = lambda v: F.coalesce(F.sum(F.when(F.col("variant") == v, F.size("lines"))), F.lit(0))
    return probes.groupBy("lecture_id").agg((n("crop") > n("full")).alias("cropped"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged screens of rows in the order of lecture_id and slide_no. Only the last few merged screens can still change;
    earlier ones are passed on, so that memory hangs neither on a lecture's length nor on a partition's."""
    recent: list[list] = []
    lecture, schema = None, None
    for batch in batches:
        schema = pa.schema([batch.schema.field(c) for c in ("lecture_id", "slide_no", "t_s", "lines")])
        for x in range(0, batch.num_rows, _ROWS):
            out: list[list] = []
            for row in batch.slice(x, _ROWS).to_pylist():
                words, score = set(row["words"] or ()), row["score"]
                if row["lecture_id"] != lecture:
                    out += recent
                    recent, lecture = [], row["lecture_id"]
                if not words:
                    continue
                hit = next((m for m in reversed(recent) if len(words & m[4]) >= K.MERGE_SHARE * min(len(words), len(m[4]))), None)
                if hit is None:
                    recent.append([lecture, row["slide_no"], row["t_s"], row["lines"], words, score])
                    out += recent[: -K.LOOK_BACK]
                    del recent[: -K.LOOK_BACK]
                elif score > hit[5]:
                    hit[3:] = [row["lines"], words, score]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in out], f.type) for k, f in enumerate(schema)], schema=schema)
    if recent:
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in recent], f.type) for k, f in enumerate(schema)], schema=schema)


def merge_screens(screens: DataFrame) -> DataFrame:
    """Repeated screens as one: each is compared with the last few merged ones, newest first; a hit takes the better
    reading and keeps the first time. screens: lecture_id, slide_no, t_s, lines.

    Words and scores, the costly part, are worked out wherever a screen happens to be; only the comparison goes along a
    lecture, as a stream."""
    s = screens.select("lecture_id", F.col("slide_no").cast("int").alias("slide_no"), F.col("t_s").cast("double").alias("t_s"), "lines").repartition("lecture_id", "slide_no")
    s = s.withColumn("words", T.screen_words(F.col("lines"))).withColumn("score", T.reading_score(F.col("lines")))
    s = s.repartition("lecture_id").sortWithinPartitions("lecture_id", "slide_no")
    kind = s.schema["lecture_id"].dataType.simpleString()
    return s.mapInArrow(_merge, f"lecture_id {kind}, slide_no int, t_s double, lines array<string>")


def timeline(screens: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """lecture_id, screen, para, kind: a row for each screen (its columns, and its kind) and for each paragraph. A short
    screen whose words were mostly spoken nearby is a subtitle.

    One shuffle by lecture; whatever goes on by lecture needs no other. Paragraphs nearby are a range of the rows in the
    order of time, so that no lecture is paired with itself. The range is a second wider, as its bounds are rounded
    otherwise than the difference of two times."""
    rest = lambda df: F.struct(*(c for c in df.columns if c != "lecture_id"))
    s = screens.select("lecture_id", F.col("t_s").alias("at"), rest(screens).alias("screen"), T.screen_words(F.col("lines")).alias("sw"))
    p = paragraphs.select("lecture_id", F.col("start_s").alias("at"), rest(paragraphs).alias("para"), F.struct(F.col("start_s").alias("p_s"), T.folded_words(F.col("text"), 2).alias("pw")).alias("said"))
    w = Window.partitionBy("lecture_id").orderBy("at").rangeBetween(-(K.NEAR_S + 1), K.NEAR_S + 1)
    rows = s.unionByName(p, allowMissingColumns=True).withColumn("near", F.when(F.col("screen").isNotNull(), F.collect_list("said").over(w)))
    words = F.flatten(F.transform(F.filter("near", lambda x: F.abs(x["p_s"] - F.col("at")) <= K.NEAR_S), lambda x: x["pw"]))
    share = F.try_divide(F.size(F.array_intersect("sw", words)), F.size("sw"))
    size = F.aggregate("screen.lines", F.lit(0), lambda s, x: s + F.length(x))
    subtitle = (F.size("screen.lines") <= K.SUBTITLE_LINES) & (size <= K.SUBTITLE_CHARS) & (F.coalesce(share, F.lit(0.0)) >= K.SUBTITLE_SHARE)
    kind = F.when(F.col("screen").isNotNull(), F.when(subtitle, K.SUBTITLE).otherwise(K.SLIDE))
    return rows.select("lecture_id", "screen", "para", kind.alias("kind"))


def label_screens(screens: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """screens with kind, see ``timeline``."""
    t = timeline(screens, paragraphs.select("lecture_id", "start_s", "text")).filter(F.col("screen").isNotNull())
    return t.select(*(c if c == "lecture_id" else F.col(f"screen.{c}") for c in screens.columns), "kind")


def marked_timeline(timeline: DataFrame) -> DataFrame:
    """timeline with span (from_s and to_s, at the first screen of each playback span, else NULL) and video (of
    paragraphs: whether they begin within a padded span). Of the spans that begin early enough, the one that ends last
    decides, so a running maximum does."""
    is_screen = F.col("screen").isNotNull()
    no, t_s, start = F.col("screen.slide_no"), F.col("screen.t_s"), F.col("para.start_s")
    run = F.row_number().over(Window.partitionBy("lecture_id", is_screen).orderBy(no)) - F.row_number().over(Window.partitionBy("lecture_id", "kind").orderBy(no))
    t = timeline.withColumn("run", F.when(F.col("kind") == K.SUBTITLE, run))
    by = Window.partitionBy("lecture_id", "run")
    first = (F.col("kind") == K.SUBTITLE) & (F.count("*").over(by) >= K.SPAN_SLIDES) & (no == F.min(no).over(by))
    t = t.withColumn("span", F.when(first, F.struct(t_s.alias("from_s"), F.max_by(t_s, no).over(by).alias("to_s")))).drop("run")
    key = F.when(is_screen, F.col("span.from_s") - K.SPAN_PAD_S).otherwise(start)
    begun = Window.partitionBy("lecture_id").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("key", key).withColumn("until", F.max(F.col("span.to_s") + K.SPAN_PAD_S).over(begun))
    return t.withColumn("video", F.when(~is_screen, F.coalesce(start <= F.col("until"), F.lit(False)))).drop("key", "until")


def video_spans(labelled: DataFrame) -> DataFrame:
    """lecture_id, span_no, from_s, to_s of runs of at least two subtitles in the order of slide_no."""
    by = Window.partitionBy("lecture_id")
    run = F.row_number().over(by.orderBy("slide_no")) - F.row_number().over(Window.partitionBy("lecture_id", "kind").orderBy("slide_no"))
    runs = labelled.select("lecture_id", "slide_no", "t_s", "kind", run.alias("run")).filter(F.col("kind") == K.SUBTITLE)
    spans = runs.groupBy("lecture_id", "run").agg(F.count("*").alias("n"), F.min("slide_no").alias("first"), F.min_by("t_s", "slide_no").alias("from_s"), F.max_by("t_s", "slide_no").alias("to_s")).filter(F.col("n") >= K.SPAN_SLIDES)
    return spans.select("lecture_id", F.row_number().over(by.orderBy("first")).alias("span_no"), "from_s", "to_s")


def in_video(paragraphs: DataFrame, spans: DataFrame) -> DataFrame:
    """paragraphs with video: whether they begin within a padded span."""
    s = spans.select(F.col("lecture_id").alias("l"), "from_s", "to_s")
    p = paragraphs.alias("p")
    inside = (F.col("l") == F.col("p.lecture_id")) & (F.col("from_s") - K.SPAN_PAD_S <= F.col("p.start_s")) & (F.col("p.start_s") <= F.col("to_s") + K.SPAN_PAD_S)
    hits = p.join(s, inside, "left_semi").select("lecture_id", "para_no", F.lit(True).alias("video"))
    return paragraphs.join(hits, ["lecture_id", "para_no"], "left").withColumn("video", F.coalesce("video", F.lit(False)))


def screen_ends(screens: DataFrame, info: DataFrame) -> DataFrame:
    """screens with end_s: the beginning of the next in time, of the last the lecture's length (which may be earlier)."""
    w = Window.partitionBy("lecture_id").orderBy("t_s", "slide_no")
    out = screens.join(info.select("lecture_id", "duration_s"), "lecture_id", "left")
    return out.withColumn("end_s", F.coalesce(F.lead("t_s").over(w), F.col("duration_s"))).drop("duration_s")


def contents_worthy(lines: Column, page_label: Column, kind: Column) -> Column:
    """Whether a screen can be in the contents, if it has a title."""
    return (kind == K.SLIDE) & ((F.size(lines) >= 2) | ((F.size(lines) > 0) & page_label.isNotNull()))


def contents(labelled: DataFrame) -> DataFrame:
    """lecture_id, t_s, page_label, title: the first slide of each title, in time order."""
    c = labelled.withColumn("title", T.title(F.col("lines")))
    c = c.filter(contents_worthy(F.col("lines"), F.col("page_label"), F.col("kind")) & F.col("title").isNotNull())
    first = Window.partitionBy("lecture_id", "title").orderBy("t_s", "slide_no")
    return c.withColumn("n", F.row_number().over(first)).filter("n = 1").select("lecture_id", "slide_no", "t_s", "page_label", "title")
