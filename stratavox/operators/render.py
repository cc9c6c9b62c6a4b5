"""Assembly: counts, the interleaved timeline, and the rendered document, a line a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from . import planner
from .screens import contents_worthy


def summary(screens: DataFrame, paragraphs: DataFrame, spans: DataFrame) -> DataFrame:
    """lecture_id with counts of screens, slides, slides taken from documents, subtitles, spans, paragraphs, suspects."""
    slide = F.col("kind") == K.SLIDE
    s = screens.groupBy("lecture_id").agg(
        F.count("*").alias("screens"), F.count_if(slide).alias("slides"), F.count_if(slide & F.col("page_label").isNotNull()).alias("from_pages"), F.count_if(~slide).alias("subtitles")
    )
    p = paragraphs.groupBy("lecture_id").agg(F.count("*").alias("paragraphs"), F.count_if("suspect").alias("suspects"))
    v = spans.groupBy("lecture_id").agg(F.count("*").alias("spans"))
    out = p.join(s, "lecture_id", "full").join(v, "lecture_id", "left")
    return out.select("lecture_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("screens", "slides", "from_pages", "subtitles", "spans", "paragraphs", "suspects")))


def _counts() -> list[Column]:
    """The columns of ``summary`` over rows of ``screens.marked_timeline``."""
    slide = F.col("kind") == K.SLIDE
    return [
        F.count("screen").alias("screens"), F.count_if(slide).alias("slides"), F.count_if(slide & F.col("screen.page_label").isNotNull()).alias("from_pages"), F.count_if(F.col("kind") == K.SUBTITLE).alias("subtitles"),
        F.count("span").alias("spans"), F.count("para").alias("paragraphs"), F.count_if("para.suspect").alias("suspects"),
    ]


def timeline_summary(marked: DataFrame) -> DataFrame:
    """``summary`` of rows of ``screens.marked_timeline``."""
    return marked.groupBy("lecture_id").agg(*_counts())


def run_summary(results: DataFrame) -> DataFrame:
    """status, n of per-lecture results."""
    return results.groupBy("status").agg(F.count("*").alias("n"))


def incomplete(audio: DataFrame) -> DataFrame:
    """audio (lecture_id, bytes, expected_s) with got_s (16 kHz, 16 bit, mono) and whether it was cut off."""
    got = (F.col("bytes") - 44) / 32000
    return audio.select("lecture_id", "bytes", "expected_s", got.alias("got_s"), F.coalesce(got < F.col("expected_s") * F.lit(K.COMPLETE), F.lit(False)).alias("truncated"))


def has_video(streams: DataFrame) -> DataFrame:
    """lecture_id, has_video: whether any stream is video and not an attached picture."""
    real = (F.col("codec_type") == "video") & (F.coalesce("attached_pic", F.lit(0)) == 0)
    return streams.groupBy("lecture_id").agg(F.coalesce(F.bool_or(real), F.lit(False)).alias("has_video"))


def missing_languages(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """lecture_id, lang of wanted languages that are nowhere available."""
    return wanted.join(available, "lang", "left_anti").select("lecture_id", "lang")


def timeline(screens: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """lecture_id, start_s, rank (screens first), ord, and either's columns. screens: with end_s and kind; paragraphs: with
    video and suspect."""
    s = screens.select("lecture_id", F.col("t_s").alias("start_s"), F.lit(0).alias("rank"), F.col("slide_no").alias("ord"), "lines", "page_label", "kind", "end_s")
    p = paragraphs.select("lecture_id", "start_s", F.lit(1).alias("rank"), F.col("para_no").alias("ord"), "text", "video", "suspect")
    return s.unionByName(p, allowMissingColumns=True)


def blocks(timeline: DataFrame) -> DataFrame:
    """timeline with block: the rendered lines of each row, ending in a blank one."""
    head = F.when(F.col("kind") == K.SUBTITLE, F.lit("📺 영상 자막")).otherwise(F.lit("🖵 슬라이드"))
    page = F.coalesce(F.concat(F.lit(" "), "page_label"), F.lit(""))
    span = F.concat(F.lit(" ["), T.timestamp(F.col("start_s")), F.lit(" – "), T.timestamp(F.col("end_s")), F.lit("]**"))
    screen = F.concat(F.array(F.concat(F.lit("> **"), head, page, span)), F.transform("lines", lambda x: F.concat(F.lit("> "), x)), F.array(F.lit("")))
    mark = lambda c, s: F.when(F.col(c), F.lit(s)).otherwise("")
    speech = F.array(F.concat(F.lit("**["), T.timestamp(F.col("start_s")), F.lit("]** "), mark("video", "📺 "), mark("suspect", "⚠ "), F.col("text")), F.lit(""))
    return timeline.withColumn("block", F.when(F.col("rank") == 0, screen).otherwise(speech))


def _line(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def header(lectures: DataFrame, counts: DataFrame, *more: Column | str) -> DataFrame:
    """lecture_id, header: front matter and notices. lectures: lecture_id, file, stem, language, language_probability
    (NULL if the language was set), duration_s, duration_after_vad_s, materials (NULL if none). What depends on the clock
    (time taken, date) is left to the caller. more: other columns of counts that are wanted."""
    course, week, period = T.course(F.col("stem"))
    c = lectures.join(counts, "lecture_id", "left")
    n = lambda k: F.coalesce(k, F.lit(0))
    text = lambda k: F.col(k).cast("string")
    lost = T.silence_share(F.col("duration_s"), F.col("duration_after_vad_s"))
    some = lambda cond, *lines: F.when(cond, F.array(*lines)).otherwise(F.array().cast("array<string>"))
    language = F.when(F.col("language_probability").isNull(), _line(F.col("language"), "  (설정에서 지정)")).otherwise(_line(F.col("language"), "  (자동 감지, 확신도 ", T.percent(F.col("language_probability")), "%)"))
    lines = F.concat(
        F.array(F.lit("---"), _line("과목: ", course)),
        some(week.isNotNull(), _line("주차: ", week.cast("string")), _line("교시: ", period.cast("string"))),
        F.array(_line("언어: ", F.col("language")), _line("길이: ", T.timestamp(F.col("duration_s"))), _line("원본: ", F.col("file"))),
        some(F.col("materials").isNotNull(), _line("강의자료: ", F.col("materials"))),
        F.array(F.lit("---"), F.lit(""), _line("# ", F.col("stem")), F.lit(""), _line("- **원본 파일**: ", F.col("file")), _line("- **길이**: ", T.timestamp(F.col("duration_s"))), _line("- **언어**: ", language)),
        some(n("screens") > 0, _line("- **슬라이드**: ", text("slides"), "장, 원문 ", text("from_pages"), "장")),
        some(n("spans") > 0, _line("- 📺 **영상 ", text("spans"), "곳**")),
        some(n("suspects") > 0, _line("- ⚠ **의심 문단 ", text("suspects"), "개**")),
        some(lost >= K.VAD_NOTICE, _line("- ⚠ **무음 제외 ", T.percent(lost), "%**")),
    )
    return c.select("lecture_id", lines.alias("header"), *more)


def _entry(t_s: Column) -> Column:
    page = F.coalesce(F.concat(F.lit(" · "), "page_label"), F.lit(""))
    return _line("- `[", T.timestamp(t_s), "]`", page, " ", F.col("title"))


def _listing(rows: Column) -> Column:
    return F.concat(F.array(F.lit(""), F.lit("## 화면 차례"), F.lit("")), F.transform(rows, lambda x: x["line"]))


def contents_lines(contents: DataFrame) -> DataFrame:
    """lecture_id, toc: the rendered table of contents."""
    rows = F.array_sort(F.collect_list(F.struct("t_s", "slide_no", _entry(F.col("t_s")).alias("line"))))
    return contents.groupBy("lecture_id").agg(_listing(rows).alias("toc"))


def _document(whole: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    lines = F.concat("header", F.coalesce("toc", none), F.array(F.lit(""), F.lit("---"), F.lit("")), F.coalesce("body", none))
    return whole.select("lecture_id", F.posexplode(lines).alias("line_no", "text"))


def _body() -> Column:
    return F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start_s", "rank", "ord", "block"))), lambda x: x["block"])).alias("body")


def render(lectures: DataFrame, screens: DataFrame, paragraphs: DataFrame, spans: DataFrame, contents: DataFrame) -> DataFrame:
    """lecture_id, line_no, text: each lecture's document but for the marker line."""
    body = blocks(timeline(screens, paragraphs)).groupBy("lecture_id").agg(_body())
    return _document(header(lectures, summary(screens, paragraphs, spans)).join(contents_lines(contents), "lecture_id", "left").join(body, "lecture_id", "left"))


def render_timeline(lectures: DataFrame, marked: DataFrame) -> DataFrame:
    """``render`` of rows of ``screens.marked_timeline``: ends of screens, contents, counts and body come from one pass
    over each lecture's rows, which are there together already."""
    is_screen, s, p = F.col("screen").isNotNull(), lambda c: F.col(f"screen.{c}"), lambda c: F.col(f"para.{c}")
    following = F.lead(s("t_s")).over(Window.partitionBy("lecture_id", is_screen).orderBy(s("t_s"), s("slide_no")))
    rows = marked.withColumn("following", following).join(lectures.select("lecture_id", "duration_s"), "lecture_id", "left")
    rows = rows.withColumn("title", F.when(contents_worthy(s("lines"), s("page_label"), F.col("kind")), T.title(s("lines"))))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("lecture_id", "title").orderBy(s("t_s"), s("slide_no"))))
    rows = rows.select(
        "lecture_id", "screen", "para", "kind", "span", "video", p("suspect").alias("suspect"), p("text").alias("text"), s("lines").alias("lines"), s("page_label").alias("page_label"),
        F.when(is_screen, s("t_s")).otherwise(p("start_s")).alias("start_s"), F.when(is_screen, 0).otherwise(1).alias("rank"), F.when(is_screen, s("slide_no")).otherwise(p("para_no")).alias("ord"),
        F.coalesce("following", "duration_s").alias("end_s"), F.when(F.col("nth") == 1, F.col("title")).alias("title"),
    )
    listed = F.when(F.col("title").isNotNull(), F.struct(F.col("start_s").alias("t_s"), F.col("ord").alias("slide_no"), _entry(F.col("start_s")).alias("line")))
    whole = blocks(rows).groupBy("lecture_id").agg(*_counts(), F.sort_array(F.collect_list(listed)).alias("listed"), _body())
    toc = F.when(F.size("listed") > 0, _listing(F.col("listed")))
    return _document(header(lectures, whole, toc.alias("toc"), "body"))


def marked(rendered: DataFrame, lectures: DataFrame) -> DataFrame:
    """lecture_id, text: each lecture's whole document, ended by the marker line by which the next plan knows it.
    lectures: lecture_id, name, bytes, cfg, pdf. One shuffle by lecture."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    body = rendered.groupBy("lecture_id").agg(F.concat(F.array_join(F.transform(rows, lambda x: x["text"]), "\n"), F.lit("\n\n")).alias("body"))
    whole = body.join(lectures, "lecture_id").withColumn("sha", T.body_hash(F.col("body")))
    return whole.select("lecture_id", F.concat("body", planner.marker(), F.lit("\n")).alias("text"))


def write(rendered: DataFrame, path: str) -> None:
    """Each lecture's lines, in order, as text in a folder of its own; the commit protocol makes the write atomic."""
    one = rendered.repartition("lecture_id").sortWithinPartitions("lecture_id", "line_no")
    one.select("lecture_id", "text").write.partitionBy("lecture_id").text(path)
