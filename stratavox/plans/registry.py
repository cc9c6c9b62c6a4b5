"""Queries by name: each applies an operator to whole supplied tables, by way of the views in ``sources.views``."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import pairs
from ..functions import text as T
from ..operators import materials, paragraphs, planner, render, screens
from ..sources import readers, views
from . import oracles

QUERIES: dict = {}


def query(f):
    def run(spark, sf_dir):
        env = spark.sparkContext.environment
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        if root not in env.get("PYTHONPATH", ""):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
        return f(views.Tables(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


def _joined(words):
    # array_sort would interpret its comparison
    return F.array_join(F.sort_array(words), " ")


def _long(c):
    return c.cast("bigint")


def _stems(t):
    """Names of many forms, one for each page."""
    p = F.col("page_id")
    s = F.when(p % 4 == 0, F.concat(F.lit("회계"), (p % 5).cast("string"), F.lit(" "), (p % 16).cast("string"), F.lit("-"), (p % 3).cast("string"), F.lit("강")))
    s = s.when(p % 4 == 1, F.concat((p % 9).cast("string"), F.lit("주차교재"))).when(p % 4 == 2, F.concat(F.lit("Lecture-"), p.cast("string"), F.lit(" Notes "), F.repeat(F.lit("x "), (p % 70).cast("int"))))
    return t.pages.select("page_id", s.otherwise(F.col("url")).alias("s"))


def _lines(t):
    """Lines of documents; of every other one, some letters become Hangul."""
    line = F.when(F.col("doc_id") % 2 == 0, F.translate("x", "aeo", "가나다")).otherwise(F.col("x"))
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "x")).select("doc_id", _long(F.col("line_no")).alias("line_no"), line.alias("x"))


def _hangul_lines(t):
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "aeo", "가나다")).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.split(text, "\n").alias("lines"))


# -- scalars --------------------------------------------------------------------------------------------------------


@query
def fmt_ts(t):
    return t.documents.select("doc_id", T.timestamp(F.col("n_chars") * F.lit(1.37) - 300).alias("ts"))


@query
def safe_stem(t):
    return t.documents.select("doc_id", T.short_name(F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).alias("name"))


@query
def slide_key(t):
    w = T.screen_words(F.split("text", "\n"))
    return t.documents.select("doc_id", _long(F.size(w)).alias("n"), _joined(w).alias("words"))


@query
def name_tokens(t):
    w = T.name_words(F.col("s"))
    return _stems(t).select("page_id", _long(F.size(w)).alias("n"), _joined(w).alias("words"))


@query
def page_key(t):
    w = F.col("w")
    return t.documents.select("doc_id", pairs.bigrams(F.col("text")).alias("w")).select("doc_id", _long(F.size(w)).alias("n"), F.md5(F.array_join(w, " ")).alias("h"))


@query
def stem_week(t):
    return _stems(t).select("page_id", _long(T.week(F.col("s"))).alias("week"))


@query
def parse_course(t):
    c, w, p = T.course(F.col("s"))
    return _stems(t).select("page_id", c.alias("course"), F.coalesce(_long(w), F.lit(-1)).alias("week"), F.coalesce(_long(p), F.lit(-1)).alias("period"))


@query
def body_hash(t):
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\r\n" + K.MARKER + " {} -->"), "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", T.body_hash(marked).alias("h"))


@query
def fingerprint(t):
    k = F.col("c_custkey")
    f = T.fingerprint(F.col("c_mktsegment"), F.when(k % 2 == 0, "ko").otherwise("auto"), k % 10 + 1, k % 3 == 0, k % 32 + 1, k % 5 > 0, F.lit("자동"))
    return t.customer.select("c_custkey", f.alias("cfg"))


@query
def config_clamp(t):
    raw = F.when(F.col("c_custkey") % 7 == 0, F.lit("many")).otherwise((F.floor("c_acctbal") % 50).cast("string"))
    batch = T.clamped(raw, 1, 32, 1)
    batch = F.when((F.col("c_custkey") % 2 == 0) & (batch == 1), 16).otherwise(batch)
    return t.customer.select("c_custkey", _long(T.clamped(raw, 1, 10, 5)).alias("beam"), _long(batch).alias("batch"))


@query
def script_mix(t):
    return _lines(t).select("doc_id", "line_no", _long(T.mixed_scripts(F.col("x"))).alias("penalty"))


@query
def ocr_score(t):
    return _hangul_lines(t).select("doc_id", T.reading_score(F.col("lines")).alias("score"))


@query
def line_score(t):
    conf = F.when(F.col("line_no") % 3 > 0, (F.col("doc_id") % 100).cast("double"))
    return _lines(t).select("doc_id", "line_no", T.line_score(F.col("x"), conf).alias("score"))


@query
def garbled(t):
    return _lines(t).select("doc_id", "line_no", T.garbled(F.col("x")).alias("garbled"))


@query
def slide_title(t):
    return _hangul_lines(t).select("doc_id", T.title(F.col("lines")).alias("title"))


@query
def ends_sentence(t):
    return _lines(t).select("doc_id", "line_no", T.ends_sentence(F.col("x")).alias("ends"))


@query
def hallucinated(t):
    return t.documents.select("doc_id", T.hallucinated(F.col("text")).alias("bad"))


@query
def suspect_segments(t):
    s = views.segments(t)
    return s.filter(T.suspect(F.col("avg_logprob"), F.col("no_speech_prob"))).select("lecture_id", _long(F.col("seq")).alias("seq"), "text")


@query
def vad_lost(t):
    return views.info(t).select("lecture_id", F.round(T.silence_share(F.col("duration_s"), F.col("duration_after_vad_s")), 6).alias("lost"))


@query
def pts_times(t):
    part = F.transform(F.sequence(F.lit(1), (F.col("event_id") % 4 + 1).cast("int")), lambda i: F.concat(F.lit("n:"), i.cast("string"), F.lit(" pts_time:"), F.col("event_id").cast("string"), F.lit("."), i.cast("string")))
    logs = t.events.select(F.col("event_id").alias("lecture_id"), F.array_join(part, "\n").alias("log"))
    return readers.frame_times(logs).select("lecture_id", _long(F.col("frame_no")).alias("frame_no"), "t_s")


# -- relations ------------------------------------------------------------------------------------------------------


@query
def has_video(t):
    s = t.lineitem.select(F.col("l_orderkey").alias("lecture_id"), F.when(F.col("l_linenumber") % 3 == 1, "video").otherwise("audio").alias("codec_type"), F.when(F.col("l_quantity") > 25, 1).alias("attached_pic"))
    return render.has_video(s)


@query
def truncation_check(t):
    a = t.orders.select(F.col("o_orderkey").alias("lecture_id"), (F.col("o_orderkey") * 32000 + 44).alias("bytes"), (F.col("o_orderkey") + F.col("o_orderkey") % 50).alias("expected_s"))
    return render.incomplete(a).select("lecture_id", "got_s", "truncated")


@query
def missing_langs(t):
    return render.missing_languages(t.documents.select(F.col("doc_id").alias("lecture_id"), "lang"), t.spark.createDataFrame([("en",), ("fr",), ("ko",)], "lang string"))


@query
def run_summary(t):
    return render.run_summary(t.orders.select(F.col("o_orderstatus").alias("status")))


@query
def pick_crop(t):
    return screens.pick_crop(t.documents.select(F.col("source").alias("lecture_id"), F.when(F.col("doc_id") % 2 == 0, "full").otherwise("crop").alias("variant"), F.split("text", "\n").alias("lines")))


@query
def speech_gaps(t):
    return paragraphs.gaps(views.segments(t)).select("lecture_id", _long(F.col("seq")).alias("seq"), F.round("gap_s", 6).alias("gap_s"), "breaks")


def _paragraphs(t):
    return paragraphs.paragraphs(views.segments(t))


def _labelled(t):
    return screens.label_screens(views.screens(t), _paragraphs(t))


def _marked(t):
    return screens.marked_timeline(screens.timeline(views.screens(t), _paragraphs(t)))


@query
def label_slides(t):
    return _labelled(t).select("lecture_id", _long(F.col("slide_no")).alias("slide_no"), "t_s", "kind")


@query
def screen_ends(t):
    return screens.screen_ends(views.screens(t), views.info(t)).select("lecture_id", _long(F.col("slide_no")).alias("slide_no"), "t_s", "end_s")


@query
def video_spans(t):
    return screens.video_spans(views.kinds(t)).select("lecture_id", _long(F.col("span_no")).alias("span_no"), "from_s", "to_s")


@query
def video_flag(t):
    return _marked(t).filter(F.col("para").isNotNull()).select("lecture_id", _long(F.col("para.para_no")).alias("para_no"), "video")


@query
def toc(t):
    return screens.contents(_labelled(t)).select("lecture_id", "t_s", "page_label", "title")


@query
def lecture_summary(t):
    return render.timeline_summary(_marked(t))


@query
def hotwords(t):
    p = t.documents.select(F.col("source").alias("lecture_id"), F.col("doc_id").alias("page_idx"), F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeo", "가나다")).otherwise(F.col("text")).alias("text"))
    return materials.hot_words(p)


@query
def match_materials(t):
    m = materials.match_materials(views.info(t), views.materials(t))
    return m.select("lecture_id", "material")


@query
def pages_labeled(t):
    pages = t.benchmark.select(F.concat((F.col("item_id") % 20 + 1).cast("string"), F.lit(".pdf")).alias("material"), F.col("item_id").alias("page_no"), "text")
    return materials.matched_pages(views.info(t), views.materials(t), pages).select("lecture_id", _long(F.col("page_idx")).alias("page_idx"), "label", "text")


@query
def align_scores(t):
    s = materials.containment(views.slides(t), views.benchmark_pages(t))
    return s.select("lecture_id", _long(F.col("slide_no")).alias("slide_no"), _long(F.col("page_idx")).alias("page_idx"), "r")


@query
def align_slides(t):
    a = materials.align(views.slides(t), views.benchmark_pages(t))
    return a.select("lecture_id", _long(F.col("slide_no")).alias("slide_no"), "t_s", F.array_join("lines", "\n").alias("body"), "page_label")


@query
def merge_slides(t):
    return screens.merge_screens(views.slides(t)).select("lecture_id", "t_s", F.array_join("lines", "\n").alias("body"))


@query
def ocr_lines(t):
    lines = screens.recognised_lines(views.ocr_tokens(t), views.ocr_plain(t))
    return lines.select("lecture_id", _long(F.col("pass_no")).alias("pass_no"), _long(F.col("line_no")).alias("line_no"), _long(F.col("top")).alias("top"), "text", F.round("conf", 6).alias("conf"))


@query
def merge_ocr(t):
    m = screens.merge_passes(screens.recognised_lines(views.ocr_tokens(t), views.ocr_plain(t)))
    return m.select("lecture_id", F.array_join("lines", "\n").alias("body"))


@query
def paragraphs_(t):
    return _paragraphs(t).select("lecture_id", _long(F.col("para_no")).alias("para_no"), "start_s", "text", "suspect")


QUERIES["paragraphs"] = QUERIES.pop("paragraphs_")


# -- planning and rendering -----------------------------------------------------------------------------------------


@query
def plan_listing(t):
    return planner.listing(views.media(t))


def _named(t):
    return planner.names(planner.listing(views.media(t)).filter("role = 'media'"))


@query
def plan_names(t):
    return _named(t).select("rel_path", "out_name")


def _state(t):
    """Media with configuration and documents, and outputs of an earlier run in all states."""
    n = F.length("rel_path") + F.col("bytes") % 11
    m = _named(t).select("rel_path", F.substring_index("rel_path", "/", -1).alias("name"), "bytes", "out_name", F.lit("cfg1").alias("cfg"), F.when(F.col("bytes") % 2 == 0, "a.pdf").otherwise("").alias("pdf"), (n % 9).alias("n"))
    body = F.concat(F.lit("# "), "out_name", F.lit("\n"))
    sha = F.when(F.col("n") == 4, F.lit("0" * 16)).otherwise(T.body_hash(body))
    mark = lambda cfg, pdf: F.concat(body, F.lit(K.MARKER + " "), F.to_json(F.struct(F.col("name").alias("src"), "bytes", cfg.alias("cfg"), sha.alias("sha"), pdf.alias("pdf"))), F.lit(" -->\n"))
    text = (
        F.when(F.col("n") == 1, F.lit("notes of my own\n"))
        .when(F.col("n") == 2, F.concat(F.lit("- **원본 파일**: "), "name", F.lit("\n")))
        .when(F.col("n") == 3, F.concat(F.lit("- **원본 파일**: "), "name", F.lit("\n" + K.MARKER + " {oops -->\n")))
        .when(F.col("n") == 5, mark(F.lit("cfg0"), F.col("pdf")))
        .when(F.col("n") == 6, mark(F.col("cfg"), F.lit("b.pdf")))
        .otherwise(mark(F.col("cfg"), F.col("pdf")))
    )
    return m, m.filter("n > 0").select("out_name", text.alias("text"))


@query
def plan_classify(t):
    media, outputs = _state(t)
    return planner.classify(media, outputs).select("rel_path", "out_name", "status")


@query
def manifest(t):
    media, _ = _state(t)
    return planner.manifest(media.withColumn("sha", T.body_hash(F.col("out_name"))))


def _rendered(t):
    return render.render_timeline(views.info(t), _marked(t))


@query
def render_lines(t):
    return _rendered(t).select("lecture_id", _long(F.col("line_no")).alias("line_no"), "text")


@query
def render_marked(t):
    lectures = views.info(t).select("lecture_id", F.col("file").alias("name"), (F.col("lecture_id") * 1000).alias("bytes"), F.lit("cfg1").alias("cfg"), F.coalesce("materials", F.lit("")).alias("pdf"))
    return render.marked(_rendered(t), lectures)


ORACLES = {k: v for k, v in oracles.SQL.items() if k in QUERIES}
