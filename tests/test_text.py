"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from stratavox import constants as K
from stratavox.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("sec, want", [(-5.0, "00:00:00"), (59.99, "00:00:59"), (3661.0, "01:01:01"), (360000.0, "100:00:00")])
def test_timestamp(spark, sec, want):
    assert one(spark, sec, T.timestamp, "double") == want


@pytest.mark.parametrize("name, want", [("6주차교재", 6), ("6협상스타일", 6), ("교재", None)])
def test_week(spark, name, want):
    assert one(spark, name, T.week) == want


@pytest.mark.parametrize("name, want", [("창업과실용법률 12-1강", ("창업과실용법률", 12, 1)), ("특강", ("특강", None, None))])
def test_course(spark, name, want):
    assert tuple(one(spark, name, lambda c: F.struct(*T.course(c)))) == want


@pytest.mark.parametrize("text, want", [("", set()), ("a", set()), ("ab", {"ab"}), ("a-B a", {"ab", "ba"})])
def test_bigrams(spark, text, want):
    assert set(one(spark, text, T.bigrams)) == want


@pytest.mark.parametrize("text, want", [("끝.", True), ("소득세율은 3.", False), ("정말…", True), ("아니", False), ("", False), ("end. ", True)])
def test_ends_sentence(spark, text, want):
    assert one(spark, text, T.ends_sentence) is want


@pytest.mark.parametrize("lines, want", [(["H O N G I K"], None), (["01"], None), (["ㅅ 트 변 그 즈다"], None), (["HItI text"], None), (["표본 크기와 신뢰구간"], "표본 크기와 신뢰구간"), ([], None), (["01", "Opening words"], "Opening words")])
def test_title(spark, lines, want):
    assert one(spark, lines, T.title, "array<string>") == want


def test_line_scores(spark):
    s = "HAS 많이 하는 편이고"
    assert one(spark, s, T.mixed_scripts) == 1
    assert one(spark, [s], T.reading_score, "array<string>") == 1
    assert one(spark, s, lambda c: T.line_score(c, F.lit(90.0))) == pytest.approx(88.6)


@pytest.mark.parametrize("text, want", [("the same long phrase." * 3, True), ("short one." * 3, False), ("", False), ("the same long phrase. other words entirely. the same long phrase.", False)])
def test_hallucinated(spark, text, want):
    assert one(spark, text, T.hallucinated) is want


@pytest.mark.parametrize("lp, ns, want", [(None, None, False), (-0.9, 0.6, False), (-0.91, 0.0, True), (0.0, 0.61, True)])
def test_suspect(spark, lp, ns, want):
    df = spark.createDataFrame([(lp, ns)], "a double, b double")
    assert df.select(T.suspect(F.col("a"), F.col("b"))).first()[0] is want


def test_body_hash_stops_at_the_first_marker(spark):
    body = "# a\nb\n"
    assert one(spark, body, T.body_hash) == one(spark, body.replace("\n", "\r\n") + K.MARKER + " {} -->\n" + K.MARKER, T.body_hash)


def test_short_name(spark):
    assert one(spark, "x" * 120, T.short_name) == "x" * 120
    assert one(spark, "x" * 119 + "  y", T.short_name) == "x" * 119 + "~"


def test_numeric_bigrams_are_those_of_the_expression(spark):
    """Every code point folds as ``flat`` does, and the work of a text isn't interpreted by the character."""
    import time

    from stratavox.functions import pairs

    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    flat = spark.createDataFrame([(k, "".join(f"{chr(i)}\n" for i in points[k : k + 4096])) for k in range(0, len(points), 4096)], "k int, s string")
    got = flat.select("k", T.flat(F.col("s")).alias("f")).collect()
    assert all(r["f"] == "".join(chr(c) for i in points[r["k"] : r["k"] + 4096] if (c := int(pairs._FOLD[i]))) for r in got)
    texts = [None, "", "a", "Ab", "a b\n가-나다", "aaaa", "İK x", "😀a😀b", "0" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    assert all(r["a"] == r["b"] for r in df.select(F.sort_array(T.bigrams(F.col("s"))).alias("a"), pairs.bigrams(F.col("s")).alias("b")).collect())
    long = spark.range(40, numPartitions=1).select(F.concat(F.repeat(F.lit("Lorem ipsum 가나다 "), 6000), F.col("id").cast("string")).alias("s"))
    began = time.time()
    assert long.select(F.sum(F.size(pairs.bigrams(F.col("s"))))).first()[0] > 0
    assert time.time() - began < 5  # 4 million characters


def test_words_have_no_interpreted_step(spark):
    """Words and their sorting for a whole table: lambdas and array_sort's comparison would be interpreted for each word."""
    import __spark_entry__ as entry

    plan = entry.queries()["slide_key"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "array_sort" not in plan
    df = spark.createDataFrame([(None,), ("",), ("a",), ("Ab-c ab",), ("가 나다 x1 x1",)], "s string")
    for least, want in ((2, [None, [], [], ["ab"], ["나다", "x1"]]), (1, [None, [], ["a"], ["ab", "c"], ["가", "나다", "x1"]])):
        assert [r["w"] for r in df.select(T.folded_words(F.col("s"), least).alias("w")).collect()] == want
