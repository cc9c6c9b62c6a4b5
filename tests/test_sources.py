"""Readers, configuration and the stream of lectures."""

from stratavox.operators import planner
from stratavox.sources import readers
from stratavox.streaming.lectures import SEGMENTS, paragraph_stream


def test_media_listing(spark, tmp_path):
    (tmp_path / "week 1").mkdir()
    for name, text in (("week 1/a b.mp4", "xx"), ("b.txt", "y"), ("~tmp.txt", "z")):
        (tmp_path / name).write_text(text)
    rows = planner.listing(readers.media(spark, str(tmp_path))).collect()
    assert sorted((r["rel_path"], r["bytes"], r["role"]) for r in rows) == [("b.txt", 1, "ignored"), ("week 1/a b.mp4", 2, "media"), ("~tmp.txt", 1, "hidden")]


def test_ocr_files(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('block_num\tpar_num\tline_num\ttop\tconf\ttext\n1\t1\t1\t5\t90.5\t"quoted\n1\t1\t1\t5\tx\tb\n')
    (tmp_path / "p.txt").write_text("one\n\ntwo")
    assert [r["text"] for r in readers.ocr_table(spark, str(tmp_path / "p.tsv")).collect()] == ['"quoted', "b"]
    assert [r["text"] for r in readers.ocr_text(spark, str(tmp_path / "p.txt")).orderBy("line_no").collect()] == ["one", "", "two"]


def test_config(tmp_path):
    (tmp_path / "a.ini").write_text("[Main]\nbeam_size = 99\nbatch_size = 1\n우선순위 = speed\n슬라이드_읽기 = maybe\n", encoding="cp949")
    c = readers.config(str(tmp_path / "a.ini"))
    assert (c.beam_size, c.batch_size, c.accurate, c.slides) == (10, 16, False, True)
    assert readers.ocr_languages("자동", "ko", {"kor", "eng"}) == ["kor", "eng"] and readers.ocr_languages("auto", "ko", {"eng"}) == ["eng"] and readers.ocr_languages("deu", "ko", set()) == ["deu"]


def test_paragraph_stream(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (1, 2):
        spark.createDataFrame([(f"l{n}", 0, 0.0, 5.0, "Hello", None, None), (f"l{n}", 1, 9.0, 12.0, "there", None, None)], SEGMENTS).write.mode("append").parquet(src)
        paragraph_stream(spark, src, sink, str(tmp_path / "c"), once=True).awaitTermination()
    assert sorted((r["lecture_id"], r["text"]) for r in spark.read.parquet(sink).collect()) == [("l1", "Hello"), ("l1", "there"), ("l2", "Hello"), ("l2", "there")]
