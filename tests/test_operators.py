"""Relational and ordered operators on literal cases and against independent specifications."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavox import constants as K
from stratavox.operators import materials, paragraphs, planner, render, screens

SEG = "lecture_id string, seq int, start_s double, end_s double, text string, avg_logprob double, no_speech_prob double"


def paras(spark, rows, bad=()):
    df = spark.createDataFrame([("l", i, float(a), float(b), t, -1.0 if i in bad else None, None) for i, (a, b, t) in enumerate(rows)], SEG)
    return [(r["start_s"], r["text"], r["suspect"]) for r in paragraphs.paragraphs(df).orderBy("para_no").collect()]


def test_paragraphs(spark):
    rows = [(0, 5, "Hello there"), (5, 12, "and more."), (12, 21, "Third part"), (21, 26, "ends here."), (26, 30, "Next"), (32, 34, "gap after"), (34, 35, "  "), (35, 36, "소득세율은 3.")]
    assert paras(spark, rows, {3, 6}) == [(0, "Hello there and more.", False), (12, "Third part ends here. Next", True), (32, "gap after 소득세율은 3.", False)]
    assert len(paras(spark, [(0, 10, "a" * 651), (10, 11, "b")])) == 2
    assert len(paras(spark, [(0, 30, "x"), (30, 45, "y")])) == 2
    assert len(paras(spark, [(0, 30, "x"), (30, 44.9, "y")])) == 1
    assert paras(spark, []) == []


def spec(rows):
    out, cur = [], None
    for a, b, t in rows:
        t = t.strip()
        if not t:
            continue
        if cur:
            long = b - cur[0]
            s = cur[1].rstrip()
            end = s[-1:] in ".!?\"'”…" and not (s[-1:] == "." and s[-2:-1].isdigit())
            if a - cur[2] >= 2 or len(cur[1]) >= 650 or long >= 45 or ((long >= 20 or len(cur[1]) >= 300) and end):
                out.append((cur[0], cur[1]))
                cur = None
        cur = [a, t, b] if cur is None else [cur[0], cur[1] + " " + t, b]
    return out + ([(cur[0], cur[1])] if cur else [])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6))
def test_paragraphs_against_specification(spark, seed):
    r, t, rows = random.Random(seed), 0.0, []
    for _ in range(120):
        t += r.choice([0.0, 0.5, 1.99, 2.0, 3.0])
        d = r.choice([0.5, 3.0, 9.0])
        rows.append((t, t + d, r.choice(["ab cd.", "word", " ", "3.", "long " * 20, "what?"])))
        t += d
    got = paras(spark, rows)
    assert [(a, b) for a, b, _ in got] == spec(rows)
    assert " ".join(x[1] for x in got) == " ".join(t.strip() for _, _, t in rows if t.strip())


SLIDE = "lecture_id string, slide_no int, t_s double, lines array<string>"


def slides(spark, rows):
    return spark.createDataFrame([("l", i, float(t), x) for i, (t, x) in enumerate(rows)], SLIDE)


def test_merge_screens(spark):
    rows = [(0, ["alpha beta gamma delta"]), (30, ["alpha beta gamma delta epsilon"]), (45, []), (50, ["a b c"]), (60, ["zeta eta theta iota"]), (90, ["kappa lamda omicron"]), (120, ["alpha beta"]), (150, ["sigma tau"]), (180, ["phi chi"]), (210, ["alpha beta gamma"])]
    got = screens.merge_screens(slides(spark, rows)).orderBy("t_s").collect()
    assert [r["t_s"] for r in got] == [0, 60, 90, 150, 180, 210]
    assert got[0]["lines"] == ["alpha beta gamma delta epsilon"]


def test_merge_threshold(spark):
    for n, k, merged in ((100, 55, 2), (100, 56, 1), (20, 11, 1)):
        a, b = [f"w{i:03d}" for i in range(n)], [f"w{i:03d}" for i in range(n - k, 2 * n - k)]
        assert screens.merge_screens(slides(spark, [(0, [" ".join(a)]), (30, [" ".join(b)])])).count() == merged


def test_merge_passes(spark):
    kind = "lecture_id string, frame_s double, pass_no int, line_no int, top int, text string, conf double"
    merge = lambda rows: screens.merge_passes(spark.createDataFrame([("l", 0.0, p, i, top, t, float(c)) for i, (p, top, t, c) in enumerate(rows)], kind)).first()["lines"]
    assert merge([(0, 10, "질문을", 80), (0, 40, "Abc def", 60), (1, 20, "HAS", 70), (1, 90, "foo bar", 90)]) == ["질문을", "Abc def", "foo bar"]
    assert merge([(0, 0, "ab", 70), (1, 0, "cd", 70)]) == ["ab"]
    assert len(merge([(0, 0, "ab", 70), (1, 25, "cd", 70)])) == 1
    assert len(merge([(0, 0, "ab", 70), (1, 26, "cd", 70)])) == 2


def h(a, b):
    return "".join(chr(0xAC00 + i) for i in range(a, b))


def aligned(spark, lines, pages):
    p = spark.createDataFrame([("l", i, f"{i}쪽", t) for i, t in enumerate(pages)], "lecture_id string, page_idx int, label string, text string")
    return [r["page_label"] for r in materials.align(slides(spark, [(30 * i, [x]) for i, x in enumerate(lines)]), p).orderBy("slide_no").collect()]


def test_align(spark):
    pages, trap = [h(0, 19), h(100, 140), h(33, 51)], h(0, 51)
    assert aligned(spark, [trap], pages) == ["0쪽"]
    assert aligned(spark, [pages[1], trap], pages) == ["1쪽", None]
    assert aligned(spark, [pages[1], pages[1], trap, trap, pages[1]], pages) == ["1쪽", None, None, "1쪽"]
    assert aligned(spark, ["abcdefg"], ["abcd"]) == [None]
    assert aligned(spark, ["abcdefg"], ["abcdef"]) == ["0쪽"]
    assert aligned(spark, ["abcde"], ["abcde"]) == [None]
    assert aligned(spark, ["abcdef"], ["abcdef"]) == ["0쪽"]


def test_spans_ends_and_labels(spark):
    kinds = [K.SUBTITLE if c == "J" else K.SLIDE for c in "SJJSJSJJJ"]
    s = spark.createDataFrame([("l", i, float(i), ["x"], k) for i, k in enumerate(kinds)], SLIDE + ", kind string")
    assert [(r["from_s"], r["to_s"]) for r in screens.video_spans(s).orderBy("span_no").collect()] == [(1, 2), (6, 8)]
    info = spark.createDataFrame([("l", 5.0)], "lecture_id string, duration_s double")
    assert screens.screen_ends(s, info).filter("slide_no = 8").first()["end_s"] == 5.0
    p = lambda t: spark.createDataFrame([("l", 0, t, "alpha beta", False)], "lecture_id string, para_no int, start_s double, text string, suspect boolean")
    one = slides(spark, [(100, ["Alpha beta"])])
    assert screens.label_screens(one, p(125.0)).first()["kind"] == K.SUBTITLE
    assert screens.label_screens(one, p(125.001)).first()["kind"] == K.SLIDE
    assert screens.label_screens(one, p(75.0)).first()["kind"] == K.SUBTITLE


def test_names(spark):
    m = spark.createDataFrame([(x, 1) for x in ("A.mp3", "a (mp4).wav", "a.mp4")], "rel_path string, bytes long")
    assert {r["rel_path"]: r["out_name"] for r in planner.names(m).collect()} == {"A.mp3": "A (mp3)", "a (mp4).wav": "a (mp4)", "a.mp4": "a (mp4) (2)"}


def test_materials(spark):
    m = spark.createDataFrame([("x", "회계 6-1강"), ("y", "···")], "lecture_id string, stem string")
    d = spark.createDataFrame([("1", "회계 6주차"), ("2", "회계 7주차"), ("3", "회계")], "name string, stem string")
    assert sorted((r["lecture_id"], r["material"]) for r in materials.match_materials(m, d).collect()) == [("x", "1"), ("x", "3")]


def test_classify(spark):
    from stratavox.functions import text as T

    body = "# a\n"
    sha = spark.range(1).select(T.body_hash(F.lit(body))).first()[0]
    mark = lambda b=1, c="c", s=sha, p="": body + f'{K.MARKER} {{"src":"f","bytes":{b},"cfg":"{c}","sha":"{s}","pdf":"{p}"}} -->\n'
    outs = {"mine": "notes", "head": "- **원본 파일**: f\n", "broken": "- **원본 파일**: f\n" + K.MARKER + " {x -->\n", "edited": mark(s="0"), "done": mark(), "bytes": mark(b=2), "pdf": mark(p="z.pdf")}
    media = spark.createDataFrame([(k, "f", 1, k, "c", "") for k in [*outs, "new"]], "rel_path string, name string, bytes long, out_name string, cfg string, pdf string")
    got = {r["out_name"]: r["status"] for r in planner.classify(media, spark.createDataFrame(list(outs.items()), "out_name string, text string")).collect()}
    assert got == {"new": "target", "mine": "blocked", "head": "target", "broken": "target", "edited": "edited", "done": "done", "bytes": "rebuilt", "pdf": "rebuilt"}


def test_render(spark, tmp_path):
    lectures = spark.createDataFrame([("l", "f.mp4", "회계 6-1강", "ko", 0.125, 60.0, 30.0, "a.pdf")], "lecture_id string, file string, stem string, language string, language_probability double, duration_s double, duration_after_vad_s double, materials string")
    s = spark.createDataFrame([("l", 0, 10.0, ["표본 크기", "x"], "1쪽", K.SLIDE, 60.0)], SLIDE + ", page_label string, kind string, end_s double")
    p = spark.createDataFrame([("l", 0, 10.0, "말", True, False)], "lecture_id string, para_no int, start_s double, text string, suspect boolean, video boolean")
    spans = spark.createDataFrame([], "lecture_id string, span_no int, from_s double, to_s double")
    r = render.render(lectures, s, p, spans, screens.contents(s))
    lines = [x["text"] for x in r.orderBy("line_no").collect()]
    assert lines[:9] == ["---", "과목: 회계", "주차: 6", "교시: 1", "언어: ko", "길이: 00:01:00", "원본: f.mp4", "강의자료: a.pdf", "---"]
    assert "- **언어**: ko  (자동 감지, 확신도 12%)" in lines
    assert "- `[00:00:10]` · 1쪽 표본 크기" in lines
    assert lines[-6:] == ["> **🖵 슬라이드 1쪽 [00:00:10 – 00:01:00]**", "> 표본 크기", "> x", "", "**[00:00:10]** ⚠ 말", ""]
    render.write(r, str(tmp_path / "out"))
    assert (next((tmp_path / "out").glob("lecture_id=l/*.txt"))).read_text() == "\n".join(lines) + "\n"


def test_fold_of_paragraphs_has_no_regular_expression(spark):
    """A text ends as its last segment does, wherever that is cut; so sentences' ends are looked for before the fold."""
    texts = ["It is 3", ".", "x 3.", "\u2003\u201cend\u201d\u2028", "No. 3.", "a", "!", "3."]
    rows = [("l", i, 21.0 * i, 21.0 * i + 20.5, t, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SEG)
    assert [r["text"] for r in paragraphs.paragraphs(df).orderBy("para_no").collect()] == ["It is 3 .", "x 3. \u201cend\u201d", "No. 3. a", "!", "3."]
    fold = [x for x in paragraphs.paragraphs(df)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "aggregate(segs" in x]
    assert len(fold) == 1 and "RLIKE" not in fold[0] and "regexp" not in fold[0]


def test_same_answer_for_any_partitioning(spark):
    rows = [("l%d" % (i % 5), i, float(i), i + 0.8, f"word {i}.", None, None) for i in range(200)]
    df = spark.createDataFrame(rows, SEG)
    a = paragraphs.paragraphs(df.repartition(1)).orderBy("lecture_id", "para_no").collect()
    b = paragraphs.paragraphs(df.orderBy(F.rand(3)).repartition(7)).orderBy("lecture_id", "para_no").collect()
    assert a == b


def test_written_documents_are_known_to_the_next_plan(spark):
    lines = [(1, 0, "# a"), (1, 1, "- **원본 파일**: a.mp4"), (1, 2, "text"), (2, 0, "# b"), (2, 1, "other")]
    lectures = spark.createDataFrame([(1, "a.mp4", 10, "c", ""), (2, "b.mp4", 20, "c", "p.pdf")], "lecture_id long, name string, bytes long, cfg string, pdf string")
    made = render.marked(spark.createDataFrame(lines, "lecture_id long, line_no int, text string"), lectures)
    outputs = made.select(F.col("lecture_id").cast("string").alias("out_name"), "text")
    media = lectures.select(F.col("name").alias("rel_path"), "name", "bytes", F.col("lecture_id").cast("string").alias("out_name"), "cfg", "pdf")
    status = lambda m, o: sorted(r["status"] for r in planner.classify(m, o).collect())
    assert status(media, outputs) == ["done", "done"]
    assert status(media, outputs.withColumn("text", F.regexp_replace("text", "other", "edited"))) == ["done", "edited"]
    assert status(media.withColumn("cfg", F.lit("d")), outputs) == ["rebuilt", "rebuilt"]
    bare = outputs.select("out_name", F.lit("- **원본 파일**: x.mp4\n- **원본 파일**: a.mp4\n").alias("text"))
    assert status(media, bare) == ["blocked", "target"]


def test_materials_make_no_pair_that_does_not_match(spark):
    """A thousand lectures and documents that share a word but no match: the joins may not pair them."""
    m = spark.createDataFrame([(i, f"회계 {i + 1}-1강") for i in range(1000)], "lecture_id long, stem string")
    d = spark.createDataFrame([(f"{i}.pdf", f"회계 교재 {i % 2 + 5001}주차") for i in range(1000)] + [("x", "회계 7주차"), ("x", "회계 7주차"), ("y", "회계"), (None, "회계 8주차"), ("z", None)], "name string, stem string")
    got = materials.match_materials(m, d)
    assert sorted((r["lecture_id"], str(r["material"])) for r in got.collect() if r["material"] != "y") == [(6, "x"), (6, "x"), (7, "None")]
    assert got.count() == 1003
    many = spark.range(40_000)
    m, d = many.select(F.col("id").alias("lecture_id"), F.lit("회계 6-1강").alias("stem")), many.select(F.col("id").cast("string").alias("name"), F.lit("회계 7주차").alias("stem"))
    assert materials.match_materials(m, d).count() == 0
    pages = spark.createDataFrame([("3", 1, "a"), ("3", 2, "b")], "material string, page_no int, text string")
    d = d.withColumn("stem", F.lit("회계 6주차"))
    out = materials.matched_pages(m.filter("lecture_id < 3"), d, pages)
    assert sorted((r["lecture_id"], r["page_idx"], r["label"]) for r in out.collect()) == [(i, k, f"{k + 1}쪽") for i in range(3) for k in range(2)]


def test_merging_is_a_stream(spark):
    """A lecture in small batches: merged screens are passed on as soon as they are beyond the look back."""
    import pyarrow as pa

    n = 10_000
    rows = lambda k: {"lecture_id": ["l"] * 100, "slide_no": list(range(100 * k, 100 * k + 100)), "t_s": [0.0] * 100, "lines": [["x"]] * 100, "words": [[f"w{100 * k + i}"] for i in range(100)], "score": [1] * 100}
    held, seen = 0, 0
    batches = (pa.RecordBatch.from_pydict(rows(k)) for k in range(n // 100))
    for k, out in enumerate(screens._merge(batches)):
        seen += out.num_rows
        held = max(held, 100 * (k + 1) - seen) if k < n // 100 else held
    assert seen == n and held <= K.LOOK_BACK
    two = slides(spark, [(0, ["alpha beta"]), (30, ["alpha beta gamma"]), (60, ["delta"])])
    both = two.union(two.withColumn("lecture_id", F.lit(None).cast("string"))).union(two.withColumn("lecture_id", F.lit("k")))
    got = sorted((str(r["lecture_id"]), r["t_s"], r["lines"]) for r in screens.merge_screens(both).collect())
    assert got == [(k, t, x) for k in ("None", "k", "l") for t, x in ((0, ["alpha beta gamma"]), (60, ["delta"]))]


def test_timeline_has_one_shuffle_and_the_parts_results(spark):
    """Labels, flags, counts and documents of random lectures: as from the separate operators, from one shuffle by lecture."""
    import re

    r = random.Random(5)
    word = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "Epsilon words"]) for _ in range(n))
    p, s, t = [], [], {"a": 0.0, "b": 50.0, "c": 7.0}
    for i in range(150):
        k = r.choice("aab")
        t[k] += r.choice([0.1, 3.3, 24.9, 25.0, 60.0])
        p.append((k, i, t[k], word(4), r.random() < 0.3))
        s.append((k, i, t[k] + r.choice([0.0, 25.0, -25.0, 11.1]), [word(r.choice([1, 9]))] * r.choice([0, 1, 1, 2]), r.choice([None, "1쪽"])))
    p.append(("c", 0, 1.0, "alone", True))
    s.append(("d", 0, 1.0, ["alone too"], None))
    p = spark.createDataFrame(p, "lecture_id string, para_no int, start_s double, text string, suspect boolean")
    s = spark.createDataFrame(s, SLIDE + ", page_label string")
    marked = screens.marked_timeline(screens.timeline(s, p))
    labelled = screens.label_screens(s, p)
    near = s.alias("s").join(p.alias("p"), F.expr("s.lecture_id = p.lecture_id AND abs(start_s - t_s) <= 25"), "left").groupBy("s.lecture_id", "slide_no", "lines").agg(F.collect_list("text").alias("said")).collect()
    words = lambda x: {w for w in " ".join(x).lower().split() if len(w) > 1}
    want = {(x["lecture_id"], x["slide_no"]): K.SUBTITLE if (sw := words(x["lines"])) and sum(map(len, x["lines"])) <= 90 and len(sw & words(x["said"])) / len(sw) >= 0.6 else K.SLIDE for x in near}
    assert {(x["lecture_id"], x["slide_no"]): x["kind"] for x in labelled.collect()} == want and set(want.values()) == {K.SUBTITLE, K.SLIDE}
    spans = screens.video_spans(labelled)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(marked.filter("para IS NOT NULL").select("lecture_id", "para.para_no", "video")) == rows(screens.in_video(p, spans).select("lecture_id", "para_no", "video"))
    assert rows(marked.filter("span IS NOT NULL").select("lecture_id", "span.*")) == rows(spans.select("lecture_id", "from_s", "to_s"))
    assert rows(render.timeline_summary(marked)) == rows(render.summary(labelled, p, spans))
    info = spark.createDataFrame([(k, "f.mp4", "회계 6-1강", "ko", 0.125, 9e3, 30.0, None) for k in "abcde"], "lecture_id string, file string, stem string, language string, language_probability double, duration_s double, duration_after_vad_s double, materials string")
    parts = render.render(info, screens.screen_ends(labelled, info), screens.in_video(p, spans), spans, screens.contents(labelled))
    assert rows(render.render_timeline(info, marked)) == rows(parts)
    for df in (labelled, marked, render.timeline_summary(marked)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # the ends of the union, which come from different tables here
        assert len(re.findall(r"Exchange hashpartitioning\(lecture_id", plan)) <= 2 and "Join" not in plan


def test_no_worker_gets_a_whole_lecture(spark, monkeypatch, tmp_path):
    """Screens of one long lecture are compared with its pages in chunks; shares and choice are those of brute force."""
    real = materials._shares

    def shares(left, right):
        assert left.num_rows <= 512
        return real(left, right)

    monkeypatch.setattr(materials, "_shares", shares)
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh 가나") for _ in range(n))
    pages = [text(r.choice([1, 9, 40])) for _ in range(30)]
    lines = [r.choice([text(12), r.choice(pages), r.choice(pages)[:30] + text(9)]) for _ in range(1200)]
    s = slides(spark, [(30 * i, [x]) for i, x in enumerate(lines)])
    s = s.union(s.withColumn("lecture_id", F.lit(None).cast("string")).filter("slide_no < 5"))
    p = spark.createDataFrame([(k, i, f"{i}쪽", t) for i, t in enumerate(pages) for k in ("l", None)], "lecture_id string, page_idx int, label string, text string")
    cut = lambda x: (lambda f: {f[i : i + 2] for i in range(len(f) - 1)})(x.replace(" ", ""))
    ks, ps, want, labels, last = [cut(x) for x in lines], [cut(x) for x in pages], {}, {}, None
    for i, k in enumerate(ks):
        if len(k) < K.MIN_BIGRAMS:
            continue
        share = {j: len(k & q) / len(k) for j, q in enumerate(ps) if q}
        want |= {(i, j): v for j, v in share.items() if v}
        adj = {j: v + (K.FORWARD_BONUS if last is not None and last <= j <= last + K.FORWARD_PAGES else 0.0) for j, v in share.items()}
        best = max(adj, key=lambda j: (adj[j], -j))
        if share[best] >= (K.SHORT_SHARE if len(k) < K.SHORT_BIGRAMS else K.MATCH_SHARE):
            last = labels[i] = best
    got = materials.containment(s, p).collect()
    assert {(x["slide_no"], x["page_idx"]): x["r"] for x in got if x["lecture_id"]} == want
    assert {(x["slide_no"], x["page_idx"]) for x in got if not x["lecture_id"]} == {a for a in want if a[0] < 5}
    shown = {x["slide_no"]: x["page_label"] for x in materials.align(s, p).filter("lecture_id = 'l'").collect()}
    assert shown == {i: f"{labels[i]}쪽" if i in labels else None for i in range(1200) if i not in labels or labels.get(i - 1) != labels[i]}


def test_align_moves_lines_twice(spark):
    """A repeated page is found among the chosen ones, without lines: no window, and no exchange of lines but by chunk and for the result."""
    import re

    s = slides(spark, [(0, [h(0, 19)]), (30, [h(0, 19)]), (60, ["x"]), (90, [h(0, 19)]), (120, [h(100, 140)]), (150, [h(0, 19)])]).filter("slide_no <> 2")
    p = spark.createDataFrame([("l", 0, "A", h(0, 19)), ("l", 1, "A", h(100, 140)), ("m", 0, "B", h(0, 19))], "lecture_id string, page_idx int, label string, text string")
    out = materials.align(s.union(s.withColumn("lecture_id", F.lit("m"))), p)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and len(re.findall("Join", plan)) == 4
    got = {k: sorted((r["slide_no"], r["page_label"]) for r in out.filter(F.col("lecture_id") == k).collect()) for k in "lm"}
    assert got == {"l": [(0, "A")], "m": [(0, "B"), (4, None), (5, "B")]}
