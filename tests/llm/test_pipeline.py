"""The whole pipeline on a small corpus, against a brute-force version of its stages."""

import random
import re

import tiktoken

import corpus_pipeline
from stratavox.llm import op4_bpe as bpe

TOXIC = ("wugplex", "blimbor", "quazzle")


def sentence(r, n):
    return " ".join("".join(r.choice("etaoinshrd") for _ in range(r.randint(2, 6))) for _ in range(n))


def corpus():
    r = random.Random(12)
    docs, labels, items = [], [], [(i, sentence(r, 25)) for i in range(6)]

    def add(text, toxic=None):
        docs.append((len(docs), text, "en", f"s{len(docs) % 3}", len(text or "")))
        if toxic is not None:
            labels.append((len(docs) - 1, 1, toxic))
        return text

    for i in range(300):
        base = sentence(r, r.randint(30, 80)).split()
        if i % 8 == 0:
            for w in TOXIC:
                base.insert(r.randint(0, len(base)), w)
        add(" ".join(base), int(i % 8 == 0) if i < 250 else None)
        clean = i % 8 > 0
        if clean and i % 9 == 0:
            for _ in range(r.choice([1, 5])):
                add(" ".join(base))
        if clean and i % 10 == 3:
            for _ in range(2):
                at = r.randrange(len(base))
                add(" ".join([*base[:at], "zz", *base[at + 1 :]]))
        if clean and i % 11 == 1:
            add(sentence(r, 20) + " " + r.choice(items)[1].upper() + ", " + sentence(r, 20))
    for t in (None, "", "w u g p l e x, b l i m b o r! wu9plex", "日本語"):
        add(t)
    return docs, labels, items


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    keep = [d for d in docs if not set(TOXIC) & set(words(d[1])) and "w u g p l e x" not in (d[1] or "")]
    seen: set[str] = set()
    keep = [d for d in keep if d[1] is None or not (d[1] in seen or seen.add(d[1]))]
    sets = {d[0]: (set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} - {()}) for d in keep for w in [words(d[1])]}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    keep = [d for d in keep if find(d[0]) == d[0]]
    return [d for d in keep if not any(" ".join(words(t)) in " ".join(words(d[1])) for _, t in items)]


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": (items, "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(docs, items)
    assert sorted(r["doc_id"] for r in got) == sorted(d[0] for d in want)
    v = bpe.Vocabulary.read(bpe.RANKS)
    ref = tiktoken.Encoding("ref", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    text = {d[0]: d[1] for d in want}
    assert all(r["tokens"] == (None if text[r["doc_id"]] is None else ref.encode_ordinary(text[r["doc_id"]])) for r in got)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, labels, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(labels[:9], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items[:2], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs[:20], []):
        df = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, df, str(tmp_path))
            assert got.columns == df.columns and (got.count() > 0) == bool(rows)


def test_odd_rows_through_the_whole_pipeline(spark, tmp_path):
    _, labels, items = corpus()
    r = random.Random(2)
    a, b, c = (sentence(r, 40) for _ in range(3))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, c), (None, a), (None, None), (4, None), (5, ""), (6, "!!!"), (7, sentence(r, 4) * 3000), (8, items[0][1]), (None, items[0][1])]
    spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, __n int, gone_id int, leak_hash int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(x["doc_id"]) for x in got) == sorted(["1", "3", "None", "None", "4", "5", "6", "7"])
    assert all(x["round_trip"] in (True, None) for x in got)
    # nothing to work on, no labels, no benchmark
    for n in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{n}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
