"""Exact and near dedup: brute force, planted cases, odd inputs."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratavox.llm import op1_near_dedup as near
from stratavox.llm import op10_exact_dedup as exact

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators use or used themselves.
CLASHING = ["comp", "bands", "__n", "__drop", "__only", "__id", "h", "gone_id", "COPY_ID", "copy_hash", "row", "k0", "n", "key", "kept", "links", "rid", "digest", "a.b"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def test_misra_gries_error_is_bounded():
    r = np.random.default_rng(1)
    keys = np.concatenate([r.integers(0, 10**6, 20_000), np.full(3000, 7), np.full(900, 8)])
    r.shuffle(keys)
    m = exact.MisraGries(50)
    for part in np.array_split(keys, 9):
        m.update(pd.Series(part))
    assert len(m.counts) <= 50 and m.error <= len(keys) / 51
    assert 3000 - m.error <= m.counts[7] <= 3000


@pytest.mark.parametrize("heavy, counters", [(exact.HEAVY, exact.COUNTERS), (20, 80), (4, 16)])
def test_exact_against_brute_force(spark, heavy, counters):
    r = random.Random(3)
    texts = [sentence(r, 5) for _ in range(60)] + [""]
    rows = [(i, r.choice(texts[:3]) if i % 2 else r.choice(texts)) for i in range(400)] + [(900, None), (901, None), (None, texts[0])]
    first = {}
    for i, t in sorted((x for x in rows if None not in x), key=lambda x: x[0]):
        first.setdefault(t, i)
    got = exact.exact_duplicates(docs(spark, rows), heavy, counters).collect()
    assert len(got) == len(rows)
    assert {(x["doc_id"], x["keeper_id"]) for x in got} == {(i, i if t is None or i is None else first[t]) for i, t in rows}
    kept = exact.drop_copies(docs(spark, rows).withColumns({c: F.lit(1) for c in CLASHING}), heavy, counters)
    assert kept.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *CLASHING]
    assert sorted((x["doc_id"] for x in kept.collect()), key=str) == sorted([*first.values(), 900, 901, None], key=str)


def test_exact_repeated_rows_and_empty_table(spark):
    assert sorted(x["doc_id"] for x in exact.drop_copies(docs(spark, [(1, "a"), (1, "a"), (1, "b"), (2, "b")])).collect()) == [1, 1]
    assert [x["kept"] for x in exact.exact_duplicates(docs(spark, [(1, "a"), (1, "a")])).orderBy("kept").collect()] == [False, True]
    assert exact.exact_duplicates(docs(spark, [])).count() == 0 and exact.drop_copies(docs(spark, [])).count() == 0


def shingles(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w)} if 0 < len(w) < 3 else set(zip(w, w[1:], w[2:]))


def edit(r, text, share):
    return " ".join(r.choice(["xx", "yy", "zz"]) + w if r.random() < share else w for w in text.split())


def corpus(seed=5):
    r, rows = random.Random(seed), []
    for _ in range(60):
        base = sentence(r, r.randint(20, 120))
        rows.append(base)
        rows += [edit(r, base, r.choice([0.01, 0.03, 0.08])) for _ in range(r.choice([0, 0, 1, 2, 9]))]
    rows += [sentence(r, 3000), "one two", "one two", "!!!", "", None]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_near_against_brute_force(spark):
    rows = corpus()
    group = {x["doc_id"]: x["group_id"] for x in near.near_duplicates(docs(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows if t}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])]
    found = sum(group[a] == group[b] for a, b in pairs)
    assert len(pairs) > 200 and found >= 0.9 * len(pairs)
    # nothing is joined that brute force doesn't join
    part = {i: i for i in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        part[y] = x
    assert all(root(i) == root(group[i]) for i in sets)


def test_near_drops_all_but_one(spark):
    rows = corpus(6)
    df = docs(spark, rows)
    group = {x["doc_id"]: x["group_id"] for x in near.near_duplicates(df).collect()}
    out = near.drop_near_copies(df.withColumns({c: F.lit(0) for c in CLASHING}))
    assert out.columns == [*df.columns, *CLASHING]
    assert sorted(x["doc_id"] for x in out.collect()) == sorted({*group.values()})


def test_near_odd_inputs(spark):
    r = random.Random(1)
    a = sentence(r, 30)
    rows = [(1, a), (1, a), (2, a.upper() + "!"), (None, a), (3, None), (4, ""), (5, "...")]
    got = sorted((str(x["doc_id"]), str(x["group_id"]), x["kept"]) for x in near.near_duplicates(docs(spark, rows)).collect())
    assert got == sorted([("1", "1", True), ("1", "1", False), ("2", "1", False), ("None", "None", True), ("3", "3", True), ("4", "4", True), ("5", "5", True)])
    assert sorted(str(x["doc_id"]) for x in near.drop_near_copies(docs(spark, rows)).collect()) == ["1", "3", "4", "5", "None"]
    assert near.near_duplicates(docs(spark, [])).count() == 0 and near.drop_near_copies(docs(spark, [])).count() == 0


def test_estimates_are_close():
    r = random.Random(2)
    base = [sentence(r, 1) + str(i) for i in range(800)]
    for keep in (0.3, 0.6, 0.9):
        other = [w if i < keep * 800 else w + "q" for i, w in enumerate(base)]
        regs, some, _ = near.sketches(pa.array([" ".join(base), " ".join(other)]))
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        assert some.all() and abs(near.estimate(regs[:1], regs[1:])[0] - len(a & b) / len(a | b)) < 0.13


def test_sketches_merge():
    r = random.Random(4)
    a, b = sentence(r, 50), sentence(r, 60)
    x, _, _ = near.sketches(pa.array([a, b]))
    s = np.concatenate([s for _, s, _ in near.shingles(pa.array([a]))] + [s for _, s, _ in near.shingles(pa.array([b]))])
    s = (s >> np.uint64(32)).astype(np.uint32)
    union = near.registers(np.array([(s * k + c).min() for k, c in zip(near._A, near._C)], np.uint32))
    assert (np.maximum(x[0], x[1]) == union).all()


def test_components_of_a_chain(spark):
    from stratavox.llm.common import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x long, y long")
    got = {r["doc_id"]: r["comp"] for r in near.components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_repeated_rows_with_clashing_columns(spark):
    r = random.Random(1)
    a, b = sentence(r, 30), sentence(r, 30)
    df = docs(spark, [(1, a), (1, a), (2, b), (3, a), (2, b)]).withColumns({c: F.when(F.rand(1) < 2, F.monotonically_increasing_id()) for c in CLASHING})
    df = spark.createDataFrame(df.collect(), df.schema)
    for drop in (near.drop_near_copies, exact.drop_copies):
        got = drop(df).collect()
        assert sorted(x["doc_id"] for x in got) == [1, 2] and got[0].asDict().keys() == set(df.columns)
        # the first in the order of all columns
        assert {x["doc_id"]: x["comp"] for x in got} == {i: min((str(x["comp"]) for x in df.collect() if x["doc_id"] == i)) and min((x["comp"] for x in df.collect() if x["doc_id"] == i), key=str) for i in (1, 2)}
        assert drop(spark.createDataFrame([], df.schema)).count() == 0


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_untried_pairs_are_complete(spark, block):
    from stratavox.llm.common import Scratch

    r = np.random.default_rng(4)
    ids, comp = np.arange(60), np.where(np.arange(60) < 35, 0, np.arange(60) % 9 * 4 + 36)
    regs = r.integers(0, 2, (60, near.M)).astype(np.uint16)
    regs[::5] = regs[0]
    regs[0, :20] = 900
    key = r.integers(0, 4, 60)
    sketch = spark.createDataFrame([(int(i), bytearray(x.tobytes())) for i, x in zip(ids, regs)], "doc_id long, regs binary")
    shared = spark.createDataFrame([(int(k), int(i)) for k, i in zip(key, ids)], "key long, doc_id long")
    named = spark.createDataFrame([(int(i), int(c)) for i, c in zip(ids, comp)], "doc_id long, comp long")
    got = sorted(tuple(x) for x in near.untried(shared, named, sketch, 0.6, Scratch(spark, "t"), block).collect())
    least = int(near.M * near._least(0.6))
    want = [(a, b) for a in range(60) for b in range(a + 1, 60) if key[a] == key[b] and comp[a] != comp[b] and (regs[a] % 256 == regs[b] % 256).sum() >= least]
    assert got == want and len(want) > 20


def test_a_large_bucket_of_strangers_costs_no_pairs():
    n = 50_000  # one component, and two strangers of which one is alike
    comp = np.append(np.zeros(n, np.int64), [7, 8])
    sig = np.zeros((n + 2, near.M), np.uint8)
    sig[-1] = 9
    doc = np.arange(n + 2)
    pairs = [p for x, y in near.compared(np.zeros(n + 2, int), comp, (comp == 0).astype(np.int64), doc, sig, 80) for p in zip(x.tolist(), y.tolist())]
    assert len(pairs) == n and {y for _, y in pairs} == {n}


def test_links_and_scripts(spark):
    r = random.Random(3)
    base = sentence(r, 40)
    han = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(60))
    rows = [(1, base), (2, base.upper()), (3, base + " xx"), (4, sentence(r, 40)), (5, han), (6, han[:30] + "好" + han[30:]), (7, "“" + base.replace(" ", "—") + "”"), (8, "Привет ΜΕΓΑΣ мир"), (9, "ПРИВЕТ μεγασ МИР")]
    got = {x["doc_id"]: (x["group_id"], x["links"]) for x in near.near_duplicates(docs(spark, rows)).collect()}
    assert {i: g for i, (g, _) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 1, 8: 8, 9: 8}
    assert {i: n for i, (_, n) in got.items()} == {1: 3, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1}
