"""Token counts, toxicity, BPE, quality, language model, URLs, decontamination, chat: brute force and odd inputs."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from stratavox.llm import op2_token_counts as tokens
from stratavox.llm import op3_toxicity as toxic
from stratavox.llm import op4_bpe as bpe
from stratavox.llm import op5_quality as quality
from stratavox.llm import op6_brown_lm as brown
from stratavox.llm import op7_url_filter as urls
from stratavox.llm import op8_decontaminate as leaks
from stratavox.llm import op9_chat as chat
from stratavox.llm import textops

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "!!! ###"), (None, "plain words here"), (5, "the same"), (5, "the same"), (6, "long words and more of them " * 20_000), (7, "日本語 Ünïcödé \U0001f600")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def extra(df):
    for c in ("s", "e", "c", "h", "score", "kept", "n", "m"):
        df = df.withColumn(c, F.lit(1))
    return df


def sentence(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n))


# -- primitives -----------------------------------------------------------------------------------------------------


def test_words_don_t_cross_texts_or_hang_on_chunks():
    r = random.Random(1)
    texts = ["".join(r.choice("aB1 .é\n") for _ in range(r.randint(0, 30))) for _ in range(200)] + [None, ""]
    for size in (1, 50, 1 << 20):
        got = {}
        for a, _, w in textops.word_chunks(pa.array(texts, pa.string()), size):
            for t in range(len(w.first) - 1):
                got[a + t] = w.hash[w.first[t] : w.first[t + 1]].tolist()
        for t, x in enumerate(texts):
            assert got[t] == [textops.hash_word(v) for v in re.findall(r"[a-zé0-9]+", (x or "").lower())]


def test_words_of_all_scripts():
    cases = {
        "“Hello” a—b\u00a0c, it’s": "hello a b c it s", "ПРИВЕТ Š ÀÉ": "привет š àé", "日本語テ abc漢d": "日 本 語 テ abc 漢 d", "ก็ab": "ก็ ab", "한국어 텍스트": "한국어 텍스트", "a😀b": "a b", "ΜΕΓΑΣ": "μεγασ", "𐐀x": "𐐨x", "e\u0301a": "e\u0301a",
    }
    for text, want in cases.items():
        data, off = textops.raw(pa.array([text]))
        w = textops.words(data, off)
        assert [w.low[i:j].tobytes().decode() for i, j in zip(w.start, w.end)] == want.split(), text
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x11000)]))
    low = textops.lower(np.frombuffer(every.encode(), np.uint8)).tobytes().decode()
    assert all(y == x.lower() or len(x.encode()) != len(x.lower().encode()) or x == "ς" for x, y in zip(every, low))


# -- token counts ---------------------------------------------------------------------------------------------------


def best(word, scores, byte):
    top = [(0, 0)]
    for i in range(1, len(word) + 1):
        c = [(top[j][0] + scores[word[j:i]], top[j][1] - 1) for j in range(i) if word[j:i] in scores]
        if word[i - 1] not in scores:
            n = len(word[i - 1].encode())
            c.append((top[i - 1][0] + n * byte, top[i - 1][1] - n))
        top.append(max(c))
    return -top[-1][1]


def test_token_counts_against_viterbi(spark):
    scores, byte = tokens.pieces(tokens.MODEL)
    r = random.Random(2)
    texts = [sentence(r, 20, "etaoinshrdé") for _ in range(40)] + [t for _, t in ODD if t and len(t) < 100]
    got = [n for _, n in tokens.TrieCounter(scores, byte).counts(texts)]
    assert got == [sum(best(tokens.BEGIN + w, scores, byte) for w in t.split()) for t in texts]
    out = tokens.token_counts(extra(docs(spark, ODD))).collect()
    assert len(out) == len(ODD) and {r["doc_id"]: r["n_tokens"] for r in out}[1] is None
    assert [r["n_tokens"] for r in out if r["doc_id"] in (2, 3)] == [0, 0]
    assert tokens.token_counts(docs(spark, [])).count() == 0


# -- BPE ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(bpe.RANKS)


def test_bpe_round_trip_against_a_library(spark, vocabulary):
    ref = tiktoken.Encoding("ref", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    r = random.Random(3)
    rows = ODD + [(100 + i, "".join(r.choice("the ing é\n'€ 12,.<|endoftext|>") for _ in range(200))) for i in range(50)]
    got = bpe.encode(extra(docs(spark, rows))).collect()
    assert sorted(map(str, ((r["doc_id"], r["tokens"]) for r in got))) == sorted(map(str, ((i, None if t is None else ref.encode_ordinary(t)) for i, t in rows)))
    assert all(r["round_trip"] for r in got if r["tokens"] is not None)
    back = bpe.decode(bpe.encode(docs(spark, rows))).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in back))) == sorted(map(str, rows))
    assert bpe.encode(docs(spark, [])).count() == 0


def test_prefix_table_appends_and_edits(vocabulary):
    r = random.Random(4)
    piece = lambda n: bytes(r.choice(b"abcde \xc3\xa9theing") for _ in range(n))
    for _ in range(150):
        a = piece(r.randint(0, 300))
        t = bpe.Prefixes(vocabulary, a)
        assert vocabulary.decode(t.tokens()) == a
        i = r.randint(0, len(a))
        j, b, c = r.randint(i, min(len(a), i + 9)), piece(r.randint(0, 6)), piece(5)
        t.replace(i, j, b)
        assert t.last == bpe.Prefixes(vocabulary, a[:i] + b + a[j:]).last
        t.append(c)
        assert t.last == bpe.Prefixes(vocabulary, a[:i] + b + a[j:] + c).last


# -- toxicity -------------------------------------------------------------------------------------------------------


def toxic_corpus():
    r, rows, labels = random.Random(5), [], []
    for i in range(600):
        w = sentence(r, r.randint(15, 60), "etaoinshrd").split()
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(["wugplex", "blimbor", "quazzle"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_finds_disguised_words_and_leaves_clean_ones(spark):
    rows, labels = toxic_corpus()
    r = random.Random(6)
    tests = {
        1000: "wugplex blimbor", 1001: "w u g p l e x and b l i m b o r", 1002: "wu9p1ex so b1imb0r", 1003: "wuuuugplex bliiiimbor", 1004: "qu4zzle and bl!mbor",
    }
    rows += [(k, sentence(r, 10, "etaoinshrd") + " " + t + " " + sentence(r, 10, "etaoinshrd")) for k, t in tests.items()]
    rows += [(i, t) for i, t in ODD]
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxic.toxicity(extra(docs(spark, rows)), lab).collect()}
    assert sum(got[i]["toxic"] != bool(y) for i, y in labels) <= 2
    assert all(got[k]["toxic"] for k in tests)
    assert not any(got[i]["toxic"] for i, _ in ODD)
    kept = toxic.drop_toxic(extra(docs(spark, rows)), lab)
    assert kept.columns == extra(docs(spark, [])).columns and kept.count() == len(rows) - sum(1 for i, _ in rows if got[i]["toxic"])
    assert not toxic.toxicity(docs(spark, rows[:50]), lab.limit(0)).filter("toxic").count()
    assert toxic.toxicity(docs(spark, []), lab).count() == 0


def test_all_signs_and_doubled_letters_pass_the_gate(spark):
    words = ["s(um", "los€r", "st¡pid", "£oser", "stuupid", "morron", "éécole"]
    spelled = {"s h @ m e": "sh@me", "l.o.s.€.r": "los€r", "“s t u p i d”": "stupid", "d-€-f": "d€f"}
    texts = [*words, *spelled, "was a man", "plain words", ""]
    data, off = textops.raw(pa.array([f"one {t} four" for t in texts]))
    got = {}
    w = textops.words(data, off)
    for t, i, j in zip(*toxic.noisy(data, off, w)):
        got.setdefault(int(t), set()).add(w.low[i:j].tobytes().decode())
    for t, token in toxic.spelled(off, w):
        got.setdefault(t, set()).add(token)
    assert all(w in got[k] for k, w in enumerate([*words, *spelled.values()]))
    assert not any(k in got for k in range(len(texts) - 3, len(texts)))
    rows, labels = toxic_corpus()
    r = random.Random(19)
    tests = {1000: "wuugplex bliimbor", 1001: "b£¡mbor and b£imbor w u g p l € x"}
    rows += [(k, sentence(r, 10, "etaoinshrd") + " " + t + " " + sentence(r, 10, "etaoinshrd")) for k, t in tests.items()]
    out = {x["doc_id"]: x["toxic"] for x in toxic.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(out[k] for k in tests) and sum(out[i] != bool(y) for i, y in labels) <= 2


def test_score_against_brute_force(spark):
    rows, labels = toxic_corpus()
    got = {x["doc_id"]: x["score"] for x in toxic.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    words = {i: t.split() for i, t in rows}
    known = dict(labels)
    n = {y: sum(v == y for v in known.values()) for y in (0, 1)}

    def features(w):
        return {("w", w)} | {(k, w[:k]) for k in toxic.STEMS if len(w) > k}

    seen, contexts = {}, {}
    for i, ws in words.items():
        for f in set().union(*map(features, ws)):
            seen.setdefault(f, [0, 0])[known[i]] += 1
        for k, w in enumerate(ws):
            for f in features(w):
                contexts.setdefault(f, set()).add((known[i], ws[k - 1] if k else None, ws[k + 1] if k + 1 < len(ws) else None))

    def llr(a, b):
        q = (a + b) / (n[1] + n[0])
        return 2 * sum(x * np.log(x / (m * q)) for x, m in ((a, n[1]), (b, n[0])) if x)

    weight = {}
    for f, (b, a) in seen.items():
        if llr(a, b) >= toxic.LLR and a * n[0] > 3 * b * n[1]:
            a, b = (sum(y == k for y, _, _ in contexts[f]) for k in (1, 0))
            odds = np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1))
            if llr(a, b) >= toxic.LLR and odds > np.log(8):
                weight[f] = odds
    assert weight
    total = {i: sum(max((weight[f] for f in features(w) if f in weight), default=0) for w in set(ws)) for i, ws in words.items()}
    coef = toxic._logistic(np.array([[total[i], np.log1p(len(ws))] for i, ws in words.items()]), np.array([known[i] for i in words], float))
    want = {i: coef[0] + coef[1] * total[i] + coef[2] * np.log1p(len(ws)) for i, ws in words.items()}
    assert all(np.isclose(got[i], want[i], rtol=1e-3, atol=1e-2) for i in words)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(toxic.CLASSES), (toxic.CLASSES, toxic.CLASSES)))
    d = toxic.Decoder(logp)

    def score(text):
        a = b = 0
        s = 0.0
        for c in [int(toxic._CLASS[x]) for x in text.encode()] + [0]:
            s += logp[a, b, c]
            a, b = b, c
        return s

    def paths(options):
        return [("", 0.0)] if not options else [(e + t, c + s) for e, c in options[0] for t, s in paths(options[1:])]

    for token in ("1d10t", "aab5", "x$y", "ooo1"):
        every = {}
        for t, c in paths(toxic.lattice(token)):
            every[t] = max(c, every.get(t, -1e9))
        top = max(every, key=lambda t: every[t] + score(t))
        assert d.decode(token) == top


# -- quality --------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    r = random.Random(7)
    rows = [(i, sentence(r, r.randint(20, 80)) if i % 4 else sentence(r, 20).upper().replace(" ", "!! ")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {x["doc_id"]: x["quality"] for x in quality.quality(extra(docs(spark, rows + ODD)), labels).collect()}
    assert sum(got[i] == int(i % 4 > 0) for i in range(200, 400)) >= 195
    assert len(got) == 400 + len({i for i, _ in ODD}) - len({i for i, _ in ODD if i in range(400)})
    alone = quality.quality(docs(spark, rows[:9]), labels.limit(0)).collect()
    assert all(x["quality"] == 1 and x["score"] is None for x in alone)
    assert quality.quality(docs(spark, []), labels).count() == 0


def test_discriminant_against_densities(spark):
    rng = np.random.default_rng(1)
    p = len(quality.NAMES)
    x = {k: rng.normal(k, 1 + k, (50, p)) for k in (0, 1)}
    m = quality.Discriminant({k: 50.0 for k in x}, {k: x[k].sum(0) for k in x}, {k: x[k].T @ x[k] for k in x}, 0.0, 0.0)
    at = rng.normal(0, 1, (5, p))
    got = [r["s"] for r in spark.createDataFrame(pd.DataFrame(at, columns=quality.NAMES)).select(m.score().alias("s")).collect()]
    dens = lambda k, v: -0.5 * np.linalg.slogdet(np.cov(x[k].T))[1] - 0.5 * (v - x[k].mean(0)) @ np.linalg.solve(np.cov(x[k].T), v - x[k].mean(0))
    assert np.allclose(sorted(got), sorted(dens(1, v) - dens(0, v) for v in at))


def test_statistics_one_by_one():
    texts = ["The cat, the CAT!\n12 é", "", None, "a a a b", "日本 “x”"]
    got = quality.statistics(pa.array(texts))
    for t, x in zip(texts, got):
        t = t or ""
        w = [v for v in re.findall(r"[^\W_]+", t.lower())] if "日" not in t else ["日", "本", "x"]
        share = lambda a, b: np.arcsin(np.sqrt(min(a / max(b, 1), 1)))
        n = len(t)
        want = [np.log1p(n), np.log1p(len(w)), np.log1p(sum(len(v.encode()) for v in w) / max(len(w), 1)), share(len(set(w)), len(w))]
        want += [share(sum(f(c) for c in t), n) for f in (lambda c: "A" <= c <= "Z", lambda c: c in "0123456789", lambda c: "!" <= c <= "~" and not c.isalnum(), lambda c: c <= " ", lambda c: c > "\x7f")]
        want += [share(sum(p == q for p, q in zip(w, w[1:])), len(w))]
        assert np.allclose(x, want), t


def test_shrinkage_and_ties(spark):
    r = np.random.default_rng(4)
    p = len(quality.NAMES)
    x = {k: r.normal(k, 1 + k, (60, p)) for k in (0, 1)}
    m = quality.Discriminant({k: 60.0 for k in x}, {k: v.sum(0) for k, v in x.items()}, {k: v.T @ v for k, v in x.items()}, pooled=0.3, identity=0.2)
    whole = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in x.values()) / 118
    for k, v in x.items():
        s = 0.7 * np.cov(v.T) + 0.3 * whole
        s = 0.8 * s + 0.2 * np.trace(s) / p * np.eye(p)
        assert np.allclose(np.linalg.inv(m.factor[k].T @ m.factor[k]), s)
    # one and the same document as an example of both classes: score 0, and a tie is good
    same = [(i, "a b c") for i in range(4)]
    labels = spark.createDataFrame([(i, y) for i in range(4) for y in (0, 1)], "doc_id long, quality int")
    got = quality.quality(docs(spark, same), labels).collect()
    assert all(x["score"] == 0 and x["quality"] == 1 for x in got)


# -- language model -------------------------------------------------------------------------------------------------


def naive_exchange(pairs, classes, rounds):
    """Word by word, with all counts made anew for every class that is tried."""
    v, k = len(pairs), brown.FIRST + classes
    member = np.arange(v)
    member[brown.FIRST :] = brown.FIRST + np.arange(v - brown.FIRST) % classes

    def total(m):
        n = np.zeros((k, k))
        np.add.at(n, (m[:, None], m[None, :]), pairs)
        return brown.likelihood(n)

    for _ in range(rounds):
        before = member.copy()
        for w in range(brown.FIRST, v):
            tried = []
            for c in range(brown.FIRST, k):
                member[w] = c
                tried.append(total(member))
            stay = tried[before[w] - brown.FIRST]
            best = int(np.argmax(tried))
            member[w] = before[w] if tried[best] <= stay + 1e-6 else brown.FIRST + best
        if (member == before).all():
            break
    return member, total(member)


@pytest.mark.parametrize("seed", range(4))
def test_exchange_is_that_of_word_by_word_and_never_lowers_the_likelihood(seed):
    r = np.random.default_rng(seed)
    hidden, follow = r.integers(0, 6, 60), r.dirichlet(np.full(6, 0.3), 6)
    words, c = [], 0
    for _ in range(8000):
        c = r.choice(6, p=follow[c])
        words.append(r.choice(np.append(np.flatnonzero(hidden == c), 59)))
    _, words = np.unique(-np.bincount(words, minlength=60)[words] * 64 + np.array(words), return_inverse=True)  # by frequency
    v = words.max() + 1 + brown.FIRST
    pairs = np.zeros((v, v))
    np.add.at(pairs, (words[:-1] + brown.FIRST, words[1:] + brown.FIRST), 1)
    pairs[0, words[0] + brown.FIRST] = pairs[words[-1] + brown.FIRST, 0] = 1
    member, met, history = brown.exchange(pairs, 8, 4)
    again = np.zeros_like(met)
    np.add.at(again, (member[:, None], member[None, :]), pairs)
    assert np.allclose(met, again) and np.isclose(history[-1], brown.likelihood(again))
    assert all(y >= x - 1e-6 for x, y in zip(history, history[1:])) and history[-1] > history[0]
    assert abs(naive_exchange(pairs, 8, 4)[1] - history[-1]) < 1e-3 * abs(history[-1])


def test_brown_model_against_brute_force(spark):
    r = random.Random(8)
    kinds = [["ka", "ki", "ku", "kab", "kib"], ["mo", "mu", "me", "mob", "mub"], ["tisa", "tiso", "tise"]]
    seldom = [[f"k{i}x" for i in range(30)], [f"m{i}x" for i in range(30)], [f"t{i}x" for i in range(30)]]
    pick = lambda k: r.choice(seldom[k]) if r.random() < 0.2 else r.choice(kinds[k])
    texts = [" ".join(pick(i % 3) for i in range(r.randint(3, 60))) for _ in range(120)] + ["", "Ka, MO!", "ka seldom mo", "lonely rarest"]
    classes, rounds, share, core = 4, 5, 3e-3, 9
    got = {x["doc_id"]: x for x in brown.perplexities(docs(spark, [*enumerate(texts), (900, None)]).repartition(3), classes, rounds, share, core).collect()}

    split = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    key = lambda w: int(np.array([textops.hash_word(w) & ~255], np.uint64).view(np.int64)[0])
    count = pd.Series([w for t in split for w in t]).value_counts()
    assert (count >= share * count.sum()).sum() > core and (count < share * count.sum()).sum() > 20  # all ways are taken
    ids = {w: k + brown.FIRST for k, w in enumerate(sorted(count.index, key=lambda w: (-count[w], key(w)))[:core])}
    v, k = core + brown.FIRST, brown.FIRST + classes
    pairs = np.zeros((v, v))
    for t in split:
        s = [0, *(ids.get(w, brown.OTHER) for w in t), 0]
        np.add.at(pairs, (s[:-1], s[1:]), 1)
    member, _ = naive_exchange(pairs, classes, rounds)
    met = np.zeros((k, k))
    np.add.at(met, (member[:, None], member[None, :]), pairs)
    cls = {w: member[i] for w, i in ids.items()}
    moved = {}
    x = lambda z: z * np.log(z) if z else 0.0
    for word in set(count.index) - set(ids):
        before, after = np.zeros(k), np.zeros(k)
        for t in split:
            s = [0, *(cls.get(w, brown.OTHER) for w in t), 0]
            for i, w in enumerate(t):
                if w == word:
                    before[s[i]] += 1
                    after[s[i + 2]] += 1
        gain = []
        for c in range(brown.FIRST, k):
            g = sum(x(met[a, c] + before[a]) - x(met[a, c]) + x(met[c, a] + after[a]) - x(met[c, a]) for a in range(k))
            rows, cols = met[c].sum(), met[:, c].sum()
            gain.append(g - x(rows + count[word]) + x(rows) - x(cols + count[word]) + x(cols))
        moved[word] = brown.FIRST + int(np.argmax(gain))
    cls |= moved
    full = np.zeros((k, k))
    for t in split:
        s = [0, *(cls[w] for w in t), 0]
        np.add.at(full, (s[:-1], s[1:]), 1)
    logp = brown.transitions(full)
    assert np.allclose(np.exp(logp).sum(1), 1)
    for i, t in enumerate(split):
        s = [0, *(cls[w] for w in t), 0]
        want = logp[s[:-1], s[1:]].sum() + sum(np.log(count[w] / full[:, cls[w]].sum()) for w in t)
        assert got[i]["n_words"] == len(t) and np.isclose(got[i]["log_prob"], want)
        assert np.isclose(got[i]["perplexity"], np.exp(-want / (len(t) + 1)))
    assert got[900]["log_prob"] is None


def test_brown_model_learns_order(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["ka", "ki", "ku"]) + " " + r.choice(["mo", "mu", "me"]) for _ in range(60))) for i in range(80)]
    shuffled = [(500, " ".join(r.sample(rows[0][1].split(), 120)))]
    m = brown.cluster(docs(spark, rows), classes=4, rounds=4)
    cls = dict(zip(m.core.tolist(), m.member.tolist()))
    part = [{cls[textops.hash_word(w) & ~255] for w in words} for words in (("ka", "ki", "ku"), ("mo", "mu", "me"))]
    assert len(m.core) == 6 and part[0].isdisjoint(part[1])
    got = {x["doc_id"]: x["perplexity"] for x in brown.perplexities(docs(spark, rows + shuffled), classes=4).collect()}
    assert got[0] < got[500]


def test_brown_odd_inputs(spark):
    got = {(r["doc_id"], r["n_words"]) for r in brown.perplexities(extra(docs(spark, ODD))).collect()}
    assert {(1, None), (2, 0), (3, 0), (4, 0), (None, 3), (5, 2)} <= got
    assert brown.perplexities(docs(spark, [])).count() == 0


def test_counts_beyond_a_packed_cell_are_kept(monkeypatch):
    monkeypatch.setattr(brown, "_MOST", 4)

    class Shared:
        value = (brown.Lexicon(np.zeros(0, np.uint64), **{"class": (np.zeros(0, np.uint8), brown.OTHER)}), 5)

    texts = pa.RecordBatch.from_arrays([pa.array(["ka " * 11 + "ki", "ki"])], names=["text"])
    total = {}
    for b in brown._contexts(Shared)(iter([texts])):
        for w, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for x in np.frombuffer(cells, np.uint32).tolist():
                total[w, x & 255] = total.get((w, x & 255), 0) + (x >> 8)
    ka, ki = (int(np.array([textops.hash_word(w) & ~255], np.uint64).view(np.int64)[0]) for w in ("ka", "ki"))
    assert total == {(ka, 0): 1, (ka, 1): 10, (ka, 6): 11, (ki, 0): 1, (ki, 1): 1, (ki, 5): 2}


# -- URLs -----------------------------------------------------------------------------------------------------------


def test_url_trees_on_held_out_urls(spark):
    r = random.Random(9)
    rows = [(i, f"https://{'cheap-pills' if i % 5 == 0 else sentence(r, 1)}{r.randint(1, 9)}.example.{r.choice(['com', 'org'])}/{sentence(r, 1)}/{r.randint(1, 999)}") for i in range(400)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows] + [(900, None, ""), (901, "", ""), (902, "::no url", ""), (903, "http://a/" + "b" * 50_000, "")], "page_id long, url string, html string")
    known = spark.createDataFrame([(u, int(i % 5 == 0)) for i, u in rows[:200]], "url string, label int")
    got = {x["page_id"]: x for x in urls.filtered(extra(pages), known).collect()}
    assert sum(got[i]["blocked"] == (i % 5 == 0) for i in range(200, 400)) >= 190
    assert got[900]["score"] is None and not got[900]["blocked"] and len(got) == 404
    assert not urls.filtered(pages, known.limit(0)).filter("blocked").count()
    assert urls.filtered(pages.limit(0), urls.weak_labels(pages.limit(0))).count() == 0
    weak = {x["url"]: x["label"] for x in urls.weak_labels(spark.createDataFrame([("http://my-pills.org/a",), ("http://spills.org/ads",), (None,)], "url string")).collect()}
    assert weak == {"http://my-pills.org/a": 1, "http://spills.org/ads": 0}


def test_url_features_one_by_one(spark):
    rows = ["https://user@Sub-1.Exämple.com:80/a/b_c/?x=1&&y=22#frag", "http://a", "", "no url at all", None, "HTTP://H/p?q#"]
    got = [r.asDict() for r in spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "i long, url string").select("i", *urls.features(F.col("url"), F.lit(0.5))).orderBy("i").collect()]

    def bits(s):
        b = np.bincount(np.frombuffer(s.encode(), np.uint8)) if s else np.zeros(1)
        p = b[b > 0] / max(b.sum(), 1)
        return float(-(p * np.log2(p)).sum())

    hosts = ["sub-1.exämple.com", "a", "", "no url at all", None, "h"]
    paths, params = ["/a/b_c/", "", "", "", None, "/p"], [2, 0, 0, 0, 0, 1]
    for u, h, p, n, x in zip(rows, hosts, paths, params, got):
        if u is None:
            assert all(v == 0 for k, v in x.items() if k not in ("i", "suffix_share"))
            continue
        size = max(len(u), 1)
        want = {
            "length": len(u), "host": len(h), "path": len(p), "depth": p.count("/"), "digits": sum(c.isdigit() for c in u) / size, "signs": sum(not c.isalnum() for c in u) / size, "entropy": bits(u), "host_entropy": bits(h), "params": n,
            "parts": len(h.split(".")), "hyphens": h.count("-"), "host_digits": sum(c.isdigit() for c in h), "vowels": sum(c in "aeiou" for c in h) / max(len(h), 1), "longest": max(map(len, h.split("."))),
            "secure": u.startswith("https:"), "fragment": u.endswith("#frag"), "suffix_share": 0.5, "suffix_length": len(h.split(".")[-1]),
        }
        assert {k: round(float(v), 9) for k, v in want.items()} == {k: round(v, 9) for k, v in x.items() if k != "i"}


def test_trees_against_exhaustive_search():
    r = np.random.default_rng(2)
    x = r.integers(0, 6, (90, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3) | (r.random(90) < 0.1)).astype(float)
    got = urls.Trees(x, y, trees=3, depth=2, rate=0.5, bins=64, leaf=4).predict(x)

    f = np.full(90, np.log(y.mean() / (1 - y.mean())))
    for _ in range(3):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        value = lambda at: g[at].sum() ** 2 / (h[at].sum() + 1)  # noqa: E731, B023

        def grow(at, depth):
            if depth:
                tries = [(value(at[x[at, j] <= c]) + value(at[x[at, j] > c]) - value(at), -j, -c) for j in range(3) for c in np.unique(x[:, j]) if min((x[at, j] <= c).sum(), (x[at, j] > c).sum()) >= 4]  # noqa: B023
                best = max(tries, default=(0, 0, 0))
                if len(at) >= 8 and best[0] > 1e-9:
                    left = x[at, -best[1]] <= -best[2]
                    return [*grow(at[left], depth - 1), *grow(at[~left], depth - 1)]
            return [at]

        step = np.zeros(90)
        for at in grow(np.arange(90), 2):
            step[at] = 0.5 * g[at].sum() / (h[at].sum() + 1)  # noqa: B023
        f = f + step
    assert np.allclose(got, f)


def test_every_suffix_has_its_share(spark):
    rows = [(i, f"http://a.often.com/{i}") for i in range(15_000)] + [(20_000 + i, f"http://x{i}.rare{i}.org/") for i in range(50)] + [(30_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    counts = spark.createDataFrame([("often.com", 15_000), *((f"rare{i}.org", 1) for i in range(50))], "end string, n long")
    got = {x["page_id"]: x["share"] for x in urls.with_shares(pages, counts).collect()}
    assert len(got) == len(rows) and got[30_000] == 0
    assert got[0] == 15_000 / 15_050 and all(got[20_000 + i] == 1 / 15_050 for i in range(50))


# -- decontamination ------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark):
    r = random.Random(10)
    items = [(i, sentence(r, r.randint(12, 50))) for i in range(25)] + [(90, "tiny item"), (91, ""), (92, None), (None, "x y z"), (93, "...")]
    rows = []
    for k in range(150):
        w = sentence(r, r.randint(30, 90)).split()
        if k % 2:
            item = r.choice(items[:25])[1].split()
            for _ in range(r.choice([0, 1, len(item) // 10, len(item) // 5])):
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice([[], ["zz"], [item[at], "zz"]])
            at = r.randint(0, len(w))
            w[at:at] = item
        rows.append((k, " ".join(w)))
    rows.append((500, "so a TINY, item!"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in leaks.leaks(extra(docs(spark, rows + ODD)), bench).collect()}
    want = {}
    for d, t in rows:
        for i, s in items:
            if i is not None and s and (words := re.findall(r"\w+", s)):
                e = edits(words, re.findall(r"\w+", t.lower()))
                if e <= int(leaks.MAX_EDITS * len(words)):
                    want[d, i] = e
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and (500, 90) in got
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)
    # in parts, the answer is the same
    assert {(x["doc_id"], x["item_id"]) for x in leaks.leaks(docs(spark, rows), bench, part=200).collect()} == set(got)
    for part in (leaks.PART, 200):
        kept = leaks.drop_contaminated(extra(docs(spark, rows)).withColumn("leak_hash", F.lit(1)), bench, part=part)
        assert {x["doc_id"] for x in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got} and kept.columns[-1] == "leak_hash"
    assert leaks.leaks(docs(spark, []), bench).count() == 0 and leaks.leaks(docs(spark, rows), bench.limit(0)).count() == 0
    assert leaks.drop_contaminated(docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_trimmed_items_are_found_wherever_they_stand():
    r = random.Random(20)
    items = [(i, sentence(r, r.randint(20, 50))) for i in range(20)]
    texts, want = [sentence(r, 40)], []
    for i, s in items:
        w = s.split()
        most = int(leaks.MAX_EDITS * len(w))
        for k in range(most + 1):
            texts.append(" ".join(w[k : len(w) - (most - k)]))
            want.append((len(texts) - 1, i, most))
    texts.append(sentence(r, 40))
    index = leaks.Index(items)
    for order in (1, -1):
        got = index.matches(pa.array(texts[::order])).to_pylist()[::order]
        assert {(t, x["item_id"], x["edits"]) for t, xs in enumerate(got) for x in xs} == set(want)


def test_short_items_are_all_found():
    r = random.Random(21)
    items = [(i, sentence(r, 5 + i % 8)) for i in range(80)]
    texts = []
    for k in range(800):
        item = items[k % 80][1].split()
        for at in sorted(r.sample(range(len(item)), len(item) // 5))[::-1]:
            item[at : at + 1] = r.choice([[], ["zz"], [item[at], "zz"]])
        texts.append(" ".join([*sentence(r, r.randint(0, 20)).split(), *item, *sentence(r, r.randint(0, 20)).split()]))
    got = {(t, x["item_id"]): x["edits"] for t, xs in enumerate(leaks.Index(items).matches(pa.array(texts)).to_pylist()) for x in xs}
    want = {(t, i): e for t, x in enumerate(texts) for i, s in items if (e := edits(s.split(), x.split())) <= len(s.split()) // 5}
    assert len(want) >= 800 and got == want


def test_leaks_in_all_scripts_and_signs():
    r = random.Random(22)
    plain = sentence(r, 30)
    han = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(60))
    cyrillic = " ".join("".join(r.choice("абвгдежз") for _ in range(5)) for _ in range(30))
    index = leaks.Index([(1, plain), (2, han), (3, cyrillic)])
    w = plain.split()
    texts = [
        "so: " + " ".join(f"“{x}”" if k % 3 == 0 else x for k, x in enumerate(w)) + "…",
        "—".join(w),
        "\u00a0".join(w),
        "文字" + han[:20] + "好" + han[20:] + "文字",
        "да " + cyrillic.upper() + "!",
        "nothing of the kind",
    ]
    got = [[(x["item_id"], x["edits"], x["word_end"]) for x in xs] for xs in index.matches(pa.array(texts)).to_pylist()]
    assert got == [[(1, 0, 31)], [(1, 0, 30)], [(1, 0, 30)], [(2, 1, 63)], [(3, 0, 31)], []]


def test_of_several_occurrences_the_nearest_then_the_earliest_counts():
    item = [f"w{i}" for i in range(25)]
    edited = [*item[:9], "zz", *item[10:]]
    for text, want in (((edited, item, item), (0, 25 + 25 + 2)), ((edited, edited), (1, 26))):
        words = [x for part in text for x in ["and", *part]]
        (got,) = leaks.Index([(7, " ".join(item))]).matches(pa.array([" ".join(words)])).to_pylist()[0]
        assert (got["edits"], got["word_end"]) == want


def test_repetitions_reach_the_recall():
    r = random.Random(23)
    for size in (18, 25, 40):
        items = [(i, sentence(r, size)) for i in range(200)]
        texts = []
        for _, s in items:
            w = s.split()
            for at in r.sample(range(size), size // 5):
                w[at] = "zz"
            texts.append(sentence(r, 10) + " " + " ".join(w) + " " + sentence(r, 10))
        got = {t for t, xs in enumerate(leaks.Index(items).matches(pa.array(texts)).to_pylist()) if any(x["item_id"] == t for x in xs)}
        assert len(got) >= 194
    assert leaks.repetitions(18, 3) > leaks.repetitions(40, 8) >= 1


def test_walks_past_the_end_hang_on_nothing_that_follows():
    r = np.random.default_rng(3)
    a, b = r.integers(1, 1 << 63, 40).astype(np.uint64), r.integers(1, 1 << 63, 30).astype(np.uint64)
    both = leaks.walk(np.concatenate([a, b]), np.concatenate([np.full(40, 40), np.full(30, 70)]), 16, 7, 5)
    assert (both[:40] == leaks.walk(a, np.full(40, 40), 16, 7, 5)).all() and (both[40:] == leaks.walk(b, np.full(30, 30), 16, 7, 5)).all()


# -- chat -----------------------------------------------------------------------------------------------------------


def test_chat_against_python(spark):
    r = random.Random(11)
    rows = [(c, t, r.choice(["user", "assistant", "ann", "system", None, "", "x|>\n<|assistant|>\nHi<|end|>"]), r.choice(["hi <|end|>", "", None, "é" * 5, sentence(r, 9)])) for c in range(12) for t in range(r.randint(1, 9))]
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again"), (None, 1, "user", "lost"), (77, 0, "system", "alone"), (78, None, "bob", "first"), (78, 1, "bob", "second" * 10_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    convs = {}
    for c, t, role, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((-1 if t is None else t, (role or "unknown").replace("\n", " ").replace("<|", "< |").replace("|>", "| >"), (x or "").replace("<|", "< |")))
    for c, turns in convs.items():
        for who in {x for _, x, _ in turns} - {"system"}:
            text, spans = "", []
            for _, role, x in sorted(turns):
                text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user name={role}|>\n"
                if role == who:
                    spans.append(f"{len(text)}-{len(text) + len(x) + 7}")
                text += x + "<|end|>\n"
            want[c, who] = (text, ",".join(spans))
    got = {(x["conv_id"], x["speaker"]): (x["rendered"], x["loss_spans"]) for x in chat.perspectives(df.withColumn("turns", F.lit(1)).withColumn("speaker", F.lit(1))).collect()}
    assert got == want
    for (c, who), (text, spans) in got.items():  # each span cuts out the speaker's words and end mark, and nothing else
        cuts = [text[int(a) : int(b)] for a, b in (x.split("-") for x in spans.split(","))]
        assert cuts == [x + "<|end|>" for _, role, x in sorted(convs[c]) if role == who] and text.count("<|assistant|>\n") == len(cuts)
    assert chat.perspectives(df.limit(0)).count() == 0
