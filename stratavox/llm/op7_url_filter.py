"""URL filtering by gradient-boosted trees on lexical features.

Features: lengths, depth, shares of digits and of signs, entropy, parameters, parts and hyphens of the host, and
statistics of the suffix (its share of all URLs, counted over the whole table). Trees are grown on histograms (quantile
bins) of at most ``LABELLED`` labelled URLs, those with the least hash, on the driver; every URL is then scored,
vectorised. Suffixes with at least one URL in ``1 / HOT`` are broadcast; URLs of the others meet their suffix by a shuffle.

Labelled URLs are a table (url, label 0 or 1). ``weak_labels`` makes one by a rule, where there is none better: a host that
has one of ``SEEDS`` as a part of its name is unwanted. The words themselves are not among the features.

All features are built-in expressions but the entropies, which are counted over the bytes of a batch at once.

Defined results:

- NULL url: NULL score, not blocked. An empty or malformed url has the features that can be read off it.
- Very long urls are read whole. Labels of one class, or none: score 0 (even odds), nothing is blocked.
- Ties (log odds exactly 0) are not blocked. Repeated rows give repeated results, and repeated labelled URLs count once,
  as unwanted if any label says so.
- Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least_hash
from .textops import chunks, raw

LABELLED = 20_000
#: Least share of a suffix that is broadcast; the others are joined.
HOT = 1e-4
SEEDS = ("spam", "casino", "pills", "bets", "adult", "ads")
TREES, DEPTH, RATE, BINS, LEAF = 40, 3, 0.3, 32, 5
NAMES = ("length", "host", "path", "depth", "digits", "signs", "entropy", "host_entropy", "params", "parts", "hyphens", "host_digits", "vowels", "longest", "secure", "fragment", "suffix_share", "suffix_length")

#: What comes before the host of a URL, the host (in lower case), and all that may follow.
_BEFORE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?"
END = _BEFORE + "([^/?#:]*)"
_WHOLE = r"(?s)" + END + r"(?::\d*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def entropies(texts: pa.Array) -> np.ndarray:
    """Bits a byte of each text; 0 for an empty one."""
    data, off = raw(texts)
    out = np.zeros(len(off) - 1)
    for a, b in chunks(off):
        size = np.diff(off[a : b + 1])
        for lo in range(0, b - a, 1024):
            n = size[lo : lo + 1024]
            row = np.repeat(np.arange(len(n)), n)
            count = np.bincount(row * 256 + data[off[a + lo] : off[a + lo + len(n)]], minlength=256 * len(n)).reshape(-1, 256)
            share = count / np.maximum(n, 1)[:, None]
            out[a + lo : a + lo + len(n)] = -(share * np.log2(np.maximum(share, 1e-300))).sum(1)
    return out + 0.0


def features(url: Column, share: Column) -> list[Column]:
    """The features of a URL in the order of NAMES, as doubles; 0 for NULL."""
    entropy = F.arrow_udf(lambda x: pa.array(entropies(x)), "double")
    part = lambda k: F.regexp_extract(url, _WHOLE, k)
    host, path, query = F.lower(part(1)), part(2), part(3)
    count = lambda c, what: F.length(F.regexp_replace(c, f"[^{what}]", ""))
    n = F.greatest(F.length(url), F.lit(1))
    parts = F.split(host, r"\.")
    made = [
        F.length(url), F.length(host), F.length(path), count(path, "/"), count(url, "0-9") / n, F.length(F.regexp_replace(url, r"[\p{L}\p{N}]", "")) / n, entropy(url), entropy(host),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")), F.size(parts), count(host, "\\-"), count(host, "0-9"), count(host, "aeiou") / F.greatest(F.length(host), F.lit(1)),
        F.array_max(F.transform(parts, F.length)), F.startswith(url, F.lit("https:")), part(4) != "", share, F.length(F.element_at(parts, -1)),
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(NAMES, made)]


class Trees:
    """Boosted regression trees for the logistic loss; each tree is complete, of ``depth`` levels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, leaf: int = LEAF):
        self.depth, self.trees = depth, []
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        coded = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            column, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for k in range(2**depth - 1):
                at = np.flatnonzero(node == k)
                best = (1e-9, 0, np.inf, None)
                if len(at) >= 2 * leaf:
                    gs, hs = g[at].sum(), h[at].sum()
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        c = coded[at, j]
                        gl, hl, nl = (np.cumsum(np.bincount(c, z, len(e) + 1))[:-1] for z in (g[at], h[at], None))
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < leaf) | (len(at) - nl < leaf)] = -1
                        i = int(np.argmax(gain))
                        if gain[i] > best[0]:
                            best = (gain[i], j, e[i], i)
                column[k], cut[k] = best[1], best[2]
                right = coded[at, best[1]] > best[3] if best[3] is not None else np.zeros(len(at), bool)
                node[at] = 2 * k + 1 + right
            leafs = node - (2**depth - 1)
            value = rate * np.bincount(leafs, g, 2**depth) / (np.bincount(leafs, h, 2**depth) + 1)
            f += value[leafs]
            self.trees.append((column, cut, value))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for column, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, column[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def weak_labels(pages: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """url, label by the parts of the host."""
    host = F.lower(F.regexp_extract("url", r"//([^/?#]*)", 1))
    return pages.filter(F.col("url").isNotNull()).select("url", host.rlike(r"(^|[.\-])(" + "|".join(seeds) + r")([.\-]|$)").cast("int").alias("label"))


def _suffix(url: Column) -> Column:
    return F.substring_index(F.regexp_extract(F.lower(url), END, 1), ".", -2)


def with_shares(urls: DataFrame, counts: DataFrame, hot: float = HOT) -> DataFrame:
    """urls with the share of all URLs that end in the same suffix, the last two parts of the host. counts: end, n."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    shares = counts.select("end", (F.col("n") / total).alias("share"))
    tagged = urls.withColumn("end", _suffix(F.col("url")))
    # at most 1 / hot rows, whatever the input; they are never shuffled by their suffix
    tagged = tagged.join(F.broadcast(shares.filter(F.col("share") >= hot)), "end", "left")
    ready = F.col("share").isNotNull() | F.col("end").isNull()
    rest = tagged.filter(~ready).drop("share").join(shares.filter(F.col("share") < hot), "end", "left")
    return tagged.filter(ready).unionByName(rest).drop("end").fillna(0.0, ["share"])


def filtered(pages: DataFrame, labelled: DataFrame, bound: int = LABELLED, hot: float = HOT) -> DataFrame:
    """page_id, score (log odds of an unwanted URL), blocked; a row for each row of pages. labelled: url, label."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    every = scratch.keep(labelled.filter("url IS NOT NULL AND label IN (0, 1)").groupBy("url").agg(F.max("label").alias("label")))
    counts = scratch.keep(pages.filter("url IS NOT NULL").groupBy(_suffix(F.col("url")).alias("end")).agg(F.count("*").alias("n")))
    known = with_shares(least_hash(every, "url", bound), counts, hot)
    known = known.select("url", "label", *features(F.col("url"), F.col("share"))).toPandas().sort_values("url")  # at most ``bound`` rows
    y = known["label"].to_numpy(float)
    model = Trees(known[list(NAMES)].to_numpy(float), y) if 0 < y.sum() < len(y) else None
    shared = spark.sparkContext.broadcast(model)

    def score(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
        return pa.array(shared.value.predict(x) if shared.value else np.zeros(len(x)))

    s = F.arrow_udf(score, "double")
    out = with_shares(pages.select("page_id", "url"), counts, hot).select("page_id", "url", *features(F.col("url"), F.col("share")))
    out = out.select("page_id", F.when(F.col("url").isNotNull(), s(*NAMES)).alias("score"))
    return out.withColumn("blocked", F.coalesce(F.col("score") > 0, F.lit(False)))
