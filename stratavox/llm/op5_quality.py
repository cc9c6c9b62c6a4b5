"""Quality classification by a regularised quadratic discriminant.

A document becomes a vector of transformed statistics (logarithms of sizes, arcsines of square roots of shares). Class
means and covariances are aggregated over all labelled documents, as sums and sums of products; each covariance is
shrunk towards the pooled one and that towards a multiple of the identity. The score is the difference of the classes'
log densities, by Mahalanobis distances through the Cholesky factors, which are inverted once and become constants of a
column expression.

Defined results:

- NULL or empty text, text without words: the statistics of an empty text; scored like others. Very long texts are
  read whole.
- Labels with NULLs are ignored; of contradictory labels of a document each counts. NULL doc_id: scored, never an
  example.
- Labels of fewer than two classes, or none: NULL score, quality 1 (nothing is known against the document).
- A score of exactly 0 is quality 1. Repeated rows give repeated results (and count repeatedly as examples); empty
  tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .textops import chunks, of_texts, raw, sums, words

#: Weight of the pooled covariance, and of the identity.
POOLED, IDENTITY = 0.1, 0.01
NAMES = ("chars", "words", "word_length", "distinct", "upper", "digit", "symbol", "space", "foreign", "again")


def statistics(texts: pa.Array) -> np.ndarray:
    """texts x len(NAMES)."""
    data, off = raw(texts)
    out = np.zeros((len(off) - 1, len(NAMES)))
    for a, b in chunks(off):
        d, cut = data[off[a] : off[b]], off[a : b + 1] - off[a]
        w = words(d, cut)
        high = d >= 128
        lead = (d & 0xC0) != 0x80
        upper = (d - np.uint8(65)) < 26
        digit = (d - np.uint8(48)) < 10
        space = d <= 32
        symbol = ~(high | upper | digit | space | ((d - np.uint8(97)) < 26))
        n = sums(lead, cut)
        size = np.diff(w.first)
        text = np.repeat(np.arange(b - a), size)
        once = text[np.unique(of_texts(text, w.hash), return_index=True)[1]]
        again = np.zeros(len(w.hash))
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
        share = lambda x, y: np.arcsin(np.sqrt(np.clip(x / np.maximum(y, 1), 0, 1)))
        out[a:b] = np.stack(
            [np.log1p(n), np.log1p(size), np.log1p(sums(w.end - w.start, w.first) / np.maximum(size, 1)), share(np.bincount(once, minlength=b - a), size)]
            + [share(sums(x, cut), n) for x in (upper, digit, symbol, space, high & lead)]
            + [share(sums(again, w.first), size)],
            axis=1,
        )
    return out


def _statistics(texts: pa.Array) -> pa.Array:
    x = statistics(texts)
    return pa.StructArray.from_arrays([pa.array(x[:, k]) for k in range(len(NAMES))], names=list(NAMES))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics."""
    made = F.arrow_udf(_statistics, "struct<" + ", ".join(f"{n}: double" for n in NAMES) + ">")
    return docs.select("doc_id", made("text").alias("s")).select("doc_id", "s.*")


class Discriminant:
    def __init__(self, n: dict[int, float], total: dict[int, np.ndarray], outer: dict[int, np.ndarray], pooled: float = POOLED, identity: float = IDENTITY):
        p = len(NAMES)
        scatter = {k: outer[k] - np.outer(total[k], total[k]) / n[k] for k in (0, 1)}
        whole = (scatter[0] + scatter[1]) / max(n[0] + n[1] - 2, 1)
        self.mean, self.factor, self.const = {}, {}, {}
        for k in (0, 1):
            s = (1 - pooled) * scatter[k] / max(n[k] - 1, 1) + pooled * whole
            s = (1 - identity) * s + identity * max(np.trace(s) / p, 1e-6) * np.eye(p)
            chol = np.linalg.cholesky(s)
            self.mean[k], self.factor[k] = total[k] / n[k], np.linalg.inv(chol)
            self.const[k] = np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(chol)).sum()

    def score(self) -> Column:
        """Log density and prior of class 1 less those of class 0."""
        parts = []
        for k in (0, 1):
            x = [F.col(n) - float(m) for n, m in zip(NAMES, self.mean[k])]
            square = F.lit(0.0)
            for row, r in enumerate(self.factor[k]):
                z = F.lit(0.0)
                for c in range(row + 1):
                    z = z + x[c] * float(r[c])
                square = square + z * z
            parts.append(F.lit(float(self.const[k])) - square / 2)
        return parts[1] - parts[0]


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant | None:
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").alias("__y"))
    p = len(NAMES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    aggs = [F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)] + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    n, total, outer = {}, {}, {}
    for r in stats.join(known, "doc_id").groupBy("__y").agg(F.count("*").alias("n"), *aggs).collect():
        k = int(r["__y"])
        n[k], total[k], outer[k] = float(r["n"]), np.array([r[f"s{i}"] for i in range(p)]), np.zeros((p, p))
        for i, j in pairs:
            outer[k][i, j] = outer[k][j, i] = r[f"p{i}_{j}"]
    return Discriminant(n, total, outer) if len(n) == 2 else None


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, quality (1 or 0); a row for each row of docs."""
    stats = Scratch(docs.sparkSession, "quality").keep(with_statistics(docs))
    model = fit(stats, labels)
    score = model.score() if model else F.lit(None).cast("double")
    out = stats.select("doc_id", score.alias("score"))
    return out.withColumn("quality", F.when(F.col("score") < 0, 0).otherwise(1))
