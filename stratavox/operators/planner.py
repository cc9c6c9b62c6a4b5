"""The rebuild plan: what to name each output, and which have to be made (again)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T


def extension(path: Column) -> Column:
    """The last suffix of a path in lower case, without the dot; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def listing(files: DataFrame) -> DataFrame:
    """rel_path, bytes, ext, role of files: media, ignored, or (temporary names) hidden."""
    name = F.substring_index("rel_path", "/", -1)
    role = F.when(extension(F.col("rel_path")).isin(*K.MEDIA), "media").when(~name.startswith("~"), "ignored").otherwise("hidden")
    return files.select("rel_path", "bytes", extension(F.col("rel_path")).alias("ext"), role.alias("role"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^./]+$", "")


def names(media: DataFrame) -> DataFrame:
    """media (rel_path, ...) with out_name, unlike any other but for case.

    Clashing names all get their extension. Names that still clash are numbered in path order; a number may clash with a
    later name, which is why clashes are settled by a fold. It runs only within families of names that can meet, those
    alike after their numbers are taken off, so it is parallel over families."""
    folder = F.split("rel_path", "/")
    parts = F.concat(F.slice(folder, 1, F.size(folder) - 1), F.array(stem(F.col("rel_path"))))
    base = T.short_name(F.array_join(parts, " - "))
    m = media.withColumn("base", base).withColumn("ext", extension(F.col("rel_path")))
    clash = F.count("*").over(Window.partitionBy(F.lower("base"))) > 1
    m = m.withColumn("name", F.when(clash, F.concat("base", F.lit(" ("), "ext", F.lit(")"))).otherwise(F.col("base")))
    m = m.withColumn("family", F.regexp_replace(F.lower("name"), r"( \([0-9]+\))+$", ""))

    def number(g: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for path, name in g.sort_values("rel_path")[["rel_path", "name"]].itertuples(index=False):
            n, one = 2, name
            while one.lower() in used:
                one, n = f"{name} ({n})", n + 1
            used.add(one.lower())
            out.append((path, one))
        return pd.DataFrame(out, columns=["rel_path", "out_name"])

    crowd = F.count("*").over(Window.partitionBy("family")) > 1
    m = m.withColumn("crowd", crowd)
    numbered = m.filter("crowd").select("family", "rel_path", "name").groupBy("family").applyInPandas(number, "rel_path string, out_name string")
    return m.join(numbered, "rel_path", "left").withColumn("out_name", F.coalesce("out_name", "name")).drop("base", "ext", "name", "family", "crowd")


_MARK = "src string, bytes bigint, cfg string, sha string, pdf string"


def classify(media: DataFrame, outputs: DataFrame) -> DataFrame:
    """media (rel_path, name, bytes, out_name, cfg, pdf) with status. outputs: out_name, text.

    target: to be made; rebuilt: to be made again; done, edited: left alone; blocked: not ours to overwrite."""
    first = F.regexp_extract("text", rf"(?m)^{K.MARKER}(.*)-->", 1)
    o = outputs.select(
        F.col("out_name").alias("o"),
        F.from_json(F.nullif(F.trim(first), F.lit("")), _MARK, {"mode": "PERMISSIVE"}).alias("mark"),
        F.try_parse_json(F.nullif(F.trim(first), F.lit(""))).isNotNull().alias("sound"),
        T.body_hash(F.col("text")).alias("now"),
        F.regexp_extract_all("text", F.lit(r"(?m)^- \*\*원본 파일\*\*:(.*)$"), F.lit(1)).alias("sources"),
    )
    m = media.join(o, F.col("out_name") == F.col("o"), "left")
    ours = F.col("sound") | F.exists("sources", lambda x: T.strip(x) == F.col("name"))
    same = F.col("mark.bytes").eqNullSafe(F.col("bytes")) & F.col("mark.cfg").eqNullSafe(F.col("cfg")) & (F.coalesce("mark.pdf", F.lit("")) == F.col("pdf"))
    status = (
        F.when(F.col("o").isNull(), "target")
        .when(~ours, "blocked")
        .when(~F.col("sound") | F.col("mark.sha").isNull(), "target")
        .when(F.col("mark.sha") != F.col("now"), "edited")
        .when(same, "done")
        .otherwise("rebuilt")
    )
    return m.select(*media.columns, status.alias("status"))


def manifest(media: DataFrame) -> DataFrame:
    """out_name, marker: the comment line that ends an output. media: out_name, name, bytes, cfg, sha, pdf."""
    return media.select("out_name", marker().alias("marker"))


def marker() -> Column:
    """The marker of a row of name, bytes, cfg, sha, pdf."""
    mark = F.to_json(F.struct(F.col("name").alias("src"), "bytes", "cfg", "sha", "pdf"))
    return F.concat(F.lit(K.MARKER + " "), mark, F.lit(" -->"))
