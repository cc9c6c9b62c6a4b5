"""Reference documents: which belong to a lecture, their pages, their terms, and which page a screen shows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import pairs
from ..functions import text as T

#: Parts of the documents of one name, each joined by a task of its own.
_PARTS = 16
#: Screens that are compared with a lecture's pages at a time, and pages in a block of these.
_BLOCK = 512


def _matched_names(media: DataFrame, materials: DataFrame) -> DataFrame:
    """stem, m_stem: the distinct names that match. Containment is an equi-join of courses with the pieces of a
    document's name that have some course's length, so that each candidate is a hit; common words are counted by word."""
    course, week, _ = T.course(F.col("stem"))
    m = media.select("stem").distinct().select("stem", T.flat(course).alias("course"), week.alias("w"), T.name_words(F.col("stem")).alias("want"))
    d = materials.select(F.col("stem").alias("m_stem")).distinct()
    d = d.select("m_stem", T.flat(F.col("m_stem")).alias("flat"), T.week(F.col("m_stem")).alias("mw"), T.name_words(F.col("m_stem")).alias("have")).filter(F.size("have") > 0)
    same_week = F.coalesce(F.col("w") == F.col("mw"), F.lit(True))
    named = m.filter("course <> ''").select("stem", "course", "w")
    lengths = F.broadcast(named.select(F.length("course").alias("n")).distinct())
    pieces = F.transform(F.sequence(F.lit(1), F.length("flat") - F.col("n") + 1), lambda i: F.substring(F.col("flat"), i, F.col("n")))
    held = d.join(lengths, F.length("flat") >= F.col("n")).select("m_stem", "mw", F.explode(F.array_distinct(pieces)).alias("course"))
    by_name = named.join(held, "course").filter(same_week).select("stem", "m_stem")
    left = m.select("stem", "w", F.size("want").alias("a"), F.explode("want").alias("word"))
    right = d.select("m_stem", "mw", F.size("have").alias("b"), F.explode("have").alias("word"))
    common = left.join(right, "word").filter(same_week).groupBy("stem", "m_stem").agg((F.count("*") / F.min(F.least("a", "b"))).alias("share"))
    return by_name.union(common.filter(F.col("share") >= K.NAME_SHARE).select("stem", "m_stem")).distinct()


def match_materials(media: DataFrame, materials: DataFrame) -> DataFrame:
    """lecture_id, stem, material, m_stem of all matches: the course's name in the document's, or half of the words in
    common; not if both names tell a week and the weeks differ. A lecture without any usable name matches nothing.

    Names are matched once each, and only matches are spread over the lectures and documents that bear them: no pair is
    made that isn't in the result. A name of many documents is spread over several tasks."""
    spread = int(media.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1)))
    wanted = media.select("lecture_id", "stem").join(_matched_names(media, materials), "stem").select("lecture_id", "stem", "m_stem", parts.alias("part"))
    d = materials.select(F.col("name").alias("material"), F.col("stem").alias("m_stem"), F.pmod(F.xxhash64("name"), F.lit(_PARTS)).cast("int").alias("part"))
    # a given number of partitions isn't coalesced: the rows are few before the join and many after it
    return wanted.repartition(spread, "m_stem", "part").join(d, ["m_stem", "part"]).select("lecture_id", "stem", "material", "m_stem")


def matched_pages(media: DataFrame, materials: DataFrame, pages: DataFrame) -> DataFrame:
    """``labelled_pages`` of the matches. Documents without pages don't count for them and aren't matched."""
    paged = materials.join(pages.select(F.col("material").alias("name")).distinct(), "name", "left_semi")
    return labelled_pages(match_materials(media, paged), pages)


def labelled_pages(matches: DataFrame, pages: DataFrame) -> DataFrame:
    """lecture_id, page_idx, label, text of all pages of a lecture's documents, in the order of material and page_no. The
    label names the document if more than one has pages."""
    p = matches.join(pages, "material")
    by = Window.partitionBy("lecture_id")
    many = F.min("material").over(by) != F.max("material").over(by)
    page = F.concat(F.col("page_no").cast("string"), F.lit("쪽"))
    return p.select(
        "lecture_id",
        (F.row_number().over(by.orderBy("material", "page_no")) - 1).alias("page_idx"),
        F.when(many, F.concat(F.col("m_stem"), F.lit(" "), page)).otherwise(page).alias("label"),
        "text",
    )


def hot_words(pages: DataFrame, limit: int = K.HOTWORD_CHARS) -> DataFrame:
    """lecture_id, words: the most frequent terms, ties by first occurrence, up to the limit of characters."""
    terms = pages.select("lecture_id", "page_idx", F.posexplode(F.regexp_extract_all("text", F.lit(T.TERMS))).alias("pos", "word"))
    counted = terms.groupBy("lecture_id", "word").agg(F.count("*").alias("n"), F.min(F.struct("page_idx", "pos")).alias("first")).filter(~F.col("word").isin(*K.COMMON))
    order = Window.partitionBy("lecture_id").orderBy(F.desc("n"), "first")
    before = F.coalesce(F.sum(F.length("word") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)) - 1, F.lit(-1))
    kept = counted.select("lecture_id", "word", F.row_number().over(order).alias("k"), before.alias("before")).filter(F.col("before") < limit)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ")
    return kept.groupBy("lecture_id").agg(F.left(words, F.lit(limit)).alias("words"))


def _shares(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of screens and pages with pairs enough: slide_no, numbers of pairs, page_idx (in order), and the shares of a
    screen's pairs that each page has (screens x pages). The counts are products of incidence matrices; an equi-join would
    make a row for each shared pair."""
    mine = [(no, k) for no, x in zip(left["slide_no"].to_pylist(), left["text"]) if len(k := pairs.codes(x.as_py())) >= K.MIN_BIGRAMS]
    theirs = [(no, k) for no, x in zip(right["page_idx"].to_pylist(), right["text"]) if len(k := pairs.codes(x.as_py()))]
    theirs.sort(key=lambda x: x[0])
    known = np.unique(np.concatenate([np.zeros(0, np.uint32), *(k for _, k in theirs)]))

    def incidence(rows: list[np.ndarray]) -> np.ndarray:
        m = np.zeros((len(rows), len(known)), np.float32)
        for i, k in enumerate(rows):
            m[i, np.searchsorted(known, k[np.isin(k, known, assume_unique=True)])] = 1
        return m

    n = np.array([len(k) for _, k in mine], np.int64)
    a = incidence([k for _, k in mine])
    # whole numbers far below 2**24, so exact
    both = [a @ incidence([k for _, k in theirs[y : y + _BLOCK]]).T for y in range(0, len(theirs), _BLOCK)]
    r = np.concatenate([np.zeros((len(mine), 0)), *both], axis=1).astype(np.float64) / n[:, None]
    return np.array([no for no, _ in mine], np.int32), n, np.array([no for no, _ in theirs], np.int32), r


def _by_chunk(screens: DataFrame, pages: DataFrame, score: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """score of each chunk of at most _BLOCK successive screens of a lecture with all the lecture's pages: a share hangs on
    one screen only, so neither a task nor a worker's memory grows with a lecture's length."""
    utf8 = lambda c: c.cast("binary").alias("text")
    chunk = F.floor(F.col("slide_no") / _BLOCK).alias("chunk")
    s = screens.select("lecture_id", chunk, "slide_no", utf8(F.array_join("lines", " ")))
    chunks = s.select(F.col("lecture_id").alias("l"), F.col("chunk").alias("of")).distinct()
    p = pages.select("lecture_id", "page_idx", utf8(F.col("text")))
    p = p.join(chunks, F.col("lecture_id").eqNullSafe(F.col("l"))).drop("l")
    return s.groupBy("lecture_id", "chunk").cogroup(p.groupBy("lecture_id", "of")).applyInArrow(score, f"lecture_id {screens.schema['lecture_id'].dataType.simpleString()}, {schema}")


def _lecture(left: pa.Table, n: int) -> pa.Array:
    return left["lecture_id"].take(pa.array([0] * n, pa.int64())).combine_chunks() if n else left["lecture_id"].slice(0, 0).combine_chunks()


def containment(screens: DataFrame, pages: DataFrame) -> DataFrame:
    """lecture_id, slide_no, page_idx, n, r: the share r of a screen's n bigrams that a page has. Pages that share none
    don't appear."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        no, n, page, r = _shares(left, right)
        i, j = np.nonzero(r)
        return pa.table({"lecture_id": _lecture(left, len(i)), "slide_no": no[i], "page_idx": page[j], "n": n[i].astype(np.int32), "r": r[i, j]})

    return _by_chunk(screens, pages, score, "slide_no int, page_idx int, n int, r double")


def align(screens: DataFrame, pages: DataFrame) -> DataFrame:
    """screens (lecture_id, slide_no, t_s, lines) with page_label; an aligned screen takes the page's lines, and is left
    out if it repeats the page before it.

    Shares are worked out chunk by chunk; only the choice, which hangs on the page chosen last, goes screen by screen:
    the first page of the greatest share, with a bonus for the pages just ahead; it counts if its share without the bonus
    suffices. For that a chunk passes on the pages that some bonus could make the greatest, of screens that have a page
    that suffices, and the numbers of all its screens, so that the choice knows what comes before a screen. Lines are
    moved twice: to the chunks, and to what was chosen."""

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        no, n, page, r = _shares(left, right)
        need = np.where(n < K.SHORT_BIGRAMS, K.SHORT_SHARE, K.MATCH_SHARE)
        top = r.max(axis=1, initial=0)
        i, j = np.nonzero((r >= top[:, None] - K.FORWARD_BONUS * 1.01) & (top >= need)[:, None])
        every = left["slide_no"].to_numpy().astype(np.int32)
        none = np.zeros(len(every))
        columns = {"slide_no": (every, no[i]), "page_idx": (none.astype(np.int32), page[j]), "need": (none, need[i]), "r": (none - 1, r[i, j])}
        return pa.table({"lecture_id": _lecture(left, len(every) + len(i))} | {k: np.concatenate(x) for k, x in columns.items()})

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        every = np.unique(g["slide_no"])
        lecture, g = g["lecture_id"].iloc[0], g[g["r"] >= 0].sort_values(["slide_no", "page_idx"])
        no, pages, shares, need = (g[c].to_numpy() for c in ("slide_no", "page_idx", "r", "need"))
        at = np.flatnonzero(np.diff(no, prepend=no[0] - 1, append=no[-1] + 1)) if len(no) else no
        last, out = None, []
        for a, b in zip(at[:-1], at[1:]):
            page, r = pages[a:b], shares[a:b]
            adj = r if last is None else r + np.where((page >= last) & (page <= last + K.FORWARD_PAGES), K.FORWARD_BONUS, 0.0)
            k = int(np.argmax(adj))
            if r[k] >= need[a]:
                last = page[k]
                out.append((no[a], last))
        chosen = dict(out)
        before = [chosen.get(every[k - 1]) if k else None for k in np.searchsorted(every, [a for a, _ in out])]
        return pd.DataFrame({"lecture_id": lecture if out else None, "slide_no": [a for a, _ in out], "page_idx": [b for _, b in out], "before": pd.array(before, "Int32")})

    kind = screens.schema["lecture_id"].dataType.simpleString()
    some = _by_chunk(screens, pages, candidates, "slide_no int, page_idx int, need double, r double")
    chosen = some.groupBy("lecture_id").applyInPandas(choose, f"lecture_id {kind}, slide_no int, page_idx int, before int")
    body = F.transform(F.filter(F.split("text", "\r\n|\r|\n"), lambda x: T.strip(x) != ""), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    p = pages.select("lecture_id", "page_idx", F.col("label").alias("page_label"), body.alias("body"))
    b = pages.select("lecture_id", F.col("page_idx").alias("before"), F.col("label").alias("label_before"))
    chosen = chosen.join(p, ["lecture_id", "page_idx"], "left").join(b, ["lecture_id", "before"], "left")
    chosen = chosen.select("lecture_id", "slide_no", "page_label", "body", F.coalesce(F.col("page_label") == F.col("label_before"), F.lit(False)).alias("again"))
    out = screens.join(chosen, ["lecture_id", "slide_no"], "left").filter(~F.coalesce("again", F.lit(False)))
    return out.select("lecture_id", "slide_no", "t_s", F.coalesce("body", "lines").alias("lines"), "page_label")
