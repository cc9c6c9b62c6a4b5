"""Multi-party perspective rotation of dialogues.

For every participant of a dialogue, the whole dialogue is rendered with that speaker as the assistant and all others
as named users; the loss mask covers exactly the speaker's own words and their end marks. The rendering is one string
and the mask a list of half-open ranges of its characters.

All of it is built-in expressions after a single shuffle on conv_id: two running sums (over the dialogue, and over the
speaker's own turns) give each turn its place in the rendering in which its speaker is the assistant, so that
dialogues of any length take linear time.

Defined results:

- NULL conv_id: belongs to no dialogue; left out. NULL turn sorts first. NULL or empty role: the speaker "unknown".
- NULL text is an empty turn. Empty and very long texts are turns like others.
- Ties of turn are ordered by role, then text; repeated rows are repeated turns.
- Markup in a text or a role is made harmless: ``<|`` becomes ``< |``, in a role also ``|>`` becomes ``| >`` and a line
  break a space, so that no participant can forge a turn. Roles that are equal then are one speaker.
- The role "system" gives context to all and is no participant; a dialogue without participants gives no row.
- An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def _harmless(role: Column) -> Column:
    for a, b in (("\n", " "), ("<|", "< |"), ("|>", "| >")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == "system", F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def perspectives(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, n_turns, rendered, loss_spans ("12-40,80-95"), loss_chars."""
    c = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.when(F.coalesce("role", F.lit("")) == "", "unknown").otherwise(_harmless(F.col("role"))).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "role").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    other = F.length(_head(F.col("role"), F.lit("")))  # as any other speaker sees the turn
    mine = F.length(_head(F.col("role"), F.col("role")))
    c = c.withColumn("__all", F.coalesce(F.sum(other + F.length("text") + len(END)).over(before), F.lit(0)))
    c = c.withColumn("__own", F.coalesce(F.sum(mine - other).over(own), F.lit(0)))
    c = c.withColumn("__from", F.col("__all") + F.col("__own") + mine).withColumn("__to", F.col("__from") + F.length("text") + len(END) - 1)
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**62))).alias("turn"), "role", "text", "__from", "__to"))).alias("turns"))
    who = turns.select("conv_id", "turns", F.explode(F.array_distinct(F.filter(F.col("turns.role"), lambda r: r != "system"))).alias("speaker"))
    mine_only = F.filter("turns", lambda t: t["role"] == F.col("speaker"))
    return who.select(
        "conv_id",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(_head(t["role"], F.col("speaker")), t["text"], F.lit(END))), "").alias("rendered"),
        F.array_join(F.transform(mine_only, lambda t: F.concat(t["__from"].cast("string"), F.lit("-"), t["__to"].cast("string"))), ",").alias("loss_spans"),
        F.aggregate(mine_only, F.lit(0).cast("long"), lambda s, t: s + t["__to"] - t["__from"]).alias("loss_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE replace(replace(replace(role, chr(10), ' '), '<|', '< |'), '|>', '| >') END AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c
), who AS (SELECT DISTINCT conv_id, role AS speaker FROM n WHERE role <> 'system'
), piece AS (
  SELECT n.conv_id, speaker, k, role = speaker AS mine,
         CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || role || '|>' || chr(10) END AS head, text || '<|end|>' || chr(10) AS body
  FROM n JOIN who USING (conv_id)
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY k) - length(body) AS a FROM piece
)
SELECT conv_id, speaker, count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS rendered,
       string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(a + length(body) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE mine) AS loss_spans,
       CAST(sum(length(body) - 1) FILTER (WHERE mine) AS BIGINT) AS loss_chars
FROM placed GROUP BY conv_id, speaker
"""
