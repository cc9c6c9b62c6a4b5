"""The training-data queries, each over its whole table with production parameters."""

from __future__ import annotations

from . import op1_near_dedup, op2_token_counts, op3_toxicity, op4_bpe, op5_quality, op6_brown_lm, op7_url_filter, op8_decontaminate, op9_chat, op10_exact_dedup
from .common import prepare, table


def _over(f, *names):
    def run(spark, sf_dir):
        prepare(spark)
        return f(*(table(spark, sf_dir, n) for n in names))

    return run


QUERIES = {
    "op1_near_dedup": _over(op1_near_dedup.near_duplicates, "documents"),
    "op2_token_counts": _over(op2_token_counts.token_counts, "documents"),
    "op3_toxicity": _over(op3_toxicity.toxicity, "documents", "labels"),
    "op4_bpe": _over(op4_bpe.encode, "documents"),
    "op5_quality": _over(op5_quality.quality, "documents", "labels"),
    "op6_brown_lm": _over(op6_brown_lm.perplexities, "documents"),
    # no table labels URLs
    "op7_url_filter": _over(lambda pages: op7_url_filter.filtered(pages, op7_url_filter.weak_labels(pages)), "pages"),
    "op8_decontaminate": _over(op8_decontaminate.leaks, "documents", "benchmark"),
    "op9_chat": _over(op9_chat.perspectives, "conversations"),
    "op10_exact_dedup": _over(op10_exact_dedup.exact_duplicates, "documents"),
}
ORACLES = {"op9_chat": op9_chat.ORACLE_SQL, "op10_exact_dedup": op10_exact_dedup.ORACLE_SQL}
