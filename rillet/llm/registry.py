"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from rillet.llm import exact_dedup, licenses, mixing, near_dedup, pieces, quality, token_shards, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_pieces": pieces.query,
        "op2_topk": topk.query,
        "op3_exact_dedup": exact_dedup.query,
        "op4_licenses": licenses.query,
        "op5_mixing": mixing.query,
        "op6_near_dedup": near_dedup.query,
        "op7_warc": warc.query,
        "op8_quality": quality.query,
        "op9_toxicity": toxicity.query,
        "op10_token_shards": token_shards.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.SQL, "op3_exact_dedup": exact_dedup.SQL, "op7_warc": warc.SQL}
