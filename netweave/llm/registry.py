"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from netweave.llm import chat, exact_dedup, hilbert, maxent, mixing, near_dup, negatives, packing, periodic, quality, secrets, simhash, warc


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1,
        "op2_quality_rules": quality.op2,
        "op3_warc": warc.op3,
        "op4_secret_forest": secrets.op4,
        "op5_mixing": mixing.op5,
        "op6_hilbert_shards": hilbert.op6,
        "op7_jaccard_join": near_dup.op7,
        "op8_maxent_scores": maxent.op8,
        "op9_exact_dedup": exact_dedup.op9,
        "op10_chat_format": chat.op10,
        "op11_simhash": simhash.op11,
        "op12_periodic_runs": periodic.op12,
        "op13_hard_negatives": negatives.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality.OP2_SQL,
        "op3_warc": warc.OP3_SQL,
        "op5_mixing": mixing.OP5_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op10_chat_format": chat.OP10_SQL,
        "op13_hard_negatives": negatives.OP13_SQL,
    }
