"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, jaccard, language, mixing, pii, quality, quotes, topk, url_filter


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality": quality.op1_quality,
        "op2_jaccard_join": jaccard.op2_jaccard_join,
        "op3_language": language.op3_language,
        "op4_bpe": bpe.op4_bpe,
        "op5_curriculum_mix": mixing.op5_curriculum_mix,
        "op6_exact_top5": topk.op6_exact_top5,
        "op7_surrogates": pii.op7_surrogates,
        "op8_reply_order": quotes.op8_reply_order,
        "op9_url_rules": url_filter.op9_url_rules,
        "op10_neighbours": ann.op10_neighbours,
    }


def oracle_sql():
    return {
        "op5_curriculum_mix": mixing.SQL.format(d="documents"),
        "op6_exact_top5": topk.SQL,
        "op9_url_rules": url_filter.SQL,
    }
