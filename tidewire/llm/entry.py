"""Queries and SQL of the training-data operators, for the repository's entry module."""

from . import bpe, decontamination, language_id, line_dedup, merkle, neardup, quality, secrets, sharding, topk, toxicity, url_filter, whitening


def queries():
    return {"op1_topk": topk.op1_topk, "op2_decontamination": decontamination.op2_decontamination, "op3_neardup": neardup.op3_neardup, "op4_lines": line_dedup.op4_lines, "op5_bpe": bpe.op5_bpe, "op6_sharding": sharding.op6_sharding, "op7_urls": url_filter.op7_urls, "op8_quality": quality.op8_quality, "op9_language": language_id.op9_language, "op10_secrets": secrets.op10_secrets, "op11_whitening": whitening.op11_whitening, "op12_toxicity": toxicity.op12_toxicity, "op13_manifest": merkle.op13_manifest}


def oracle_sql():
    return {"op1_topk": topk.ORACLE, "op2_decontamination": decontamination.ORACLE, "op3_neardup": neardup.ORACLE, "op6_sharding": sharding.ORACLE, "op13_manifest": merkle.ORACLE}
