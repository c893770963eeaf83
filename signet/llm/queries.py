"""The queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from . import classifier, embedding_dedup, jaccard_join, licenses, mixing, packing, quality_rules, sharding, suffix_dedup, warc


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_mixing": mixing.op2_mixing,
        "op3_quality_classifier": classifier.op3_quality_classifier,
        "op4_warc": warc.op4_warc,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_packing": packing.op8_packing,
        "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.op1_sql(), "op2_mixing": mixing.op2_sql(), "op4_warc": warc.op4_sql(), "op5_jaccard_join": jaccard_join.op5_sql(), "op9_embedding_dedup": embedding_dedup.op9_sql()}
