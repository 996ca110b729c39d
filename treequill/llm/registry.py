"""Registered queries of the corpus operators, with their SQL oracles."""

from __future__ import annotations

from treequill.llm import fixity, media, mixing, ngram_join, pieces, quality_classifier, quality_rules, sharding, substring_dedup, urls


def queries() -> dict:
    return {
        "op1_fm_quality": quality_classifier.op1_fm_quality,
        "op2_merkle_fixity": fixity.op2_merkle_fixity,
        "op3_netpbm_bmp_tiles": media.op3_netpbm_bmp_tiles,
        "op4_rlz_substring_dedup": substring_dedup.op4_rlz_substring_dedup,
        "op5_pfair_mix": mixing.op5_pfair_mix,
        "op6_bloom_url_filter": urls.op6_bloom_url_filter,
        "op7_wfst_sentencepiece": pieces.op7_wfst_sentencepiece,
        "op8_hash_tree_shards": sharding.op8_hash_tree_shards,
        "op9_rule_cascade": quality_rules.op9_rule_cascade,
        "op10_chosen_path_join": ngram_join.op10_chosen_path_join,
    }


def oracle_sql() -> dict:
    return {
        "op2_merkle_fixity": fixity.ORACLE_SQL,
        "op4_rlz_substring_dedup": substring_dedup.ORACLE_SQL,
        "op5_pfair_mix": mixing.ORACLE_SQL,
        "op6_bloom_url_filter": urls.ORACLE_SQL,
        "op9_rule_cascade": quality_rules.ORACLE_SQL,
        "op10_chosen_path_join": ngram_join.ORACLE_SQL,
    }
