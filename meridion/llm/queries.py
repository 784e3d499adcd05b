"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridion.llm import brown_lm, line_dedup, merkle, packing, periodic_runs, pfair_mix, rule_ledger, sharding, simhash_dedup, token_counts, topk_search, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_brown_class_lm": brown_lm.op1_brown_class_lm,
        "op2_pfair_mix": pfair_mix.op2_pfair_mix,
        "op3_rule_ledger": rule_ledger.op3_rule_ledger,
        "op4_exact_top_k": topk_search.op4_exact_top_k,
        "op5_simhash_near_dedup": simhash_dedup.op5_simhash_near_dedup,
        "op6_site_line_dedup": line_dedup.op6_site_line_dedup,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_extendible_shards": sharding.op8_extendible_shards,
        "op9_retrieval_packing": packing.op9_retrieval_packing,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_warc": warc.op11_warc,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_pfair_mix": pfair_mix.OP2_SQL,
        "op3_rule_ledger": rule_ledger.OP3_SQL,
        "op4_exact_top_k": topk_search.OP4_SQL,
        "op6_site_line_dedup": line_dedup.OP6_SQL,
        "op7_url_filter": url_filter.OP7_SQL,
        "op8_extendible_shards": sharding.OP8_SQL,
        "op11_warc": warc.OP11_SQL,
        "op13_merkle_manifest": merkle.OP13_SQL,
    }
