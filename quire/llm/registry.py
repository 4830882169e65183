"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quire.llm import decontamination, exact_dedup, licenses, packing, sharding, simhash, substring_dedup, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_sharding": sharding.op2_sharding,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_licenses": licenses.op4_licenses,
        "op5_packing": packing.op5_packing,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_warc": warc.op10_warc,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_licenses": licenses.OP4_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op9_url_filter": url_filter.OP9_SQL,
        "op10_warc": warc.OP10_SQL,
    }
