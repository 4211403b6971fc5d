"""The queries of this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

from demoflux.llm import (
    importance, langid, mixing, near_dup, packing, quality, repeats, secret_scan, simhash, topk, toxicity, vector_codes, warc)
from demoflux.llm.common import Query, table

QUERIES: dict[str, Query] = {
    "op1_mixing": lambda spark, folder: mixing.mixing_query(table(spark, folder, "documents")),
    "op2_quality": lambda spark, folder: quality.quality_query(table(spark, folder, "documents")),
    "op3_repeats": lambda spark, folder: repeats.repeats_query(table(spark, folder, "documents")),
    "op4_packing": lambda spark, folder: packing.packing_query(table(spark, folder, "documents")),
    "op5_topk": lambda spark, folder: topk.topk_query(table(spark, folder, "embeddings")),
    "op6_near_dup": lambda spark, folder: near_dup.near_dup_query(table(spark, folder, "documents")),
    "op7_toxicity": lambda spark, folder: toxicity.toxicity_query(table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op8_warc": lambda spark, folder: warc.warc_query(table(spark, folder, "pages")),
    "op9_language": lambda spark, folder: langid.language_query(table(spark, folder, "documents")),
    "op10_secrets": lambda spark, folder: secret_scan.secret_query(table(spark, folder, "documents")),
    "op11_importance": lambda spark, folder: importance.resample_query(table(spark, folder, "documents"), table(spark, folder, "benchmark")),
    "op12_vector_codes": lambda spark, folder: vector_codes.codes_query(table(spark, folder, "embeddings")),
    "op13_simhash": lambda spark, folder: simhash.simhash_query(table(spark, folder, "documents")),
}

CHECKS: dict[str, str] = {
    "op2_quality": quality.QUALITY_SQL, "op3_repeats": repeats.REPEATS_SQL, "op5_topk": topk.TOPK_SQL,
    "op6_near_dup": near_dup.NEAR_DUP_SQL, "op8_warc": warc.WARC_SQL, "op11_importance": importance.RESAMPLE_SQL,
    "op12_vector_codes": vector_codes.CODES_SQL,
}
