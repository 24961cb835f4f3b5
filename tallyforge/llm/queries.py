"""Queries over the supplied tables, one an operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, embedding_dedup, fingerprints, importance_resampling, line_dedup, packing, pii, quality, quality_rules, repeats, secret_scan, simhash_dedup, source_audit


def _over(table: str, run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _with(other: str, run: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", other)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": _over("embeddings", embedding_dedup.near_vectors),
        "op2_simhash_near_dedup": _over("documents", simhash_dedup.simhash_query),
        "op3_secret_scan": _over("documents", secret_scan.find_secrets),
        "op4_packing": _over("documents", lambda docs: packing.pack(docs, with_ids=False)),
        "op5_quality_classifier": _over("documents", quality.quality_query),
        "op6_suffix_array_dedup": _over("documents", repeats.repeats_query),
        "op7_line_dedup": _over("documents", line_dedup.line_query),
        "op8_document_fingerprints": _over("documents", fingerprints.fingerprint_query),
        "op9_byte_bpe": _over("documents", byte_bpe.round_trip),
        "op10_pii": _over("documents", pii.pii_query),
        "op11_source_divergence_audit": _over("documents", source_audit.audit),
        "op12_importance_resampling": _with("benchmark", importance_resampling.resample),
        "op13_quality_rules": _with("labels", quality_rules.rules),
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence_audit": source_audit.ORACLE_SQL, "op12_importance_resampling": importance_resampling.ORACLE_SQL}
