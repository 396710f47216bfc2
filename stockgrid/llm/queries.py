"""Registered queries of this package: one per operator, each over its whole table with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockgrid.llm import (byte_bpe, conversation_repair, filter_audit, fingerprints, langid_crf, lattice_lm, license_scan,
                           mixing, pivot_topk, quality_knn, secret_scan, sharding, simhash)
from stockgrid.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.byte_bpe(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def _lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    pieces = lattice_lm.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice_lm.score(table(spark, sf_dir, "documents"), pieces)


QUERIES: dict[str, Query] = {
    "op1_secret_scan": _documents(secret_scan.secret_scan),
    "op2_fingerprints": _documents(fingerprints.fingerprints),
    "op3_sharding": _documents(sharding.sharding),
    "op4_lattice_lm": _lattice_lm,
    "op5_byte_bpe": _byte_bpe,
    "op6_mixing": _documents(mixing.mix_report),
    "op7_simhash_near_dedup": _documents(simhash.simhash_near_dedup),
    "op8_quality_knn": lambda spark, sf_dir: quality_knn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_language_id": _documents(langid_crf.language_id),
    "op10_pivot_topk": lambda spark, sf_dir: pivot_topk.top_k(table(spark, sf_dir, "embeddings")),
    "op11_filter_audit": lambda spark, sf_dir: filter_audit.filter_audit(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op12_conversation_repair": lambda spark, sf_dir: conversation_repair.conversation_repair(
        table(spark, sf_dir, "conversations")),
    "op13_license_scan": _documents(license_scan.license_scan),
}

ORACLE_SQL: dict[str, str] = {"op10_pivot_topk": pivot_topk.TOP_K_SQL, "op11_filter_audit": filter_audit.AUDIT_SQL}
