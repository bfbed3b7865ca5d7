"""The registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocation, decontam, divergence, fingerprint, forest, jaccard, linededup, packing, quality, rans, secrets, substring, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the public vocabulary file that the contracts name."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines_digest(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_units_spans(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_files(table(spark, sf_dir, "documents"), vocabulary())


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared_with_next(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_secrets": op2_secrets,
        "op3_line_dedup": op3_line_dedup,
        "op4_packing": op4_packing,
        "op5_decontamination": op5_decontamination,
        "op6_quality": op6_quality,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_nearest": op9_nearest,
        "op10_token_output": op10_token_output,
        "op11_fingerprints": op11_fingerprints,
        "op12_collocations": op12_collocations,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.ORACLE_SQL,
        "op3_line_dedup": linededup.ORACLE_SQL,
        "op7_substring_dedup": substring.ORACLE_SQL,
        "op12_collocations": collocation.ORACLE_SQL,
        "op13_divergence": divergence.ORACLE_SQL,
    }
