"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirador.llm.mixing import op1_mix_sources

    return op1_mix_sources(read(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirador.llm.secret_scan import op2_secret_scan

    return op2_secret_scan(read(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirador.llm.substring import op3_substring_dedup

    return op3_substring_dedup(read(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirador.llm.sharding import op4_shard_documents

    return op4_shard_documents(read(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirador.llm.embeddings import op5_embedding_dedup

    return op5_embedding_dedup(read(spark, sf_dir, "embeddings"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirador.llm.toxicity import op6_toxicity

    return op6_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirador.llm.simhash import op7_simhash

    return op7_simhash(read(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirador.llm.quality import op8_quality

    return op8_quality(read(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirador.llm.decontaminate import op9_decontaminate

    return op9_decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirador.llm.linededup import op10_line_dedup

    return op10_line_dedup(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mix_sources": _op1, "op2_secret_scan": _op2, "op3_substring_dedup": _op3, "op4_shard_documents": _op4, "op5_embedding_dedup": _op5, "op6_toxicity": _op6, "op7_simhash": _op7, "op8_quality": _op8, "op9_decontaminate": _op9, "op10_line_dedup": _op10}


def oracle_sql() -> dict[str, str]:
    from mirador.llm.linededup import OP10_SQL
    from mirador.llm.secret_scan import OP2_SQL

    return {"op2_secret_scan": OP2_SQL, "op10_line_dedup": OP10_SQL}
