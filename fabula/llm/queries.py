"""The queries of this subpackage, bound to the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fabula.llm import decontaminate, embeddings, linededup, mixing, neardup, pii, secrets, substrings, tokenout, toxicity
from fabula.llm.runtime import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), most_ratio=4.0)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.without_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(_table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), 0.95)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.written_order(_table(spark, sf_dir, "documents"), Scratch(spark, "shards").root)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_mixing": op2_mixing,
        "op3_minhash": op3_minhash,
        "op4_line_dedup": op4_line_dedup,
        "op5_secrets": op5_secrets,
        "op6_toxicity": op6_toxicity,
        "op7_pii": op7_pii,
        "op8_substrings": op8_substrings,
        "op9_embeddings": op9_embeddings,
        "op10_token_ids": op10_token_ids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash": neardup.ORACLE, "op4_line_dedup": linededup.ORACLE, "op8_substrings": substrings.ORACLE, "op9_embeddings": embeddings.ORACLE}
