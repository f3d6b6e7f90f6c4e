"""Incremental runs over folders of texts: Structured Streaming with AvailableNow.

An extension: a restarted run reads only files that earlier runs haven't seen.
A micro-batch may be run again after a failure, so each has a folder of its own,
which a second run replaces: its rows are there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fabula.operators.dialogue import MAX_CHARS, PROFILES, parse_book


def run_once(spark: SparkSession, source: str, out: str, checkpoint: str, most: int = MAX_CHARS, profiles: dict = PROFILES) -> None:
    """Parses new Parquet files of documents (doc_id, text) into chunk files, then stops."""
    schema = spark.read.parquet(source).select("doc_id", "text").schema
    fresh = spark.readStream.schema(schema).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        parse_book(batch, most=most, profiles=profiles).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = fresh.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
