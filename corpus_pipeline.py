"""A corpus from documents to training order, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fabula.llm import decontaminate, mixing, neardup, tokenout, toxicity
from fabula.llm.runtime import Scratch

#: Near copies: shingles of five words, similarity of 0.8 or more.
NEAR = {"width": 5, "percent": 80}
#: The mix: flattest weights at which no source is repeated over 1.25 times as
#: often as another, with the least budget that gives every source a whole pass.
MIX = {"most_ratio": 1.25, "budget": "cover"}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; trained from labelled documents of the folder.

    Null and empty texts are scored as a sentence without features, and stay if
    that is below 0.5; repeated rows stay or go together; an empty table stays so.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, toxicity.teaching_labels(labels))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together.  Null and
    empty texts are no copies, and rows without a doc_id stay.
    """
    kept = neardup.near_duplicates(docs, **NEAR).where("not kept").select(F.col("doc_id").alias("__copy")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["__copy"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within 10 % of edits.

    Null and empty texts stay; repeated rows stay or go together; without items
    all rows stay.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of small sources again, up to their weights.

    Rows without a source are a source of their own; null and empty texts have no
    tokens and stay once or as often as their source's passes; equal rows are
    treated alike.
    """
    return mixing.mixed_rows(docs, **MIX)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every sequence at its slot.

    Null and empty texts are one sequence of the end token; repeated rows give
    their sequences each; a null doc_id sorts first.
    """
    return tokenout.training_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_ids", training_order),
]

#: Not expressible in SQL: every stage but the joins is a trained model, a sketch or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of the folder; an empty table gives none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else scratch.write(out, name)
    return docs
