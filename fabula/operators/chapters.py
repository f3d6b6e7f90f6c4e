"""Chapters of plain text: heading rows start groups, which windows number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fabula.functions import text as T
from fabula.operators.segment import plain_paragraphs


def book_paragraphs(raw: Column) -> Column:
    """Paragraphs of a text with literal line breaks and glued chapter markers."""
    return plain_paragraphs(T.isolate_headings(T.unescape_newlines(T.clean_wrappers(raw))))


def guess_title(paras: Column, default: Column) -> Column:
    """The first line of the first paragraph, if it has 2 to 120 characters."""
    first = T.strip(F.substring_index(F.try_element_at(paras, F.lit(1)), "\n", 1))
    return F.when(F.length(first).between(2, 120), first).otherwise(default)


def split_chapters(df: DataFrame, key: str = "doc_id", paras: str = "paragraphs", title: str = "title") -> DataFrame:
    """key, chapter_idx (from 0), title, paragraphs (array) of every book of df.

    df has one row per key, with the array of paragraphs and a fallback title.
    A heading opens a chapter and is no paragraph of it; chapters without
    paragraphs are dropped, but a book without any keeps one, of its last
    heading.  A first paragraph of chapter 0 that equals the book's title is
    dropped.  The windows hold one book each.
    """
    rows = df.select(key, F.col(title).alias("__book"), F.posexplode(paras).alias("__i", "__p"))
    norm = T.heading_normalize("__p")
    ordered = Window.partitionBy(key).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__h", F.when(T.is_heading(norm), norm))
    placed = marked.withColumn("__g", F.count("__h").over(ordered)).withColumn("__title", F.coalesce(F.last("__h", ignorenulls=True).over(ordered), "__book"))
    groups = placed.groupBy(key, "__g").agg(
        F.first("__title").alias("title"), F.first("__book").alias("__book"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("__h").isNull(), F.struct("__i", "__p")))), lambda x: x["__p"]).alias("paragraphs"),
    )
    full = F.size("paragraphs") > 0
    any_full = F.max(full).over(Window.partitionBy(key))
    last = F.col("__g") == F.max("__g").over(Window.partitionBy(key))
    kept = groups.withColumn("__keep", full | (~any_full & last)).where("__keep")
    numbered = kept.withColumn("chapter_idx", F.row_number().over(Window.partitionBy(key).orderBy("__g")) - 1)
    repeats = (F.col("chapter_idx") == 0) & (T.heading_normalize(F.try_element_at("paragraphs", F.lit(1))) == T.heading_normalize("__book"))
    trimmed = F.when(repeats, F.slice("paragraphs", F.lit(2), F.size("paragraphs"))).otherwise(F.col("paragraphs"))
    return numbered.select(key, "chapter_idx", "title", trimmed.alias("paragraphs"))
