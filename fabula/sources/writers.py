"""Writers: chunk files, texts by chapter, FictionBook, caches and state."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fabula.functions.text import chunk_line, fold_newlines
from fabula.sources.readers import NAMESPACE


def chunk_json(kind: Column, text: Column, ssml: Column, post_tone: Column) -> Column:
    """A chunk as JSON without null markup and empty tone."""
    return F.to_json(F.struct(kind.alias("type"), text.alias("text"), ssml.alias("ssml"), F.nullif(post_tone, F.lit("")).alias("post_tone")))


def parsed_files(chunks: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, json (an indented array) and lines (``[type]: text``) of each book."""
    sorted_ = F.array_sort(F.collect_list(F.struct(*order, "type", "text", "ssml", "post_tone")))
    rows = chunks.groupBy(by).agg(sorted_.alias("c"))
    whole = F.array_join(F.transform("c", lambda c: F.concat(F.lit("  "), chunk_json(c["type"], c["text"], c["ssml"], c["post_tone"]))), ",\n")
    listed = F.array_join(F.transform("c", lambda c: chunk_line(c["type"], c["text"])), "\n")
    return rows.select(by, F.concat(F.lit("[\n"), whole, F.lit("\n]")).alias("json"), F.concat(listed, F.lit("\n")).alias("lines"))


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """A folder of text files for each name."""
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).write.partitionBy("name").text(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Caches, states and reject tables are Parquet."""
    df.write.mode(mode).parquet(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table that is written by key."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [s.getPath() for s in files.listStatus(where) if s.getPath().getName().startswith("v")]
    return sorted(int(p.getName()[1:]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete version of a table written by ``write_keyed``; None if there is none."""
    known = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{known[-1]}") if known else None


def write_keyed(df: DataFrame, path: str, keys: list[str]) -> int:
    """Puts rows in place of those with their keys; the others stay.  Returns the number of the version written.

    Every call writes a version, and readers take the last complete one, so a run
    that is cut off leaves the table as it was.  Keys of df are unique.
    """
    known, old = _versions(df.sparkSession, path), read_keyed(df.sparkSession, path)
    number = known[-1] + 1 if known else 0
    whole = df if old is None else old.join(df.select(*keys), keys, "left_anti").unionByName(df, allowMissingColumns=True)
    whole.write.mode("overwrite").parquet(f"{path}/v{number}")
    return number


def whole_text(chapters: DataFrame, by: str) -> DataFrame:
    """by, text: stripped chapter texts in order, a blank line between them and a line break at the end."""
    from fabula.functions.text import strip

    rows = chapters.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("chapter_idx", strip("text").alias("t")))).alias("c"))
    return rows.select(by, F.concat(F.array_join(F.transform("c", lambda c: c["t"]), "\n\n"), F.lit("\n")).alias("text"))


def fb2_document(title: str, author: tuple[str, str] | None, date: str, chapters: list[tuple[str, list[str]]]) -> str:
    """A FictionBook file of chapters (title, paragraphs without line breaks); blank paragraphs are left out."""
    ET.register_namespace("", NAMESPACE)

    def add(parent: ET.Element, name: str, text: str | None = None, **attributes: str) -> ET.Element:
        node = ET.SubElement(parent, f"{{{NAMESPACE}}}{name}", attributes)
        node.text = text
        return node

    book = ET.Element(f"{{{NAMESPACE}}}FictionBook")
    description = add(book, "description")
    info = add(description, "title-info")
    if author:
        person = add(info, "author")
        add(person, "first-name", author[0])
        add(person, "last-name", author[1])
    add(info, "book-title", title)
    add(info, "lang", "ru")
    made = add(description, "document-info")
    add(made, "program-used", "fabula")
    add(made, "date", date, value=date)
    body = add(book, "body")
    for name, paras in chapters:
        section = add(body, "section")
        add(add(section, "title"), "p", name)
        for p in paras:
            if p:
                add(section, "p", p)
    ET.indent(book)
    return '<?xml version="1.0" encoding="utf-8"?>\n' + ET.tostring(book, encoding="unicode")


def fb2_files(chapters: DataFrame, by: str, date: str, author: tuple[str, str] | None = None) -> DataFrame:
    """by, fb2: a FictionBook file for each book of chapters (book_title, chapter_idx, title, paragraphs)."""
    kind = dict(chapters.dtypes)[by]
    clean = chapters.withColumn("paragraphs", F.transform("paragraphs", fold_newlines))
    books = clean.groupBy(by).agg(F.first("book_title").alias("book_title"), F.array_sort(F.collect_list(F.struct("chapter_idx", "title", "paragraphs"))).alias("c"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [fb2_document(t, author, date, [(c["title"], list(c["paragraphs"])) for c in cs]) for t, cs in zip(batch["book_title"], batch["c"])]
            yield pd.DataFrame({by: batch[by], "fb2": made})

    return books.mapInPandas(build, f"{by} {kind}, fb2 string")
