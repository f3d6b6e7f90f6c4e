"""Readers: whole texts, chunk files, FictionBook chapters, audio headers, settings."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fabula.functions.keys import profile_tone
from fabula.functions.text import strip
from fabula.operators.dialogue import MAX_CHARS, PROFILES, parse_book

# The namespace and the titles of untitled parts.
NAMESPACE = "http://www.gribuser.ru/xml/fictionbook/2.0"
UNTITLED, WHOLE_BOOK = "Глава {}", "Книга"
CHUNK_SCHEMA = "type string, text string, ssml string, post_tone string, pitch_shift string"


def read_texts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path, text of whole files, line breaks unified.

    strict: bytes that aren't UTF-8 are an error when the file is read; otherwise
    they are replaced.  Spark lists no files of 0 bytes, so these give no row.
    """
    return texts_of(spark.read.format("binaryFile").load(path).select("path", "content"), strict)


def texts_of(files: DataFrame, strict: bool = True) -> DataFrame:
    """``read_texts`` of files that are read: path, content; no content is no text, and no error."""
    text = F.col("content").cast("string")
    wrong = F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path")))
    text = F.when(~F.is_valid_utf8(text), wrong).otherwise(text) if strict else F.make_valid_utf8(text)
    return files.select("path", F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")).alias("text"))


def read_filled_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files as (valid, rejected): path, text, stripped; rejected with the reason, as they hold no text."""
    rows = filled(read_texts(spark, path))
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def filled(texts: DataFrame) -> DataFrame:
    """path, text, stripped, reason: every file, with ``empty`` as the reason where no text is left and null elsewhere."""
    rows = texts.withColumn("text", strip("text"))
    return rows.withColumn("reason", F.when(F.coalesce(F.col("text") == "", F.lit(True)), "empty"))


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunk files as (valid, rejected): path, chunk_idx (from 1), type, text, ssml, post_tone; rejected with the reason.

    A chunk needs a type and a text that aren't blank; a blank markup is null.
    """
    return chunks_of(read_texts(spark, path))


def chunks_of(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``read_chunks`` of texts that are read: path, text."""
    items = texts.select("path", F.posexplode_outer(F.from_json("text", f"array<struct<{', '.join(f.replace(' ', ':') for f in CHUNK_SCHEMA.split(', '))}>>")).alias("i", "c"))
    blank = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    reason = (
        F.when(F.col("i").isNull(), "not a list of chunks").when(F.col("c").isNull(), "not an object")
        .when(blank(F.col("c.type")), "no type").when(blank(F.col("c.text")), "no text")
    )
    rows = items.select(
        "path", (F.col("i") + 1).alias("chunk_idx"), "c.type", "c.text", F.when(~blank(F.col("c.ssml")), F.col("c.ssml")).alias("ssml"),
        profile_tone(F.col("c.post_tone"), F.col("c.pitch_shift")).alias("post_tone"), reason.alias("reason"),
    )
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def read_book(spark: SparkSession, path: str, most: int = MAX_CHARS, profiles: dict = PROFILES) -> DataFrame:
    """Chunks of ``.txt`` books (parsed) or of ``.json`` chunk files (as they are)."""
    if path.endswith(".txt"):
        return parse_book(read_texts(spark, path), most=most, profiles=profiles)
    if path.endswith(".json"):
        return read_chunks(spark, path)[0]
    raise ValueError(f"neither .txt nor .json: {path}")


def _texts(node: ET.Element) -> Iterator[str]:
    for p in node.iter(f"{{{NAMESPACE}}}p"):
        t = "".join(p.itertext()).strip()
        if t:
            yield t


def book_chapters(content: bytes) -> list[tuple[str, list[str]]]:
    """(title, paragraphs) of the chapters of a FictionBook file.

    Chapters are the top sections of the first body; sections inside them and
    their titles' paragraphs count as their text.  Untitled ones are named by
    their place among all; empty ones are dropped.  Without any, the body is one.
    """
    tag = lambda name: f"{{{NAMESPACE}}}{name}"
    body = ET.fromstring(content).find(tag("body"))
    if body is None:
        return []
    found = []
    for k, section in enumerate(body.findall(tag("section")), 1):
        heading = section.find(tag("title"))
        own = [] if heading is None else [t for p in heading.findall(tag("p")) if (t := "".join(p.itertext()).strip())]
        found.append((" ".join(own) or UNTITLED.format(k), list(_texts(section))))
    found = [c for c in found if c[1]]
    whole = list(_texts(body))
    return found or ([(WHOLE_BOOK, whole)] if whole else [])


def chapters_of(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, chapter_idx (from 1), title, paragraphs, error of FictionBook contents (binary).

    A file that can't be parsed gives one row with the error alone.
    """
    kind = dict(files.dtypes)[key]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, raw in zip(batch[key], batch[content]):
                try:
                    rows += [(k, i, t, ps, None) for i, (t, ps) in enumerate(book_chapters(bytes(raw)), 1)]
                except ET.ParseError as e:
                    rows.append((k, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "chapter_idx", "title", "paragraphs", "error"]).astype({"chapter_idx": "Int64"})

    return files.select(key, content).mapInPandas(parse, f"{key} {kind}, chapter_idx long, title string, paragraphs array<string>, error string")


def read_fb2(spark: SparkSession, path: str) -> DataFrame:
    return chapters_of(spark.read.format("binaryFile").load(path).select("path", "content"))


def json_object(text: Column) -> Column:
    """The values of a JSON object as strings; an empty map for anything else."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def model_folder(variable: str, name: str, environ: dict[str, str] | None = None) -> str:
    """The folder of an engine's models: that of the variable, else ``name`` in the user's cache folder."""
    environ = dict(os.environ) if environ is None else environ
    if environ.get(variable):
        return environ[variable]
    return os.path.join(environ.get("XDG_CACHE_HOME") or os.path.join(environ.get("HOME", os.path.expanduser("~")), ".cache"), name)


def chapter_text(paragraphs: Column) -> Column:
    return F.array_join(paragraphs, "\n\n")


def load_dotenv(text: str, environ: dict[str, str] | None = None) -> dict[str, str]:
    """Settings of ``key=value`` lines that aren't set yet; they are set in environ and returned."""
    environ = os.environ if environ is None else environ
    new = {}
    for line in map(str.strip, text.splitlines()):
        name, eq, value = line.partition("=")
        if line.startswith("#") or not eq or not name.strip() or name.strip() in environ:
            continue
        new[name.strip()] = environ[name.strip()] = value.strip().strip("'\"")
    return new
