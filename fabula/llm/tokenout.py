"""Token ids in training order: fixed-stride records at keyed random slots.

Documents are tokenised and cut into sequences of at most ``length`` tokens (each
document ends with the end token).  Sequences are numbered by doc_id and place.
A keyed Feistel network over the least even number of bits that holds all
numbers permutes them; a result beyond the last number is permuted again (cycle
walking) until it falls inside, so the slots are a permutation, and the slot of
any sequence is known without a shuffle.  As slots are 0 .. n - 1, their range
partitions are known without sampling too.  ``write_shards`` writes each shard as
one binary file of records of one stride: slot s is in shard ``s div shard_size``
at byte ``(s mod shard_size) * stride``.  A record is the number of its tokens
(2 bytes), its ids padded to the whole length, and a line break (Spark's text
writer, which puts bytes as they are into any store, ends records so).  Files of
whole shards appear only when their task is committed, so an interrupted run is
resumed by writing the shards that lack.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from fabula.llm import kernels as K
from fabula.llm.runtime import Scratch, forget, keep_columns, ship, ship_file, shuffle_parts

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizer's split pattern, as published with its vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_TOKEN = 50256
LENGTH = 1024
SHARD_SIZE = 4096
#: Up to so many numbers of shards (8 bytes each) are broadcast.
BROADCAST_SHARDS = 1 << 20
#: Shards are written in up to so many passes, each over a range of them, so that only a part of all sequences is shuffled at a time.
PASSES = 4
#: Words whose tokens a worker remembers.
REMEMBERED = 600_000


class Tokenizer:
    """Byte-level BPE by a rank file; remembers the tokens of words.

    A text is split at each space between two other characters, which the split
    pattern never joins, so the ids equal those of the text as a whole.  New
    words are encoded together: only the first token of each starts with a
    space.  Texts with other white space beside a space are encoded as they are.
    """

    ODD = -1

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[k for token, k in ranks.items() if token.startswith(b" ")]] = True
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.ids, self.at = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.n_ids = self.n_words = 0

    def _keep(self, ids: np.ndarray, ends: np.ndarray) -> int:
        """Stores the tokens of new words, which end at ``ends``; the number of the first of them."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_words + len(ends) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.at[self.n_words + 1 : self.n_words + 1 + len(ends)] = self.n_ids + ends
        self.n_ids += len(ids)
        self.n_words += len(ends)
        return self.n_words - len(ends)

    def _learn(self, words: set[str]) -> None:
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        self.index.update(dict.fromkeys(words - set(plain), self.ODD))
        if plain:
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(plain)))
            starts = np.flatnonzero(self.spaced[ids])
            k = self._keep(ids, np.append(starts[1:], len(ids)))
            self.index.update(zip(plain, range(k, k + len(plain))))

    def _start(self, word: str) -> int:
        """The number of a word that starts a text."""
        if not word or word[-1].isspace():
            return self.ODD
        if word not in self.first:
            ids = np.array(self.encoding.encode_ordinary(word))
            self.first[word] = self._keep(ids, np.array([len(ids)]))
        return self.first[word]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > REMEMBERED:
            self.forget()
        split = [t.split(" ") for t in texts]
        self._learn({w for parts in split for w in parts[1:]}.difference(self.index))
        known = [[self._start(parts[0]), *map(self.index.__getitem__, parts[1:])] for parts in split]
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        k = np.fromiter(chain.from_iterable(known), np.int64, int(sizes.sum()))
        n = np.where(k >= 0, self.at[k + 1] - self.at[k], 0)
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(self.at[k] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        rows = np.split(flat, np.append(0, ends)[np.cumsum(sizes)][:-1]) if len(texts) else []
        odd = np.add.reduceat(k < 0, np.cumsum(sizes) - sizes) > 0 if len(texts) else []
        return [np.array(self.encoding.encode_ordinary(t), np.int32) if o else row for t, o, row in zip(texts, odd, rows)]


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def feistel(numbers: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """The keyed permutation of 0 .. size - 1, at ``numbers``."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = K.mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key % (1 << 64)))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (K.mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def unfeistel(slots: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """The inverse of ``feistel``: the numbers of the sequences at ``slots``."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = K.mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key % (1 << 64)))
    out = slots.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys[::-1]:
            left, right = right ^ (K.mix(left + k) & mask), left
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def sequences(documents: DataFrame, path: str = TOKENIZER, length: int = LENGTH, end: int = END_TOKEN) -> DataFrame:
    """doc_id, seq_no, n_tokens, ids (little-endian uint16) of every sequence, in partitions sorted by doc_id.

    A null or empty text is one sequence of the end token.  The rank file is sent
    to the workers.
    """
    spark = documents.sparkSession
    ship(spark)
    name = ship_file(spark, path)
    docs = keep_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(shuffle_parts(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(SparkFiles.get(name)).encode_batch
        for batch in batches:
            offsets, _ = K.string_column(batch.column("text"))
            for i, j in K.slices(offsets):
                texts = [t or "" for t in batch.column("text").slice(i, j - i).to_pylist()]
                rows, seq, count, ids = [], [], [], []
                for k, tokens in enumerate(encode(texts), i):
                    tokens = np.append(tokens, end)
                    for s, at in enumerate(range(0, len(tokens), length)):
                        part = tokens[at : at + length].astype("<u2")
                        rows.append(k)
                        seq.append(s)
                        count.append(len(part))
                        ids.append(part.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(seq, pa.int32()), pa.array(count, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "seq_no", "n_tokens", "ids"])

    return ordered.mapInArrow(cut, "doc_id long, seq_no int, n_tokens int, ids binary")


def numbered(written: DataFrame) -> tuple[DataFrame, int]:
    """A written table with ``number``, its rows' place in the order of files and rows, and the number of rows.

    Files hold ascending ranges and keep the order of rows, so the number is the
    rank by doc_id and sequence, however the table was partitioned.  The table
    of first numbers has a row for each file.
    """
    spark = written.sparkSession
    placed = written.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = placed.groupBy("file").agg(F.count("*").alias("n")).collect()
    part = lambda name: int(re.search(r"part-(\d+)", name)[1])
    first, total = [], 0
    for r in sorted(files, key=lambda r: part(r.file)):
        first.append((r.file, total))
        total += r.n
    table = spark.createDataFrame(first, "file string, first long")
    return placed.join(F.broadcast(table), "file").withColumn("number", F.col("first") + F.col("row")).drop("file", "first", "row"), total


def slotted(documents: DataFrame, path: str, length: int, key: int, end: int) -> tuple[DataFrame, int]:
    """slot, doc_id, seq_no, n_tokens, ids of every sequence, in no order, and the number of sequences."""
    spark = documents.sparkSession
    written = Scratch(spark, "tokens").write(sequences(documents, path, length, end), "sequences")
    forget(spark)
    rows, total = numbered(written)

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), total, key))

    return rows.withColumn("slot", slot("number")).select("slot", "doc_id", "seq_no", "n_tokens", "ids"), total


def in_ranges(rows: DataFrame, total: int, size: int, *order: str, first: int = 0) -> DataFrame:
    """``rows`` of ``total`` slots from ``first`` on in one partition for each of as many even ranges of whole units of ``size`` slots as there are partitions, sorted within."""
    parts = shuffle_parts(rows.sparkSession)
    each = -(-max(1, -(-total // size)) // parts) * size
    return rows.repartitionById(parts, F.floor((F.col("slot") - first) / each).cast("int")).sortWithinPartitions(*order)


def training_order(documents: DataFrame, path: str = TOKENIZER, length: int = LENGTH, shard_size: int = SHARD_SIZE, key: int = 0x5EED, end: int = END_TOKEN) -> DataFrame:
    """Every sequence with its place: slot, shard, byte_offset, doc_id, seq_no, n_tokens, ids; in range partitions sorted by slot.

    documents: doc_id (long) and text; other columns are ignored.  Null and empty
    texts give one sequence of the end token alone.  Repeated rows give their
    sequences each.  A null doc_id sorts first.  An empty table gives no rows.
    """
    rows, total = slotted(documents, path, length, key, end)
    return _with_places(in_ranges(rows, total, 1, "slot"), length, shard_size, "doc_id", "seq_no", "n_tokens", "ids")


def _with_places(rows: DataFrame, length: int, shard_size: int, *columns: str) -> DataFrame:
    """slot, shard, byte_offset and ``columns`` of rows with a slot."""
    shard, offset = F.floor(F.col("slot") / shard_size), F.pmod("slot", F.lit(shard_size)) * stride(length)
    return rows.select("slot", shard.cast("long").alias("shard"), offset.cast("long").alias("byte_offset"), *columns)


def written_order(documents: DataFrame, out: str, path: str = TOKENIZER, length: int = LENGTH, shard_size: int = SHARD_SIZE, key: int = 0x5EED, end: int = END_TOKEN) -> DataFrame:
    """Writes the shards as ``write_shards`` does and returns what they hold: slot, shard, byte_offset, doc_id, seq_no, n_tokens, ids_sha256.

    n_tokens and the digest of the ids come from the records as they are read back
    from the files; doc_id and seq_no, which records don't hold, join them by slot.
    In range partitions sorted by slot.  Nulls, empty texts and repeated rows as
    in ``training_order``; an empty table gives no rows and no shards.
    """
    rows, total = slotted(documents, path, length, key, end)
    _write_slotted(rows, total, out, length, shard_size, end)
    read = read_shards(documents.sparkSession, out, 0, shard_size, length).select("slot", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))
    held = rows.select("slot", "doc_id", "seq_no").join(read, "slot", "left")
    return _with_places(in_ranges(held, total, 1, "slot"), length, shard_size, "doc_id", "seq_no", "n_tokens", "ids_sha256")


def stride(length: int) -> int:
    """Bytes of a record: the number of tokens, the ids, a line break."""
    return 2 + 2 * length + 1


def write_shards(documents: DataFrame, out: str, path: str = TOKENIZER, length: int = LENGTH, shard_size: int = SHARD_SIZE, key: int = 0x5EED, end: int = END_TOKEN) -> int:
    """Writes each shard as a file of fixed-stride records, out/shards/shard=k/part-*; the number of shards that were written.

    Shards that are there with all their bytes are left as they are, so a run that
    was cut off goes on where it ended (with the same documents and arguments).
    out/manifest, a JSON table, holds for each shard first_slot, n_records and
    stride.  Nulls, empty texts and repeated rows as in ``training_order``; an
    empty table gives no shards.
    """
    return _write_slotted(*slotted(documents, path, length, key, end), out, length, shard_size, end)


def _write_slotted(rows: DataFrame, total: int, out: str, length: int, shard_size: int, end: int) -> int:
    """Writes the shards that lack, in passes over ranges of shards; their number."""
    spark = rows.sparkSession
    manifest = spark.range(-(-total // shard_size)).select(F.col("id").alias("shard"), (F.col("id") * shard_size).alias("first_slot"))
    manifest = manifest.withColumns({"n_records": F.least(F.lit(shard_size), F.lit(total) - F.col("first_slot")), "stride": F.lit(stride(length))})
    manifest.write.mode("overwrite").json(f"{out}/manifest")
    # a shard is there if its file has all its bytes; a broken one is replaced
    there = shard_files(spark, out).groupBy("shard").agg(F.sum("length").alias("bytes"))
    whole = manifest.join(there, "shard").where(F.col("bytes") == F.col("n_records") * F.col("stride"))
    lacking = Scratch(spark, "shards").write(manifest.join(whole, "shard", "left_anti").select("shard"), "lacking")
    count = lacking.count()
    if count:
        pad = np.full(length, end, "<u2").tobytes()
        byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
        record = F.concat(byte(F.pmod("n_tokens", F.lit(256))), byte(F.floor(F.col("n_tokens") / 256)), F.substring(F.concat("ids", F.lit(pad)), 1, 2 * length))
        held = rows.withColumn("shard", F.floor(F.col("slot") / shard_size).cast("long"))
        held = held.join(F.broadcast(lacking) if count <= BROADCAST_SHARDS else lacking, "shard", "left_semi")
        shards = -(-total // shard_size)
        each = -(-shards // max(1, min(PASSES, shards // PASSES))) * shard_size
        for first in range(0, total, each):
            some = held.where((F.col("slot") >= first) & (F.col("slot") < first + each))
            placed = in_ranges(some, min(each, total - first), shard_size, "shard", "slot", first=first).select(record.cast("string").alias("value"), "shard")
            # in the order of shards, so the writer keeps the order and has one file open at a time
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).option("lineSep", "\n").partitionBy("shard").text(f"{out}/shards")
            forget(spark)
    return count


def shard_files(spark: SparkSession, out: str) -> DataFrame:
    """shard, length and content of the shard files; none where there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/shards")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "shard long, length long, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{out}/shards")
    return files.select(F.col("shard").cast("long").alias("shard"), "length", "content")


def read_shards(spark: SparkSession, out: str, first_slot: int = 0, shard_size: int = SHARD_SIZE, length: int = LENGTH) -> DataFrame:
    """slot, n_tokens, ids of the records from ``first_slot`` on; only files of shards from there on are read."""
    step = stride(length)
    files = shard_files(spark, out).where(F.col("shard") >= first_slot // shard_size)
    rows = files.select("shard", "content", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / step).cast("int") - 1)).alias("i"))
    record = F.substring(F.col("content"), F.col("i") * step + 1, F.lit(step))
    rows = rows.select((F.col("shard") * shard_size + F.col("i")).alias("slot"), record.alias("r"))
    byte = lambda k: F.conv(F.hex(F.substring("r", k, 1)), 16, 10).cast("int")
    rows = rows.where(F.col("slot") >= first_slot).withColumn("n_tokens", byte(1) + byte(2) * 256)
    return rows.select("slot", "n_tokens", F.substring(F.col("r"), F.lit(3), F.col("n_tokens") * 2).alias("ids"))
