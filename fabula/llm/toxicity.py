"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has the probability
``sigmoid(bias + sum of the weights of its features)``; a document's score joins
them by noisy-or, ``1 - prod(1 - p)``.  Only documents carry labels: the
gradient of the document's log-likelihood teaches the sentence weights, and
the trained weights then locate the offending sentences.

Features are hashed words and word beginnings of 4 to 7 bytes, letters only and
without case, so inflected or decorated forms share what their stems teach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fabula.llm import kernels as K
from fabula.llm.runtime import Scratch, keep_columns, ship

BITS = 20
PREFIXES = (4, 5, 6, 7)
#: Sentences end at one of these bytes.
STOPS = b".!?\n"
#: Documents of the training sample, at most this many of either label.
TRAIN_ROWS = 2500


def sentence_features(data: np.ndarray, rows: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of a slice: (feature ids [words, 1 + prefixes], sentence of each word, row of each sentence, start of each sentence).

    A sentence without words doesn't appear.
    """
    starts, ends, counts = K.word_spans(data, rows, letters=True)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), none, none, none
    stop = np.isin(data, np.frombuffer(STOPS, np.uint8))
    passed = np.cumsum(stop)[starts]
    row = np.repeat(np.arange(len(counts)), counts)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (passed[1:] != passed[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(fresh) - 1
    shift = np.uint64(64 - bits)
    ids = np.empty((len(starts), 1 + len(PREFIXES)), np.int64)
    ids[:, 0] = (K.span_hashes(data, starts, ends) >> shift).astype(np.int64)
    for k, size in enumerate(PREFIXES, 1):
        cut = np.minimum(ends, starts + size)
        ids[:, k] = (K.mix(K.span_hashes(data, starts, cut) + np.uint64(size)) >> shift).astype(np.int64)
    return ids, sentence, row[fresh], starts[fresh]


def _sentence_logits(data: np.ndarray, rows: np.ndarray, weights: np.ndarray, bias: float):
    ids, sentence, row, start = sentence_features(data, rows)
    if not len(sentence):
        return np.zeros(0), row, start
    per_word = weights[ids].sum(axis=1, dtype=np.float64)
    return bias + np.bincount(sentence, per_word, len(row)), row, start


def noisy_or(logits: np.ndarray, row: np.ndarray, n: int, bias: float) -> np.ndarray:
    """Scores of n documents from their sentences' logits.

    A document without sentences counts as one sentence without features.
    """
    quiet = np.bincount(row, np.logaddexp(0.0, logits), n)  # -log(1 - p)
    quiet[np.bincount(row, minlength=n) == 0] = np.logaddexp(0.0, bias)
    return -np.expm1(-quiet)


def telling(counts: DataFrame, documents: tuple[int, int], z: float) -> np.ndarray:
    """Features that positive documents hold more often than chance allows, by a two-sample z of at least ``z``; ascending.

    counts: feature, n0, n1 (documents of either label that hold it); documents: how many there are of either label.
    """
    n0, n1 = (max(1, n) for n in documents)
    r0, r1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
    pooled = (F.col("n0") + F.col("n1") + 1) / (n0 + n1 + 2)
    kept = counts.where((r1 - r0 >= z * F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))) & (F.col("n1") >= 3))
    return np.sort(np.array([r.feature for r in kept.select("feature").collect()], np.int64))


def fit(bags: list[tuple[int, int, np.ndarray, np.ndarray]], known: np.ndarray, prior: float = 0.5, bits: int = BITS, rounds: int = 300, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias from bags (label, number of sentences, places in ``known`` of the features, sentence of each).

    Maximises the log-likelihood of the document labels under noisy-or by
    full-batch Adam; ``prior`` is the share of label 1 among all labelled rows,
    whatever it is in the sample.  Features that aren't ``known`` keep the weight 0.
    """
    if not bags:
        return np.zeros(1 << bits, np.float32), -4.0
    labels = np.array([b[0] for b in bags], float)
    sizes = np.array([b[1] for b in bags])
    base = np.cumsum(sizes) - sizes
    cols = np.concatenate([b[2] for b in bags]).astype(np.int64)
    rws = np.concatenate([b[3] + at for b, at in zip(bags, base)]).astype(np.int64)
    row = np.repeat(np.arange(len(bags)), sizes)
    n_cols, n_rows, n_docs = len(known), len(row), len(bags)
    w, bias = np.zeros(n_cols), -6.0
    m, v, mb, vb = np.zeros(n_cols), np.zeros(n_cols), 0.0, 0.0
    share = np.where(labels == 1, prior / max(labels.sum(), 1), (1 - prior) / max((1 - labels).sum(), 1))
    for step in range(1, rounds + 1):
        logits = np.clip(bias + np.bincount(rws, w[cols], n_rows), -40, 40)
        total = np.maximum(np.bincount(row, np.logaddexp(0.0, logits), n_docs), 1e-9)
        # d(loss)/d(total): 1 for a negative document, -1 / (exp(total) - 1) for a positive one
        slope = share * np.where(labels == 1, -1.0 / np.expm1(np.minimum(total, 50)), 1.0)
        g_row = slope[row] / (1.0 + np.exp(-logits))
        g = np.bincount(cols, g_row[rws], n_cols) + decay * w
        gb = g_row.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        bias -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    out = np.zeros(1 << bits, np.float32)
    out[known] = w
    return out, float(bias)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, z: float = 4.0) -> tuple[np.ndarray, float]:
    """Fits on a bounded sample: at most ``rows`` labelled doc_ids of either label, those of the least hash.

    documents: doc_id, text; labels: doc_id, toxic (one row per doc_id).  The
    sample is chosen from the labels alone, so its ids (at most 2 * rows) are
    broadcast and the texts are read once, whole; of rows that repeat a doc_id the
    one whose text has the least hash teaches.  Features are counted and screened
    where the texts are; the driver gets the places of those that pass.
    """
    spark = documents.sparkSession
    ship(spark)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    size = known.agg(F.count("*").alias("n"), F.sum("y").alias("positive")).first()
    ids = known.where("y = 1").orderBy("h", "doc_id").limit(rows).unionByName(known.where("y = 0").orderBy("h", "doc_id").limit(rows))
    taught = keep_columns(documents, "doc_id", "text").join(F.broadcast(ids.select("doc_id", "y")), "doc_id")
    taught = taught.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("y", F.coalesce("t.text", F.lit("")).alias("text"))
    sample = Scratch(spark, "toxicity").write(taught, "sample")

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            offsets, data = K.string_column(batch.column("text"))
            for i, y in enumerate(np.asarray(batch.column("y")).tolist()):
                part = data[offsets[i] : offsets[i + 1]]
                found, sentence, _, _ = sentence_features(part, np.array([0, len(part)]))
                yield y, found, sentence

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int64)
        for y, found, _ in documents_of(batches):
            held[y, np.unique(found)] += 1
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[0, at]), pa.array(held[1, at])], ["feature", "n0", "n1"])

    counts = sample.mapInArrow(count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    number = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    features = telling(counts, (number.get(0, 0), number.get(1, 0)), z)
    sent = spark.sparkContext.broadcast(features)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[sent.value] = np.arange(len(sent.value))
        for y, found, sentence in documents_of(batches):
            own = place[found]
            use = own >= 0
            at = np.repeat(sentence.astype(np.int32), found.shape[1]).reshape(found.shape)[use]
            n = int(sentence[-1]) + 1 if len(sentence) else 1
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([n], pa.int32()), pa.array([own[use].tobytes()], pa.binary()), pa.array([at.tobytes()], pa.binary())], ["y", "n", "features", "sentence"])

    taken = sample.mapInArrow(bags, "y int, n int, features binary, sentence binary").toLocalIterator()
    return fit([(r.y, r.n, np.frombuffer(r.features, np.int32), np.frombuffer(r.sentence, np.int32)) for r in taken], features, prior=(size.positive or 0) / max(size.n, 1))


def _scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    offsets, data = K.string_column(texts)
    out = np.empty(len(texts))
    for i, j in K.slices(offsets):
        part = data[offsets[i] : offsets[j]]
        logits, row, _ = _sentence_logits(part, offsets[i : j + 1] - offsets[i], weights, bias)
        out[i:j] = noisy_or(logits, row, j - i, bias)
    return out


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id`` and ``score`` of every row, from whole texts; a null text counts as empty.

    The model is a table of fixed size (4 MB), which is broadcast.
    """
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), *held.value))], ["doc_id", "score"])

    kind = dict(documents.dtypes)["doc_id"]
    return keep_columns(documents, "doc_id", "text").mapInArrow(scores, f"doc_id {kind}, score double")


def without_toxic(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score below the threshold, with all their columns; nothing is shuffled.

    Null and empty texts are scored as a sentence without features; repeated rows
    stay or go together; an empty table gives none.
    """
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), *held.value) < threshold))

    return documents.mapInArrow(keep, documents.schema)


def offending_sentences(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """Sentences whose own probability reaches the threshold: doc_id, sentence, score.

    Null and empty texts have none; repeated rows give theirs each.
    """
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    stops = re.compile(b"[" + re.escape(STOPS) + b"]")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            offsets, data = K.string_column(batch.column("text"))
            ids, texts, probs = [], [], []
            doc_ids = batch.column("doc_id").to_pylist()
            for i in range(batch.num_rows):
                part = data[offsets[i] : offsets[i + 1]]
                logits, _, start = _sentence_logits(part, np.array([0, len(part)]), weights, bias)
                p = 1.0 / (1.0 + np.exp(-logits))
                raw = part.tobytes()
                for k in np.flatnonzero(p >= threshold):
                    end = stops.search(raw, int(start[k]))
                    ids.append(doc_ids[i])
                    texts.append(raw[start[k] : end.end() if end else len(raw)].decode("utf-8", "replace").strip())
                    probs.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), pa.array(texts, pa.string()), pa.array(probs, pa.float64())], ["doc_id", "sentence", "score"])

    kind = dict(documents.dtypes)["doc_id"]
    return keep_columns(documents, "doc_id", "text").mapInArrow(locate, f"doc_id {kind}, sentence string, score double")


def held_out(doc_id: Column) -> Column:
    """The rows that never teach: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def teaching_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labels that may teach, once for each doc_id."""
    usable = F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    return keep_columns(labels, "doc_id", "toxic").where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a sentence without features.  Repeated
    rows are scored each.  Without any usable label every score is that of the
    starting model, below 0.5 for empty texts.
    """
    model = train(documents, teaching_labels(labels))
    return score(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
