"""Exact-substring dedup by bucketed suffix arrays, sorted in two stages.

A byte is removed if a string of ``length`` bytes that covers it also starts in
a document of a smaller doc_id.  Sorting every suffix of a corpus would move
each byte many times, so suffixes are dealt out by an anchor of their first
``length`` bytes: the least of the hashed ``GRAM``-byte grams inside (a
minimiser).  Equal strings have equal anchors.  The steps:

1. each document's anchors, as hashes only; those found in a single document
   are dropped, for no suffix there can be repeated;
2. around the other anchors, the pieces of text that hold all suffixes of an
   anchor (neighbouring suffixes share their anchor, so a piece has them
   together) go to the bucket of the anchor; equal pieces count once;
3. in each bucket a suffix array: only suffixes smaller than their successors
   are sorted directly, the others follow by scanning the buckets of first
   bytes in order; adjacent common prefixes of at least ``length`` bytes make
   classes, and the smallest doc_id of a class decides for the others;
4. the removed runs go back to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fabula.llm import kernels as K
from fabula.llm.runtime import Scratch, forget, keep_columns, plan_bytes, shuffle_parts, ship

LENGTH = 50
GRAM = 16
#: Anchors that a task gathers before it passes them on.
FLUSH = 400_000
#: Aims for the size of groups: anchors, bytes of documents (as stored), bytes of pieces.
GROUP_ANCHORS, GROUP_TEXT, GROUP_PIECES = 500_000, 4 << 20, 1 << 20

_POS = np.uint64((1 << 22) - 1)
#: Places in a text carry bits of the text's hash above these, so that two texts under one doc_id keep apart.
PLACE_BITS, TAG_BITS = 40, 22


def segments(offsets: np.ndarray, length: int, most: int = K.SLICE_BYTES) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, first byte, last byte) of at most about ``most`` bytes; long rows are cut with an overlap of length - 1."""
    group, held = [], 0
    for r in range(len(offsets) - 1):
        n = int(offsets[r + 1] - offsets[r])
        if n < length:
            continue
        lo = 0
        while True:
            hi = min(n, lo + most)
            group.append((r, lo, hi))
            held += hi - lo
            if held >= most:
                yield group
                group, held = [], 0
            if hi == n:
                break
            lo = hi - length + 1
    if group:
        yield group


def anchored_runs(data: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffix starts that share an anchor: first start, end of the run, anchor hash; in order of start.

    rows: offsets of the pieces within data; a suffix needs ``length`` bytes of its piece.
    """
    n = len(data)
    window = length - GRAM + 1
    up, down = K.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(K.BYTE_CODE[data] * up[:-1], out=sums[1:])
    grams = K.mix((sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1])
    v = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < window:
        v = np.minimum(v[: len(v) - (window - span)], v[window - span :])
    starts = np.arange(len(v))
    left = np.repeat(rows[1:], np.diff(rows))[: len(v)] - starts
    starts = starts[left >= length]
    anchor = (v[starts] & _POS).astype(np.int64)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] + 1, grams[anchor[first]]


def _documents_runs(offsets: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row of each run, its start in bytes, its suffixes, its anchor, its start in the row) of each group of segments."""
    for group in segments(offsets, length):
        part = np.concatenate([data[offsets[r] + lo : offsets[r] + hi] for r, lo, hi in group])
        rows = np.concatenate([[0], np.cumsum([hi - lo for _, lo, hi in group])])
        first, end, h = anchored_runs(part, rows, length)
        seg = np.searchsorted(rows, first, "right") - 1
        row = np.array([g[0] for g in group])[seg]
        shift = np.array([g[1] for g in group])[seg] - rows[seg]
        yield part, row, first, end - first, h, first + shift


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, positions) of each distinct key; positions ascend."""
    if len(keys):
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for at in np.split(order, cuts):
            yield int(keys[at[0]]), at


def suffix_order(text: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """All positions of text in the order of their first ``depth`` bytes, by two-stage sorting.

    words: the 8 bytes from each position as big-endian integers, padded by at least ``depth`` entries.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    nearest = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    following = np.append(text[1:], 0)
    smaller = (text < following)[nearest]
    smaller[nearest == n - 1] = False  # the last suffix is larger than the empty one
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(words[direct], kind="stable")]
    group = np.zeros(len(direct), np.int64)
    fresh = np.ones(len(direct), bool)
    fresh[1:] = words[direct[1:]] != words[direct[:-1]]
    for at in range(8, depth, 8):
        group = np.cumsum(fresh)
        alone = fresh & np.append(fresh[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        sub = direct[tied]
        w = words[sub + at]
        order = np.lexsort((w, group[tied]))
        direct[tied] = sub[order]
        w, g = w[order], group[tied]
        fresh[tied] = np.append(True, (w[1:] != w[:-1]) | (g[1:] != g[:-1]))
    cuts = np.searchsorted(text[direct], np.arange(257))
    arriving: list[list[np.ndarray]] = [[] for _ in range(256)]
    arriving[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        larger = arriving[c]
        current = np.concatenate(larger) if larger else np.zeros(0, np.int64)
        larger = [current]
        while len(current):
            before = current[current > 0] - 1
            current = before[text[before] == c]
            larger.append(current)
        bucket = np.concatenate([*larger, direct[cuts[c] : cuts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        chars = text[before]
        before, chars = before[chars > c], chars[chars > c]
        for key, at in _split(chars.astype(np.int64)):
            arriving[key].append(before[at])
        arriving[c] = []
    return np.concatenate(out)


def repeated_starts(pieces: list[bytes], owners: np.ndarray, length: int) -> np.ndarray:
    """For every suffix start of the joined pieces the least owner of its first ``length`` bytes (-1 << 63 where fewer are left)."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + 72, np.uint8)]).astype(np.uint64)
    words = np.zeros(n + length + 64, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)] << np.uint64(56 - 8 * k)
    sizes = np.array([len(p) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    order = suffix_order(text, words, length)
    order = order[left[order] >= length]
    least = np.full(n, -(1 << 63), np.int64)
    if len(order):
        fresh = np.zeros(len(order), bool)
        fresh[0] = True
        for at in [*range(0, length - 7, 8), length - 8]:
            w = words[order + at]
            fresh[1:] |= w[1:] != w[:-1]
        heads = np.flatnonzero(fresh)
        low = np.minimum.reduceat(owners[piece[order]], heads)
        least[order] = np.repeat(low, np.diff(np.append(heads, len(order))))
    return least


def _odd(n: int) -> int:
    """A number from n on with no small divisors, so that ids of any stride spread."""
    n |= 1
    while any(n % p == 0 for p in (3, 5, 7, 11, 13) if n > p):
        n += 2
    return n


def removed_runs(docs: DataFrame, scratch: Scratch, length: int, groups: int) -> DataFrame:
    """Removed runs by group of documents: g, docs, starts, ends (binary arrays of longs)."""
    spark = docs.sparkSession
    size = plan_bytes(docs)
    bits = max(4, min(16, int(np.ceil(np.log2(max(1, size * 2 / 16 / GROUP_ANCHORS))))))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, d = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
            h, d = h[once], d[once]
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            low = ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for b, at in _split(bucket):
                at = at[np.argsort(d[at], kind="stable")]  # runs of one document compress
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([d[at].tobytes()], pa.binary()), pa.array([low[at].tobytes()], pa.binary())], ["bucket", "docs", "lows"])

        for batch in batches:
            offsets, data = K.string_column(batch.column("text"))
            ids = np.asarray(batch.column("doc_id"))
            for _, row, _, _, h, _ in _documents_runs(offsets, data, length):
                held.append((h, ids[row]))
                count += len(h)
                if count >= FLUSH:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    def shared(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        d = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("docs")])
        low = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("lows")])
        order = np.lexsort((d, low))
        d, low = d[order], low[order]
        fresh = np.append(True, low[1:] != low[:-1])
        heads = np.flatnonzero(fresh)
        n = np.diff(np.append(heads, len(low)))
        several = np.repeat(d[heads] != d[heads + n - 1], n)
        d, low = d[several], low[several]
        key = np.uint64(bucket << 32) | low.astype(np.uint64)
        g, docs_, keys, size_ = [], [], [], []
        for k, at in _split(d % groups):
            g.append(k)
            docs_.append(d[at].tobytes())
            keys.append(key[at].tobytes())
            size_.append(len(at))
        return pa.table({"g": pa.array(g, pa.int32()), "docs": pa.array(docs_, pa.binary()), "keys": pa.array(keys, pa.binary()), "n": pa.array(size_, pa.int64())})

    anchors = scratch.write(docs.mapInArrow(hashes, "bucket int, docs binary, lows binary").groupBy("bucket").applyInArrow(shared, "g int, docs binary, keys binary, n long"), "anchors")
    forget(spark)
    total = anchors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, total * (length + 16) // GROUP_PIECES)

    def pieces(texts: pa.Table, found: pa.Table) -> pa.Table:
        fields = ["bucket", "text", "sizes", "which", "docs", "starts"]
        out: dict[str, list] = {f: [] for f in fields}
        if texts.num_rows and found.num_rows:
            offsets, data = K.string_column(texts.column("text"))
            ids = np.asarray(texts.column("doc_id").combine_chunks())
            tags = np.asarray(texts.column("tag").combine_chunks())
            d = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in found.column("docs")])
            k = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in found.column("keys")])
            known = np.unique(K.mix(K.mix(d.view(np.uint64)) + k))
            taken = [[] for _ in range(5)]
            strings: list[bytes] = []
            for part, row, first, n, h, start in _documents_runs(offsets, data, length):
                key = h >> np.uint64(32 - bits)
                pair = K.mix(K.mix(ids[row].view(np.uint64)) + key)
                at = np.searchsorted(known, pair)
                hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == pair)
                raw = part.tobytes()
                strings += [raw[a : a + m + length - 1] for a, m in zip(first[hit].tolist(), n[hit].tolist())]
                for x, y in zip(taken, (K.mix(key[hit]) % np.uint64(buckets), ids[row[hit]], start[hit] + tags[row[hit]])):
                    x.append(y)
            if strings:
                b, d, s = (np.concatenate(x).astype(np.int64) for x in taken[:3])
                for bucket, at in _split(b):
                    own: dict[bytes, int] = {}
                    which = [own.setdefault(strings[i], len(own)) for i in at.tolist()]
                    out["bucket"].append(bucket)
                    out["text"].append(pa.compress(b"".join(own), codec="zstd", asbytes=True))
                    out["sizes"].append(np.array([len(x) for x in own], np.int32).tobytes())
                    out["which"].append(np.array(which, np.int32).tobytes())
                    out["docs"].append(d[at].tobytes())
                    out["starts"].append(s[at].astype(np.int64).tobytes())
        return pa.table([pa.array(out["bucket"], pa.int64()), *(pa.array(out[f], pa.binary()) for f in fields[1:])], names=fields)

    def decide(table: pa.Table) -> pa.Table:
        own: dict[bytes, int] = {}
        which, docs_, starts = [], [], []
        for text, sizes, w, d, s in zip(*(table.column(c).to_pylist() for c in ("text", "sizes", "which", "docs", "starts"))):
            ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
            text = pa.decompress(text, decompressed_size=ends[-1], codec="zstd", asbytes=True)
            index = np.array([own.setdefault(text[a:b], len(own)) for a, b in zip([0, *ends], ends)])
            which.append(index[np.frombuffer(w, np.int32)])
            docs_.append(np.frombuffer(d, np.int64))
            starts.append(np.frombuffer(s, np.int64))
        which, docs_, starts = (np.concatenate(x) for x in (which, docs_, starts))
        owner = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(owner, which, docs_)
        contents = list(own)
        least = repeated_starts(contents, owner, length)
        sizes = np.array([len(x) for x in contents])
        at = np.concatenate([[0], np.cumsum(sizes)])
        later = docs_ > owner[which]
        runs = [(docs_[later], starts[later], starts[later] + sizes[which[later]])]
        # a piece's first document keeps what no other piece has from an earlier one
        piece = np.repeat(np.arange(len(contents)), sizes)
        taken = (least != -(1 << 63)) & (least < owner[piece])
        if taken.any():
            edge = np.diff(np.concatenate([[False], taken, [False]]).astype(np.int8))
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            of = piece[lo]
            by_piece = np.argsort(which[~later], kind="stable")
            firsts = np.flatnonzero(~later)[by_piece]
            a = np.searchsorted(which[firsts], of, "left")
            b = np.searchsorted(which[firsts], of, "right")
            n = b - a
            ref = firsts[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            lo, hi, of = np.repeat(lo, n), np.repeat(hi, n), np.repeat(of, n)
            runs.append((docs_[ref], starts[ref] + lo - at[of], starts[ref] + hi - at[of] + length - 1))
        d, s, e = (np.concatenate(x) for x in zip(*runs))
        g, out = [], [[], [], []]
        for k, pos in _split(d % groups):
            g.append(k)
            for x, y in zip(out, (d, s, e)):
                x.append(y[pos].tobytes())
        return pa.table([pa.array(g, pa.int32()), *(pa.array(x, pa.binary()) for x in out)], names=["g", "docs", "starts", "ends"])

    # no name is kept for what was written, so that its shuffle files can go
    runs = scratch.write(
        docs.groupBy("g").cogroup(anchors.groupBy("g")).applyInArrow(pieces, "bucket long, text binary, sizes binary, which binary, docs binary, starts binary")
        .groupBy("bucket").applyInArrow(decide, "g int, docs binary, starts binary, ends binary"), "runs"
    )
    scratch.drop(anchors)
    forget(spark)
    return runs


def kept_bytes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of raw without the runs, the number of removed bytes and of maximal runs."""
    if not len(starts):
        return raw, 0, 0
    delta = np.zeros(len(raw) + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    gone = np.cumsum(delta[:-1]) > 0
    n = int(gone.sum())
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), n, runs


def without_repeats(documents: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """One row per row of ``documents``: doc_id, kept (binary), n_bytes, n_removed, n_spans, kept_sha256.

    With ``texts`` False kept is null, for uses that need the figures alone.

    documents: doc_id (long) and text, taken as UTF-8 bytes; other columns are
    ignored.  Null and empty texts, and texts of fewer than ``length`` bytes,
    lose nothing.  Rows that repeat a doc_id don't remove one another's bytes, and
    each gets the result of its own text.  Rows without a doc_id lose nothing and
    take nothing from others.  An empty table gives no rows.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark, "substrings")
    docs = keep_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    groups = _odd(min(max(shuffle_parts(spark), plan_bytes(docs) // GROUP_TEXT), 1 << 30))
    tag = F.shiftleft(F.pmod(F.xxhash64("text"), F.lit(1 << TAG_BITS)), PLACE_BITS)
    # rows without a doc_id are spread by their texts
    docs = docs.withColumns({"tag": tag, "g": F.pmod(F.coalesce("doc_id", F.xxhash64("text")), F.lit(groups)).cast("int")})
    runs = removed_runs(docs.where("doc_id is not null"), scratch, length, groups)

    def finish(own: pa.Table, found: pa.Table) -> pa.Table:
        offsets, data = K.string_column(own.column("text")) if own.num_rows else (np.zeros(1, np.int64), np.zeros(0, np.uint8))
        if found.num_rows:
            d, s, e = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in found.column(c)]) for c in ("docs", "starts", "ends"))
            order = np.lexsort((s, d))
            d, s, e = d[order], s[order], e[order]
        else:
            d = s = e = np.zeros(0, np.int64)
        kept, digests, sizes, gone, spans = [], [], [], [], []
        for i, (doc, tag) in enumerate(zip(own.column("doc_id").to_pylist(), own.column("tag").to_pylist())):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            a, b = (np.searchsorted(d, doc, "left"), np.searchsorted(d, doc, "right")) if doc is not None else (0, 0)
            a, b = a + np.searchsorted(s[a:b], [tag, tag + (1 << PLACE_BITS)])
            rest, n, k = kept_bytes(raw, s[a:b] - tag, e[a:b] - tag)
            kept.append(rest if texts else None)
            digests.append(hashlib.sha256(rest).hexdigest())
            sizes.append(len(raw))
            gone.append(n)
            spans.append(k)
        return pa.table([own.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.groupBy("g").cogroup(runs.groupBy("g")).applyInArrow(finish, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The same for the query over ``documents``, in DuckDB, on the hexadecimal form of the bytes.
ORACLE = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, pos, hash(substring(h, pos * 2 + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS pos FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
g AS (SELECT w.doc_id, pos FROM w JOIN f ON w.k = f.k WHERE first < w.doc_id),
r AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM g),
s AS (SELECT doc_id, min(pos) AS lo, max(pos) + 50 AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r) GROUP BY doc_id, run),
e AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS done FROM s),
p AS (SELECT e.doc_id, string_agg(substring(h, done * 2 + 1, (lo - done) * 2), '' ORDER BY lo) AS front, max(hi) AS last, sum(hi - lo) AS gone, count(*) AS spans FROM e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substring(h, coalesce(last, 0) * 2 + 1))) AS kept_sha256
FROM d LEFT JOIN p ON d.doc_id = p.doc_id
"""
