"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are compared after folding ASCII case and joining white space.  Windows
start where words do (after anything but a letter or digit), and at every
character of three bytes and more, as scripts without spaces have them.  From each such
anchor a CGK random walk embeds the window: step t writes the character at the
cursor and moves the cursor on if a random bit of (t, character) says so.
Strings at a small edit distance become strings at a small Hamming distance, so
keys of a few sampled positions, drawn anew for each repeat, collide for them.

Window sizes come in classes, from a dozen bytes up to the item's own size.  For
items of each size it is measured, on copies with as many edits as the bound allows,
how many windows of a copy have a colliding key, by class and number of repeats.
An item becomes a candidate where as many windows collide as all but a few copies
have, so the target recall is met; of the classes the one is taken whose colliding
windows cover the most (their number, up to MOST_HITS, times their size), with the
fewest repeats that make this selective.  So a small edit bound gives windows of the items' size, and a
bound of 10 % smaller ones, of which several must collide: windows of 200
characters with 20 edits share so little of their embedding that few keys
collide.  An item that no class finds often enough (short ones) is sought by exact
pieces instead: cut into one piece more than it may have edits, one is untouched.

Every candidate is then verified: enough four-byte grams of the item must be
near their places, which loses nothing, and the item must be within the allowed
edit distance of a piece of the document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fabula.llm import kernels as K
from fabula.llm.runtime import keep_columns, ship

#: Steps of the walk in each class of windows; a walk takes about half a byte a step.
STEPS = (24, 48, 96, 192, 384, 768)
#: Repeats that a class may have.
REPEATS = (2, 4, 8, 16)
SAMPLED = 10
#: Bytes of the grams that are counted before a distance is measured: an edit can't change more than so many of an item.
GRAM = 4
#: Bytes of a piece that are looked up.
PIECE = 8
#: Items shorter than this after folding can't identify a leak and are left out, unless the caller says otherwise.
LEAST_CHARS = 16
#: An item may differ from a document's passage by this percentage of its length.
EDIT_PERCENT = 10
#: The share of copies at the edit bound to be found.
RECALL = 0.95
#: Candidates are asked for up to so many colliding windows.
MOST_HITS = 4
#: With fewer steps in all colliding windows together there would be many candidates, and more repeats are taken.
LEAST_COVER = 96
#: All items are measured, in groups of about so many of one size (two sizes to a doubling), each group on so many edited copies.
SAMPLE, COPIES = 48, 480
#: Items are broadcast in blocks of at most this many characters.
BLOCK_CHARS = 2 << 20

_COIN = (K.mix(np.arange(STEPS[-1] * 256, dtype=np.uint64)) & np.uint64(1)).astype(np.int32).reshape(STEPS[-1], 256)
_DRAWN = {
    steps: [np.argsort(K.mix(np.arange(steps, dtype=np.uint64) + np.uint64(1000 * r + steps)))[:SAMPLED] for r in range(REPEATS[-1])] for steps in STEPS
}
#: The part of a key that a byte at a sampled place adds.
_PART = K.mix(np.arange(REPEATS[-1] * SAMPLED * 256, dtype=np.uint64) + np.uint64(1 << 40)).reshape(REPEATS[-1], SAMPLED, 256)
_WORD = K._LETTER.copy()
_WORD[48:58] = True


def fold(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ASCII case folded and runs of white space joined within each row, and the rows' new offsets."""
    low = K._LOWER[data]
    space = K._SPACE[data]
    low[space] = 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[rows[:-1][np.diff(rows) > 0]] = True
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[rows]


def anchors(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of words, and of all characters of three bytes and more, and their rows."""
    wide = data >= 0xE0
    beyond = wide.copy()
    for k in (1, 2):
        beyond[k:] |= wide[:-k]
    beyond[3:] |= data[:-3] >= 0xF0
    word = _WORD[data] & ~beyond
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = rows[:-1][np.diff(rows) > 0]
    first[edge] |= word[edge]
    starts = np.flatnonzero(first | wide)
    return starts, np.searchsorted(rows, starts, "right") - 1


def walk(data: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """The embedding [steps, windows] of the windows from ``starts``.

    A window that passes the end of its row goes on in the next one; no item
    has such a window, so it can only fail to match.
    """
    out = np.empty((steps, len(starts)), np.uint8)
    cursor = starts.astype(np.int32)
    padded = np.concatenate([data, np.zeros(steps + 1, np.uint8)])
    for t in range(steps):
        np.take(padded, cursor, out=out[t])
        cursor += np.take(_COIN[t], out[t])
    return out


def window_keys(embedded: np.ndarray, steps: int, repeats: int) -> Iterator[np.ndarray]:
    """A 64-bit key of each window for each repeat."""
    for r, drawn in enumerate(_DRAWN[steps][:repeats]):
        key = np.full(embedded.shape[1], 31 * r + steps, np.uint64)
        for i, t in enumerate(drawn):
            key += np.take(_PART[r, i], embedded[t])
        yield key


def edit_distance_within(pattern: str, text: str, most: int) -> int | None:
    """The least edit distance of the pattern to any piece of the text, if at most ``most`` (bit-parallel)."""
    m = len(pattern)
    if m == 0:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        grow = down | (full & ~(xh | up))
        shrink = up & xh
        if grow & top:
            score += 1
        elif shrink & top:
            score -= 1
            if score < best:
                best = score
        grow = (grow << 1) & full
        shrink = (shrink << 1) & full
        up = shrink | (full & ~(xv | grow))
        down = grow & xv
    return best if best <= most else None


def grams(data: np.ndarray) -> np.ndarray:
    """A 16-bit code of the GRAM bytes from each position."""
    x = np.concatenate([data, np.zeros(GRAM, np.uint8)]).astype(np.uint32)
    n = len(data)
    return (((x[:n] | x[1 : n + 1] << 8 | x[2 : n + 2] << 16 | x[3 : n + 3] << 24) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def size_class(size: int) -> int:
    """The class of an item of so many bytes: two to a doubling."""
    return int(2 * np.log2(max(size, 1)))


def edited(data: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy in which so many bytes are replaced, removed or led by another one."""
    fate = np.zeros(len(data), np.int64)
    fate[rng.choice(len(data), edits, replace=False)] = rng.integers(1, 4, edits)
    other = data[rng.integers(0, len(data), len(data))]
    pairs = np.stack([other, np.where(fate == 1, other, data)], axis=1)
    return pairs[np.stack([fate == 3, fate != 2], axis=1)]


def folded_text(text: str | None) -> str:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    data, _ = fold(raw, np.array([0, len(raw)]))
    return data.tobytes().decode("utf-8", "replace").strip()


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def measured_hits(size: int, group: int, texts: list[str], percent: float) -> dict[tuple[int, int], np.ndarray]:
    """For steps and repeats how many of COPIES edited copies of the texts (folded, of one size class) have 0, 1, .. MOST_HITS and more colliding windows."""
    rng = np.random.default_rng([size, group] if group else size)
    some = sorted(texts)
    items = [np.frombuffer(t.encode(), np.uint8) for t in some]
    of = np.resize(np.arange(len(items)), max(COPIES, len(items)))  # every item has a copy
    copies = [np.append(edited(items[k], int(len(some[k]) * percent // 100), rng), np.uint8(32)) for k in of]
    (own, own_rows), (other, rows) = _joined(items), _joined(copies)
    (at, item), (there, copy) = anchors(own, own_rows), anchors(other, rows)
    room = own_rows[item + 1] - at
    known, seen = walk(own, at, STEPS[-1]), walk(other, there, STEPS[-1])
    # keys of another item don't count
    salt = K.mix(np.arange(len(items), dtype=np.uint64))
    out = {}
    for steps in STEPS:
        fits = room >= 0.6 * steps
        hit = np.zeros(len(there), bool)
        pairs = zip(window_keys(known[:, fits], steps, REPEATS[-1]), window_keys(seen, steps, REPEATS[-1]))
        for r, (a, b) in enumerate(pairs, 1):
            hit |= np.isin(b + salt[of[copy]], a + salt[item[fits]])
            if r in REPEATS:
                n = np.minimum(np.bincount(copy[hit], minlength=len(of)), MOST_HITS)
                out[steps, r] = np.bincount(n, minlength=MOST_HITS + 1)
    return out


def planned(counts: dict[int, dict[tuple[int, int], np.ndarray]], recall: float) -> dict[int, tuple[int, int, int]]:
    """For each class of item sizes the steps and repeats of windows and the windows that must collide, from ``measured_hits`` of all its items; none where no windows do."""
    plan = {}
    for size, measured in counts.items():
        found: dict[int, tuple[int, int]] = {}  # of each number of repeats what windows cover, and their steps
        for (steps, r), n in sorted(measured.items()):
            need = int(np.searchsorted(np.cumsum(n), int(n.sum() * (1 - recall) / 4), "right"))
            found[r] = max(found.get(r, (0, 0)), (need * steps, steps))
        for r, (cover, steps) in sorted(found.items()):
            if cover and (cover >= LEAST_COVER or r == REPEATS[-1]):
                plan[size] = (steps, r, cover // steps)
                break
    return plan


def measured_plan(texts: list[str], percent: float, recall: float) -> dict[int, tuple[int, int, int]]:
    """The plan (see ``planned``) of all texts (folded); the same ones give the same plan."""
    by_size: dict[int, list[str]] = {}
    for t in sorted(set(texts)):
        by_size.setdefault(size_class(len(t.encode())), []).append(t)
    counts: dict[int, dict] = {}
    for size, some in by_size.items():
        for group, lo in enumerate(range(0, len(some), SAMPLE)):
            for k, n in measured_hits(size, group, some[lo : lo + SAMPLE], percent).items():
                of = counts.setdefault(size, {})
                of[k] = of.get(k, 0) + n
    return planned(counts, recall)


def plan_of_all(items: DataFrame, percent: float, recall: float) -> dict[int, tuple[int, int, int]]:
    """The plan (see ``planned``) of every item (text), measured on the executors in groups of about SAMPLE items of a size.

    Only counts come to the driver, a few rows for each class of sizes.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in map(folded_text, batch.column("text").to_pylist()) if t]
            yield pa.RecordBatch.from_arrays([pa.array([size_class(len(t.encode())) for t in texts], pa.int32()), pa.array(texts, pa.string())], ["size", "text"])

    def measure(key: tuple, table: pa.Table) -> pa.Table:
        size, group = (k.as_py() for k in key)
        counts = measured_hits(size, group, table.column("text").to_pylist(), percent)
        rows = [(size, steps, r, k, int(c)) for (steps, r), n in counts.items() for k, c in enumerate(n) if c]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["size", "steps", "repeats", "hits", "n"])

    texts = items.select("text").distinct().mapInArrow(folded, "size int, text string").distinct()
    groups = texts.groupBy("size").agg(F.ceil(F.count("*") / SAMPLE).alias("groups"))
    dealt = texts.join(F.broadcast(groups), "size").select("size", F.pmod(F.xxhash64("text"), F.col("groups")).alias("part"), "text")
    measured = dealt.groupBy("size", "part").applyInArrow(measure, "size int, steps int, repeats int, hits int, n long")
    counts: dict[int, dict] = {}
    for r in measured.groupBy("size", "steps", "repeats", "hits").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["size"], {}).setdefault((r.steps, r.repeats), np.zeros(MOST_HITS + 1, np.int64))[r.hits] = r.n
    return planned(counts, recall)


class Index:
    """The window keys and pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], percent: float = EDIT_PERCENT, recall: float = RECALL, least_chars: int = LEAST_CHARS, plan: dict | None = None):
        folded = {(item_id, s) for item_id, s in ((i, folded_text(t)) for i, t in items) if len(s) >= max(1, least_chars)}
        self.items = sorted(folded, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        plan = measured_plan([s for _, s in self.items], percent, recall) if plan is None else plan
        joined = [s.encode() for _, s in self.items]
        size = np.array([len(x) for x in joined], np.int64)
        self.most = np.array([int(len(s) * percent // 100) for _, s in self.items], np.int64)
        self.grams = [grams(np.frombuffer(x, np.uint8))[: max(0, len(x) - GRAM + 1)] for x in joined]
        rows = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        data = np.frombuffer(b"".join(joined), np.uint8)
        starts, row = anchors(data, rows) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        room = rows[row + 1] - starts
        # of each item the class and the windows that must collide; a class has the repeats that any of its items needs
        planned = np.array([plan.get(size_class(n), (0, 0, 1)) for n in size], np.int64).reshape(-1, 3)
        steps_of, self.hits = planned[:, 0], planned[:, 2].copy()
        # where an item has fewer windows itself, its pieces are sought
        windows = np.bincount(row[room >= 0.6 * steps_of[row]], minlength=len(size))
        steps_of = np.where(windows >= self.hits, steps_of, 0)
        self.hits[steps_of == 0] = 1
        self.repeats = {int(steps): int(planned[steps_of == steps, 1].max()) for steps in np.unique(steps_of) if steps}
        self.n_pieces = int((steps_of == 0).sum())
        self.keys: dict[int, tuple] = {}
        for steps, repeats in self.repeats.items():
            fits = (steps_of[row] == steps) & (room >= 0.6 * steps)
            keys = list(window_keys(walk(data, starts[fits], steps), steps, repeats))
            self.keys[steps] = self._table(np.concatenate(keys), np.tile(row[fits], repeats), np.tile((starts - rows[row])[fits], repeats))
        self.pieces: dict[int, tuple] = {}
        found: dict[int, list] = {}
        for k in np.flatnonzero(steps_of == 0):
            text, parts = self.items[k][1], int(self.most[k]) + 1
            cuts = [len(text[: len(text) * j // parts].encode()) for j in range(parts + 1)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi > lo:
                    found.setdefault(min(PIECE, hi - lo), []).append((joined[k][lo : lo + PIECE], k, lo))
        for g, rest in found.items():
            value = np.array([int.from_bytes(x[:g], "little") for x, _, _ in rest], np.uint64)
            self.pieces[g] = self._table(value, np.array([x[1] for x in rest]), np.array([x[2] for x in rest]))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def _table(self, keys: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> tuple:
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(1 << 22, bool)
        seen[self._slot(keys)] = True
        return keys[order], owner[order].astype(np.int32), offset[order].astype(np.int32), seen

    def _hits(self, table: tuple, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, begin of the item) for the keys found in a table; ``at``: the keys' places."""
        known, owner, offset, seen = table
        near = np.flatnonzero(seen[self._slot(keys)])
        first, last = (np.searchsorted(known, keys[near], side) for side in ("left", "right"))
        near, first, last = (x[last > first] for x in (near, first, last))
        n = last - first
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.repeat(at[near], n)
        return place, owner[entry].astype(np.int64), place - offset[entry]

    def _candidates(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct (item, place, begin) of colliding windows and of pieces."""
        out = []
        starts, _ = anchors(data, rows)
        for lo in range(0, len(starts) if self.keys else 0, 1 << 13):
            s = starts[lo : lo + (1 << 13)]
            embedded = walk(data, s, max(self.keys))
            for steps, table in self.keys.items():
                for key in window_keys(embedded, steps, self.repeats[steps]):
                    place, item, begin = self._hits(table, key, s)
                    out.append(np.stack([item, place, begin]))
        if self.pieces:
            padded = np.concatenate([data, np.zeros(PIECE, np.uint8)]).astype(np.uint64)
            value, g = np.zeros(len(data), np.uint64), 0
            for size in sorted(self.pieces):
                for k in range(g, size):
                    value |= padded[k : k + len(data)] << np.uint64(8 * k)
                g = size
                place, item, begin = self._hits(self.pieces[size], value, np.arange(len(data)))
                out.append(np.stack([item, place, begin]))
        return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((3, 0), np.int64)

    def _places(self, data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first begin, last begin) of the cells in which enough windows collide; cells overlap by half."""
        item, place, begin = self._candidates(data, rows)
        doc = np.searchsorted(rows, place, "right") - 1
        half = self.most[item] + 1
        for shift in (0, 1):
            cell = (begin - rows[doc] + shift * half + (1 << 40)) // (2 * half)
            order = np.lexsort((begin, cell, item, doc))
            d, i, c, b, p = (x[order] for x in (doc, item, cell, begin, place))
            if not len(d):
                return
            heads = np.flatnonzero(np.append(True, (np.diff(d) != 0) | (np.diff(i) != 0) | (np.diff(c) != 0)))
            tails = np.append(heads[1:], len(d)) - 1
            enough = tails - heads + 1 >= self.hits[i[heads]]
            yield from zip(*(x.tolist() for x in (d[heads[enough]], i[heads[enough]], b[heads[enough]], b[tails[enough]])))

    def leaks(self, data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item position, distance) of each item found in each folded row of a slice."""
        codes = None
        found: dict[tuple[int, int], int] = {}
        done: set = set()
        for where in self._places(data, rows):
            doc, item, first, last = where
            if where in done or found.get((doc, item), 1) == 0:
                continue
            done.add(where)
            text, own, most = self.items[item][1], self.grams[item], int(self.most[item])
            size = len(own) + GRAM - 1 if len(own) else len(text.encode())
            # an edit of a character changes at most its bytes and GRAM - 1 before them, and moves what follows
            wide = 1 if size == len(text) else 4
            slack = most * wide
            if len(own):
                if codes is None:
                    codes = np.concatenate([np.full(1 << 12, -1), grams(data), np.full(1 << 12, -1)])
                lo = first - slack + (1 << 12)
                width = last - first + 2 * slack + 1
                if lo >= 0 and lo + len(own) + width <= len(codes):
                    near = codes[lo + np.arange(len(own))[:, None] + np.arange(width)]
                    if np.count_nonzero((near == own[:, None]).any(axis=1)) < len(own) - most * (GRAM + wide - 1):
                        continue
            lo, hi = max(int(rows[doc]), first - 2 * slack), min(int(rows[doc + 1]), last + size + 2 * slack)
            d = edit_distance_within(text, data[lo:hi].tobytes().decode("utf-8", "ignore"), most)
            if d is not None:
                found[doc, item] = min(d, found.get((doc, item), d))
        for (doc, item), d in found.items():
            yield doc, item, d


_BUILT: dict = {}


def _index(held) -> Index:
    """The index of a broadcast, built once in each worker."""
    name, how = held.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(**how)
    return _BUILT[name]


def _blocks(benchmark: DataFrame, percent: float, recall: float, least_chars: int) -> list:
    """The arguments of an index for blocks of items of bounded size, as broadcasts."""
    spark = benchmark.sparkSession
    items = keep_columns(benchmark, "item_id", "text").where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_CHARS))
    plan = plan_of_all(items, percent, recall)  # of all items, so that one is sought alike in any block
    held = []
    for k in range(blocks):
        block = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator()]
        held.append(spark.sparkContext.broadcast((uuid.uuid4().hex, {"items": block, "percent": percent, "recall": recall, "least_chars": least_chars, "plan": plan})))
    return held


def _found(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(row, item position, distance) of a column of texts."""
    offsets, raw = K.string_column(texts)
    for i, j in K.slices(offsets):
        data, rows = fold(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for doc, item, d in index.leaks(data, rows):
            yield i + doc, item, d


def leaks(documents: DataFrame, benchmark: DataFrame, percent: float = EDIT_PERCENT, recall: float = RECALL, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Leaks of benchmark items: doc_id, item_id, distance, item_chars, one row for each row and item found in it.

    documents: doc_id, text; benchmark: item_id, text.  Other columns are
    ignored.  ``recall`` is the share of copies with edits of ``percent`` of their
    length that is to be found; exact copies are all found.  Null and empty
    texts, and items under ``least_chars`` folded characters, have no leaks; a null
    item_id stays null.  Repeated rows of documents give a row each; repeated
    items one, and items of one id with different texts one each.  An empty table
    gives no rows.  Items are read in blocks of bounded size, one pass over the
    documents for each block, and nothing is shuffled.
    """
    ship(documents.sparkSession)
    docs = keep_columns(documents, "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]

    def one(held) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(held)
            for batch in batches:
                found = list(_found(index, batch.column("text")))
                at, ids, far, long = (list(x) for x in zip(*((r, *index.items[k][:1], d, len(index.items[k][1])) for r, k, d in found))) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), pa.array(far, pa.int32()), pa.array(long, pa.int32())], ["doc_id", "item_id", "distance", "item_chars"]
                )

        return docs.mapInArrow(scan, f"doc_id {kind}, item_id long, distance int, item_chars int")

    return reduce(DataFrame.unionByName, [one(held) for held in _blocks(benchmark, percent, recall, least_chars)])


def decontaminated(documents: DataFrame, benchmark: DataFrame, percent: float = EDIT_PERCENT, recall: float = RECALL, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows of ``documents`` without a leak, with all their columns.

    Null and empty texts stay, repeated rows stay or go together, and an empty
    table of either kind takes nothing away; see ``leaks``.
    """
    ship(documents.sparkSession)

    def without(rows: DataFrame, held) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(held)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _, _ in _found(index, batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(keep, rows.schema)

    return reduce(without, _blocks(benchmark, percent, recall, least_chars), documents)
