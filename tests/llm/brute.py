"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def components(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_duplicates(rows, width, percent):
    """{doc_id: (n_shingles, component_id)}; exact, by rare-shingle prefixes."""
    sets = {d: shingles(t, width) for d, t in rows}
    freq = defaultdict(int)
    for s in sets.values():
        for x in s:
            freq[x] += 1
    index, edges = defaultdict(list), set()
    for d in sorted(sets, key=lambda d: len(sets[d])):
        s = sets[d]
        if not s:
            continue
        order = sorted(s, key=lambda x: (freq[x], x))
        keep = len(order) - -(-percent * len(order) // 100) + 1
        seen = set()
        for x in order[:keep]:
            for o in index[x]:
                if o not in seen:
                    seen.add(o)
                    common = len(s & sets[o])
                    if 100 * common >= percent * (len(s) + len(sets[o]) - common):
                        edges.add((d, o))
            index[x].append(d)
    comp = components(sets, edges)
    return {d: (len(sets[d]), comp[d]) for d in sets}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def base_digest(text):
    return hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in base_spans(text)).encode()).hexdigest()


def without_repeats(rows, length=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}"""
    first = {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], d)
    out = {}
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < d:
                gone[i : i + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kept_lines(rows, least=16):
    """{doc_id: (n_lines, n_removed, sha256)}"""
    seen, out = [], {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        kept, parts, gone = [], t.split("\n") if t is not None else [], 0
        for line in parts:
            x = line.strip(" \t\r\f\v")
            hit = x != "" and any(x == y or (min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= 1 and edit_distance(x, y) <= 1) for y in seen)
            if x:
                seen.append(x)
            if hit:
                gone += 1
            else:
                kept.append(line)
        out[d] = (len(parts), gone, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out
