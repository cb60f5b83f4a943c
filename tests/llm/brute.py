"""Plain versions to compare with."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def documents(spark: SparkSession, rows: list[tuple]):
    """rows: (doc_id, text) or with lang and source."""
    full = [(*r, *(None,) * (4 - len(r)))[:4] for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCS)


def links(texts: dict[int, str], threshold: float = 0.8) -> set[tuple[int, int]]:
    sets = {k: s for k, v in texts.items() if (s := shingles(v))}
    inverted = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            inverted[g].append(k)
    shared: Counter = Counter()
    for own in inverted.values():
        for i, b in enumerate(own):
            for a in own[:i]:
                shared[(a, b)] += 1
    return {(a, b) for (a, b), n in shared.items() if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9}


def classes(nodes, edges) -> dict[int, int]:
    parent = {n: n for n in nodes}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
