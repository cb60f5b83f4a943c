"""Join of documents whose five-word shingle sets are alike (Jaccard), by a MinHash LSH forest.

Each of ``trees`` prefix tries holds a label of ``longest`` min-hashes, two bytes each, of every
document; a node is a prefix of labels, and documents below one node are candidates.  The search begins with
the longest prefixes.  The links found there, each weighed by the chance
1 - (1 - s**depth)**trees of finding one of its similarity s, tell how many there are in all (and one
more link, at the threshold, is supposed to exist); the prefixes are then shortened
to the greatest length at which the expected share of links found reaches the
target recall, again and again until the measured share does.  They are
not shortened beyond the length at which every pair at the threshold is found with probability
``sure``.  Every candidate pair is verified exactly on whole shingle sets, once: at
the first length and in the first trie where it meets.

Equal texts are one class first, so copies never meet each other.  A node's
documents are verified in blocks by matrix products; a node of many documents is
split into pairs of chunks, so no task holds an unbounded group, and no pairs
are emitted: a block reports each document's number of links, which least
document it hangs together with, and how many links there are of each similarity.  Of nodes with
the same documents, in any trie or at any length, one is verified.

Words are ``[^\\x20\\x09-\\x0D]+`` as they are; a text of one to four words has
one shingle.  Null texts and texts without a word have no shingle and no links.
Rows without an identifier take no part (class null, no links).  Texts that share
an identifier are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime
from .components import components
from .textcore import Chunk, chunks, mix64, seeds

THRESHOLD, SHINGLE, TREES, LONGEST, RECALL, SURE = 0.8, 5, 16, 8, 0.9999, 0.999
#: Documents, and bytes of shingles, in one side of a block; documents whose sets are multiplied at a time.
BLOCK_DOCS, BLOCK_BYTES, TILE = 8192, 24 << 20, 1024
#: Parts that a node's documents are joined in, and steps of similarity that links are counted by.
PARTS, STEPS = 8, 200


def chance(similarity: float, trees: int, depth: int) -> float:
    """That two documents share a prefix of this length in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float, trees: int, longest: int, recall: float) -> int:
    """Shorten the prefix until the recall at the threshold is reached."""
    for depth in range(longest, 1, -1):
        if chance(threshold, trees, depth) >= recall:
            return depth
    return 1


def expected_recall(links: dict[float, int], depth: int, shorter: int, threshold: float, trees: int) -> float:
    """Share of all links that prefixes of length ``shorter`` find, judged by those found at ``depth`` (similarity: number)."""
    every = {s: n / chance(s, trees, depth) for s, n in links.items()}
    found = sum(n * chance(s, trees, shorter) for s, n in every.items())
    return (found + chance(threshold, trees, shorter)) / (sum(every.values()) + 1)


def distinct(c: Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a chunk, sorted inside a text, and where each text's begin."""
    h, d = c.shingles(size)
    bounds = np.searchsorted(d, np.arange(c.n + 1))
    out = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return (np.concatenate(out) if out else h), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def labels(h: np.ndarray, offsets: np.ndarray, trees: int, longest: int) -> np.ndarray:
    """A row a text with shingles: its label in each trie, two bytes a min-hash, most telling byte order for sorting."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.empty((len(full), trees * longest), ">u2")
    begins, numbers = offsets[:-1][full], seeds(2 * trees * longest, 500)
    for k in range(trees * longest):
        a, b = numbers[2 * k : 2 * k + 2]
        out[:, k] = (mix64(np.minimum.reduceat((h ^ b) * (a | np.uint64(1)), begins)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, k1, k2 (128 bits of the text) of the rows with an identifier."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id is not null")
    return rows.select("*", *text_keys(F.col("text")))


def text_keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def signatures(docs: DataFrame, trees: int, longest: int) -> DataFrame:
    """row (a number of its own), doc_id, k1, k2, n (distinct shingles), labels of every row with an identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi, c in chunks(b.column("text")):
                h, offsets = distinct(c)
                n = np.diff(offsets)
                own = labels(h, offsets, trees, longest) if len(h) else np.zeros((0, 1), ">u2")
                lists = np.full(len(n), None, object)
                lists[n > 0] = [x.tobytes() for x in own]
                keys = [b.column(x).slice(lo, hi - lo) for x in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(lo, hi)), *keys, pa.array(n), pa.array(lists, pa.binary())], ["row", "doc_id", "k1", "k2", "n", "labels"])
            row += b.num_rows

    return _identified(docs).mapInArrow(run, "row long, doc_id long, k1 long, k2 long, n long, labels binary")


def intersections(sets: list[np.ndarray], split: int, slice_at: int = 8192) -> np.ndarray:
    """How many members each of the first ``split`` sets shares with each of the others (with all, if split is their number)."""
    lengths = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    number, owner = number[shared], owner[shared]
    number = np.cumsum(np.concatenate([[0], (number[1:] != number[:-1]).astype(np.int64)])) if len(number) else number
    rest = len(sets) if split == len(sets) else len(sets) - split
    out = np.zeros((split, rest))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, slice_at):
        a, b = np.searchsorted(number, (lo, lo + slice_at))
        m = np.zeros((len(sets), int(number[b - 1]) - lo + 1), np.float32)
        m[owner[a:b], number[a:b] - lo] = 1
        out += m[:split] @ (m if split == len(sets) else m[split:]).T
    return out


def prefixes(raw: list[bytes], trees: int, depth: int) -> np.ndarray:
    """Of labels, a 64-bit hash of each trie's prefix of this length: documents by trie."""
    values = np.frombuffer(b"".join(raw), ">u2").astype(np.uint64).reshape(len(raw), trees, -1)
    out = np.full((len(raw), trees), depth, np.uint64)
    for k in range(depth):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return out


def verify(table: pa.Table, threshold: float, trees: int, depth: int, before: int | None) -> pa.Table:
    """A block: documents of one trie node, in one chunk or two. Of each that has links: their number, and the least document it hangs with. And (node null) how many links have a similarity of ``root`` steps or a little more."""
    at: dict[tuple[int, int], int] = {}
    for i, k in enumerate(zip(table.column("chunk").to_pylist(), table.column("node").to_pylist(), strict=True)):
        at.setdefault(k, i)
    keys = sorted(at)
    none = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    pair = table.column("bi")[0].as_py() != table.column("bj")[0].as_py()
    split = sum(k[0] == keys[0][0] for k in keys) if pair else len(keys)
    if len(keys) < 2 or (pair and split == len(keys)):
        return none
    index, own_tree = [at[k] for k in keys], table.column("tree")[0].as_py()
    ids = np.array([k[1] for k in keys])
    raw = [table.column("shingles")[i].as_py() for i in index]
    sizes = np.array([len(x) // 8 for x in raw])
    given = [table.column("labels")[i].as_py() for i in index]
    now, old = prefixes(given, trees, depth), None if before is None else prefixes(given, trees, before)
    tiles = lambda lo, hi: [np.arange(k, min(k + TILE, hi)) for k in range(lo, hi, TILE)]
    hits, steps = [], np.zeros(STEPS + 1, np.int64)
    for a in tiles(0, split):
        for b in tiles(split, len(keys)) if pair else [x for x in tiles(0, split) if x[0] >= a[0]]:
            same = a[0] == b[0]
            sets = [np.frombuffer(raw[i], np.uint64) for i in (a if same else np.concatenate([a, b])).tolist()]
            shared = intersections(sets, len(a))
            whole = sizes[a][:, None] + sizes[b][None]
            alike = shared >= threshold / (1 + threshold) * whole - 1e-9
            alike &= ids[a][:, None] < ids[b][None] if same else True
            for t in range(own_tree):  # a pair counts in the first trie where it meets
                alike &= now[a, t][:, None] != now[b, t][None]
            if old is not None:  # and at the first length
                for t in range(trees):
                    alike &= old[a, t][:, None] != old[b, t][None]
            i, j = np.nonzero(alike)
            if len(i):
                hits.append(np.stack([a[i], b[j]]))
                similarity = shared[i, j] / (whole[i, j] - shared[i, j])
                steps += np.bincount(np.minimum((similarity * STEPS + 1e-6).astype(np.int64), STEPS), minlength=STEPS + 1)
    if not hits:
        return none
    i, j = np.concatenate(hits, 1)
    links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, new[i])
        if (new == root).all():
            break
        root = new
    some, counted = np.flatnonzero(links), np.flatnonzero(steps)
    return pa.table({
        "node": pa.chunked_array([pa.array(ids[some]), pa.nulls(len(counted), pa.int64())]),
        "links": np.concatenate([links[some], steps[counted]]).astype(np.int64),
        "root": np.concatenate([root[some], counted]).astype(np.int64),
    })


class Forest:
    """The tries of a corpus, the shingle sets of the documents that share a node, and what was verified so far."""

    def __init__(self, docs: DataFrame, threshold: float, trees: int, longest: int, sure: float) -> None:
        self.threshold, self.trees, self.longest = threshold, trees, longest
        self.floor = depth_for(threshold, trees, longest, sure)
        self.marks = runtime.cut(signatures(docs, trees, longest))
        first = self.marks.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("labels").alias("labels"), F.max("n").alias("n"))
        self.classes = runtime.cut(first.select("k1", "k2", F.col("first.row").alias("node"), F.col("first.doc_id").alias("rep"), "labels", "n"))
        shared = self._below(self.nodes(self.floor), self.nodes(self.floor).groupBy("tree", "prefix").count().where("count > 1").select("tree", "prefix"))
        members = self.classes.join(shared.select("node").distinct(), "node").select("rep", F.col("k1").alias("r1"), F.col("k2").alias("r2"), "node", "labels")
        texts = _identified(docs).join(members.hint("shuffle_hash"), (F.col("doc_id") == F.col("rep")) & (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))).select("node", "labels", "text")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # rows that repeat identifier and text come together
            for b in batches:
                nodes = b.column("node").to_pylist()
                new = [k for k, x in enumerate(nodes) if not (x in seen or seen.add(x))]
                for lo, hi, c in chunks(b.column("text").take(pa.array(new, pa.int64()))):
                    h, offsets = distinct(c)
                    own = pa.array(new[lo:hi], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("node").take(own), b.column("labels").take(own), pa.array([h[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["node", "labels", "shingles"])

        self.sets = runtime.cut(texts.mapInArrow(sets, "node long, labels binary, shingles binary"))
        self.verified: DataFrame | None = None

    def nodes(self, depth: int) -> DataFrame:
        """tree, prefix, node, n: of every class, its prefix of this length in each trie."""
        each = self.classes.select("node", "n", "labels", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree"))
        return each.select("tree", F.substring(F.col("labels"), F.col("tree") * 2 * self.longest + 1, F.lit(2 * depth)).alias("prefix"), "node", "n")

    def _below(self, nodes: DataFrame, groups: DataFrame) -> DataFrame:
        """The documents below some nodes. A node may have any number, so they are joined in parts."""
        part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")
        return nodes.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")).join(groups.select("*", part), ["tree", "prefix", "_part"]).drop("_part")

    def links(self, depth: int, before: int | None) -> DataFrame:
        """Verify all pairs that meet at this length and did not ``before``: as verify() gives them."""
        threshold, trees = self.threshold, self.trees
        nodes, who = self.nodes(depth), F.xxhash64("node")
        groups = nodes.groupBy("tree", "prefix").agg(F.count("*").alias("docs"), F.sum("n").alias("volume"), F.bit_xor(who).alias("x"), F.min(who).alias("lo"), F.max(who).alias("hi")).where("docs > 1")
        same = ["docs", "volume", "x", "lo", "hi"]
        chosen = groups.groupBy(*same).agg(F.min(F.struct("tree", "prefix")).alias("at"))
        if self.verified is not None:
            chosen = chosen.join(self.verified, same, "left_anti")
        chosen = runtime.cut(chosen.select(*same, "at.tree", "at.prefix"))
        self.verified = chosen.select(*same) if self.verified is None else self.verified.unionByName(chosen.select(*same))
        parts = F.least(F.col("docs"), F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("volume") * 8 / BLOCK_BYTES))).cast("int")
        wanted = self._below(nodes, chosen.select("tree", "prefix", parts.alias("parts"))).select("node", "tree", "prefix", "parts")
        dealt = self.sets.join(wanted, "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("tree", "prefix", F.least("chunk", "other").alias("bi"), F.greatest("chunk", "other").alias("bj"), "chunk", "node", "labels", "shingles")
        return runtime.cut(dealt.groupBy("tree", "prefix", "bi", "bj").applyInArrow(lambda t: verify(t, threshold, trees, depth, before), "node long, links long, root long"))


def search(forest: Forest, recall: float = RECALL) -> tuple[DataFrame, list[tuple[int, float]]]:
    """All links, as verify() gives them, and the lengths of prefixes tried with the share of links found, as measured there."""
    depth, before, counts, found, tried = forest.longest, None, {}, None, []
    while True:
        new = forest.links(depth, before)
        found = new if found is None else found.unionByName(new)
        for r in new.where("node is null").groupBy("root").agg(F.sum("links").alias("n")).collect():  # a row a step of similarity
            s = max(r.root / STEPS, forest.threshold)
            counts[s] = counts.get(s, 0) + r.n
        share = lambda shorter: expected_recall(counts, depth, shorter, forest.threshold, forest.trees)  # noqa: E731, B023
        tried.append((depth, share(depth)))
        if depth <= forest.floor or tried[-1][1] >= recall:
            return found, tried
        before, depth = depth, next((d for d in range(depth - 1, forest.floor, -1) if share(d) >= recall), forest.floor)


def judged(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL, sure: float = SURE) -> DataFrame:
    """doc_id, k1, k2, row, n, class_id, text_class, n_links, first (whether the row is its class's first, by identifier) of every row with an identifier."""
    forest = Forest(docs, threshold, trees, longest, sure)
    found, _ = search(forest, recall)
    found = found.where("node is not null")
    hung = components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    about = forest.classes.select("k1", "k2", "node", "rep").join(hung, "node", "left").join(links, "node", "left")
    about = about.withColumn("component", F.coalesce("component", "node"))
    # a class of links is named by its least identifier; a class of one text names itself
    least = about.where("n_links > 0").groupBy("component").agg(F.min(F.struct("rep", "node")).alias("least"))
    about = about.join(least, "component", "left").select("k1", "k2", "rep", F.coalesce("least.rep", "rep").alias("class_id"), F.coalesce("least.node", "node").alias("head"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = forest.marks.where("n > 0").select("row", "doc_id", "k1", "k2", "n").join(about, ["k1", "k2"])
    known = known.select("doc_id", "k1", "k2", "row", "n", "class_id", F.col("rep").alias("text_class"), F.col("n_links").cast("long").alias("n_links"), (F.col("row") == F.col("head")).alias("first"))
    bare = forest.marks.where("n = 0").select("doc_id", "k1", "k2", "row", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_class"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return known.unionByName(bare)


def similar(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL, sure: float = SURE) -> DataFrame:
    """doc_id, class_id, text_class, n_links of every row of docs (doc_id, text).

    text_class: the least identifier with this text.  n_links: how many different
    texts are at least as similar as the threshold.  class_id: the least
    identifier of all that hang together by links and copies.
    """
    columns = ["doc_id", "class_id", "text_class", "n_links"]
    lost = docs.where("doc_id is null").select(*(F.lit(None).cast("long").alias(x) for x in columns[:3]), F.lit(0).cast("long").alias("n_links"))
    return judged(docs, threshold, trees, longest, recall, sure).select(*columns).unionByName(lost)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are their class's first, with their columns: texts that share an identifier are judged each, and of rows that repeat both one stays. Rows without an identifier or without a word stay."""
    told = judged(docs, **options).where("n > 0").groupBy("doc_id", "k1", "k2").agg(F.max("first").alias("stays"), F.count("*").alias("times"))
    # one key may hold many rows, so they are dealt to several parts
    told = runtime.cut(told.where("not stays or times > 1").select(F.col("doc_id").alias("j_id"), "k1", "k2", "stays")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    whole = F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("whole")
    held = docs.select(whole, F.col("doc_id").cast("long").alias("j_id"), *text_keys(F.col("text")), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int").alias("part"))
    joined = held.join(told.hint("shuffle_hash"), ["j_id", "k1", "k2", "part"], "left")
    once = joined.where("stays").groupBy("j_id", "k1", "k2").agg(F.first("whole").alias("whole")).select("whole.*")
    return joined.where("stays is null").select("whole.*").unionByName(once)
