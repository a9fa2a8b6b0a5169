"""Similarity join of shingle sets: group counts as points of an R-tree.

A text's set holds its distinct shingles of `width` words (fewer words: the whole
sequence). Texts are linked if `100 * |intersection| >= percent * |union|`; a component
of links has the smallest id it can reach.

Points. Tokens are hashed into groups; the counts per group are a point, and the overlap
of two sets is at most the sum of the coordinates' minima. Boxes of points bound it too:
by the minima of their upper corners, and by the gaps between the boxes.

Tree. A linked pair differs in `d = size * (100 - percent) / percent` tokens at most. The
groups are dealt into `d + 1` segments by hash, so in one segment at least all counts
agree. The upper levels of the tree are therefore size levels (each half as large again
as the one below) and, for each segment, tiles of points with equal counts in it: an
equality Spark can shuffle by. A size level has its own number of segments, and a set that
could meet smaller ones across the border is put into the lower level, too. Inside a large
tile an R-tree is packed over `GROUPS` folded counts of the whole sets and joined with
itself, box against box. Pairs that survive are verified on the whole sets; `linking`
spares those already in one component and cuts hot tiles.

Defined cases. Texts with equal sets are one node from the start, so copies cost nothing.
Null and wordless texts have an empty set and are linked with nothing: each is its own
component. A-Z are lower-cased. Rows of one id and different texts are told apart by text.
Null ids get a component but never name one, unless no member has an id (null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import stored, text_key
from vigilake.llm.linking import link_groups

GROUPS = 64
CELLS = 1024
LEAF_ROWS = 32
COUNT = "<u4"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit image of every number."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def token_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all shingles: word hashes, combined by position."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(width, len(words))
    last = len(words) - span + 1
    total = np.full(last, span, dtype=np.uint64)
    for k in range(span):
        total = total * _MIX[0] + hashes[k:k + last]
    return np.unique(mixed(total))


def most_apart(size: int, percent: int) -> int:
    """Largest symmetric difference of linked sets, the smaller one of this size."""
    return size * (100 - percent) // percent


def levels(size: int, percent: int) -> list[tuple[int, int]]:
    """(level, segments) a set belongs to; none if only equal sets can be linked with it."""
    first, level, found = -(-percent // (100 - percent)), 0, []
    least = -(-size * percent // 100)  # smallest partner
    while first <= size:
        beyond = first + first // 2 + 1
        if size < beyond or least < beyond:
            found.append((level, most_apart(beyond - 1, percent) + 1))
        first, level = beyond, level + 1
    return found[::-1]


def segment_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """One key per segment of every level: a hash of the counts of the segment's groups."""
    out = []
    cells = mixed(tokens & np.uint64(CELLS - 1))
    for level, segments in levels(len(tokens), percent):
        # tokens are sorted, hence their segments are
        of = ((tokens >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        ends = np.searchsorted(of, np.arange(1, segments + 1, dtype=np.uint64))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(cells, dtype=np.uint64)))
        counts = sums[ends] - sums[np.append(0, ends[:-1])]
        out.append(mixed(counts + mixed(np.arange(segments, dtype=np.uint64) + np.uint64(level << 40))))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def point(tokens: np.ndarray, groups: int = GROUPS) -> bytes:
    """Counts of the tokens in `groups` groups, a power of two."""
    return np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(COUNT).tobytes()


def _fits(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """How far a bound of the overlap is above what a link of these sizes takes."""
    return (100 + percent) * overlap - percent * sizes


def score(percent: int):
    def bound(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        return _fits(np.minimum(a, b).sum(axis=1, dtype=np.int64), size_a + size_b, percent)

    return bound


class _Box:
    """A node of the tree: rows, corners of their points, ranges of sizes and components."""

    def __init__(self, rows, points, size, comp, leaf_rows):
        self.rows = rows
        mine = points[rows]
        self.low, self.high = mine.min(axis=0).astype(np.int64), mine.max(axis=0).astype(np.int64)
        self.sizes = int(size[rows].min()), int(size[rows].max())
        self.comps = comp[rows].min(), comp[rows].max()
        self.parts: list[_Box] = []
        if len(rows) > leaf_rows:
            # packed by the coordinate that spreads most, the set's size being one of them
            wide = np.append(self.high - self.low, self.sizes[1] - self.sizes[0])
            along = int(wide.argmax())
            order = np.argsort(size[rows] if along == len(wide) - 1 else mine[:, along], kind="stable")
            half = len(rows) // 2
            self.parts = [_Box(rows[o], points, size, comp, leaf_rows) for o in (order[:half], order[half:])]


def _may_meet(a: _Box, b: _Box, percent: int) -> bool:
    if a.comps[0] == a.comps[1] == b.comps[0] == b.comps[1]:
        return False
    if 100 * a.sizes[1] < percent * b.sizes[0] or 100 * b.sizes[1] < percent * a.sizes[0]:
        return False
    if _fits(int(np.minimum(a.high, b.high).sum()), a.sizes[0] + b.sizes[0], percent) < 0:
        return False
    gap = int(np.maximum(0, np.maximum(a.low - b.high, b.low - a.high)).sum())
    return (100 - percent) * (a.sizes[1] + b.sizes[1]) >= (100 + percent) * gap


def tree_join(percent: int, leaf_rows: int = LEAF_ROWS):
    """Pairs of rows of a tile in leaves that may hold a link."""

    def search(points, size, comp, block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        root = _Box(np.arange(len(points)), points, size, comp, leaf_rows)
        waiting = [(root, root)]
        while waiting:
            a, b = waiting.pop()
            if not _may_meet(a, b, percent):
                continue
            if a is b and a.parts:
                x, y = a.parts
                waiting += [(x, x), (x, y), (y, y)]
            elif a.parts or b.parts:
                wide, other = (a, b) if len(a.rows) >= len(b.rows) else (b, a)
                waiting += [(part, other) for part in wide.parts]
            elif a is b:
                i, j = np.triu_indices(len(a.rows), 1)
                yield a.rows[i], a.rows[j]
            else:
                yield np.repeat(a.rows, len(b.rows)), np.tile(b.rows, len(a.rows))

    return search


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, describe: Callable, schema: str) -> DataFrame:
    """`row, doc_id, t0, t1, k0, k1, size` and what `describe` makes of a token set: one row per document, without its text."""
    names = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(f"k0 long, k1 long, size int, {schema}")
    def sketched(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(text):
            tokens = token_set(text, width)
            raw = tokens.tobytes()
            name = np.array([xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)], dtype=np.uint64).view(np.int64)
            return int(name[0]), int(name[1]), len(tokens), *describe(tokens)

        for batch in texts:
            yield pd.DataFrame([one(t) for t in batch], columns=["k0", "k1", "size", *names])

    first, second = text_key(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"), first.alias("t0"), second.alias("t1"), sketched(F.col(text_col)).alias("s")
    ).select(F.monotonically_increasing_id().alias("row"), "doc_id", "t0", "t1", "s.*")


def token_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """`node, grams` of the nodes in `wanted` (`node, doc_id, t0, t1`), from one document each."""

    @F.pandas_udf("array<long>")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([token_set(t, width).view(np.int64) for t in texts])

    first, second = text_key(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("text"), first.alias("u0"), second.alias("u1"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t0") == F.col("u0")) & (F.col("t1") == F.col("u1"))
    # rows that repeat an id and a text give one set
    return texts.join(wanted, same).dropDuplicates(["node"]).select("node", grams("text").alias("grams"))


def set_nodes(sketched: DataFrame, least_size: int = 1) -> DataFrame:
    """`k0, k1, node, first_id`: one row per different set, named by one of its rows."""
    return sketched.where(F.col("size") >= least_size).groupBy("k0", "k1").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"))


def named_groups(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """`k0, k1, root, component_id`: the component of every set and the smallest id in it."""
    groups = nodes.join(roots, "node", "left").select("k0", "k1", "first_id", F.coalesce("root", "node").alias("root"))
    return groups.join(groups.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").drop("first_id")


def shared_members(described: DataFrame) -> DataFrame:
    """`key, pos, node` of the keys that several nodes have, from `node, keys`."""
    placed = described.select("node", F.posexplode("keys").alias("pos", "key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return placed.join(shared, "key").select("key", "pos", "node")


def join_sets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90,
    block_rows: int = 2048,
) -> DataFrame:
    """`doc_id, row_key, size, component_id`: one row per document; `row_key` is its text's hash."""
    describe = lambda tokens: (point(tokens), segment_keys(tokens, percent).view(np.int64))
    sketched = stored(sketches(docs, id_col, text_col, width, describe, "sig binary, keys array<long>"))
    nodes = stored(set_nodes(sketched))
    described = sketched.withColumnRenamed("row", "node").join(nodes.select("node"), "node", "left_semi")
    members = stored(shared_members(described))
    points = stored(described.join(members.select("node").distinct(), "node", "left_semi").drop("keys", "k0", "k1"))
    sets = stored(token_sets(docs, points.select("node", "doc_id", "t0", "t1"), id_col, text_col, width))
    roots = link_groups(members, points, sets, percent, COUNT, score(percent), tree_join(percent), block_rows=block_rows)
    member = named_groups(nodes, roots)
    rows = sketched.where("size > 0").join(member, ["k0", "k1"])
    linked = rows.select("doc_id", F.col("t0").alias("row_key"), "size", "component_id")
    alone = sketched.where("size = 0").select("doc_id", F.col("t0").alias("row_key"), "size", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
