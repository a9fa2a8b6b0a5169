"""Near copies by exact similarity of word shingles: SimHash first, MinHash for what it cannot reach.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is
`percent` or more; a component of links is a group of near copies.

First pass. The sets' SimHash fingerprints are linked by `simhash.links`, the probing of
masked fingerprints, and every link is confirmed on the whole sets. This joins exact and
almost exact copies. At a similarity of 0.8 about ten of 64 bits differ, which no masks
can probe, hence the second pass.

Second pass. `BANDS` bands of `BAND_ROWS` minima of the set are keys; texts at a
similarity of 0.8 share no band with a chance of 3e-6. Nodes that share a key go through
the rounds of `linking`: only those of different components meet, the bound on group
counts (exact, it never drops a link) sorts out most, the whole sets decide.

Defined cases. Texts with the same shingles are one node from the start, as are all null
and wordless ones. Fewer words than a shingle make one shingle. Case of A-Z is folded.
Null ids get a component but never name one, unless no member has an id (null).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import simhash
from vigilake.llm.common import stored
from vigilake.llm.linking import confirmed, link_groups
from vigilake.llm.set_join import (
    COUNT,
    named_groups,
    point,
    score,
    set_nodes,
    shared_members,
    sketches,
    token_sets,
    tree_join,
)

BANDS = 24
BAND_ROWS = 4
GROUPS = 256
DISTANCE = 2
_RNG = np.random.default_rng(simhash.SEED)
_FLIP = _RNG.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)
_FACTOR = _RNG.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)


def minima(tokens: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    low = np.full(len(_FLIP), np.iinfo(np.uint32).max, dtype=np.uint32)
    mixed = (tokens ^ (tokens >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(mixed), 512):
        np.minimum(low, ((mixed[at:at + 512, None] ^ _FLIP) * _FACTOR).min(axis=0), out=low)
    return low


def majority(tokens: np.ndarray) -> int:
    """SimHash of a set: the bits that are one in over half of its hashes."""
    ones = np.unpackbits(tokens.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(tokens), bitorder="little").view(np.int64)[0])


def _describe(tokens: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    if not len(tokens):
        return b"", np.zeros(0, dtype=np.int64), 0
    parts = minima(tokens).reshape(BANDS, BAND_ROWS)
    keys = np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], dtype=np.uint64)
    return point(tokens, GROUPS), keys.view(np.int64), majority(tokens)


def _alike(nodes: DataFrame) -> DataFrame:
    """`a, b`: sets with fingerprints that are equal or linked, through one set of each fingerprint."""
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(first, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.links(first.select("fp"), DISTANCE)
    of = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"n_{name}"))
    linked = near.join(of("a"), "a").join(of("b"), "b").select(
        F.least("n_a", "n_b").alias("a"), F.greatest("n_a", "n_b").alias("b"))
    return equal.unionByName(linked)


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
    block_rows: int = 2048,
) -> DataFrame:
    """`doc_id, row_key, root, component_id`: the smallest id reachable over links, one row per document.

    `row_key` is the hash of the text; `root` names the component even where ids repeat.
    """
    sketched = stored(sketches(docs, id_col, text_col, width, _describe, "sig binary, keys array<long>, fp long"))
    nodes = stored(set_nodes(sketched, least_size=0))
    described = sketched.withColumnRenamed("row", "node").where("size > 0").join(nodes.select("node"), "node", "left_semi")
    alike = stored(_alike(described.select("node", "fp")))
    members = stored(shared_members(described))
    wanted = members.select("node").unionByName(alike.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    points = stored(described.join(wanted, "node", "left_semi").drop("keys", "k0", "k1", "fp"))
    sets = stored(token_sets(docs, points.select("node", "doc_id", "t0", "t1"), id_col, text_col, width))
    known = stored(confirmed(alike, sets, percent))
    roots = link_groups(
        members, points, sets, percent, COUNT, score(percent), tree_join(percent), block_rows=block_rows, known=known)
    member = named_groups(nodes, roots)
    return sketched.join(member, ["k0", "k1"]).select("doc_id", F.col("t0").alias("row_key"), "root", "component_id")
