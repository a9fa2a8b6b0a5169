"""Components of a similarity join from tiles of possible partners, in a few rounds.

Input: `members` (`key, pos, node`, nodes that may be linked share a key), `points`
(`node, size, sig`, a short description that bounds the similarity) and `sets`
(`node, grams`, the whole sets). Two nodes are linked if
`100 * |intersection| >= percent * |union|`; links are always confirmed on whole sets.

Rounds. (1) In a few tiles each node meets the one of middle size, so that
groups of copies become stars, which take few steps to join. (2) In every tile that
still holds several components each node gets its most promising partner of another one.
(3) In the tiles left, all pairs of different components whose bound allows a link. No
link is lost, since nodes not compared in the end are in one component already, and
members of a group of copies are never paired with each other in rounds 2 and 3. A unit of
round 3 with more than `DENSE_PAIRS` such pairs a row (a family of copies that differ by
about the threshold) does not give them out, tile by tile: its whole sets are brought
together and compared there, and only links of a spanning forest leave it.

Large tiles are cut into blocks of at most about `block_rows` nodes. A component too large
for one block gets blocks of its own, so its blocks meet others but not each other, and
block pairs whose sizes cannot match do not meet. Each pair of blocks is a unit of work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.tasks import per_group
from vigilake.llm.common import stored
from vigilake.llm.simhash import components

SMALL_TILE = 64
FEW_LINKS = 200_000
CHUNK = 4096
DENSE_PAIRS = 4
UNIT = ["key", "lo", "hi"]
# score of the pairs (i, j) of a tile's rows; below 0: cannot be linked
Score = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
# candidate pairs of one large tile: (sig, size, comp, block) -> (i, j)
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def sizes_match(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _neighbours(starts: np.ndarray, counts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs inside tiles of at most `SMALL_TILE` rows, one distance in the order at a time."""
    rows = np.arange(int(counts.sum()))
    left = np.repeat(starts + counts, counts) - rows
    left[np.repeat(counts > SMALL_TILE, counts)] = 0
    here = rows
    for shift in range(1, most):
        here = here[left[here] > shift]
        if not len(here):
            return
        yield here, here + shift


def _compare(mode: str, percent: int, dtype: str, score: Score, search: Search):
    names = UNIT

    def candidates(rows: pd.DataFrame) -> pd.DataFrame:
        tile = rows.groupby(names, sort=False).ngroup().to_numpy()
        node, comp, size, block = (rows[c].to_numpy(np.int64) for c in ("node", "comp", "size", "block"))
        apart = (rows["lo"] != rows["hi"]).to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"]), dtype=dtype).reshape(len(rows), -1)
        starts = np.flatnonzero(np.diff(tile, prepend=-1))
        counts = np.diff(np.append(starts, len(tile)))
        found = []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            near = (comp[i] != comp[j]) & (~apart[i] | (block[i] != block[j])) & sizes_match(size[i], size[j], percent)
            i, j = i[near], j[near]
            for at in range(0, len(i), CHUNK):
                a, b = i[at:at + CHUNK], j[at:at + CHUNK]
                value = score(sig[a], sig[b], size[a], size[b])
                good = value >= 0
                found.append((a[good], b[good], value[good]))

        if mode == "star":
            # rows come in order of size: each meets the one in the middle
            middle, here = np.repeat(starts + counts // 2, counts), np.arange(len(tile))
            keep(here[here != middle], middle[here != middle])
        else:
            for i, j in _neighbours(starts, counts, SMALL_TILE):
                keep(i, j)
            for start, count in zip(starts[counts > SMALL_TILE], counts[counts > SMALL_TILE]):
                part = slice(start, start + count)
                for i, j in search(sig[part], size[part], comp[part], np.where(apart[part], block[part], 0)):
                    keep(i + start, j + start)
        if not found:
            return pd.DataFrame(dict.fromkeys(["a", "b", *names], np.zeros(0, np.int64)))
        i, j, value = (np.concatenate([f[k] for f in found]) for k in range(3))
        if mode == "best":
            asks, gives, worth = np.append(i, j), np.append(j, i), np.append(value, value)
            order = np.lexsort((node[gives], -worth, asks))
            first = order[np.flatnonzero(np.diff(asks[order], prepend=-1))] if len(order) else order
            i, j = asks[first], gives[first]
        units = rows.iloc[starts[:0]][names]
        if mode == "all":
            dense = np.bincount(tile[i], minlength=len(counts)) > DENSE_PAIRS * counts
            units = rows.iloc[starts[dense]][names]
            i, j = i[~dense[tile[i]]], j[~dense[tile[i]]]
        a, b = node[i], node[j]
        pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
        # a unit that is dense is named instead of its pairs
        return pd.concat([pairs.astype("Int64"), units.astype("Int64")])[["a", "b", *names]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch.iloc[-1]
            ends = np.logical_and.reduce([batch[c].to_numpy() == last[c] for c in names])
            if not ends.all() or waiting and any(waiting[-1].iloc[-1][c] != last[c] for c in names):
                waiting.append(batch[~ends])
                yield candidates(pd.concat(waiting, ignore_index=True))
                waiting = []
            waiting.append(batch[ends])
        if waiting:
            yield candidates(pd.concat(waiting, ignore_index=True))

    return run


def _dealt(rows: DataFrame, tiles: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """`key, lo, hi, block, node, comp, size` of the tiles with several components."""
    large = stored(tiles.where(F.col("n") > block_rows).select("key"))
    usual = rows.join(tiles.where(F.col("n") <= block_rows).select("key"), "key").select(
        "key", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("block"),
        "node", "comp", "size",
    )
    if large.isEmpty():
        return usual
    hot = rows.join(large, "key")
    per = hot.groupBy("key", "comp").agg(F.count("*").alias("own"))
    pooled = per.groupBy("key").agg(F.sum(F.when(F.col("own") <= block_rows, F.col("own"))).alias("pooled"))
    whole = per.where(F.col("own") > block_rows)
    cut = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(n / block_rows))
    placed = stored(
        hot.join(whole, ["key", "comp"], "left").join(pooled, "key").withColumn("block", F.when(
            F.col("own").isNotNull(), F.xxhash64("comp", cut(F.col("own")))
        ).otherwise(F.xxhash64(F.lit("pooled"), cut(F.col("pooled"))))).select("key", "block", "node", "comp", "size")
    )
    blocks = placed.groupBy("key", "block").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("size").alias("s0"), F.max("size").alias("s1"))
    other = blocks.select("key", *[F.col(c).alias(f"o_{c}") for c in ("block", "c0", "c1", "s0", "s1")])
    pure = (F.col("c0") == F.col("c1")) & (F.col("o_c0") == F.col("o_c1")) & (F.col("c0") == F.col("o_c0"))
    reach = (100 * F.col("s1") >= percent * F.col("o_s0")) & (100 * F.col("o_s1") >= percent * F.col("s0"))
    pairs = blocks.join(other, "key").where((F.col("block") <= F.col("o_block")) & ~pure & reach).select(
        "key", F.col("block").alias("lo"), F.col("o_block").alias("hi"))
    wanted = pairs.select("key", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    return usual.unionByName(placed.join(wanted, ["key", "block"]).select(*usual.columns))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _whole(percent: int):
    """Links of a spanning forest between the components of a unit, from its rows' whole sets."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        node, comp = rows["node"].to_numpy(np.int64), rows["comp"].to_numpy(np.int64)
        sizes = np.array([len(g) for g in rows["grams"]], dtype=np.int64)
        _, token, times = np.unique(np.concatenate(rows["grams"].to_list()), return_inverse=True, return_counts=True)
        shared = times[token] > 1
        column = (np.cumsum(times > 1) - 1)[token[shared]]
        order = np.argsort(column, kind="stable")
        row, column = np.repeat(np.arange(len(rows)), sizes)[shared][order], column[order]
        overlap = np.zeros((len(rows), len(rows)), dtype=np.float32)  # whole numbers
        for at in range(0, int((times > 1).sum()), CHUNK):
            part = slice(*np.searchsorted(column, [at, at + CHUNK]))
            has = np.zeros((len(rows), CHUNK), dtype=np.float32)
            has[row[part], column[part] - at] = 1
            overlap += has @ has.T
        linked = (100 + percent) * overlap.astype(np.int64) >= percent * (sizes[:, None] + sizes)
        linked &= comp[:, None] != comp
        left, a, b = linked.any(axis=1), [], []
        for start in np.flatnonzero(left):
            queue = [start] if left[start] else []
            left[start] = False
            while queue:
                here = queue.pop()
                new = np.flatnonzero(linked[here] & left)
                left[new] = False
                a += [node[here]] * len(new)
                b += node[new].tolist()
                queue += new.tolist()
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return per_group(UNIT, links)


def grouped(links: DataFrame) -> DataFrame:
    """`node, root`: the smallest node of each component, for nodes with a link.

    Up to `FEW_LINKS` links, counted first, are joined in one task of a few megabytes; more
    go through rounds over the cluster. The result is the same.
    """
    if links.count() > FEW_LINKS:
        return components(links)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype=np.int64), *batches])
        node, ends = np.unique(pairs.to_numpy(np.int64), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        root = np.arange(len(node))
        while True:
            low = np.minimum(root[a], root[b])
            moved = root.copy()
            for side in (a, b, root[a], root[b]):
                np.minimum.at(moved, side, low)
            moved = moved[moved]
            if (moved == root).all():
                break
            root = moved
        yield pd.DataFrame({"node": node, "root": node[root]})

    return links.select("a", "b").coalesce(1).mapInPandas(joined, "node long, root long")


def link_groups(
    members: DataFrame, points: DataFrame, sets: DataFrame, percent: int, dtype: str, score: Score, search: Search,
    star_keys: int = 6, block_rows: int = 2048, known: DataFrame | None = None,
) -> DataFrame:
    """`node, root` of all nodes with a link: the smallest node of its component. `known` are links found before."""

    def paired(rows: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
        """(`a, b` pairs, dense units)."""
        described = rows.join(points.select("node", "sig"), "node").withColumn("turn", F.xxhash64("node", "key"))
        compare = _compare(mode, percent, dtype, score, search)
        found = (
            described.repartition(*UNIT).sortWithinPartitions(*UNIT, "size", "turn")
            .drop("turn").mapInPandas(compare, "a long, b long, key long, lo long, hi long")
        )
        found = stored(found.distinct())
        return found.where("a is not null").select("a", "b"), found.where("a is null").select(*UNIT)

    def inside(rows: DataFrame, units: DataFrame) -> DataFrame:
        met = rows.join(units, UNIT).select(*UNIT, "node", "comp").join(sets.select("node", "grams"), "node")
        return met.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInPandas(_whole(percent), "a long, b long")

    sized = members.join(points.select("node", "size"), "node")
    near = sized.where(F.col("pos") < star_keys)
    tiles = near.groupBy("key").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    own = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / block_rows))
    stars = near.join(tiles, "key").select(
        "key", own.alias("lo"), own.alias("hi"), zero.alias("block"), "node", F.col("node").alias("comp"), "size")
    first = confirmed(paired(stars, "star")[0], sets, percent)
    links = stored(first if known is None else first.unionByName(known))
    roots = stored(grouped(links))
    for mode in ("best", "all"):
        rows = stored(
            sized.select("key", "node", "size").join(roots, "node", "left")
            .select("key", "node", F.coalesce("root", "node").alias("comp"), "size")
        )
        mixed = stored(
            rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
            .where("c0 != c1").select("key", "n")
        )
        dealt = _dealt(rows, mixed, percent, block_rows)
        pairs, dense = paired(dealt, mode)
        crowded = not dense.isEmpty()
        if not crowded and pairs.isEmpty():
            break  # no pair whose bound allows a link, so the next round has none either
        new = confirmed(pairs, sets, percent)
        new = stored(new.unionByName(inside(dealt, dense)).distinct() if crowded else new)
        if not new.isEmpty():
            links = stored(links.unionByName(new))
            roots = stored(grouped(links))
    return roots
