"""Similar incidents for many probes at once, and groups of similar ones, without all pairs.

An index of random hyperplanes: a vector's key in a table is the side it lies on of each
of the table's planes. How many planes follows from the number of vectors (about
`BUCKET_ROWS` to a key where they are spread evenly), how many tables from the threshold
and the recall wanted, so both hold at every size. A pair that meets is compared exactly,
in double precision. Equal vectors are one node from the start and are expanded at the end.

Buckets are units of work: large ones are cut into blocks and each pair of blocks is one
unit, compared by a product of matrices. A unit gives each probe its best few, or the
links of a spanning forest, so what leaves it grows with its rows, not with their pairs.

For groups every vector goes to every table, so the number of tables is held: a key takes up
to `GROUP_ROWS` vectors before planes are added. What goes there is the unit vector rounded
to 16 bits a component. The rounding error is bounded: pairs farther from the threshold than
the bound are decided by it, the few others on the whole vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.skew import blocks_between
from vigilake.functions.tasks import per_group
from vigilake.operators.graph import components
from vigilake.session import cut_lineage

BUCKET_ROWS = 64
GROUP_PLANES = 9
GROUP_ROWS = 4096
SHORT = 32767
STRIP = 512
UNIT = ["bucket", "key", "lo", "hi"]


def index_shape(rows: int, threshold: float, recall: float, probing: bool) -> tuple[int, int]:
    """(planes per table, tables) that find a pair at the threshold with the recall.

    With `probing` a probe also asks the keys that differ on one plane.
    """
    same = 1 - math.acos(threshold) / math.pi
    planes = max(4, min(30, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS))) if rows > BUCKET_ROWS else 4)
    meets = same**planes + (planes * same ** (planes - 1) * (1 - same) if probing else 0.0)
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log1p(-meets)))


def group_shape(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(planes, tables) for groups: the same from `BUCKET_ROWS` up to `GROUP_ROWS` vectors to a key of `GROUP_PLANES`."""
    held = max(min(rows, BUCKET_ROWS << GROUP_PLANES), rows * BUCKET_ROWS // GROUP_ROWS)
    return index_shape(held, threshold, recall, False)


def usable_vectors(incidents: DataFrame, *carry: Column) -> DataFrame:
    """`id, v, h0, h1`: vectors of the most frequent size that are finite and not zero; two hashes name a vector."""
    rows = incidents.select("id", F.col("embedding").cast("array<double>").alias("v"), F.array(*carry).alias("carry")).where(
        F.col("id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists("v", lambda x: x != 0.0)
    )
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("v") == (common["size"] if common else 0)).select(
        "id", "v", "carry", F.xxhash64("v").alias("h0"), F.xxhash64(F.lit(7), "v").alias("h1")
    )


def _nodes(rows: DataFrame) -> DataFrame:
    """`node, v, h0, h1`: one row per different vector, named by its smallest id."""
    return cut_lineage(rows.groupBy("h0", "h1").agg(F.min("id").alias("node"), F.first("v").alias("v")))


def _planes(size: int, planes: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size, tables * planes))


def _keys(normals: np.ndarray, planes: int, tables: int, probing: bool) -> Callable:
    """Keys of every table as one number each; with `probing` those that differ on one plane follow."""
    weights = 1 << np.arange(planes, dtype=np.int64)
    flips = np.append(0, weights) if probing else np.zeros(1, dtype=np.int64)

    def keyed(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        sides = np.stack(vectors.to_numpy()) @ normals > 0
        key = sides.reshape(len(vectors), tables, planes).astype(np.int64) @ weights
        return pd.Series(list((key[:, :, None] ^ flips).reshape(len(vectors), -1)))

    return F.pandas_udf(keyed, "array<long>")


def _placed(nodes: DataFrame, shape: tuple[int, int], size: int, seed: int, probing: bool, *carry: Column) -> DataFrame:
    """`node, bucket, key` and what is carried."""
    planes, tables = shape
    keys = _keys(_planes(size, planes, tables, seed), planes, tables, probing)
    asked = planes + 1 if probing else 1
    placed = nodes.select("node", *carry, F.posexplode(keys("v")).alias("at", "key"))
    return placed.withColumn("bucket", F.floor(F.col("at") / asked).cast("int")).drop("at")


def _matrix(column: pd.Series) -> np.ndarray:
    raw = np.stack(column.to_numpy())
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _counted(nodes: DataFrame) -> tuple[int, int]:
    """(vectors, components of each)."""
    counted = nodes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
    return counted["n"], counted["size"] or 0


def _short() -> Callable:
    """Unit vectors rounded to multiples of 1 / `SHORT`, as 16-bit numbers."""

    def rounded(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series([line.tobytes() for line in np.rint(_matrix(vectors) * SHORT).astype("<i2")])

    return F.pandas_udf(rounded, "binary")


def short_error(size: int) -> float:
    """Most that the product of two rounded unit vectors, in single precision, is off."""
    off = math.sqrt(size) * 0.5 / SHORT
    return 2 * off + off * off + (size + 2) * 2.0**-23


def _similarity() -> Callable:
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series((_matrix(x) * _matrix(y)).sum(axis=1) if len(x) else [], dtype=float)

    return F.pandas_udf(exact, "double")


def similar_incidents(
    incidents: DataFrame, is_probe: Column, threshold: float = 0.85, limit: int = 5, recall: float = 0.999,
    seed: int = 42, block_rows: int = 4096, block_probes: int = 1024,
) -> DataFrame:
    """`probe_id, rank, id, similarity`: the nearest other incidents of each probe above the threshold.

    Ties go to the smaller id. Ids are expected to be unique; vectors that are null,
    zero or not finite take no part.
    """
    rows = cut_lineage(usable_vectors(incidents, is_probe).withColumn("is_probe", F.col("carry")[0]))
    nodes = _nodes(rows)
    count, size = _counted(nodes)
    shape = index_shape(count, threshold, recall, True)
    if not size:
        return incidents.sparkSession.createDataFrame([], "probe_id long, rank int, id long, similarity double")
    same = ["h0", "h1"]
    probes = rows.where("is_probe").select("id", *same).join(nodes.select("node", *same), same).select(F.col("id").alias("probe_id"), "node")
    asked_nodes = nodes.join(probes.select("node"), "node", "left_semi")
    asking = _placed(asked_nodes, shape, size, seed, True)
    offered = _placed(nodes, shape, size, seed, False)
    at = ["bucket", "key"]
    offered = offered.join(asking.select(*at).distinct(), at, "left_semi")
    # only buckets beyond a block are listed
    many = offered.groupBy(*at).agg(F.ceil(F.count("*") / block_rows).alias("row_blocks")).where("row_blocks > 1")
    busy = asking.groupBy(*at).agg(F.ceil(F.count("*") / block_probes).alias("probe_blocks")).where("probe_blocks > 1")
    cuts = cut_lineage(many.join(busy, at, "full"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.coalesce(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
    unit = lambda side, lo, hi, offers: side.join(cuts, at, "left").select(
        *at, lo.alias("lo"), "node", F.lit(offers).alias("offers"), "row_blocks", "probe_blocks"
    ).select(*at, "lo", hi.alias("hi"), "node", "offers")
    dealt = unit(asking, own(F.col("probe_blocks")), every(F.col("row_blocks")), False).unionByName(
        unit(offered, every(F.col("probe_blocks")), own(F.col("row_blocks")), True))
    met = dealt.join(nodes.select("node", "v"), "node").repartition(*UNIT).sortWithinPartitions(*UNIT)
    most = limit + 1

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        offers = group["offers"].to_numpy()
        ids, unit_vectors = group["node"].to_numpy(), _matrix(group["v"])
        if not len(offers) or offers.all() or not offers.any():
            return pd.DataFrame({"probe": [], "node": [], "similarity": []})
        others = ids[offers]
        near = unit_vectors[~offers] @ unit_vectors[offers].T
        out = []
        for probe, line in zip(ids[~offers], near):
            found = np.flatnonzero(line > threshold)
            best = found[np.lexsort((others[found], -line[found]))[:most]]
            out.append(pd.DataFrame({"probe": probe, "node": others[best], "similarity": line[best]}))
        return pd.concat(out)

    found = met.mapInPandas(per_group(UNIT, nearest), "probe long, node long, similarity double").groupBy(
        "probe", "node").agg(F.max("similarity").alias("similarity"))
    nearest_first = Window.partitionBy("probe").orderBy(F.desc("similarity"), "node")
    found = cut_lineage(found.withColumn("at", F.row_number().over(nearest_first)).where(F.col("at") <= most).drop("at"))
    # of the copies of one vector no probe needs more than the first few
    first = Window.partitionBy("node").orderBy("id")
    copies = rows.join(nodes.select("node", *same), same).select("node", "id").withColumn(
        "at", F.row_number().over(first)).where(F.col("at") <= most).drop("at")
    answers = probes.join(found, probes["node"] == found["probe"]).select("probe_id", found["node"], "similarity").join(
        copies, "node").where("id != probe_id")
    order = Window.partitionBy("probe_id").orderBy(F.desc("similarity"), "id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
        "probe_id", "rank", "id", "similarity")


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the links in a symmetric matrix: (child, parent) rows, and each row's root."""
    root = np.arange(len(linked))
    left = linked.any(axis=1)
    child, parent = [], []
    for start in np.flatnonzero(left):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            here = queue.pop()
            new = np.flatnonzero(linked[here] & left)
            left[new] = False
            root[new] = start
            child += new.tolist()
            parent += [here] * len(new)
            queue += new.tolist()
    return np.array(child, dtype=np.int64), np.array(parent, dtype=np.int64), root


def _linked(dealt: DataFrame, nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """`a, b`: the links of a spanning forest of every unit, from rows `UNIT, node, short`."""
    slack = short_error(size)

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["node"].to_numpy()
        short = np.frombuffer(b"".join(group["short"]), dtype="<i2").reshape(len(ids), -1)
        vectors = short.astype(np.float32) / np.float32(SHORT)
        sure, open_a, open_b = np.zeros((len(ids), len(ids)), dtype=bool), [], []
        for at in range(0, len(ids), STRIP):
            near = vectors[at:at + STRIP] @ vectors.T
            sure[at:at + STRIP] = near >= threshold + slack
            i, j = np.nonzero(np.abs(near - threshold) < slack)
            open_a.append(i + at)
            open_b.append(j)
        sure |= sure.T
        np.fill_diagonal(sure, False)
        child, parent, root = _forest(sure)
        i, j = np.concatenate(open_a), np.concatenate(open_b)
        apart = (i != j) & (root[i] != root[j])
        a, b = ids[np.append(child, i[apart])], ids[np.append(parent, j[apart])]
        known = np.arange(len(a)) < len(child)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": known}).drop_duplicates()

    met = dealt.repartition(*UNIT).sortWithinPartitions(*UNIT, "node")
    found = met.mapInPandas(per_group(UNIT, forest), "a long, b long, sure boolean")
    found = cut_lineage(found.groupBy("a", "b").agg(F.max("sure").alias("sure")))
    doubtful = found.where("not sure").select("a", "b")
    links = found.where("sure").select("a", "b")
    if doubtful.isEmpty():
        return links
    exact = _with_similarity(doubtful, nodes).where(F.col("similarity") >= threshold).select("a", "b")
    return cut_lineage(links.unionByName(exact))


def _with_similarity(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """`a, b, similarity` on the whole vectors, in double precision."""
    side = lambda end, v: nodes.select(F.col("node").alias(end), F.col("v").alias(v))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", _similarity()("x", "y").alias("similarity"))


def _groups(links: DataFrame) -> DataFrame:
    edges = links.select(F.col("a").alias("service"), F.col("b").alias("depends_on"))
    return components(edges).select(F.col("service").alias("node"), F.col("component").alias("group"))


def _connecting(
    incidents: DataFrame, threshold: float, recall: float, seed: int = 42, block_rows: int = 8192,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(`a, b` pairs that connect each group, nodes, `id, node` membership)."""
    rows = cut_lineage(usable_vectors(incidents))
    nodes = _nodes(rows)
    same = ["h0", "h1"]
    member = rows.select("id", *same).join(nodes.select("node", *same), same).select("id", "node")
    count, size = _counted(nodes)
    if not size:
        return incidents.sparkSession.createDataFrame([], "a long, b long"), nodes, member
    at = ["bucket", "key"]
    short = _short()("v").alias("short")
    shape = group_shape(count, threshold, recall)
    placed = _placed(nodes, shape, size, seed, False, short)
    held = _placed(nodes, shape, size, seed, False)
    # few rows: one for every `block_rows` rows placed, at most
    large = cut_lineage(held.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > block_rows))
    some = not large.isEmpty()
    own = F.lit(0).cast("long")
    if some:
        placed = placed.join(F.broadcast(large), at, "left")
        own = F.coalesce(F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / block_rows)), own)
    links = _linked(placed.select(*at, own.alias("lo"), own.alias("hi"), "node", "short"), nodes, size, threshold)
    if not some:
        return links, nodes, member
    grouped = held.join(F.broadcast(large.select(*at)), at).join(_groups(links), "node", "left").select(
        *at, "node", F.coalesce("group", "node").alias("group"))
    between = blocks_between(grouped, at, "node", "group", block_rows).join(nodes.select("node", short), "node")
    return cut_lineage(links.unionByName(_linked(between, nodes, size, threshold)).distinct()), nodes, member


def similarity_links(
    incidents: DataFrame, threshold: float = 0.85, recall: float = 0.99, **options
) -> tuple[DataFrame, DataFrame]:
    """(`a, b, similarity` pairs of different vectors that connect each group, `id, node` membership).

    A node stands for all incidents of one vector and is named by the smallest of them. A
    bucket beyond a block is first compared block by block, in other blocks in each table;
    the rest of its pairs only between nodes that are not in one group by then.
    """
    links, nodes, member = _connecting(incidents, threshold, recall, **options)
    return cut_lineage(_with_similarity(links, nodes)), member


def similar_groups(incidents: DataFrame, threshold: float = 0.85, recall: float = 0.99, **options) -> DataFrame:
    """`id, group_id`: every incident with a usable vector and the smallest id its links reach."""
    links, _, member = _connecting(incidents, threshold, recall, **options)
    return member.join(_groups(links), "node", "left").select("id", F.coalesce("group", "node").alias("group_id"))
