"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking.

Trees are fitted on a bounded sample (`sample_rows` rows by hash): a node splits its
rows at the median of their projections on the difference of two random ones. Every
row is then indexed: it gets one leaf per tree. A query walks all trees through one
shared priority queue, nearest margins first, until the leaves taken hold its budget
of rows. The budget, as a share of all rows, is what gave `target_recall` against
brute force inside the sample, so it adapts to how hard the data are.

Rows and the queries that took their leaf meet by leaf; distances are exact, in
double precision on the original vectors, and each query's best are merged. Leaves
with many rows or many queries are cut into blocks of both, so no task gets more.

Defined cases. Vectors that are null, zero, empty or hold null, NaN or infinite parts
take no part, nor do vectors whose size is not the most frequent one. Null ids take no
part. Rows that repeat an id and a vector count once, ties go to the smaller id. A query
with fewer candidates than `k` gets all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import stored

# a tree: projections (nodes x size), cuts, and children; a child below 0 is leaf `-1 - child`
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def build_tree(rows: np.ndarray, leaf_rows: int, seed: int) -> Tree:
    rng = np.random.default_rng(seed)
    projections, cuts, children, leaves = [], [], [], 0
    waiting = [(np.arange(len(rows)), None)]
    while waiting:
        members, slot = waiting.pop()
        split = None
        if len(members) > leaf_rows:
            a, b = rows[rng.choice(members, 2, replace=False)]
            direction = a - b
            length = np.sqrt(direction @ direction)
            if length > 0:
                direction = direction / length
                along = rows[members] @ direction
                cut = float(np.median(along))
                low = along <= cut
                if low.any() and not low.all():
                    split = (direction, cut, members[low], members[~low])
        if split is None:
            number, leaves = -1 - leaves, leaves + 1
        else:
            number = len(projections)
            projections.append(split[0])
            cuts.append(split[1])
            children.append([0, 0])
            waiting += [(split[2], (number, 0)), (split[3], (number, 1))]
        if slot is not None:
            children[slot[0]][slot[1]] = number
    size = rows.shape[1]
    return (
        np.array(projections).reshape(-1, size), np.array(cuts),
        np.array(children, dtype=np.int32).reshape(-1, 2), leaves,
    )


def leaves_of(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """Leaf number of every row."""
    projections, cuts, children, _ = tree
    at = np.zeros(len(rows), dtype=np.int32) if len(cuts) else np.full(len(rows), -1, dtype=np.int32)
    while (moving := np.flatnonzero(at >= 0)).size:
        node = at[moving]
        side = np.einsum("ij,ij->i", rows[moving], projections[node]) > cuts[node]
        at[moving] = children[node, side.astype(np.int8)]
    return -1 - at


def search(forest: list[Tree], weights: list[np.ndarray], query: np.ndarray, budget: float) -> list[tuple[int, int]]:
    """(tree, leaf) in order of the shared queue until their weights reach the budget."""
    margins = [tree[0] @ query - tree[1] for tree in forest]
    queue = [(0.0, t, 0 if len(tree[1]) else -1) for t, tree in enumerate(forest)]
    taken, held = [], 0.0
    while queue and held < budget:
        distance, t, node = heapq.heappop(queue)
        if node < 0:
            taken.append((t, -1 - node))
            held += weights[t][-1 - node]
            continue
        margin = float(margins[t][node])
        low, high = forest[t][2][node].tolist()
        near, far = (high, low) if margin > 0 else (low, high)
        heapq.heappush(queue, (distance, t, near))
        heapq.heappush(queue, (max(distance, abs(margin)), t, far))
    return taken


def best_of(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the `k` nearest; `rough` are squared distances up to rounding."""
    if len(ids) > k:
        limit = np.partition(rough, k - 1)[k - 1]
        near = np.flatnonzero(rough <= limit + 1e-9 * max(1.0, abs(limit)))
    else:
        near = np.arange(len(ids))
    gap = rows[near] - query
    exact = np.sqrt((gap * gap).sum(axis=1))
    order = np.lexsort((ids[near], exact))[:k]
    return ids[near][order], exact[order]


def calibrate(forest: list[Tree], rows: np.ndarray, k: int, target: float, probes: int = 100) -> float:
    """Budget, in rows of the sample over all trees, that finds `target` of the true neighbours."""
    where = [leaves_of(tree, rows) for tree in forest]
    weights = [np.bincount(w, minlength=tree[3]).astype(float) for w, tree in zip(where, forest)]
    needed = []
    squares = (rows * rows).sum(axis=1)
    for q in np.linspace(0, len(rows) - 1, min(probes, len(rows))).astype(int):
        rough = squares - 2 * rows @ rows[q]
        rough[q] = np.inf
        true = np.argsort(rough, kind="stable")[:min(k, len(rows) - 1)]
        order = search(forest, weights, rows[q], float("inf"))
        held = np.cumsum([weights[t][leaf] for t, leaf in order])
        place = [np.full(tree[3], np.inf) for tree in forest]
        for (t, leaf), cost in zip(order, held):
            place[t][leaf] = cost
        needed += np.min([place[t][where[t][true]] for t in range(len(forest))], axis=0).tolist()
    return float(np.quantile(needed, target)) if needed else 0.0


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`vec_id, v` with usable vectors of the most frequent size."""
    usable = (
        table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .where(F.exists("v", lambda x: x != 0.0))
    )
    sizes = usable.groupBy(F.size("v").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc())
    common = sizes.first()
    return usable.where(F.size("v") == (common["size"] if common else 0))


def nearest(
    table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
    trees: int = 8, sample_rows: int = 20_000, leaf_rows: int = 200, target_recall: float = 0.97,
    block_rows: int = 20_000, block_queries: int = 2_000,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: nearest other rows of every row where `is_query` holds."""
    spark = table.sparkSession
    rows = valid_vectors(table, id_col, vector_col)
    total = rows.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if total == 0:
        return spark.createDataFrame([], empty)
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    sample = np.array([
        r["v"] for r in rows.where(place < min(1.0, sample_rows / total) * (1 << 30)).orderBy(place, "vec_id")
        .limit(2 * sample_rows).select("v").toLocalIterator()
    ])
    if not len(sample):
        sample = np.array([r["v"] for r in rows.orderBy("vec_id").limit(1).collect()])
    forest = [build_tree(sample, leaf_rows, seed) for seed in range(trees)]
    budget = calibrate(forest, sample, k, target_recall) / len(sample) * total
    shared = spark.sparkContext.broadcast(forest)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                data = np.stack(batch["v"].to_numpy())
                for t, tree in enumerate(shared.value):
                    yield pd.DataFrame({"tree": t, "leaf": leaves_of(tree, data), "vec_id": batch["vec_id"]})

    leaves = stored(rows.mapInPandas(index, "tree int, leaf int, vec_id long"))
    counted = leaves.groupBy("tree", "leaf").count().collect()  # `trees` times the leaves of the sample
    held = [np.zeros(tree[3]) for tree in forest]
    for row in counted:
        held[row["tree"]][row["leaf"]] = row["count"]
    budget = max(budget, float(trees * (k + 1)))
    weights = spark.sparkContext.broadcast(held)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (t, leaf, i) for i, v in zip(batch["vec_id"], batch["v"])
                for t, leaf in search(shared.value, weights.value, np.asarray(v), budget)
            ]
            yield pd.DataFrame(out, columns=["tree", "leaf", "vec_id"])

    queries = rows.where(is_query)
    probes = stored(queries.mapInPandas(probe, "tree int, leaf int, vec_id long"))
    asked = {(r["tree"], r["leaf"]): r["count"] for r in probes.groupBy("tree", "leaf").count().collect()}
    cuts = [
        (t, leaf, int(-(-held[t][leaf] // block_rows)) or 1, -(-n // block_queries)) for (t, leaf), n in asked.items()
    ] or [(0, 0, 1, 1)]
    blocks = F.broadcast(spark.createDataFrame(cuts, "tree int, leaf int, row_blocks int, query_blocks int"))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = (
        probes.join(blocks, ["tree", "leaf"])
        .select("tree", "leaf", own(F.col("query_blocks")).alias("qb"), every(F.col("row_blocks")).alias("rb"), "vec_id")
        .withColumn("is_row", F.lit(False))
    )
    offered = (
        leaves.join(blocks, ["tree", "leaf"])
        .select("tree", "leaf", every(F.col("query_blocks")).alias("qb"), own(F.col("row_blocks")).alias("rb"), "vec_id")
        .withColumn("is_row", F.lit(True))
    )
    # queries come first in each block, then its rows
    met = (
        asking.unionByName(offered).join(rows.dropDuplicates(["vec_id", "v"]), "vec_id")
        .repartition("tree", "leaf", "qb", "rb").sortWithinPartitions("tree", "leaf", "qb", "rb", "is_row", "vec_id")
    )

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        is_row = group["is_row"].to_numpy()
        ids = group["vec_id"].to_numpy()
        vectors = np.stack(group["v"].to_numpy())
        row_ids, row_vectors = ids[is_row], vectors[is_row]
        squares = (row_vectors * row_vectors).sum(axis=1)
        out = []
        for query_id, query in zip(ids[~is_row], vectors[~is_row]):
            rough = squares - 2 * (row_vectors @ query) + query @ query
            keep = row_ids != query_id
            found, score = best_of(query, row_ids[keep], row_vectors[keep], rough[keep], k)
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, waiting = ["tree", "leaf", "qb", "rb"], None
        for batch in batches:
            data = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            last = (data[keys] == data[keys].iloc[-1]).all(axis=1).to_numpy()
            waiting = data[last]
            for _, group in data[~last].groupby(keys, sort=False):
                yield answer(group)
        if waiting is not None:
            yield answer(waiting)

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        met.mapInPandas(rerank, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
