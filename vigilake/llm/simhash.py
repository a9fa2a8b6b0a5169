"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `distance` differing bits are linked; a component of links is a
group of near-duplicates. Copies with one fingerprint are one node from the start.

Candidates. The bits are grouped into partitions of correlated bits (correlation over
all distinct fingerprints). Partition `i` gets a threshold `t_i >= -1` with
`sum(t_i + 1) = distance + 1`: two fingerprints in reach then agree in some partition
up to `t_i` bits. A dynamic programme picks the thresholds, and the number of
partitions, by estimated probes and candidates. Probing a partition with threshold
`t` means one key per choice of `t` ignored bits, so every probe is an equality of
masked fingerprints, and buckets of equal keys are verified bit by bit.

Hot buckets. A bucket of more than `bucket_rows` fingerprints is cut by the same
principle over the bits its key leaves free, again until all are small. Every cut
fixes a further share of the free bits, so the size of a bucket is bounded by what
its free bits can spell. Buckets give a spanning forest of their links, not all pairs.

Defined cases. Null and wordless texts have fingerprint zero and link like others.
Fewer words than a shingle make one shingle. Repeated rows share their fingerprint.
Null ids get a component but never name one, unless no member has an id (null).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import stored

BITS = 64
SEED = 42
PARTITION_CHOICES = (2, 3)
SMALL_ROWS = 200_000
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_OFFSET = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the hashes of all shingles of `width` words, repeats included."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - span].tolist(), ends[span:].tolist())],
        dtype=np.uint64,
    )
    by_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSET).ravel(), minlength=2048)
    ones = (by_byte.reshape(8, 256) @ _BYTE_BITS).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """`doc_id, fp`: fingerprints as signed 64-bit numbers."""

    @F.pandas_udf("long")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, width) for t in batch], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), hashed(F.col(text_col)).alias("fp"))


def _bit_moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, together = 0, np.zeros((BITS, BITS))
        for batch in batches:
            raw = np.ascontiguousarray(batch["fp"].to_numpy(np.int64)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            together += bits.T @ bits
            total += len(batch)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(together.ravel(), total)})

    rows = nodes.select("fp").mapInPandas(counted, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n"))
    values = {(r["i"], r["j"]): r["n"] for r in rows.collect()}  # 4,097 numbers
    matrix = np.array([[values.get((i, j), 0.0) for j in range(BITS)] for i in range(BITS)])
    return int(values.get((-1, -1), 0)), matrix


def correlated_partitions(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size, each grown by mean absolute correlation."""
    share = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(share, share)
    spread = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    link = np.abs(cov / np.outer(spread, spread))
    free, groups = list(range(len(share))), []
    for k in range(parts):
        room = -(-len(free) // (parts - k))
        rest = link[np.ix_(free, free)] - np.eye(len(free))
        group = [free[int(rest.max(axis=1).argmax())]]
        free.remove(group[0])
        while len(group) < room:
            best = max(free, key=lambda b: (link[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def within(disagree: np.ndarray, most: int) -> np.ndarray:
    """P(at most t differing bits) for t up to `most`, bits taken as independent."""
    law = np.zeros(most + 1)
    law[0] = 1.0
    for p in disagree:
        law[1:] = law[1:] * (1 - p) + law[:-1] * p
        law[0] *= 1 - p
    return np.cumsum(law)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds `t_i >= -1` with `sum(t_i + 1) = total` of least cost; `costs[i][t + 1]`."""
    best = {0: (0.0, [])}
    for cost in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best.items():
            for step in range(total - used + 1):
                option = (so_far + cost[step], [*chosen, step - 1])
                if used + step not in grown or option < grown[used + step]:
                    grown[used + step] = option
        best = grown
    return best[total]


def plan_masks(nodes: DataFrame, distance: int) -> list[int]:
    """Masks whose equal masked values cover all pairs within `distance`."""
    n, together = _bit_moments(nodes)
    share = np.diag(together) / max(n, 1)
    disagree = 2 * share * (1 - share)
    choices = [correlated_partitions(n, together, m) for m in PARTITION_CHOICES]
    masks = [_mask(bits) for groups in choices for bits in groups]
    value = F.explode(F.array(*[
        F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
        for k, m in enumerate(masks)
    ])).alias("p")
    equal = {
        r["part"]: r["pairs"]
        for r in nodes.select(value).groupBy("p.part", "p.value").agg(F.count("*").cast("double").alias("c"))
        .groupBy("part").agg(F.sum(F.col("c") * F.col("c")).alias("pairs")).collect()
    }
    best = None
    part = 0
    for groups in choices:
        costs = []
        for bits in groups:
            reach = within(disagree[bits], distance)
            # measured agreement at threshold 0 corrects the independence assumption
            scale = equal.get(part, 0.0) / max(n * n * reach[0], 1e-9)
            costs.append([0.0] + [
                n * math.comb(len(bits), t) + min(float(n) * n, n * n * reach[t] * scale) for t in range(distance + 1)
            ])
            part += 1
        cost, thresholds = allocate(costs, distance + 1)
        if best is None or cost < best[0]:
            best = (cost, groups, thresholds)
    return [
        _mask([b for b in bits if b not in ignored])
        for bits, t in zip(best[1], best[2]) if t >= 0
        for ignored in itertools.combinations(bits, t)
    ]


def finer_masks(mask: int, distance: int) -> list[int]:
    """Cuts of the bits `mask` leaves free: one of `distance + 1` shares must agree as well."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    shares = [free[k::distance + 1] for k in range(distance + 1)]
    return [mask | _mask(share) for share in shares if share]


def _forest(distance: int):
    """Links inside sorted buckets as (fp, smallest fp of its local component)."""

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = rows.groupby(["mask", "key"], sort=False).ngroup().to_numpy()
        fp = np.ascontiguousarray(rows["fp"].to_numpy(np.int64))
        bits = fp.view(np.uint64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        size = np.diff(np.append(starts, len(bucket)))
        left = np.repeat(size, size) - (np.arange(len(bucket)) - np.repeat(starts, size))
        pairs = []
        here = np.flatnonzero(left > 1)
        for shift in range(1, int(size.max(initial=1))):
            here = here[left[here] > shift]
            close = np.bitwise_count(bits[here] ^ bits[here + shift]) <= distance
            pairs.append(np.stack((here[close], here[close] + shift)))
        links = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
        label = np.arange(len(fp))
        while True:
            low = np.minimum(label[links[0]], label[links[1]])
            moved = label.copy()
            np.minimum.at(moved, links[0], low)
            np.minimum.at(moved, links[1], low)
            np.minimum.at(moved, label[links[0]], low)
            np.minimum.at(moved, label[links[1]], low)
            moved = moved[moved]
            if (moved == label).all():
                break
            label = moved
        joined = label != np.arange(len(fp))
        return pd.DataFrame({"a": fp[joined], "b": fp[label[joined]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            last = rows.iloc[-1]
            open_bucket = (rows["mask"] == last["mask"]) & (rows["key"] == last["key"])
            waiting = rows[open_bucket]
            if not open_bucket.all():
                yield verify(rows[~open_bucket].reset_index(drop=True))
        if waiting is not None:
            yield verify(waiting.reset_index(drop=True))

    return run


def links(nodes: DataFrame, distance: int = 2, bucket_rows: int = 256) -> DataFrame:
    """`a, b`: links that connect all distinct fingerprints `fp` within `distance`."""
    keyed = lambda masks: F.explode(F.array(*[
        F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for m in masks
    ])).alias("k")
    level = nodes.select("fp", keyed(plan_masks(nodes, distance))).select("k.mask", "k.key", "fp")
    found = None
    while True:
        sizes = stored(level.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1))
        small = (
            level.join(sizes.where(F.col("n") <= bucket_rows), ["mask", "key"]).select("mask", "key", "fp")
            .repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
            .mapInPandas(_forest(distance), "a long, b long")
        )
        found = small if found is None else found.unionByName(small)
        hot = sizes.where(F.col("n") > bucket_rows)
        masks = [row["mask"] for row in hot.select("mask").distinct().collect()]  # of the fixed set of masks
        if not masks:
            return found.distinct()
        cuts = F.create_map(*[x for m in masks for x in (
            F.lit(m), F.array(*[F.lit(_signed(f)) for f in finer_masks(m & (2**64 - 1), distance)])
        )])
        level = stored(
            level.join(hot, ["mask", "key"]).select("fp", F.explode(cuts[F.col("mask")]).alias("mask"))
            .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct()
        )


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """`node, root`: smallest node of the component, for nodes with a link (alternating stars)."""

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs if small else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        met = both.join(F.broadcast(least) if least.count() <= SMALL_ROWS else least, "a")
        moved = met.where((F.col("b") > F.col("a")) | F.lit(small)).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if small:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return stored(moved.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    pairs = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(pairs)
    for _ in range(max_rounds):
        pairs = star(star(pairs, small=False), small=True)
        now = state(pairs)
        if now == before:
            roots = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError("components did not settle")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2,
) -> DataFrame:
    """`doc_id, fp, component_id`: the smallest id reachable over links, one row per document."""
    hashed = stored(fingerprints(docs, id_col, text_col, width))
    nodes = stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes, distance))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = stored(placed.join(named, "root").select("fp", "component_id"))
    return hashed.join(member, "fp").select("doc_id", "fp", "component_id")
