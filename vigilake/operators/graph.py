"""Service dependency graph: edges, hop distance, depth and connected components.

An edge (service, depends_on) reads "service depends on depends_on". Iterative
operators keep one small row per node between rounds, cut lineage with a
reliable checkpoint and stop when a round changes nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.session import cut_lineage

SUBSET_SERVICES = 20
SEARCH_STEPS = 500_000


def service_edges(services: DataFrame) -> DataFrame:
    """Edge list from the services' dependency id arrays; no arrays give an empty list."""
    names = services.select(F.col("id").alias("_dep"), F.col("name").alias("depends_on"))
    return (
        services.select(F.col("name").alias("service"), F.explode("depends_on").alias("_dep"))
        .join(names, "_dep")
        .select("service", "depends_on")
        .distinct()
    )


def graph_nodes(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Every service an edge mentions, plus declared ones without edges."""
    nodes = edges.select("service").union(edges.select(F.col("depends_on").alias("service")))
    if declared is not None:
        nodes = nodes.union(declared.select("service"))
    return nodes.where(F.col("service").isNotNull()).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) in both directions, without self loops."""
    forward = edges.select(F.col("service").alias("a"), F.col("depends_on").alias("b"))
    return forward.union(forward.select("b", "a")).where(F.col("a") != F.col("b")).distinct()


def neighbours(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(service, near): direct neighbours of every known service, bounded by the services."""
    sides = undirected(edges).groupBy(F.col("a").alias("service")).agg(
        F.sort_array(F.collect_set("b")).alias("near")
    )
    return graph_nodes(edges, declared).join(sides, "service", "left").withColumn(
        "near", F.coalesce("near", F.array().cast("array<string>"))
    )


def hops_between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected hops 0, 1 or 2 for the given (a, b) pairs; NULL when farther or unknown.

    Only asked pairs are looked up, and the two-hop test walks from the end with
    fewer neighbours, so a hub is never paired with itself.
    """
    near = undirected(edges)
    degree = near.groupBy("a").agg(F.count("*").alias("_degree"))
    known = graph_nodes(edges).select(F.col("service").alias("_node"))
    asked = (
        pairs.select("a", "b").distinct()
        .join(known, F.col("a") == F.col("_node"), "left_semi")
        .join(known, F.col("b") == F.col("_node"), "left_semi")
        .join(degree.withColumnRenamed("_degree", "_da"), "a", "left")
        .join(degree.select(F.col("a").alias("b"), F.col("_degree").alias("_db")), "b", "left")
    )
    same = asked.where(F.col("a") == F.col("b")).select("a", "b", F.lit(0).alias("hops"))
    one = asked.join(near, ["a", "b"], "left_semi").select("a", "b", F.lit(1).alias("hops"))
    swap = F.col("_db") < F.col("_da")
    walked = asked.select(
        "a", "b", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("_from"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("_to"),
    )
    first = near.select(F.col("a").alias("_from"), F.col("b").alias("_mid"))
    second = near.select(F.col("a").alias("_mid"), F.col("b").alias("_to"))
    two = (
        walked.join(first, "_from").join(second, ["_mid", "_to"], "left_semi")
        .select("a", "b", F.lit(2).alias("hops"))
    )
    found = same.union(one).union(two).groupBy("a", "b").agg(F.min("hops").alias("hops"))
    return pairs.select("a", "b").distinct().join(found, ["a", "b"], "left")


def components(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(service, component): smallest service name reachable, ignoring direction.

    Each round takes the smallest label among neighbours and then the label of
    that label, so long chains shorten by doubling.
    """
    edges = cut_lineage(edges.select("service", "depends_on"))
    near = undirected(edges)
    labels = graph_nodes(edges, declared).withColumn("component", F.col("service"))
    while True:
        heard = (
            near.join(labels.select(F.col("service").alias("a"), "component"), "a")
            .groupBy(F.col("b").alias("service"))
            .agg(F.min("component").alias("_heard"))
        )
        lowered = labels.join(heard, "service", "left").select(
            "service", F.least("component", F.coalesce("_heard", "component")).alias("_low"),
            F.col("component").alias("_old"),
        )
        jump = labels.select(F.col("service").alias("_low"), F.col("component").alias("_jump"))
        moved = cut_lineage(
            lowered.join(jump, "_low", "left").select(
                "service", F.least("_low", "_jump").alias("component"), "_old"
            )
        )
        changed = moved.where(F.col("component") != F.col("_old")).limit(1).count()
        labels = moved.drop("_old")
        if not changed:
            return labels


def depths(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(service, depth): longest chain of dependents above each service.

    Services whose dependents are all settled settle level by level, which
    covers an acyclic graph in as many rounds as it has levels. What remains
    sits on or below a cycle; there a path stops where it re-enters itself,
    counting that edge. Paths are searched inside one cycle at a time.
    """
    links = cut_lineage(edges.select("service", "depends_on").distinct())
    nodes = graph_nodes(links, declared)
    settled = cut_lineage(
        nodes.join(links.select(F.col("depends_on").alias("service")), "service", "left_anti")
        .withColumn("depth", F.lit(0))
    )
    while True:
        above = links.join(
            settled.select("service", F.col("depth").alias("_above")), "service", "left"
        )
        ready = (
            above.groupBy(F.col("depends_on").alias("service"))
            .agg(F.count_if(F.col("_above").isNull()).alias("_open"),
                 (F.max("_above") + 1).alias("depth"))
            .where(F.col("_open") == 0)
            .join(settled, "service", "left_anti")
            .select("service", "depth")
        )
        ready = cut_lineage(ready)
        if ready.limit(1).count() == 0:
            break
        settled = cut_lineage(settled.union(ready))
    tangled = nodes.join(settled, "service", "left_anti")
    if tangled.limit(1).count() == 0:
        return settled
    return settled.union(_tangled_depths(links, settled, tangled))


def strong_components(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(service, scc): services that reach each other; `scc` is the largest name among them.

    Forward and backward colouring: every service takes the largest name that reaches it;
    those that reach back to the service of their own colour are its component and leave,
    and the rest is coloured anew.
    """
    links = cut_lineage(edges.select("service", "depends_on").distinct())
    left = cut_lineage(graph_nodes(links, declared))
    done = None
    while left.limit(1).count():
        a, b = left.select("service"), left.select(F.col("service").alias("depends_on"))
        inner = cut_lineage(links.join(a, "service", "left_semi").join(b, "depends_on", "left_semi"))
        colour = left.select("service", F.col("service").alias("colour"))
        while True:
            heard = inner.join(colour, "service").groupBy(F.col("depends_on").alias("service")).agg(
                F.max("colour").alias("_heard"))
            colour = cut_lineage(colour.select("service", F.col("colour").alias("_old")).join(heard, "service", "left").select(
                "service", F.greatest("_old", F.coalesce("_heard", "_old")).alias("colour"), "_old"))
            if not colour.where("colour != _old").limit(1).count():
                break
            colour = colour.drop("_old")
        colour = colour.drop("_old")
        back = (
            inner.join(colour, "service")
            .join(colour.select(F.col("service").alias("depends_on"), F.col("colour").alias("_c")), "depends_on")
            .where("colour = _c").select("service", "depends_on", "colour")
        )
        found = cut_lineage(colour.where("service = colour"))
        newest = found
        while newest.limit(1).count():
            above = back.join(newest.select(F.col("service").alias("depends_on")), "depends_on", "left_semi").select(
                "service", "colour").distinct()
            newest = cut_lineage(above.join(found, "service", "left_anti"))
            found = cut_lineage(found.unionByName(newest))
        members = found.select("service", F.col("colour").alias("scc"))
        done = members if done is None else done.unionByName(members)
        left = cut_lineage(left.join(members, "service", "left_anti"))
    return left.select("service", F.lit(None).cast("string").alias("scc")) if done is None else done


def _tangled_depths(links: DataFrame, settled: DataFrame, tangled: DataFrame) -> DataFrame:
    """Depths on and below cycles: the cycles' graph without cycles is settled level by level.

    A path that leaves a strongly connected component never comes back, so what is above a
    component enters its own search as one number per service.
    """
    inner = links.join(tangled.select(F.col("service").alias("depends_on")), "depends_on", "left_semi")
    parts = cut_lineage(strong_components(inner.join(tangled, "service", "left_semi"), tangled))
    up = cut_lineage(
        inner.join(parts.select(F.col("service").alias("depends_on"), F.col("scc").alias("_scc")), "depends_on")
        .join(parts, "service", "left")
        .select(F.col("depends_on").alias("service"), F.col("_scc").alias("scc"), F.col("service").alias("above"),
                F.coalesce(F.col("scc") == F.col("_scc"), F.lit(False)).alias("within"))
    )
    known, waiting = settled, parts
    solved = None
    while waiting.limit(1).count():
        depth = known.select(F.col("service").alias("above"), F.col("depth").alias("_depth"))
        rows = up.join(waiting.select("service"), "service", "left_semi").join(depth, "above", "left")
        blocked = rows.where(~F.col("within") & F.col("_depth").isNull()).select("scc").distinct()
        ready = rows.join(blocked, "scc", "left_anti").groupBy("scc", "service").agg(
            F.collect_set(F.when(F.col("within"), F.col("above"))).alias("near"), F.max("_depth").alias("exit"))
        found = cut_lineage(ready.groupBy("scc").applyInPandas(_depths_inside, "service string, depth int"))
        solved = found if solved is None else solved.unionByName(found)
        known = known.unionByName(found)
        waiting = cut_lineage(waiting.join(found.select("service"), "service", "left_anti"))
    return solved


def _depths_inside(rows: pd.DataFrame) -> pd.DataFrame:
    """Depth of every service of one strongly connected component."""
    names = sorted(rows["service"])
    place = {name: n for n, name in enumerate(names)}
    near: list[list[int]] = [[] for _ in names]
    exits: list[int | None] = [None] * len(names)
    for name, above, leaving in zip(rows["service"], rows["near"], rows["exit"]):
        near[place[name]] = [place[other] for other in above]
        exits[place[name]] = None if pd.isna(leaving) else int(leaving)
    search = longest_by_subsets if len(names) <= SUBSET_SERVICES else longest_by_search
    return pd.DataFrame({"service": names, "depth": search(near, exits)}).astype({"depth": "int32"})


def longest_by_subsets(near: list[list[int]], exits: list[int | None]) -> list[int]:
    """Longest simple path from every service, counting the edge that re-enters it or leaves.

    For each set of services and each last one: which first ones have a path over exactly
    that set, as bits; sets in order of size.
    """
    m = len(near)
    sets = np.arange(1 << m, dtype=np.int64)
    size = np.bitwise_count(sets).astype(np.int64)
    starts = np.zeros((m, 1 << m), dtype=np.int32)
    for v in range(m):
        starts[v, 1 << v] = 1 << v
    by_size = np.argsort(size, kind="stable")
    bounds = np.searchsorted(size[by_size], np.arange(m + 2))
    for k in range(1, m):
        layer = by_size[bounds[k]:bounds[k + 1]]
        for last in range(m):
            here = layer[starts[last, layer] != 0]
            for step in near[last]:
                free = here[here >> step & 1 == 0]
                starts[step, free | 1 << step] |= starts[last, free]
    depth = np.zeros(m, dtype=np.int64)
    for last in range(m):
        back = sum(1 << step for step in near[last])
        value = np.where(sets & back, size, 0)
        if exits[last] is not None:
            value = np.maximum(value, size + exits[last])
        for v in range(m):
            here = starts[last] >> v & 1 == 1
            depth[v] = max(depth[v], int(value[here].max(initial=0)))
    return depth.tolist()


def longest_by_search(near: list[list[int]], exits: list[int | None]) -> list[int]:
    """The same by search, for components too large for sets of services.

    A path stops at the best value any path can have. A component in which that takes
    more than `SEARCH_STEPS` steps for one service is an error, not a guess.
    """
    most = len(near) + max((e for e in exits if e is not None), default=0)
    return [_longest_from(v, near, exits, most) for v in range(len(near))]


def _longest_from(first: int, near: list[list[int]], exits: list[int | None], most: int) -> int:
    best, steps, on_path, path, options = 0, 0, {first}, [first], [iter(near[first])]
    best = 1 + exits[first] if exits[first] is not None else 0
    while path and best < most:
        step = next(options[-1], None)
        if step is None:
            on_path.discard(path.pop())
            options.pop()
            continue
        steps += 1
        if steps > SEARCH_STEPS:
            raise ValueError(f"a cycle of {len(near)} services is too entangled to measure its longest path")
        if step in on_path:
            best = max(best, len(path))
            continue
        path.append(step)
        on_path.add(step)
        # the service with the fewest ways on is tried first
        options.append(iter(sorted(near[step], key=lambda n: (n in on_path, sum(o not in on_path for o in near[n])))))
        if exits[step] is not None:
            best = max(best, len(path) + exits[step])
    return best


def sync_services(existing: DataFrame, edges: DataFrame, teams: DataFrame) -> DataFrame:
    """Service rows with recomputed depth: depth 0 opens as tier 1, the rest as tier 2.

    A known service keeps its tier; depth and team always follow the graph.
    """
    fresh = depths(edges).withColumnRenamed("service", "name").join(teams, "name", "left").select(
        "name", F.coalesce("team", F.lit("unassigned")).alias("team"),
        F.when(F.col("depth") == 0, 1).otherwise(2).alias("tier"),
        F.col("depth").alias("graph_depth"), F.lit(True).alias("_fresh"),
    )
    old = existing.select(
        "name", F.col("team").alias("_team"), F.col("tier").alias("_tier"),
        F.col("graph_depth").alias("_depth"),
    )
    return fresh.join(old, "name", "full").select(
        "name", F.coalesce("team", "_team").alias("team"),
        F.coalesce("_tier", "tier").alias("tier"),
        F.coalesce("graph_depth", "_depth").alias("graph_depth"),
    )
