"""Running sequential kernels for every component in parallel.

The problem is decomposed by connected components of the edges that can join anything
(all edges, or those of positive weight); each is solved by one kernel in one task.
What is gained is exact: no kernel joins nodes across such components. A component
must fit a task; `limit` refuses larger ones instead of running out of memory.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .graph import connected_components, contract
from .lookup import with_node_values
from .tiles import deal

LIMIT = 5_000_000
#: Rows of results that a task gathers before it hands them on.
FLUSH = 20_000


def by_group(rows: DataFrame, keys: list[str], run: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """run(rows of a group, the columns before the keys, sorted) for every group; many small groups cost a task no data frame each.

    Groups are dealt into a fixed number of partitions: small tables are not merged into
    one task, since the time goes into the kernels, not the bytes.
    """
    rest = [c for c in rows.columns if c not in keys]
    names = [f.split()[0] for f in schema.split(", ")]
    width, order = len(rest), [*rest, *keys]
    key = itemgetter(*range(width, len(order)))

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        every = itertools.chain.from_iterable(zip(*[pdf[c].tolist() for c in order], strict=True) for pdf in frames)
        for _, group in itertools.groupby(every, key):
            out += run(sorted(group))
            if len(out) >= FLUSH:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return deal(rows.select(*order), *keys).sortWithinPartitions(*keys).mapInPandas(pieces, schema)


def _edges(rows: list[tuple]) -> kernels.Edges:
    return [r[:3] for r in rows]


def _kinds(rows: list[tuple], n: int, at: int = 3) -> list[list[tuple]]:
    """Rows by their kind, 0 to n - 1."""
    out: list[list[tuple]] = [[] for _ in range(n)]
    for r in rows:
        out[r[at]].append(r)
    return out


def with_components(edges: DataFrame, positive: bool = False) -> DataFrame:
    """Edges with their component; with positive=True of the graph of positive edges, and only edges inside one."""
    base = edges.where("w > 0") if positive else edges
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    comp = connected_components(base, nodes)
    if not positive:
        return edges.join(comp.select(F.col("node").alias("u"), "component"), "u")
    j = with_node_values(edges, comp, "component")
    return j.where("component_u = component_v").withColumn("component", F.col("component_u")).drop("component_u", "component_v")


def per_component(edges: DataFrame, kernel: Callable[[kernels.Edges], dict[int, int]], positive: bool = False, limit: int = LIMIT) -> DataFrame:
    """(node, label) by running kernel(edges) on each component."""

    def run(rows: list[tuple]) -> list[tuple]:
        if len(rows) > limit:
            raise ValueError(f"a component has {len(rows)} edges; the limit is {limit}")
        return list(kernel(_edges(rows)).items())

    held = with_components(edges.select("u", "v", "w"), positive)
    solved = by_group(held.select("u", "v", "w", "component"), ["component"], run, "node long, label long")
    if not positive:
        return solved
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(solved, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def per_component_seeded(edges: DataFrame, seeds: DataFrame, kernel: Callable, heights: DataFrame | None = None) -> DataFrame:
    """(node, label) by kernel(edges, {node: seed}[, {node: height}]) on each component; node values travel as self edges."""
    held = with_components(edges.select("u", "v", "w")).withColumn("kind", F.lit(0))
    comp = held.select(F.explode(F.array("u", "v")).alias("node"), "component").distinct()

    def told(df: DataFrame, value: str, kind: int) -> DataFrame:
        return df.join(comp, "node").select(F.col("node").alias("u"), F.col("node").alias("v"), F.col(value).cast("double").alias("w"), "component", F.lit(kind).alias("kind"))

    every = held.select("u", "v", "w", "component", "kind").union(told(seeds, "label", 1))
    tall = heights is not None
    if tall:
        every = every.union(told(heights, "height", 2))

    def run(rows: list[tuple]) -> list[tuple]:
        held, told_seeds, told_heights = _kinds(rows, 3)
        args = [_edges(held), {r[0]: int(r[2]) for r in told_seeds}]
        if tall:
            args.append({r[0]: r[2] for r in told_heights})
        return list(kernel(*args).items())

    return by_group(every.select("u", "v", "w", "kind", "component"), ["component"], run, "node long, label long")


def per_component_lifted(edges: DataFrame, lifted: DataFrame, kernel: Callable) -> DataFrame:
    """(node, label) by kernel(edges, lifted edges) on each component of the local graph; lifted edges across go."""
    held = with_components(edges.select("u", "v", "w")).select("u", "v", "w", "component", F.lit(0).alias("kind"))
    comp = held.select(F.explode(F.array("u", "v")).alias("node"), "component").distinct()
    j = with_node_values(lifted.select("u", "v", "w"), comp, "component").where("component_u = component_v")
    every = held.union(j.select("u", "v", "w", F.col("component_u").alias("component"), F.lit(1).alias("kind")))

    def run(rows: list[tuple]) -> list[tuple]:
        return list(kernel(*map(_edges, _kinds(rows, 2))).items())

    return by_group(every.select("u", "v", "w", "kind", "component"), ["component"], run, "node long, label long")


def decompose(edges: DataFrame, kernel: Callable = kernels.kernighan_lin) -> DataFrame:
    """Multicut by components of positive edges: no optimal cluster spans two of them."""
    return per_component(edges, kernel, positive=True)


def perturb_and_map(edges: DataFrame, times: int, kind: str = "normal", magnitude: float = 1.0, kernel: Callable = kernels.greedy_additive) -> DataFrame:
    """(u, v, cut_share): how often an edge is cut over perturbed copies, each solved in a task of its own."""
    held = with_components(edges.select("u", "v", "w")).select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("seed"))

    def run(rows: list[tuple]) -> list[tuple]:
        e = _edges(rows)
        labels = kernel(kernels.perturb(e, kind, magnitude, rows[0][-1]))
        return [(u, v, float(labels[u] != labels[v])) for u, v, _ in e]

    cuts = by_group(held.select("u", "v", "w", "component", "seed"), ["component", "seed"], run, "u long, v long, cut double")
    return cuts.groupBy("u", "v").agg(F.avg("cut").alias("cut_share"))


def lifted_ucm_features(edges: DataFrame, lifted: DataFrame, regularizers: list[float]) -> DataFrame:
    """(u, v, heights) of lifted pairs: the priorities at which their ends merge over the local edges."""
    held = with_components(edges.select("u", "v", "w")).select("u", "v", "w", "component", F.lit(0).alias("kind"))
    comp = held.select(F.explode(F.array("u", "v")).alias("node"), "component").distinct()
    j = with_node_values(lifted.select("u", "v"), comp, "component").where("component_u = component_v")
    every = held.union(j.select("u", "v", F.lit(0.0).alias("w"), F.col("component_u").alias("component"), F.lit(1).alias("kind")))

    def run(rows: list[tuple]) -> list[tuple]:
        near, far = _kinds(rows, 2)
        return kernels.ucm(_edges(near), regularizers, [r[:2] for r in far])

    return by_group(every.select("u", "v", "w", "kind", "component"), ["component"], run, "u long, v long, heights array<double>")


def ucm_features(edges: DataFrame, regularizers: list[float]) -> DataFrame:
    """(u, v, heights): for each regulariser the priority at which an edge's ends merge."""

    def run(rows: list[tuple]) -> list[tuple]:
        return kernels.ucm(_edges(rows), regularizers)

    return by_group(with_components(edges.select("u", "v", "w")).select("u", "v", "w", "component"), ["component"], run, "u long, v long, heights array<double>")


def dendrogram(edges: DataFrame, regularizer: float = 0.5) -> DataFrame:
    """(component, t, a, b, priority): the merges of each component in order."""

    def run(rows: list[tuple]) -> list[tuple]:
        steps: list = []
        kernels.edge_weighted_clustering(_edges(rows), regularizer=regularizer, dendrogram=steps)
        return [(rows[0][-1], t, a, b, p) for t, (a, b, p) in enumerate(steps)]

    return by_group(with_components(edges.select("u", "v", "w")).select("u", "v", "w", "component"), ["component"], run, "component long, t long, a long, b long, priority double")


def st_cut(edges: DataFrame, unaries: DataFrame) -> DataFrame:
    """(node, label, flow) of the least cut of each component."""
    held = with_components(edges.select("u", "v", "w")).select("u", "v", "w", "component", F.lit(0.0).alias("c1"), F.lit(0).alias("kind"))
    comp = held.select(F.explode(F.array("u", "v")).alias("node"), "component").distinct()
    told = unaries.join(comp, "node").select(F.col("node").alias("u"), F.col("node").alias("v"), F.col("c0").alias("w"), "component", "c1", F.lit(1).alias("kind"))

    def run(rows: list[tuple]) -> list[tuple]:
        held, un = _kinds(rows, 2, 4)
        flow, labels = kernels.min_st_cut(_edges(held), {r[0]: (r[2], r[3]) for r in un})
        return [(x, side, flow) for x, side in labels.items()]

    return by_group(held.union(told).select("u", "v", "w", "c1", "kind", "component"), ["component"], run, "node long, label long, flow double")


def block_multicut(edges: DataFrame, blocks: DataFrame, kernel: Callable = kernels.greedy_additive) -> DataFrame:
    """Two passes: solve inside the blocks of nodes (node, block), contract what they joined, solve the rest."""
    j = with_node_values(edges.select("u", "v", "w"), blocks, "block")
    inner = j.where("block_u = block_v")

    def run(rows: list[tuple]) -> list[tuple]:
        return list(kernel(_edges(rows)).items())

    first = by_group(inner.select("u", "v", "w", F.col("block_u").alias("block")), ["block"], run, "node long, label long")
    labels = blocks.join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    from ..plans.rounds import keep

    labels = keep(labels)
    small = contract(edges, labels)
    second = per_component(small, kernel, positive=True).select(F.col("node").alias("label"), F.col("label").alias("final"))
    return labels.join(second, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
