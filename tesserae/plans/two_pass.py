"""Block-wise agglomeration in two passes over a checkerboard of blocks.

Blocks of even parity are segmented on their own, with a halo. Blocks of odd parity are
then segmented with the even blocks' labels in their halo as seeds. Labels that a seed
joined are united over the whole volume, and the labels written to the core of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels
from ..operators.graph import union_find
from ..operators.grid import Blocking, axes_of, node_to_coordinate
from ..operators.solve import by_group
from .rounds import keep


def _segment(rows: list[tuple], n: int, offsets: Sequence[Sequence[int]], solver: Callable, seeds: bool) -> list[int]:
    """Labels of a block's voxels (n coordinates, affinities a0, a1, ..., core, seed), kept apart or joined by seeds."""
    index = {r[:n]: i for i, r in enumerate(rows)}
    edges = []
    for k, off in enumerate(offsets):
        for i, r in enumerate(rows):
            j = index.get(tuple(c + d for c, d in zip(r, off, strict=False)))
            if j is not None:
                edges.append((min(i, j), max(i, j), r[n + k]))
    if seeds:
        lead: dict[int, int] = {}
        for i, r in enumerate(rows):
            if r[-2] >= 0:
                first = lead.setdefault(r[-2], i)
                if first != i:
                    edges.append((first, i, 1e6))
    labels = solver(edges) if edges else {}
    return [labels.get(i, i) for i in range(len(rows))]


def two_pass(affinities: DataFrame, offsets: Sequence[Sequence[int]], blocking: Blocking, halo: Sequence[int], solver: Callable = kernels.greedy_additive) -> DataFrame:
    """(coordinates, label): affinities are wide rows (coordinates, a0, a1, ...), signed, positive where voxels belong together."""
    own = axes_of(affinities)
    size = int(np.prod([b + 2 * h for b, h in zip(blocking.block, halo, strict=True)]))
    placed = blocking.with_halo(affinities, halo)
    parity = sum(node_to_coordinate(F.col("block_id"), blocking.per_axis), F.lit(0)) % 2
    placed = placed.withColumn("core", blocking.block_id([F.col(a) for a in own]) == F.col("block_id")).withColumn("odd", parity)
    cols = ", ".join([f"{a} long" for a in own])
    schema = f"{cols}, core boolean, seed long, label long"

    def solve(rows: DataFrame, seeds: bool) -> DataFrame:
        def run(rows: list[tuple]) -> list[tuple]:
            labels = _segment(rows, len(own), offsets, solver, seeds)
            return [(*r[: len(own)], *r[-3:-1], label + r[-1] * size) for r, label in zip(rows, labels, strict=True)]

        return by_group(rows.select(*own, *[f"a{k}" for k in range(len(offsets))], "core", "seed", "block_id"), ["block_id"], run, schema)

    even = keep(solve(placed.where("odd = 0").withColumn("seed", F.lit(-1).cast("long")), False))
    told = even.where("core").select(*own, F.col("label").alias("seed"))
    rows = placed.where("odd = 1").join(told, list(own), "left").withColumn("seed", F.coalesce("seed", F.lit(-1)))
    odd = keep(solve(rows, True))
    joined = odd.where("seed >= 0").select(F.col("label").alias("a"), F.col("seed").alias("b")).distinct()
    core = even.where("core").select(*own, "label").union(odd.where("core").select(*own, "label"))
    roots = union_find(joined).select(F.col("node").alias("label"), "root")
    return core.join(roots, "label", "left").select(*own, F.coalesce("root", "label").alias("label"))
