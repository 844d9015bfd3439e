"""Scoring a segmentation by skeletons: splits, merges, run lengths, distances.

Nodes are (skel, node, z, y, x, label), edges (skel, a, b); an edge is valid if both
ends are nodes with a label other than 0 (-1 marks a root).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def assign(nodes: DataFrame, vox: DataFrame) -> DataFrame:
    """Skeleton nodes with the label of their voxel; 0 where there is none."""
    return nodes.drop("label").join(vox.select(*AXES, "label"), list(AXES), "left").withColumn("label", F.coalesce("label", F.lit(0)))


def labelled_edges(nodes: DataFrame, edges: DataFrame, coords: bool = False) -> DataFrame:
    """Valid edges with la, lb (and the coordinates of both ends)."""
    extra = AXES if coords else ()
    a = nodes.select("skel", F.col("node").alias("a"), F.col("label").alias("la"), *[F.col(c).alias(f"a_{c}") for c in extra])
    b = nodes.select("skel", F.col("node").alias("b"), F.col("label").alias("lb"), *[F.col(c).alias(f"b_{c}") for c in extra])
    return edges.where("a >= 0 and b >= 0").join(a, ["skel", "a"]).join(b, ["skel", "b"]).where("la <> 0 and lb <> 0")


def split_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(skel, split): share of valid edges whose ends differ; 0 without any."""
    s = labelled_edges(nodes, edges).groupBy("skel").agg(F.avg((F.col("la") != F.col("lb")).cast("double")).alias("split"))
    return nodes.select("skel").distinct().join(s, "skel", "left").select("skel", F.coalesce("split", F.lit(0.0)).alias("split"))


def false_split_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(skel, u, v): label pairs that a skeleton joins."""
    return labelled_edges(nodes, edges).where("la <> lb").select("skel", F.least("la", "lb").alias("u"), F.greatest("la", "lb").alias("v")).distinct()


def _length(resolution: Sequence[float]) -> Column:
    d = [(F.col(f"a_{c}") - F.col(f"b_{c}")) * r for c, r in zip(AXES, resolution, strict=True)]
    return F.sqrt(sum((x * x for x in d), F.lit(0.0)))


def split_run_lengths(nodes: DataFrame, edges: DataFrame, resolution: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """(skel, label, length): length of a skeleton within each label it keeps along an edge."""
    e = labelled_edges(nodes, edges, coords=True).where("la = lb")
    return e.groupBy("skel", F.col("la").alias("label")).agg(F.sum(_length(resolution)).alias("length"))


def skeleton_lengths(nodes: DataFrame, edges: DataFrame, resolution: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """(skel, length) over all valid edges."""
    return labelled_edges(nodes, edges, coords=True).groupBy("skel").agg(F.sum(_length(resolution)).alias("length"))


def explicit_merges(nodes: DataFrame) -> DataFrame:
    """(label, n_skel): labels that more than one skeleton hits."""
    return nodes.where("label <> 0").groupBy("label").agg(F.countDistinct("skel").alias("n_skel")).where("n_skel > 1")


def merge_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(skel, merge, points): share of edges inside a merged label, and edges that enter or leave one."""
    m = explicit_merges(nodes).select("label", F.lit(True).alias("__m"))
    e = labelled_edges(nodes, edges).join(m.select(F.col("label").alias("la"), F.col("__m").alias("ma")), "la", "left").join(m.select(F.col("label").alias("lb"), F.col("__m").alias("mb")), "lb", "left")
    ma, mb = F.coalesce("ma", F.lit(False)), F.coalesce("mb", F.lit(False))
    inside = (F.col("la") == F.col("lb")) & ma
    point = (F.col("la") != F.col("lb")) & (ma | mb)
    return e.groupBy("skel").agg(F.avg(inside.cast("double")).alias("merge"), F.sum(point.cast("long")).alias("points"))


def edge_shares(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: shares of correct, split and merged edges over all skeletons, and merge points; a split counts before a merge."""
    m = explicit_merges(nodes).select("label", F.lit(True).alias("__m"))
    e = labelled_edges(nodes, edges).join(m.select(F.col("label").alias("la"), F.col("__m").alias("ma")), "la", "left").join(m.select(F.col("label").alias("lb"), F.col("__m").alias("mb")), "lb", "left")
    split = F.col("la") != F.col("lb")
    merged = ~split & F.coalesce("ma", F.lit(False))
    point = split & (F.coalesce("ma", F.lit(False)) | F.coalesce("mb", F.lit(False)))
    share = lambda c: F.avg(c.cast("double"))
    return e.agg(share(~split & ~merged).alias("correct"), share(split).alias("split"), share(merged).alias("merge"), F.sum(point.cast("long")).alias("points"))


def heuristic_merges(nodes: DataFrame, points: DataFrame, resolution: Sequence[float], max_distance: float) -> DataFrame:
    """Points (id, skel, coordinates) with no node of their skeleton within the distance.

    Both sides are dealt to cells of eight times the distance, and a point is copied to
    the other cells that it reaches, so the join is an equality with few copies.
    """
    side = 8.0 * max_distance
    cell = lambda c, r, d: F.floor((F.col(c) * r + d) / side).cast("long")
    p = points.select("id", "skel", *AXES)
    n = nodes.select("skel", *[F.col(c).alias(f"n_{c}") for c in AXES], *[cell(c, r, 0.0).alias(f"c{c}") for c, r in zip(AXES, resolution, strict=True)])
    for c, r in zip(AXES, resolution, strict=True):
        p = p.withColumn(f"c{c}", F.explode(F.sequence(cell(c, r, -max_distance), cell(c, r, max_distance))))
    d = sum((((F.col(c) - F.col(f"n_{c}")) * r) * ((F.col(c) - F.col(f"n_{c}")) * r) for c, r in zip(AXES, resolution, strict=True)), F.lit(0.0))
    near = p.join(n, ["skel", *[f"c{c}" for c in AXES]]).where(d <= max_distance**2).select("id").distinct()
    return points.join(near, "id", "left_anti")


def distance_statistics(nodes: DataFrame, boundary: DataFrame, resolution: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """(skel, label, mean, max): distances of nodes to the nearest boundary voxel of their label."""
    b = boundary.select("label", *[F.col(c).alias(f"b_{c}") for c in AXES])
    n = nodes.where("label <> 0").select("skel", "node", "label", *[F.col(c).alias(f"a_{c}") for c in AXES])
    # nodes at one place share their distance, so places meet the boundary, not nodes
    at = ["label", *[f"a_{c}" for c in AXES]]
    far = n.select(*at).distinct().join(b, "label").groupBy(*at).agg(F.min(_length(resolution)).alias("d"))
    near = n.join(far, at)
    return near.groupBy("skel", "label").agg(F.avg("d").alias("mean"), F.max("d").alias("max"))


def nodes_in_merges(nodes: DataFrame) -> DataFrame:
    """Nodes whose label other skeletons hit too."""
    return nodes.join(explicit_merges(nodes).select("label"), "label", "left_semi").select("skel", "node", "label")


def by_block(nodes: DataFrame, blocking) -> DataFrame:
    """(block_id, skel, n): nodes of each skeleton by block."""
    return nodes.groupBy(blocking.block_id([F.col(c) for c in AXES]).alias("block_id"), "skel").agg(F.count("*").alias("n"))
