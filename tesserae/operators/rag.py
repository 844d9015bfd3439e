"""Region graphs of label volumes: adjacency, slices, blocks, long range, boundary voxels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import Blocking, axes_of, boundary, contacts, offset_pairs


def region_graph(vox: DataFrame, ignore_label: bool = False) -> DataFrame:
    """Distinct pairs (u, v), u < v, of labels that share a face."""
    return boundary(vox, ignore_label).select("u", "v").distinct()


def region_nodes(vox: DataFrame, number_of_labels: int | None = None) -> DataFrame:
    """Labels as nodes; all of 0..n-1 where a number is given."""
    if number_of_labels is not None:
        return vox.sparkSession.range(number_of_labels).withColumnRenamed("id", "node")
    return vox.select(F.col("label").alias("node")).distinct()


def stacked_region_graph(vox: DataFrame, ignore_label: int | None = None) -> DataFrame:
    """(u, v, in_slice, z): edges within a slice, and between a slice and the next."""
    v = vox if ignore_label is None else vox.where(F.col("label") != ignore_label)
    b = boundary(v)
    return b.select("u", "v", (F.col("axis") != "z").alias("in_slice"), "z").distinct()


def slice_summary(vox: DataFrame) -> DataFrame:
    """Labels of each slice: z, min_label, max_label, n_nodes."""
    return vox.groupBy("z").agg(F.min("label").alias("min_label"), F.max("label").alias("max_label"), F.countDistinct("label").alias("n_nodes"))


def slice_edge_counts(edges: DataFrame) -> DataFrame:
    """Edges of each slice and to the next, with running offsets (one row a slice)."""
    n = edges.groupBy("z").agg(F.sum(F.col("in_slice").cast("long")).alias("n_in"), F.sum((~F.col("in_slice")).cast("long")).alias("n_between"))
    w = Window.orderBy("z").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = n.agg(F.sum("n_in").alias("t"))
    n = n.withColumn("in_offset", (F.sum("n_in").over(w) - F.col("n_in")).cast("long")).withColumn("between_offset", (F.sum("n_between").over(w) - F.col("n_between")).cast("long"))
    return n.crossJoin(F.broadcast(total)).withColumn("between_offset", (F.col("between_offset") + F.col("t")).cast("long")).drop("t")


def block_region_graph(vox: DataFrame, blocking: Blocking, ignore_label: bool = False) -> DataFrame:
    """(block_id, u, v): each contact belongs to the block of its upper voxel, so blocks see their lower faces."""
    own = axes_of(vox)
    b = boundary(vox, ignore_label)
    upper = [F.col(a) + (F.col("axis") == a).cast("int") for a in own]
    return b.select(blocking.block_id(upper).alias("block_id"), "u", "v").distinct()


def merge_subgraphs(blocks: DataFrame) -> DataFrame:
    """The edges of all blocks, each once."""
    return blocks.select("u", "v").distinct()


def map_edge_ids(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Block edges with their ids in the merged graph (u, v, edge_id)."""
    return blocks.join(edges.select("u", "v", "edge_id"), ["u", "v"])


def coarser_blocks(blocks: DataFrame, fine: Blocking, coarse: Blocking) -> DataFrame:
    """Block edges dealt anew to the blocks of a coarser tiling."""
    from .grid import node_to_coordinate

    pos = node_to_coordinate(F.col("block_id"), fine.per_axis)
    start = [p * b + o for p, b, o in zip(pos, fine.block, fine.begin, strict=True)]
    return blocks.select(coarse.block_id(start).alias("block_id"), "u", "v").distinct()


def long_range_adjacency(vox: DataFrame, long_range: int, ignore_label: bool = False) -> DataFrame:
    """(u, v, z, dz): labels 2..long_range slices apart at the same place; equal labels do not pair."""
    v = vox.where("label <> 0") if ignore_label else vox
    p = offset_pairs(v, [[k, 0, 0] for k in range(2, long_range + 1)], ("label",)).where("a_label <> b_label")
    return p.select(F.least("a_label", "b_label").alias("u"), F.greatest("a_label", "b_label").alias("v"), "z", (F.col("channel") + 2).cast("long").alias("dz")).distinct()


def lifted_edges(vox: DataFrame, edges: DataFrame, offsets: Sequence[Sequence[int]]) -> DataFrame:
    """Pairs of labels at the offsets that do not touch."""
    p = offset_pairs(vox, offsets, ("label",)).where("a_label <> b_label")
    pairs = p.select(F.least("a_label", "b_label").alias("u"), F.greatest("a_label", "b_label").alias("v")).distinct()
    return pairs.join(edges.select("u", "v"), ["u", "v"], "left_anti")


def edge_coordinates(vox: DataFrame) -> DataFrame:
    """(u, v, axis, coordinates, side): the voxels on either side of each edge."""
    own = axes_of(vox)
    c = contacts(vox, ("label",)).where("a_label <> b_label")
    u, v = F.least("a_label", "b_label"), F.greatest("a_label", "b_label")
    low = c.select(u.alias("u"), v.alias("v"), "axis", *own, F.col("a_label").alias("side"))
    high = c.select(u.alias("u"), v.alias("v"), "axis", *[(F.col(a) + (F.col("axis") == a).cast("int")).cast("long").alias(a) for a in own], F.col("b_label").alias("side"))
    return low.unionByName(high)


def topological_coordinates(vox: DataFrame) -> DataFrame:
    """(u, v, coordinates) of boundary faces on the doubled grid."""
    own = axes_of(vox)
    c = contacts(vox, ("label",)).where("a_label <> b_label")
    return c.select(F.least("a_label", "b_label").alias("u"), F.greatest("a_label", "b_label").alias("v"), *[(2 * F.col(a) + (F.col("axis") == a).cast("int")).cast("long").alias(a) for a in own])


def edge_lengths(vox: DataFrame) -> DataFrame:
    """(u, v, length): contacts of each edge."""
    return boundary(vox).groupBy("u", "v").agg(F.count("*").alias("length"))


def one_axis_edges(vox: DataFrame) -> DataFrame:
    """(u, v, kind): 1 where all contacts lie along one axis, else 2."""
    return boundary(vox).groupBy("u", "v").agg(F.when(F.countDistinct("axis") == 1, 1).otherwise(2).cast("long").alias("kind"))


def block_boundary_edges(vox: DataFrame, blocking: Blocking) -> DataFrame:
    """Edges with a contact that crosses a block face."""
    own = axes_of(vox)
    b = boundary(vox)
    upper = [F.col(a) + (F.col("axis") == a).cast("int") for a in own]
    return b.where(blocking.block_id([F.col(a) for a in own]) != blocking.block_id(upper)).select("u", "v").distinct()


def z_extended(vox: DataFrame) -> DataFrame:
    """Labels that span more than one slice."""
    return vox.groupBy("label").agg(F.countDistinct("z").alias("n")).where("n > 1").select(F.col("label").alias("node"))


def skip_edges(vox: DataFrame, defects: Sequence[int]) -> DataFrame:
    """(u, v, z, dz, length) across defective slices: each good slice and the next good one above a gap."""
    bad = list(defects)
    good = vox.where(~F.col("z").isin(bad)) if bad else vox
    w = Window.partitionBy("y", "x").orderBy("z")
    p = good.select("z", F.col("label").alias("a"), F.lead("label").over(w).alias("b"), (F.lead("z").over(w) - F.col("z")).alias("dz")).where("dz > 1 and a <> b")
    return p.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "z", "dz").agg(F.count("*").alias("length"))


def edges_to_volume(vox: DataFrame, edges: DataFrame, value: str = "w", fill: float = 0.0) -> DataFrame:
    """Every voxel with the value of an edge it borders; of several, that of the largest (u, v) is painted last."""
    own = axes_of(vox)
    painted = edge_coordinates(vox).join(edges.select("u", "v", value), ["u", "v"]).groupBy(*own).agg(F.max_by(value, F.struct("u", "v")).alias("__w"))
    return vox.select(*own).join(painted, list(own), "left").select(*own, F.coalesce("__w", F.lit(fill)).alias(value))


def nodes_to_blocks(vox: DataFrame, blocking: Blocking, halo: Sequence[int]) -> DataFrame:
    """(block_id, label): labels in each block with its halo."""
    return blocking.with_halo(vox, halo).select("block_id", "label").distinct()


def block_mapping(vox: DataFrame, blocking: Blocking) -> DataFrame:
    """(label, begin/end of boxes): blocks that hold a label, adjacent ones along the last axis joined into boxes."""
    from .grid import node_to_coordinate

    own = axes_of(vox)
    d = vox.select("label", blocking.block_id([F.col(a) for a in own]).alias("b")).distinct()
    pos = node_to_coordinate(F.col("b"), blocking.per_axis)
    d = d.select("label", *[p.alias(f"p{k}") for k, p in enumerate(pos)])
    last = len(own) - 1
    lead = [f"p{k}" for k in range(last)]
    w = Window.partitionBy("label", *lead).orderBy(f"p{last}")
    d = d.withColumn("g", F.col(f"p{last}") - F.row_number().over(w))
    boxes = d.groupBy("label", *lead, "g").agg(F.min(f"p{last}").alias("lo"), F.max(f"p{last}").alias("hi"))
    cols = [F.col("label")]
    for k in range(last):
        cols += [(F.col(f"p{k}") * blocking.block[k] + blocking.begin[k]).alias(f"begin{k}"), F.least((F.col(f"p{k}") + 1) * blocking.block[k] + blocking.begin[k], F.lit(blocking.end[k])).alias(f"end{k}")]
    cols += [(F.col("lo") * blocking.block[last] + blocking.begin[last]).alias(f"begin{last}"), F.least((F.col("hi") + 1) * blocking.block[last] + blocking.begin[last], F.lit(blocking.end[last])).alias(f"end{last}")]
    return boxes.select(*cols)
