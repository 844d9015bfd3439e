"""Lookups: labels to values, edges to ids, subgraphs, dense relabeling, run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def take(values: DataFrame, relabeling: DataFrame, column: str = "label") -> DataFrame:
    """values with `column` replaced by relabeling(node, label); rows without an entry go."""
    r = relabeling.select(F.col("node").alias(column), F.col("label").alias("__new"))
    return values.join(r, column).drop(column).withColumnRenamed("__new", column)


def take_dict(values: DataFrame, relabeling: DataFrame, column: str = "label") -> DataFrame:
    """As `take`, but a missing key raises an error."""
    r = relabeling.select(F.col("node").alias(column), F.col("label").alias("__new"))
    out = values.join(r, column, "left")
    found = F.coalesce("__new", F.raise_error(F.concat(F.lit("no entry for label "), F.col(column).cast("string"))).cast("long"))
    return out.withColumn("__new", found).drop(column).withColumnRenamed("__new", column)


def map_features(vox: DataFrame, features: DataFrame, ignore_label: int = -1, fill_value: float = 0.0) -> DataFrame:
    """vox with column `feature` of its label; the ignored label and those out of range get the fill value."""
    f = features.where(F.col("node") != ignore_label).select(F.col("node").alias("label"), "feature")
    return vox.join(f, "label", "left").withColumn("feature", F.coalesce("feature", F.lit(float(fill_value))))


def inflate(labeling: DataFrame, max_value: int, fill_value: int = 0) -> DataFrame:
    """A sparse labeling (node, label) as a dense one over 0..max_value."""
    full = labeling.sparkSession.range(max_value + 1).withColumnRenamed("id", "node")
    return full.join(labeling, "node", "left").select("node", F.coalesce("label", F.lit(fill_value)).alias("label"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Node labeling second(first(node))."""
    s = second.select(F.col("node").alias("label"), F.col("label").alias("__new"))
    return first.join(s, "label").select("node", F.col("__new").alias("label"))


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Edges with edge_id, the rank of (u, v), without a window over the whole table.

    Rows are range-partitioned by (u, v); each partition numbers its own after the
    counts of those before it (one number a partition).
    """
    ranged = edges.repartitionByRange("u", "v").sortWithinPartitions("u", "v").withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    parts = ranged.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__p", "first", before.alias("before"))
    out = ranged.join(F.broadcast(parts), "__p")
    return out.withColumn("edge_id", (F.col("before") + F.col("__m") - F.col("first")).cast("long")).drop("__p", "__m", "first", "before")


def find_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (a, b) with edge_id of edges (u, v, edge_id), -1 where there is none."""
    e = edges.select(F.col("u").alias("__u"), F.col("v").alias("__v"), "edge_id")
    hit = (F.least("a", "b") == F.col("__u")) & (F.greatest("a", "b") == F.col("__v"))
    return pairs.join(e, hit, "left").select("a", "b", F.coalesce("edge_id", F.lit(-1)).cast("long").alias("edge_id"))


def symmetric(edges: DataFrame, *columns: str) -> DataFrame:
    """Both orientations of edges as (node, neighbor, columns)."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("neighbor"), *columns).union(edges.select(F.col("v").alias("node"), F.col("u").alias("neighbor"), *columns))


def neighborhoods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, neighbor) for the nodes of a list."""
    return symmetric(edges).join(nodes.select("node").distinct(), "node", "left_semi")


def graph_counts(edges: DataFrame) -> DataFrame:
    """One row: numbers of nodes and edges, and the largest node."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return nodes.agg(F.countDistinct("node").alias("n_nodes"), F.max("node").alias("max_node"), (F.count("*") / 2).cast("long").alias("n_edges"))


def subgraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inner edges with both ends in nodes, outer edges with one)."""
    n = nodes.select("node").distinct().withColumn("__in", F.lit(1))
    e = edges.join(n.select(F.col("node").alias("u"), F.col("__in").alias("__iu")), "u", "left").join(n.select(F.col("node").alias("v"), F.col("__in").alias("__iv")), "v", "left")
    ends = F.coalesce("__iu", F.lit(0)) + F.coalesce("__iv", F.lit(0))
    keep = edges.columns
    return e.where(ends == 2).select(*keep), e.where(ends == 1).select(*keep)


def edges_from_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in a node list."""
    return subgraph(nodes, edges)[0]


def make_dense(values: DataFrame, column: str = "label") -> DataFrame:
    """(column, dense): distinct values numbered from 0 in ascending order."""
    ids = values.select(F.col(column).alias("u"), F.lit(0).alias("v")).distinct()
    return with_edge_ids(ids).select(F.col("u").alias(column), F.col("edge_id").alias("dense"))


def run_lengths(bits: DataFrame, key: str, order: str, bit: str = "bit") -> DataFrame:
    """Run lengths (key, run, length) of a binary vector for each key; run 0 counts zeros, and is 0 where a one leads."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.lag(bit).over(w) == F.col(bit), 0).otherwise(1)
    g = bits.withColumn("__g", change).withColumn("__g", F.sum("__g").over(w) - 1)
    first = F.first(bit).over(Window.partitionBy(key).orderBy(order))
    g = g.withColumn("run", (F.col("__g") + F.when(first == 1, 1).otherwise(0)).cast("long"))
    runs = g.groupBy(key, "run").agg(F.count("*").alias("length"))
    lead = bits.withColumn("__r", F.row_number().over(w)).where(f"__r = 1 and {bit} = 1").select(key, F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("length"))
    return runs.union(lead)


def node_to_edge_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with `cut`: whether the labels of the ends differ."""
    return with_node_values(edges, labels, "label").withColumn("cut", F.col("label_u") != F.col("label_v")).drop("label_u", "label_v")


def with_node_values(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Edges with value_u and value_v from nodes(node, value)."""
    out = edges.join(nodes.select(F.col("node").alias("u"), F.col(value).alias(f"{value}_u")), "u")
    return out.join(nodes.select(F.col("node").alias("v"), F.col(value).alias(f"{value}_v")), "v")


def edge_map_from_nodes(edges: DataFrame, nodes: DataFrame, value: str, f) -> DataFrame:
    """Edges with w = f(value of u, value of v)."""
    out = with_node_values(edges, nodes, value)
    return out.withColumn("w", f(F.col(f"{value}_u"), F.col(f"{value}_v"))).drop(f"{value}_u", f"{value}_v")


def foreground(df: DataFrame, column: str = "label", ignore_label: int = 0) -> DataFrame:
    """Rows whose label is not ignored."""
    return df.where(F.col(column) != ignore_label)


def probability_from_affinities(aff: DataFrame, edge_format: int = 1) -> DataFrame:
    """(y, x, value): boundary probability of a pixel from its two affinity channels (ay, ax) and its neighbours'."""
    up = F.lag("ay").over(Window.partitionBy("x").orderBy("y"))
    left = F.lag("ax").over(Window.partitionBy("y").orderBy("x"))
    if edge_format == -1:
        up = F.lead("ay").over(Window.partitionBy("x").orderBy("y"))
        left = F.lead("ax").over(Window.partitionBy("y").orderBy("x"))
    zero = F.lit(0.0)
    value: Column = (F.col("ay") + F.col("ax") + F.coalesce(up, zero) + F.coalesce(left, zero)) / 4
    return aff.select("y", "x", value.alias("value"))
