"""Graph algorithms on edge tables (u, v, ...): components, searches, paths, cycles, lifted neighbourhoods.

Iterations are joins of a frontier with the edges. Every round is materialised and
stops on a fixed point; minima are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import drop, keep
from .lookup import make_dense, symmetric, with_node_values


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): component is the smallest node reachable; isolated nodes are their own.

    Large-star and small-star contraction (Kiveris et al. 2014): rounds grow with the
    logarithm of the longest chain.
    """
    own = edges.select(F.explode(F.array("u", "v")).alias("node"))
    own = (own if nodes is None else own.union(nodes.select("node"))).distinct()
    e = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        new = keep(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        drop(e)
        e = new
        if now == mark:
            break
        mark = now
    return own.join(e.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def components_from_node_labels(edges: DataFrame, labels: DataFrame, dense: bool = False, ignore_background: bool = False) -> DataFrame:
    """Components of edges whose ends share a label; dense ids start at 0, or at 1 with the background as 0."""
    fg = labels.where("label <> 0") if ignore_background else labels
    same = with_node_values(edges.select("u", "v"), fg, "label").where("label_u = label_v").select("u", "v")
    out = connected_components(same, fg.select("node"))
    if dense:
        ids = make_dense(out, "component")
        out = out.join(ids, "component").select("node", (F.col("dense") + (1 if ignore_background else 0)).alias("component"))
    if ignore_background:
        zero = labels.where("label = 0").select("node", F.lit(0).cast("long").alias("component"))
        out = out.union(zero)
    return out


def components_from_edge_labels(edges: DataFrame, cut: str = "cut") -> DataFrame:
    """Components over edges that are not cut."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return connected_components(edges.where(~F.col(cut)), nodes)


def union_find(pairs: DataFrame, size: int | None = None) -> DataFrame:
    """(node, root) after merging pairs (a, b); with a size, of all elements below it."""
    nodes = pairs.sparkSession.range(size).withColumnRenamed("id", "node") if size is not None else None
    return connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), nodes).select("node", F.col("component").alias("root"))


def sets_of(labels: DataFrame) -> DataFrame:
    """(root, members): the elements of each set, in order."""
    return labels.groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("members"))


def distances(edges: DataFrame, sources: DataFrame, max_distance: int | None = None) -> DataFrame:
    """(source, node, hops): breadth-first distances from each source, within a bound if given."""
    nb = keep(symmetric(edges).distinct())
    found = keep(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")).distinct())
    hops = 0
    while max_distance is None or hops < max_distance:
        step = found.where(F.col("hops") == hops).join(nb, "node").select("source", F.col("neighbor").alias("node")).distinct()
        step = keep(step.join(found, ["source", "node"], "left_anti").select("source", "node", F.lit(hops + 1).alias("hops")))
        if step.isEmpty():
            break
        new = keep(found.union(step))
        drop(found)
        drop(step)
        found = new
        hops += 1
    return found


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def pairs_within(edges: DataFrame, max_distance: int, exact: bool = False) -> DataFrame:
    """(u, v, hops), u < v: pairs of nodes within so many hops, or exactly so many."""
    d = distances(edges, nodes_of(edges), max_distance).where("source < node")
    d = d.where(F.col("hops") == max_distance) if exact else d
    return d.select(F.col("source").alias("u"), F.col("node").alias("v"), F.col("hops").cast("long").alias("hops"))


def lifted_neighborhood(edges: DataFrame, max_distance: int) -> DataFrame:
    """Pairs at 2 to max_distance hops."""
    return pairs_within(edges, max_distance).where("hops >= 2")


def lifted_from_node(edges: DataFrame, node: int, max_distance: int) -> DataFrame:
    """(u, v, hops): pairs of a node with those at 2 to max_distance hops."""
    source = edges.sparkSession.createDataFrame([(node,)], "node long")
    d = distances(edges, source, max_distance).where("hops >= 2")
    return d.select(F.least("source", "node").alias("u"), F.greatest("source", "node").alias("v"), F.col("hops").cast("long").alias("hops"))


def lifted_from_labels(edges: DataFrame, labels: DataFrame, max_distance: int, mode: str = "all", ignore_label: int = 0) -> DataFrame:
    """Lifted pairs whose ends are both labelled; of the same or different labels only, by mode."""
    j = with_node_values(lifted_neighborhood(edges, max_distance), labels.where(F.col("label") != ignore_label), "label")
    keep_ = {"all": F.lit(True), "same": F.col("label_u") == F.col("label_v"), "different": F.col("label_u") != F.col("label_v")}[mode]
    return j.where(keep_).select("u", "v", "hops")


def shortest_distances(edges: DataFrame, sources: DataFrame, weight: str = "w", targets: DataFrame | None = None) -> DataFrame:
    """(source, node, dist, previous): least path weights from each source by relaxation; weights must not be negative.

    Only improved nodes are relaxed in a round. `previous` is the node before, the
    smallest of ties, and null at the source.
    """
    nb = keep(symmetric(edges, F.col(weight).alias("w")).groupBy("node", "neighbor").agg(F.min("w").alias("w")))
    best = keep(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("previous"), F.lit(True).alias("fresh")).distinct())
    while True:
        step = best.where("fresh").join(nb, "node").select("source", F.col("neighbor").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("node").alias("previous"), F.lit(True).alias("fresh"))
        every = best.withColumn("fresh", F.lit(False)).union(step)
        pick = F.min(F.struct("dist", "fresh", "previous"))
        new = keep(every.groupBy("source", "node").agg(pick.alias("m")).select("source", "node", "m.dist", "m.previous", "m.fresh"))
        drop(best)
        best = new
        if best.where("fresh").isEmpty():
            break
    out = best.select("source", "node", "dist", "previous")
    return out if targets is None else out.join(targets.select("node").distinct(), "node", "left_semi").select("source", "node", "dist", "previous")


def shortest_paths(edges: DataFrame, pairs: DataFrame, weight: str = "w") -> DataFrame:
    """(source, target, path, dist): nodes from target back to source; an empty path and null where unreachable."""
    reach = keep(shortest_distances(edges, pairs.select(F.col("source").alias("node")).distinct(), weight))
    goal = pairs.select("source", "target").distinct()
    found = reach.select("source", F.col("node").alias("target"), "dist")
    open_ = keep(goal.join(found, ["source", "target"], "left").select("source", "target", "dist", F.when(F.col("dist").isNotNull(), F.array("target")).otherwise(F.array().cast("array<bigint>")).alias("path")))
    step = reach.select("source", F.col("node").alias("last"), F.col("previous").alias("before"))
    while True:
        nxt = open_.withColumn("last", F.try_element_at("path", F.lit(-1))).join(step, ["source", "last"], "left")
        new = keep(nxt.select("source", "target", "dist", F.when(F.col("before").isNotNull(), F.concat("path", F.array("before"))).otherwise(F.col("path")).alias("path"), F.col("before").isNotNull().alias("more")))
        drop(open_)
        open_ = new.drop("more")
        if new.where("more").isEmpty():
            return open_.select("source", "target", "path", "dist")
        open_.kept_at = new.kept_at


def bellman_ford(arcs: DataFrame, source: int) -> DataFrame:
    """(node, dist) over directed arcs (src, dst, w); raises on a negative cycle that the source reaches."""
    spark = arcs.sparkSession
    n = arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    dist = keep(spark.createDataFrame([(source, 0.0)], "node long, dist double"))
    for k in range(n + 1):
        step = arcs.join(dist, arcs.src == dist.node).select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        new = keep(dist.union(step).groupBy("node").agg(F.min("dist").alias("dist")))
        changed = not new.join(dist.withColumnRenamed("dist", "was"), "node", "left").where("was is null or dist < was").isEmpty()
        drop(dist)
        dist = new
        if not changed:
            return dist
        if k == n:
            raise ValueError("the graph has a negative cycle")
    return dist


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: triples of mutually adjacent nodes.

    Edges are directed from the end of lower degree, so a hub's list is never paired with itself.
    """
    e = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    deg = symmetric(e).groupBy("node").agg(F.count("*").alias("d"))
    d = e.join(deg.select(F.col("node").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("node").alias("v"), F.col("d").alias("dv")), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    arc = d.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("t"))
    wedge = arc.select("s", F.col("t").alias("t1")).join(arc.select("s", F.col("t").alias("t2")), "s").where("t1 < t2")
    closed = wedge.join(e.select(F.col("u").alias("t1"), F.col("v").alias("t2")), ["t1", "t2"])
    s = F.array_sort(F.array("s", "t1", "t2"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def chords(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, u, v): edges between nodes of a path that are not next to each other on it; paths are (path_id, position, node)."""
    p = paths.select("path_id", F.col("position").alias("i"), F.col("node").alias("u"))
    q = paths.select(F.col("path_id").alias("__p"), F.col("position").alias("j"), F.col("node").alias("v"))
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    j = e.join(p, "u").join(q, "v").where("path_id = __p and abs(i - j) > 1")
    return j.select("path_id", "u", "v").distinct()


def label_propagation(edges: DataFrame, rounds: int = 10, weight: str | None = None, size_limit: int | None = None) -> DataFrame:
    """(node, label) by synchronous label propagation, the smallest label of ties.

    A node keeps its label unless another's summed weight is positive and larger; labels
    of size_limit nodes or more take no more. In odd rounds only nodes of odd id move, and
    in even ones those of even id, so two nodes do not swap for ever.
    """
    nb = keep(symmetric(edges, (F.col(weight) if weight else F.lit(1.0)).alias("w")))
    labels = keep(nodes_of(edges).select("node", F.col("node").alias("label")))
    for k in range(rounds):
        score = nb.join(labels.withColumnRenamed("node", "neighbor"), "neighbor").groupBy("node", "label").agg(F.sum("w").alias("s"))
        j = score.join(labels.select("node", F.col("label").alias("own")), "node")
        if size_limit is not None:
            size = labels.groupBy("label").agg(F.count("*").alias("n"))
            j = j.join(size, "label").where(F.col("n") - (F.col("label") == F.col("own")).cast("int") < size_limit)
        j = j.where("s > 0")
        best = j.groupBy("node").agg(F.max_by("label", F.struct("s", (F.col("label") == F.col("own")).alias("o"), (-F.col("label")).alias("l"))).alias("new"))
        moved = labels.join(best, "node", "left").select("node", F.when(F.col("node") % 2 == k % 2, F.coalesce("new", "label")).otherwise(F.col("label")).alias("label"))
        new = keep(moved)
        drop(labels)
        labels = new
    return labels


def contract(edges: DataFrame, labels: DataFrame, value: str = "w") -> DataFrame:
    """The graph of labels: parallel edges' weights are summed, inner edges go."""
    j = with_node_values(edges, labels, "label").where("label_u <> label_v")
    return j.groupBy(F.least("label_u", "label_v").alias("u"), F.greatest("label_u", "label_v").alias("v")).agg(F.sum(value).alias(value))


def random_graph(spark, nodes: int, edges: int, seed: int = 0) -> DataFrame:
    """At most `edges` random distinct edges on 0..nodes-1, the same for a seed."""
    r = spark.range(edges).select(F.floor(F.rand(seed) * nodes).cast("long").alias("a"), F.floor(F.rand(seed + 1) * nodes).cast("long").alias("b"))
    return r.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def spanning_forest(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Minimum spanning forest (u, v, w) by Boruvka rounds: every component takes its lightest outgoing edge."""
    e = keep(edges.select("u", "v", F.col(weight).alias("w")))
    labels = keep(nodes_of(e).select("node", F.col("node").alias("label")))
    forest = None
    while True:
        j = with_node_values(e, labels, "label").where("label_u <> label_v")
        out = j.select(F.explode(F.array("label_u", "label_v")).alias("label"), "u", "v", "w")
        pick = keep(out.groupBy("label").agg(F.min(F.struct("w", "u", "v")).alias("m")).select("m.u", "m.v", "m.w").distinct())
        if pick.isEmpty():
            return forest if forest is not None else e.where("false")
        forest = pick if forest is None else keep(forest.union(pick))
        comp = connected_components(forest, labels.select("node"))
        new = keep(comp.select("node", F.col("component").alias("label")))
        drop(labels)
        labels = new


def slice_ranks(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows numbered from 0 within a key."""
    return df.withColumn("rank", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
