"""Comparing and combining partitions: overlaps, Rand, information, votes, edge mapping, objectives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import axes_of
from .lookup import make_dense, with_node_values


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, cnt): voxels of each pair of labels of two volumes on the same grid."""
    own = list(axes_of(a))
    return a.select(*own, F.col("label").alias("a")).join(b.select(*own, F.col("label").alias("b")), own).groupBy("a", "b").agg(F.count("*").alias("cnt"))


def overlap_lists(ov: DataFrame) -> DataFrame:
    """(a, b, cnt, rank, share): overlaps of each label by falling count, with their share of the label."""
    w = Window.partitionBy("a")
    return ov.select("a", "b", "cnt", F.row_number().over(w.orderBy(F.desc("cnt"), "b")).cast("long").alias("rank"), (F.col("cnt") / F.sum("cnt").over(w)).alias("share"))


def different_overlap(pairs: DataFrame, ov: DataFrame) -> DataFrame:
    """(u, v, different): probability that two draws, one from u and one from v, fall on different labels."""
    p = overlap_lists(ov).select("a", "b", "share")
    pu, pv = p.select(F.col("a").alias("u"), "b", F.col("share").alias("su")), p.select(F.col("a").alias("v"), "b", F.col("share").alias("sv"))
    same = pairs.join(pu, "u").join(pv, ["v", "b"]).groupBy("u", "v").agg(F.sum(F.col("su") * F.col("sv")).alias("s"))
    return pairs.join(same, ["u", "v"], "left").select("u", "v", (1 - F.coalesce("s", F.lit(0.0))).alias("different"))


def bleeding(ov: DataFrame) -> DataFrame:
    """(a, bleeding): largest overlap over size."""
    return ov.groupBy("a").agg((F.max("cnt") / F.sum("cnt")).alias("bleeding"))


def max_overlap(ov: DataFrame, ignore: int | None = None, downvote: int | None = None) -> DataFrame:
    """(a, label, cnt): the commonest label; the smallest of ties. `ignore` is left out; `downvote` loses to any other."""
    o = ov if ignore is None else ov.where(F.col("b") != ignore)
    good = F.lit(0) if downvote is None else (F.col("b") != downvote).cast("int")
    best = F.max_by(F.struct("b", "cnt"), F.struct(good, F.col("cnt"), (-F.col("b")).alias("n")))
    return o.groupBy("a").agg(best.alias("m")).select("a", F.col("m.b").alias("label"), F.col("m.cnt").alias("cnt"))


def overlaps_zero(ov: DataFrame) -> DataFrame:
    """(a, zero): whether a label meets label 0."""
    return ov.groupBy("a").agg(F.max((F.col("b") == 0).cast("int")).cast("boolean").alias("zero"))


def merge_overlaps(parts: DataFrame, labels: DataFrame | None = None, ignore: int = 0) -> DataFrame:
    """Largest overlaps from those of blocks; a label of the range without any gets (ignore, 0)."""
    out = max_overlap(parts.groupBy("a", "b").agg(F.sum("cnt").alias("cnt")))
    if labels is None:
        return out
    return labels.select(F.col("label").alias("a")).join(out, "a", "left").select("a", F.coalesce("label", F.lit(ignore)).alias("label"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def rand_error(ov: DataFrame, ignore_zero: bool = False) -> DataFrame:
    """One row: joins and cuts, right and wrong, precision, recall, index and error of b against a."""
    o = ov.where("a <> 0 and b <> 0") if ignore_zero else ov
    n = F.col("cnt").cast("double")
    pairs = lambda s: s * (s - 1) / 2
    cells = o.agg(F.sum(n).alias("n"), F.sum(pairs(n)).alias("tt"))
    truth = o.groupBy("a").agg(F.sum("cnt").cast("double").alias("s")).agg(F.sum(pairs(F.col("s"))).alias("ta"))
    pred = o.groupBy("b").agg(F.sum("cnt").cast("double").alias("s")).agg(F.sum(pairs(F.col("s"))).alias("tb"))
    j = cells.crossJoin(truth).crossJoin(pred)
    total = pairs(F.col("n"))
    tj, fj, fc = F.col("tt"), F.col("tb") - F.col("tt"), F.col("ta") - F.col("tt")
    tc = total - tj - fj - fc
    return j.select(tj.alias("true_joins"), tc.alias("true_cuts"), fj.alias("false_joins"), fc.alias("false_cuts"), (tj / F.col("tb")).alias("join_precision"), (tj / F.col("ta")).alias("join_recall"), (tc / (tc + fc)).alias("cut_precision"), (tc / (tc + fj)).alias("cut_recall"), ((tj + tc) / total).alias("rand_index"), ((fj + fc) / total).alias("rand_error"))


def variation_of_information(ov: DataFrame, ignore_zero: bool = False) -> DataFrame:
    """One row: vi, vi_false_cut = H(b) - I, vi_false_join = H(a) - I, in bits."""
    o = ov.where("a <> 0 and b <> 0") if ignore_zero else ov
    n = o.agg(F.sum("cnt").cast("double").alias("n"))

    def entropy(d: DataFrame, name: str) -> DataFrame:
        p = F.col("s") / F.col("n")
        return d.crossJoin(F.broadcast(n)).agg(F.sum(-p * F.log2(p)).alias(name))

    ha = entropy(o.groupBy("a").agg(F.sum("cnt").alias("s")), "ha")
    hb = entropy(o.groupBy("b").agg(F.sum("cnt").alias("s")), "hb")
    hab = entropy(o.select(F.col("cnt").alias("s")), "hab")
    j = ha.crossJoin(hb).crossJoin(hab)
    i = F.col("ha") + F.col("hb") - F.col("hab")
    return j.select((F.col("ha") + F.col("hb") - 2 * i).alias("vi"), (F.col("hb") - i).alias("vi_false_cut"), (F.col("ha") - i).alias("vi_false_join"))


def merge_votes(votes: DataFrame, weighted: bool = False) -> DataFrame:
    """(u, v, merges, total): summed indicators (times size) and counts (or sizes) of pairs; not normalised."""
    w = F.col("size") if weighted else F.lit(1)
    return votes.groupBy("u", "v").agg(F.sum(F.col("indicator") * w).cast("long").alias("merges"), F.sum(w).cast("long").alias("total"))


def merge_merged_votes(votes: DataFrame) -> DataFrame:
    return votes.groupBy("u", "v").agg(F.sum("merges").alias("merges"), F.sum("total").alias("total"))


def contract_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with nu < nv, the labels of their ends; null where both ends share one."""
    j = with_node_values(edges, labels, "label")
    inside = F.col("label_u") == F.col("label_v")
    return j.withColumn("nu", F.when(~inside, F.least("label_u", "label_v"))).withColumn("nv", F.when(~inside, F.greatest("label_u", "label_v"))).drop("label_u", "label_v")


def edge_mapping(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new edges nu, nv, edge_id, n; old edges u, v, edge_id with -1 inside a label)."""
    from .lookup import with_edge_ids

    c = contract_edges(edges, labels)
    new = c.where("nu is not null").groupBy("nu", "nv").agg(F.count("*").alias("n"))
    new = with_edge_ids(new.select(F.col("nu").alias("u"), F.col("nv").alias("v"), "n")).select(F.col("u").alias("nu"), F.col("v").alias("nv"), "edge_id", "n")
    old = c.join(new.select("nu", "nv", "edge_id"), ["nu", "nv"], "left").select("u", "v", F.coalesce("edge_id", F.lit(-1)).cast("long").alias("edge_id"))
    return new, old


REDUCE = {
    "sum": lambda v, w: F.sum(v),
    "mean": lambda v, w: F.sum(w * v) / F.sum(w),
    "min": lambda v, w: F.min(v),
    "max": lambda v, w: F.max(v),
    "abs_max": lambda v, w: F.max_by(v, F.struct(F.abs(v), -v)),
    "gmean2": lambda v, w: F.sqrt(F.sum(w * v * v) / F.sum(w)),
}


def map_edge_values(edges: DataFrame, labels: DataFrame, how: str = "mean", value: str = "w", weight: str | None = None) -> DataFrame:
    """(nu, nv, value): values of parallel edges after contraction, reduced by one of REDUCE."""
    c = contract_edges(edges, labels).where("nu is not null")
    return c.groupBy("nu", "nv").agg(REDUCE[how](F.col(value), F.col(weight) if weight else F.lit(1.0)).alias(value))


def relabel_consecutive(labels: DataFrame) -> DataFrame:
    """(node, label) with labels numbered from 0 in ascending order."""
    d = make_dense(labels.select("label"))
    return labels.join(d, "label").select("node", F.col("dense").alias("label"))


def multicut_energy(edges: DataFrame, labels: DataFrame, value: str = "w") -> DataFrame:
    """One row: energy, the sum of weights of cut edges."""
    j = with_node_values(edges, labels, "label")
    return j.agg(F.coalesce(F.sum(F.when(F.col("label_u") != F.col("label_v"), F.col(value)).otherwise(0.0)), F.lit(0.0)).alias("energy"))


def pixel_wise_energy(vox: DataFrame, weights: DataFrame, offsets) -> DataFrame:
    """One row: energy of a pixel labeling, the sum of weights (channel, coordinates, value) of pairs it separates."""
    from .features import affinity_samples

    s = affinity_samples(vox, weights, offsets).where("u <> v")
    return s.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("energy"))


def st_cut_energy(edges: DataFrame, unaries: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: cut weights plus the unary cost of each node's label (0 or 1, else an error)."""
    bad = F.when(~F.col("label").isin(0, 1), F.raise_error(F.lit("labels must be 0 or 1")).cast("double"))
    cost = F.coalesce(bad, F.when(F.col("label") == 0, F.col("c0")).otherwise(F.col("c1")))
    u = unaries.join(labels, "node").agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("unary"))
    return multicut_energy(edges, labels).crossJoin(u).select((F.col("energy") + F.col("unary")).alias("energy"))


def downsample_multiset(vox: DataFrame, block: int, keep: int) -> DataFrame:
    """(block coordinates, label, cnt): the `keep` commonest labels of each block of voxels; smaller labels first of ties."""
    own = axes_of(vox)
    cells = [F.floor(F.col(a) / block).cast("long").alias(f"b{a}") for a in own]
    c = vox.groupBy(*cells, "label").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy(*[f"b{a}" for a in own]).orderBy(F.desc("cnt"), "label")
    return c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep).drop("k")


def multiset_argmax(multi: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label): the commonest label of each multiset, the smallest of ties."""
    return multi.groupBy(*keys).agg(F.max_by("label", F.struct("cnt", -F.col("label"))).alias("label"))


def multiset_groups(multi: DataFrame, keys: list[str]) -> DataFrame:
    """(group, entries, n): distinct multisets, numbered, with how many blocks share each."""
    e = multi.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", "cnt"))).alias("entries"))
    g = e.groupBy("entries").agg(F.count("*").alias("n"))
    return g.select(F.xxhash64("entries").alias("group"), "entries", "n")
