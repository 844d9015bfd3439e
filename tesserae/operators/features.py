"""Statistics of region-graph edges and nodes, in one pass and mergeable by block.

All of them are grouped aggregates with partial sums, so a label next to everything
(background) is combined map-side and no task gathers its contacts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import histogram
from .grid import Blocking, axes_of, boundary, offset_pairs

#: Order of the standard features.
STANDARD = ("mean", "variance", "min", "q10", "q25", "q50", "q75", "q90", "max", "count")


def boundary_samples(vox: DataFrame, side: int = 0, ignore_label: bool = False, axes: Sequence[str] | None = None) -> DataFrame:
    """(u, v, value): both values of each contact, or those on the lower or higher side (side 1, 2)."""
    b = boundary(vox, ignore_label, axes)
    values = {0: F.array("vu", "vv"), 1: F.array("vu"), 2: F.array("vv")}[side]
    return b.select("u", "v", F.explode(values).alias("value"))


def mean_and_length(samples: DataFrame, keys: Sequence[str] = ("u", "v")) -> DataFrame:
    """(keys, mean, count) of samples."""
    return samples.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("*").alias("count"))


def node_mean_and_length(vox: DataFrame) -> DataFrame:
    return mean_and_length(vox.select(F.col("label").alias("node"), "value"), ("node",))


def moments(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mean, variance, min, max, count); variance is that of the population."""
    return samples.groupBy(*keys).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count"))


def standard_features(samples: DataFrame, keys: Sequence[str], low: float, high: float, bins: int = histogram.BINS) -> DataFrame:
    """The STANDARD features of each group; quantiles are those of an interpolated histogram."""
    keys = list(keys)
    q = histogram.fill(samples, keys, "value", low, high, bins)
    names = ("q10", "q25", "q50", "q75", "q90")
    q = q.select(*keys, *[histogram.quantile(F.col("hist"), r, low, high, bins).alias(n) for n, r in zip(names, histogram.QUANTILES, strict=True)])
    return moments(samples, keys).join(q, keys).select(*keys, *STANDARD)


def merge_features(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Standard features of groups from those of blocks: pooled moments, and quantiles averaged by count."""
    n = F.col("count")
    total = F.sum(n)
    mean = F.sum(n * F.col("mean")) / total
    out = [mean.alias("mean"), (F.sum(n * (F.col("variance") + F.col("mean") * F.col("mean"))) / total - mean * mean).alias("variance"), F.min("min").alias("min")]
    out += [(F.sum(n * F.col(q)) / total).alias(q) for q in STANDARD if q.startswith("q") and q in blocks.columns]
    return blocks.groupBy(*keys).agg(*out, F.max("max").alias("max"), total.alias("count"))


def block_features(vox: DataFrame, blocking: Blocking) -> DataFrame:
    """Moments of edges by block (of the upper voxel of a contact): block_id, u, v, ..."""
    own = axes_of(vox)
    b = boundary(vox)
    upper = [F.col(a) + (F.col("axis") == a).cast("int") for a in own]
    s = b.select(blocking.block_id(upper).alias("block_id"), "u", "v", F.explode(F.array("vu", "vv")).alias("value"))
    return moments(s, ("block_id", "u", "v"))


def geometric_nodes(vox: DataFrame) -> DataFrame:
    """(node, count, center by axis, covariance by pair of axes)."""
    own = axes_of(vox)
    cov = [F.covar_pop(a, b).alias(f"cov_{a}{b}") for i, a in enumerate(own) for b in own[i:]]
    return vox.groupBy(F.col("label").alias("node")).agg(F.count("*").alias("count"), *[F.avg(a).alias(f"center_{a}") for a in own], *cov)


def principal_axes(vox: DataFrame) -> DataFrame:
    """(node, axes): unit vectors of a region's axes by falling variance, flattened; from a covariance row a region."""
    import numpy as np
    import pandas as pd

    own = axes_of(vox)
    n = len(own)
    names = [f"cov_{a}{b}" for i, a in enumerate(own) for b in own[i:]]

    def scan(batches):
        for pdf in batches:
            c = np.zeros((len(pdf), n, n))
            k = 0
            for i in range(n):
                for j in range(i, n):
                    c[:, i, j] = c[:, j, i] = pdf[names[k]]
                    k += 1
            _, v = np.linalg.eigh(c)
            axes = np.swapaxes(v[:, :, ::-1], 1, 2)
            lead = np.take_along_axis(axes, np.abs(axes).argmax(axis=2)[:, :, None], axis=2)
            yield pd.DataFrame({"node": pdf["node"], "axes": list((axes * np.sign(lead)).reshape(len(pdf), n * n))})

    return geometric_nodes(vox).select("node", *names).mapInPandas(scan, "node long, axes array<double>")


def geometric_edges(vox: DataFrame) -> DataFrame:
    """Size of an edge, and comparisons of its ends' sizes and centers.

    The angle divides the dot product of the centers' offsets from the edge's center by
    both norms.
    """
    own = axes_of(vox)
    b = boundary(vox)
    e = b.groupBy("u", "v").agg(F.count("*").alias("size"), *[F.avg(a).alias(f"e_{a}") for a in own])
    n = vox.groupBy(F.col("label").alias("node")).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"c_{a}") for a in own])
    u = n.select(F.col("node").alias("u"), F.col("n").alias("nu"), *[F.col(f"c_{a}").alias(f"u_{a}") for a in own])
    v = n.select(F.col("node").alias("v"), F.col("n").alias("nv"), *[F.col(f"c_{a}").alias(f"v_{a}") for a in own])
    j = e.join(u, "u").join(v, "v")

    def norm(p: str, q: str) -> Column:
        return F.sqrt(sum(((F.col(f"{p}_{a}") - F.col(f"{q}_{a}")) * (F.col(f"{p}_{a}") - F.col(f"{q}_{a}")) for a in own), F.lit(0.0)))

    dot = sum(((F.col(f"u_{a}") - F.col(f"e_{a}")) * (F.col(f"v_{a}") - F.col(f"e_{a}")) for a in own), F.lit(0.0))
    nu, nv = F.col("nu"), F.col("nv")
    lo, hi = F.least(nu, nv), F.greatest(nu, nv)
    return j.select("u", "v", "size", F.abs(nu - nv).alias("diff"), (nu + nv).alias("sum"), (nu * nv).alias("product"), lo.alias("min"), hi.alias("max"), (lo / hi).alias("ratio"), (F.col("size") / lo).alias("ratio_min"), (F.col("size") / hi).alias("ratio_max"), norm("u", "v").alias("d_uv"), norm("u", "e").alias("d_ue"), norm("v", "e").alias("d_ve"), (dot / (norm("u", "e") * norm("v", "e"))).alias("cosine"))


def affinity_samples(vox: DataFrame, affinities: DataFrame, offsets: Sequence[Sequence[int]], ignore_label: bool = False) -> DataFrame:
    """(u, v, channel, value): affinities between voxels of different labels."""
    own = axes_of(vox)
    pairs = offset_pairs(vox if not ignore_label else vox.where("label <> 0"), offsets, ("label",))
    j = pairs.join(affinities.select("channel", *own, "value"), ["channel", *own])
    return j.select(F.least("a_label", "b_label").alias("u"), F.greatest("a_label", "b_label").alias("v"), "channel", "value")


def affinity_means(samples: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, mean): mean affinity of each edge, 0 where it has no sample."""
    s = samples.where("u <> v").groupBy("u", "v").agg(F.avg("value").alias("mean"))
    return edges.select("u", "v").join(s, ["u", "v"], "left").select("u", "v", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def weighted_affinities(samples: DataFrame, weights: Sequence[float], inside: bool = False) -> DataFrame:
    """Weighted mean, summed weight and maximum by edge; with inside=True by node, of pairs of one label."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = samples.where("u = v" if inside else "u <> v").withColumn("w", F.element_at(table, F.col("channel") + 1))
    keys = [F.col("u").alias("node")] if inside else ["u", "v"]
    return s.groupBy(*keys).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"), F.sum("w").alias("length"), F.max("value").alias("max"))


def lifted_affinities(samples: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moments of edges in the graph, moments of pairs beyond it)."""
    s = samples.where("u <> v")
    near = s.join(edges.select("u", "v"), ["u", "v"], "left_semi")
    far = s.join(edges.select("u", "v"), ["u", "v"], "left_anti")
    return moments(near, ("u", "v")), moments(far, ("u", "v"))


def slice_features(vox: DataFrame, keep: str = "all", side: int = 0) -> DataFrame:
    """Moments of a stacked graph's edges: all, only within slices (`xy`), or only between (`z`)."""
    axes = {"all": None, "xy": ("y", "x"), "z": ("z",)}[keep]
    return moments(boundary_samples(vox, side, axes=axes), ("u", "v"))


def long_range_features(vox: DataFrame, affinities: DataFrame, long_range: int) -> DataFrame:
    """Moments of affinities (channel k: k + 2 slices up) by long-range edge and distance."""
    s = affinity_samples(vox, affinities, [[k, 0, 0] for k in range(2, long_range + 1)]).where("u <> v")
    return moments(s.withColumn("dz", (F.col("channel") + 2).cast("long")), ("u", "v", "dz"))


def features_on_graph(vox: DataFrame, edges: DataFrame, ignore_label: bool = False) -> DataFrame:
    """Moments of a given graph's edges only."""
    return moments(boundary_samples(vox, ignore_label=ignore_label).join(edges.select("u", "v"), ["u", "v"], "left_semi"), ("u", "v"))


def morphology(vox: DataFrame) -> DataFrame:
    """(label, size, center, min and max coordinate by axis)."""
    own = axes_of(vox)
    return vox.groupBy("label").agg(F.count("*").alias("size"), *[F.avg(a).alias(f"com_{a}") for a in own], *[F.min(a).alias(f"min_{a}") for a in own], *[F.max(a).alias(f"max_{a}") for a in own])


def merge_morphology(parts: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Morphology of labels from that of blocks; centers are weighted by size."""
    n = F.sum("size")
    return parts.groupBy("label").agg(n.alias("size"), *[(F.sum(F.col("size") * F.col(f"com_{a}")) / n).alias(f"com_{a}") for a in axes], *[F.min(f"min_{a}").alias(f"min_{a}") for a in axes], *[F.max(f"max_{a}").alias(f"max_{a}") for a in axes])


def filter_features(vox: DataFrame, sigmas: Sequence[float], ignore_label: bool = False) -> DataFrame:
    """(u, v, sigma, moments): edge moments of the volume smoothed at each scale."""
    from .images import smooth

    own = axes_of(vox)
    out = None
    for s in sigmas:
        part = vox.select(*own, "label").join(smooth(vox.select(*own, "value"), s), list(own))
        m = moments(boundary_samples(part, ignore_label=ignore_label), ("u", "v")).withColumn("sigma", F.lit(float(s)))
        out = m if out is None else out.unionByName(m)
    return out


def central_moments(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mean, sum, min, max, moment2, moment3): central moments from power sums."""
    v = F.col("value")
    n, s1, s2, s3 = F.count("*"), F.sum(v), F.sum(v * v), F.sum(v * v * v)
    m = s1 / n
    return samples.groupBy(*keys).agg(m.alias("mean"), s1.alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), (s2 / n - m * m).alias("moment2"), (s3 / n - 3 * m * s2 / n + 2 * m * m * m).alias("moment3"))
