"""Dense grids in long form: contacts, offset pairs, grid graphs, maps from images to edges, blocks.

A grid is a table with coordinate columns (`y, x` or `z, y, x`), and values. Face
neighbours come from `lead` over the lines of an axis, which sorts each line once and
joins nothing; arbitrary offsets are an equality join on shifted coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AXES2, AXES3 = ("y", "x"), ("z", "y", "x")


def axes_of(df: DataFrame) -> tuple[str, ...]:
    return AXES3 if "z" in df.columns else AXES2


def contacts(vox: DataFrame, values: Sequence[str] = ("label", "value"), axes: Sequence[str] | None = None) -> DataFrame:
    """One row per pair of face neighbours: coordinates of the lower one, axis, and a_/b_ of each value."""
    own = axes_of(vox)
    out = None
    for axis in axes or own:
        line = Window.partitionBy(*[a for a in own if a != axis]).orderBy(axis)
        nxt = [F.lead(v).over(line).alias(f"b_{v}") for v in values]
        part = vox.select(*own, F.lit(axis).alias("axis"), *[F.col(v).alias(f"a_{v}") for v in values], *nxt, F.lead(axis).over(line).alias("__n"))
        part = part.where(F.col("__n") == F.col(axis) + 1).drop("__n")
        out = part if out is None else out.unionByName(part)
    return out


def boundary(vox: DataFrame, ignore_label: bool = False, axes: Sequence[str] | None = None) -> DataFrame:
    """Contacts of different labels: u < v, vu and vv (the values on either side), axis, coordinates."""
    c = contacts(vox, axes=axes).where("a_label <> b_label")
    if ignore_label:
        c = c.where("a_label <> 0 and b_label <> 0")
    low = F.col("a_label") < F.col("b_label")
    return c.select(F.least("a_label", "b_label").alias("u"), F.greatest("a_label", "b_label").alias("v"), *axes_of(vox), "axis", F.when(low, F.col("a_value")).otherwise(F.col("b_value")).alias("vu"), F.when(low, F.col("b_value")).otherwise(F.col("a_value")).alias("vv"))


def offset_pairs(vox: DataFrame, offsets: Sequence[Sequence[int]], values: Sequence[str] = ("label", "value")) -> DataFrame:
    """Pairs of voxels at each offset (inside the grid): channel, coordinates, a_/b_ of each value."""
    own = axes_of(vox)
    table = F.array(*[F.struct(F.lit(c).alias("channel"), *[F.lit(int(o)).alias(f"d{a}") for a, o in zip(own, off, strict=True)]) for c, off in enumerate(offsets)])
    left = vox.select(*own, *[F.col(v).alias(f"a_{v}") for v in values], F.explode(table).alias("o"))
    left = left.select(*own, *[f"a_{v}" for v in values], F.col("o.channel").alias("channel"), *[(F.col(a) + F.col(f"o.d{a}")).alias(f"__{a}") for a in own])
    right = vox.select(*[F.col(a).alias(f"__{a}") for a in own], *[F.col(v).alias(f"b_{v}") for v in values])
    return left.join(right, [f"__{a}" for a in own]).drop(*[f"__{a}" for a in own])


def grid_nodes(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """Coordinates and row-major node ids of a grid of the given shape; nothing is stored."""
    axes = AXES3 if len(shape) == 3 else AXES2
    total = 1
    for s in shape:
        total *= s
    return spark.range(total).select(F.col("id").alias("node"), *[c.alias(a) for a, c in zip(axes, node_to_coordinate(F.col("id"), shape), strict=True)])


def node_to_coordinate(node: Column, shape: Sequence[int]) -> list[Column]:
    out, step = [], 1
    for s in reversed(shape):
        out.append((F.floor(node / step) % s).cast("long"))
        step *= s
    return out[::-1]


def coordinate_to_node(coords: Sequence[Column], shape: Sequence[int]) -> Column:
    node = F.lit(0).cast("long")
    for c, s in zip(coords, shape, strict=True):
        node = node * s + c
    return node


def grid_edges(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """Edges (u, v, axis) of the grid graph of 4 or 6 neighbours, by arithmetic alone."""
    axes = AXES3 if len(shape) == 3 else AXES2
    steps = [1]
    for s in reversed(shape[1:]):
        steps.append(steps[-1] * s)
    steps = steps[::-1]
    kinds = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(st).alias("step"), (F.col(a) + 1 < s).alias("ok")) for a, s, st in zip(axes, shape, steps, strict=True)])
    e = grid_nodes(spark, shape).select("node", F.explode(kinds).alias("k")).where("k.ok")
    return e.select(F.col("node").alias("u"), (F.col("node") + F.col("k.step")).alias("v"), F.col("k.axis").alias("axis"))


def long_range_grid_edges(spark: SparkSession, shape: Sequence[int], offsets: Sequence[Sequence[int]]) -> DataFrame:
    """Edges (u, v, channel) between grid nodes at the offsets that stay inside."""
    axes = AXES3 if len(shape) == 3 else AXES2
    table = F.array(*[F.struct(F.lit(c).alias("channel"), *[F.lit(int(o)).alias(f"d{a}") for a, o in zip(axes, off, strict=True)]) for c, off in enumerate(offsets)])
    e = grid_nodes(spark, shape).select("node", *axes, F.explode(table).alias("o"))
    inside = F.lit(True)
    for a, s in zip(axes, shape, strict=True):
        inside &= (F.col(a) + F.col(f"o.d{a}")).between(0, s - 1)
    to = coordinate_to_node([F.col(a) + F.col(f"o.d{a}") for a in axes], shape)
    e = e.where(inside).select(F.col("node").alias("a"), to.alias("b"), F.col("o.channel").alias("channel"))
    return e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "channel")


MODES = {
    "min": F.least,
    "max": F.greatest,
    "sum": lambda a, b: a + b,
    "prod": lambda a, b: a * b,
    "l1": lambda a, b: F.abs(a - b),
    "l2": lambda a, b: F.pow(a - b, F.lit(2)),
}


def image_to_edges(vox: DataFrame, shape: Sequence[int], mode: str = "max") -> DataFrame:
    """(u, v, w): a map of grid edges from an image by one of MODES; `interpixel` takes an image of shape 2s-1."""
    own = axes_of(vox)
    if mode == "interpixel":
        odd = sum((F.col(a) % 2 for a in own), F.lit(0))
        low = [F.floor(F.col(a) / 2).cast("long") for a in own]
        high = [F.ceil(F.col(a) / 2).cast("long") for a in own]
        return vox.where(odd == 1).select(coordinate_to_node(low, shape).alias("u"), coordinate_to_node(high, shape).alias("v"), F.col("value").alias("w"))
    c = contacts(vox, ("value",))
    u = coordinate_to_node([F.col(a) for a in own], shape)
    v = coordinate_to_node([F.col(a) + (F.col("axis") == a).cast("int") for a in own], shape)
    return c.select(u.alias("u"), v.alias("v"), MODES[mode](F.col("a_value"), F.col("b_value")).alias("w"))


def channel_distance(a: Column, b: Column, distance: str) -> Column:
    """l1, l2 or cosine distance of two arrays."""
    both = F.arrays_zip(a.alias("p"), b.alias("q"))
    add = lambda f: F.aggregate(F.transform(both, f), F.lit(0.0), lambda x, y: x + y)
    if distance == "l1":
        return add(lambda z: F.abs(z["p"] - z["q"]).cast("double"))
    if distance == "l2":
        return F.sqrt(add(lambda z: F.pow((z["p"] - z["q"]).cast("double"), F.lit(2.0))))
    if distance == "cosine":
        dot = add(lambda z: z["p"].cast("double") * z["q"].cast("double"))
        return 1 - dot / F.sqrt(add(lambda z: F.pow(z["p"].cast("double"), F.lit(2.0))) * add(lambda z: F.pow(z["q"].cast("double"), F.lit(2.0))))
    raise ValueError(f"no distance {distance!r}")


def channels_to_edges(vox: DataFrame, distance: str = "l2", offsets: Sequence[Sequence[int]] | None = None, strides: Sequence[int] | None = None, seed: int | None = None) -> DataFrame:
    """Distance of the channel arrays (column `value`) of neighbours, or of pairs at offsets on a stride.

    With a seed, pairs are drawn at random in the stride's proportion instead of on its grid.
    """
    pairs = offset_pairs(vox, offsets, ("value",)) if offsets else contacts(vox, ("value",))
    if strides and seed is not None:
        share = 1.0
        for s in strides:
            share /= s
        pairs = pairs.where(F.rand(seed) < share)
    elif strides:
        for a, s in zip(axes_of(vox), strides, strict=True):
            pairs = pairs.where(F.col(a) % s == 0)
    return pairs.withColumn("w", channel_distance(F.col("a_value"), F.col("b_value"), distance)).drop("a_value", "b_value")


def affinities_to_edges(affinities: DataFrame, shape: Sequence[int], offsets: Sequence[Sequence[int]], strides: Sequence[int] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """(u, v, channel, w): affinities (channel, coordinates, value) as a map of edges at the offsets."""
    own = axes_of(affinities)
    table = affinities.sparkSession.createDataFrame([(c, *map(int, o)) for c, o in enumerate(offsets)], ["channel", *[f"d{a}" for a in own]])
    e = affinities.join(F.broadcast(table), "channel")
    for a, s in zip(own, shape, strict=True):
        e = e.where((F.col(a) + F.col(f"d{a}")).between(0, s - 1))
    if strides:
        for a, s in zip(own, strides, strict=True):
            e = e.where((F.col("channel") < len(own)) | (F.col(a) % s == 0))
    if mask is not None:
        e = e.join(mask.where("keep").select("channel", *own), ["channel", *own], "left_semi")
    u = coordinate_to_node([F.col(a) for a in own], shape)
    v = coordinate_to_node([F.col(a) + F.col(f"d{a}") for a in own], shape)
    return e.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), F.col("channel").cast("int").alias("channel"), F.col("value").alias("w"))


def euclidean_edges(mask: DataFrame, shape: Sequence[int], resolution: Sequence[float]) -> DataFrame:
    """Length of each grid edge; infinite where either end is masked out (column `value` is 0)."""
    own = axes_of(mask)
    c = contacts(mask, ("value",))
    length = F.lit(None).cast("double")
    for a, r in zip(own, resolution, strict=True):
        length = F.when(F.col("axis") == a, F.lit(float(r))).otherwise(length)
    u = coordinate_to_node([F.col(a) for a in own], shape)
    v = coordinate_to_node([F.col(a) + (F.col("axis") == a).cast("int") for a in own], shape)
    masked = (F.col("a_value") == 0) | (F.col("b_value") == 0)
    return c.select(u.alias("u"), v.alias("v"), F.when(masked, F.lit(float("inf"))).otherwise(length).alias("w"))


def project_edges_to_pixels(edges: DataFrame, spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """(axis, coordinates, edge_id): edges of a grid graph at their lower pixel, -1 where there is none."""
    own = AXES3 if len(shape) == 3 else AXES2
    full = grid_nodes(spark, shape).select("node", *own, F.explode(F.array(*[F.lit(a) for a in own])).alias("axis"))
    at = edges.select(F.col("u").alias("node"), "axis", "edge_id")
    return full.join(at, ["node", "axis"], "left").select("axis", *own, F.coalesce("edge_id", F.lit(-1)).cast("long").alias("edge_id"))


class Blocking:
    """A region of interest tiled into blocks, as column arithmetic and a small table."""

    def __init__(self, begin: Sequence[int], end: Sequence[int], block: Sequence[int], shift: Sequence[int] | None = None):
        self.begin, self.end, self.block = list(begin), list(end), list(block)
        self.shift = list(shift or [0] * len(self.begin))
        self.per_axis = [-(-(e - b + s) // k) for b, e, k, s in zip(self.begin, self.end, self.block, self.shift, strict=True)]
        self.count = 1
        for n in self.per_axis:
            self.count *= n

    def block_id(self, coords: Sequence[Column]) -> Column:
        return coordinate_to_node([F.floor((c - b + s) / k) for c, b, s, k in zip(coords, self.begin, self.shift, self.block, strict=True)], self.per_axis).cast("long")

    def table(self, spark: SparkSession, halo: Sequence[int] | None = None) -> DataFrame:
        """block_id, and begin/end (and outer_begin/outer_end with a halo) by axis number."""
        halo = list(halo or [0] * len(self.begin))
        pos = node_to_coordinate(F.col("id"), self.per_axis)
        cols = [F.col("id").alias("block_id")]
        for k, p in enumerate(pos):
            raw = p * self.block[k] + self.begin[k] - self.shift[k]
            lo, hi = F.greatest(raw, F.lit(self.begin[k])), F.least(raw + self.block[k], F.lit(self.end[k]))
            cols += [p.alias(f"pos{k}"), lo.cast("long").alias(f"begin{k}"), hi.cast("long").alias(f"end{k}"), F.greatest(lo - halo[k], F.lit(self.begin[k])).cast("long").alias(f"outer_begin{k}"), F.least(hi + halo[k], F.lit(self.end[k])).cast("long").alias(f"outer_end{k}")]
        return spark.range(self.count).select(*cols)

    def neighbor(self, block_id: Column, axis: int, lower: bool) -> Column:
        """Id of the next block along an axis, -1 at the border."""
        pos = node_to_coordinate(block_id, self.per_axis)
        pos[axis] = pos[axis] + (-1 if lower else 1)
        return F.when(pos[axis].between(0, self.per_axis[axis] - 1), coordinate_to_node(pos, self.per_axis)).otherwise(F.lit(-1)).cast("long")

    def in_box(self, spark: SparkSession, begin: Sequence[int], end: Sequence[int], inside: bool) -> DataFrame:
        """Ids of blocks that lie inside, or overlap, a bounding box."""
        keep = F.lit(True)
        for k, (b, e) in enumerate(zip(begin, end, strict=True)):
            keep &= ((F.col(f"begin{k}") >= b) & (F.col(f"end{k}") <= e)) if inside else ((F.col(f"begin{k}") < e) & (F.col(f"end{k}") > b))
        return self.table(spark).where(keep).select("block_id")

    def with_halo(self, vox: DataFrame, halo: Sequence[int]) -> DataFrame:
        """Voxels copied to every block whose halo holds them (column block_id)."""
        own = axes_of(vox)
        spans = []
        for k, a in enumerate(own):
            top = self.per_axis[k] - 1
            at = lambda x, k=k: F.floor((x - self.begin[k] + self.shift[k]) / self.block[k])
            spans.append(F.sequence(F.greatest(at(F.col(a) - halo[k]), F.lit(0)), F.least(at(F.col(a) + halo[k]), F.lit(top))))
        out = vox
        for k, s in enumerate(spans):
            out = out.withColumn(f"__p{k}", F.explode(s))
        return out.withColumn("block_id", coordinate_to_node([F.col(f"__p{k}") for k in range(len(own))], self.per_axis)).drop(*[f"__p{k}" for k in range(len(own))])
