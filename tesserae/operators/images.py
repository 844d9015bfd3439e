"""Image operators: edges of a segmentation, offset flags, filters, extrema, transformations, cell complexes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.rounds import keep
from . import tiles
from .graph import connected_components
from .grid import axes_of, contacts, coordinate_to_node, offset_pairs
from .lookup import make_dense


def segment_edges(vox: DataFrame) -> DataFrame:
    """(coordinates, edge): 1 where any face neighbour has another label."""
    own = axes_of(vox)
    differs = F.lit(False)
    for a in own:
        w = Window.partitionBy(*[c for c in own if c != a]).orderBy(a)
        for step in (F.lag, F.lead):
            near = step(F.col(a)).over(w)
            differs |= F.coalesce((F.abs(near - F.col(a)) == 1) & (step("label").over(w) != F.col("label")), F.lit(False))
    return vox.select(*own, differs.cast("long").alias("edge"))


def offset_flags(vox: DataFrame, offsets: Sequence[Sequence[int]]) -> DataFrame:
    """(coordinates, channel, flag): 1 where the label at an offset differs, 0 outside the image."""
    own = axes_of(vox)
    full = vox.select(*own, F.explode(F.array(*[F.lit(c) for c in range(len(offsets))])).alias("channel"))
    p = offset_pairs(vox, offsets, ("label",)).select(*own, "channel", (F.col("a_label") != F.col("b_label")).cast("long").alias("flag"))
    return full.join(p, [*own, "channel"], "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


def slice_offset_flags(vox: DataFrame, offsets: Sequence[Sequence[int]], center: int, border: int = 0) -> DataFrame:
    """Flags of one slice against others: (y, x, channel, flag); 2 where either label is the border's, 0 outside."""
    mid = vox.where(F.col("z") == center).select("y", "x", F.col("label").alias("a"), F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), *[F.lit(int(v)).alias(k) for k, v in zip(("dz", "dy", "dx"), o, strict=True)]) for c, o in enumerate(offsets)])).alias("o"))
    mid = mid.select("y", "x", "a", "o.channel", (F.lit(center) + F.col("o.dz")).alias("tz"), (F.col("y") + F.col("o.dy")).alias("ty"), (F.col("x") + F.col("o.dx")).alias("tx"))
    to = vox.select(F.col("z").alias("tz"), F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("label").alias("b"))
    j = mid.join(to, ["tz", "ty", "tx"], "left")
    flag = F.when(F.col("b").isNull(), 0).when((F.col("a") == border) | (F.col("b") == border), 2).otherwise((F.col("a") != F.col("b")).cast("int"))
    return j.select("y", "x", "channel", flag.cast("long").alias("flag"))


def thin_filter(vox: DataFrame, sigma: float) -> DataFrame:
    """(coordinates, value): Gaussian-weighted mean of `value` over pixels of the same label with value > 0, in tiles with a halo."""
    return tiles.same_label_mean(vox, sigma, int(3.5 * sigma + 0.5))


def smooth(vox: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian smoothing; each axis is a window over its lines, normalised at the border."""
    own = axes_of(vox)
    r = int(3 * sigma + 0.5)
    weights = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    for a in own:
        line = Window.partitionBy(*[c for c in own if c != a]).orderBy(a)
        num, den = F.lit(0.0), F.lit(0.0)
        for d, w in zip(range(-r, r + 1), weights, strict=True):
            v = F.lead("value", d).over(line) if d >= 0 else F.lag("value", -d).over(line)
            num += F.coalesce(v * w, F.lit(0.0))
            den += F.when(v.isNotNull(), F.lit(w)).otherwise(0.0)
        vox = vox.withColumn("value", num / den)
    return vox


def gradient(vox: DataFrame) -> DataFrame:
    """Magnitude of central differences (one-sided at the border)."""
    own = axes_of(vox)
    total = F.lit(0.0)
    for a in own:
        line = Window.partitionBy(*[c for c in own if c != a]).orderBy(a)
        nxt, prv = F.lead("value").over(line), F.lag("value").over(line)
        span = F.when(nxt.isNotNull() & prv.isNotNull(), 2.0).otherwise(1.0)
        d = (F.coalesce(nxt, F.col("value")) - F.coalesce(prv, F.col("value"))) / span
        total += d * d
    return vox.select(*own, F.sqrt(total).alias("value"))


def hessian_strongest(vox: DataFrame) -> DataFrame:
    """Larger eigenvalue of the 2D Hessian of second differences; borders repeat."""
    def at(df: DataFrame, axis: str, other: str, column: str):
        w = Window.partitionBy(other).orderBy(axis)
        return F.coalesce(F.lead(column).over(w), F.col(column)), F.coalesce(F.lag(column).over(w), F.col(column))

    yn, yp = at(vox, "y", "x", "value")
    xn, xp = at(vox, "x", "y", "value")
    v = F.col("value")
    d = vox.select("y", "x", (yn - 2 * v + yp).alias("yy"), (xn - 2 * v + xp).alias("xx"), ((xn - xp) / 2).alias("gx"))
    gn, gp = at(d, "y", "x", "gx")
    d = d.select("y", "x", "yy", "xx", ((gn - gp) / 2).alias("xy"))
    half = (F.col("yy") + F.col("xx")) / 2
    root = F.sqrt(((F.col("yy") - F.col("xx")) / 2) * ((F.col("yy") - F.col("xx")) / 2) + F.col("xy") * F.col("xy"))
    return d.select("y", "x", (half + root).alias("value"))


def disk_median(vox: DataFrame, radius: int) -> DataFrame:
    """Median over a disk (the lower of an even count)."""
    own = axes_of(vox)
    span = [[]]
    for _ in own:
        span = [[*s, d] for s in span for d in range(-radius, radius + 1)]
    span = [s for s in span if sum(d * d for d in s) <= radius * radius]
    p = offset_pairs(vox, span, ("value",))
    s = F.array_sort(F.collect_list("b_value"))
    return p.groupBy(*own).agg(F.element_at(s, F.floor((F.count("*") + 1) / 2).cast("int")).alias("value"))


def extrema(vox: DataFrame, maxima: bool = False) -> DataFrame:
    """Pixels strictly below (above) all face neighbours."""
    own = axes_of(vox)
    c = contacts(vox, ("value",))
    low = c.select(*own, F.col("a_value").alias("me"), F.col("b_value").alias("other"))
    high = c.select(*[(F.col(a) + (F.col("axis") == a).cast("int")).cast("long").alias(a) for a in own], F.col("b_value").alias("me"), F.col("a_value").alias("other"))
    best = F.max("other") if maxima else F.min("other")
    g = low.union(high).groupBy(*own).agg(F.first("me").alias("value"), best.alias("__o"))
    return g.where(F.col("value") > F.col("__o") if maxima else F.col("value") < F.col("__o")).select(*own, "value")


def extrema_seeds(vox: DataFrame, shape: Sequence[int], maxima: bool = False) -> DataFrame:
    """(node, label): extrema numbered from 1 by node; they are strict, so no two of them touch."""
    own = axes_of(vox)
    marks = extrema(vox, maxima).select(coordinate_to_node([F.col(a) for a in own], shape).alias("node"))
    return make_dense(marks, "node").select("node", (F.col("dense") + 1).alias("label"))


def image_components(vox: DataFrame, shape: Sequence[int], dense: bool = True, ignore_background: bool = False) -> DataFrame:
    """(node, component): connected regions of equal label, solved in tiles; only parts that touch across tiles are joined over the whole."""
    own = axes_of(vox)
    inner, touching = tiles.components(vox, shape, ignore_background)
    roots = connected_components(touching).select(F.col("node").alias("part"), "component")
    out = inner.join(roots, "part", "left").select("node", F.coalesce("component", "part").alias("component"))
    if dense:
        out = out.join(make_dense(out, "component"), "component").select("node", (F.col("dense") + (1 if ignore_background else 0)).alias("component"))
    if ignore_background:
        zero = vox.where("label = 0").select(coordinate_to_node([F.col(a) for a in own], shape).alias("node"), F.lit(0).cast("long").alias("component"))
        out = out.union(zero)
    return out


def non_maximum_suppression(points: DataFrame) -> DataFrame:
    """Points (id, y, x, dist): each stands for itself or the point of largest dist within its own dist; distinct winners.

    Points ask in tiles 16 times as wide as a power of eight at least their reach, one
    level for each power. Every point is copied once a level, and once more for each other
    tile that it lies next to; the pairs of a tile never leave its task.
    """
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("dist"), F.lit(1.0))) / 3) - 1, F.lit(0)).cast("int")
    p = points.withColumn("own", level)
    levels = [r[0] for r in p.select("own").distinct().collect()]
    rows = p.withColumn("lv", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")))
    side, reach = F.pow(F.lit(8.0), F.col("lv") + 1) * 16, F.pow(F.lit(8.0), F.col("lv") + 1) * 1.01
    for c in ("y", "x"):
        rows = rows.withColumn(f"t{c}", F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))))
    ask = (F.col("own") == F.col("lv")) & (F.floor(F.col("y") / side) == F.col("ty")) & (F.floor(F.col("x") / side) == F.col("tx"))
    rows = rows.select("id", "y", "x", "dist", ask.alias("ask"), "lv", "ty", "tx")
    kind = points.schema["id"].dataType.simpleString()
    return tiles.deal(rows, "lv", "ty", "tx").groupBy("lv", "ty", "tx").applyInPandas(tiles.strongest, f"id {kind}").distinct()


def affine(vox: DataFrame, matrix: Sequence[Sequence[float]], shape: Sequence[int], order: int = 0, fill: float = 0.0, box: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """(coordinates, value): the volume read at matrix * output position, nearest (order 0) or linear (order 1).

    box is (begin, end) of the output; all corners must lie inside, else the fill value stands.
    """
    own = axes_of(vox)
    spark: SparkSession = vox.sparkSession
    begin, end = box or ([0] * len(own), list(shape))
    out = spark.range(begin[0], end[0]).withColumnRenamed("id", own[0])
    for a, b, e in zip(own[1:], begin[1:], end[1:], strict=True):
        out = out.withColumn(a, F.explode(F.sequence(F.lit(b).cast("long"), F.lit(e - 1).cast("long"))))
    at = [sum((F.col(c) * float(m) for c, m in zip(own, row[:-1], strict=True)), F.lit(float(row[-1]))) for row in matrix[: len(own)]]
    for k, (c, s) in enumerate(zip(at, shape, strict=True)):
        out = out.withColumn(f"p{k}", c)
    source = vox.select(*[F.col(a).alias(f"q{k}") for k, a in enumerate(own)], "value")
    keys = [f"q{k}" for k in range(len(own))]
    if order == 0:
        near = out.select(*own, *[F.floor(F.col(f"p{k}") + 0.5).cast("long").alias(f"q{k}") for k in range(len(own))])
        return near.join(source, keys, "left").select(*own, F.coalesce("value", F.lit(fill)).alias("value"))
    corners = [[]]
    for _ in own:
        corners = [[*c, d] for c in corners for d in (0, 1)]
    rows = F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(c)]) for c in corners])
    part = out.select(*own, *[f"p{k}" for k in range(len(own))], F.explode(rows).alias("c"))
    weight = F.lit(1.0)
    for k in range(len(own)):
        f = F.col(f"p{k}") - F.floor(f"p{k}")
        weight *= F.when(F.col(f"c.d{k}") == 1, f).otherwise(1 - f)
        part = part.withColumn(f"q{k}", (F.floor(F.col(f"p{k}")) + F.col(f"c.d{k}")).cast("long"))
    part = part.withColumn("w", weight).where("w > 0").join(source, keys, "left")
    inside = F.sum(F.col("value").isNull().cast("int")) == 0
    return part.groupBy(*own).agg(F.when(inside, F.sum(F.col("w") * F.col("value"))).otherwise(F.lit(fill)).alias("value"))


def read_coordinates(vox: DataFrame, coordinates: DataFrame, fill: float = 0.0) -> DataFrame:
    """Values at a list of (id, coordinates)."""
    own = axes_of(vox)
    return coordinates.join(vox.select(*own, "value"), list(own), "left").select("id", F.coalesce("value", F.lit(fill)).alias("value"))


def upsample(vox: DataFrame, factor: int) -> DataFrame:
    """Nearest upsampling: each voxel becomes a cube."""
    own = axes_of(vox)
    for a in own:
        vox = vox.withColumn(a, F.explode(F.sequence(F.col(a) * factor, F.col(a) * factor + factor - 1)))
    return vox


def seeded_watershed(vox: DataFrame, seeds: DataFrame, shape: Sequence[int], method: str = "edge_weighted", mode: str = "max") -> DataFrame:
    """(node, label): seeds (node, label) grown over a height map, by edges or by nodes, tile by tile."""
    from . import kernels

    kernel = kernels.kruskal_watershed if method == "edge_weighted" else kernels.node_watershed
    return tiles.watershed(vox, seeds, shape, kernel, mode, method != "edge_weighted")


def distance_transform(vox: DataFrame, threshold: float) -> DataFrame:
    """(z, y, x, value): Euclidean distance in each slice to the nearest pixel with value above the threshold.

    Exact, in tiles of a slice. A slice without such pixels is infinitely far.
    """
    v = vox if "z" in vox.columns else vox.withColumn("z", F.lit(0).cast("long"))
    return tiles.distances(v.select("z", "y", "x", "value"), threshold)


def distance_transform_watershed(vox: DataFrame, threshold: float, sigma: float, shape: Sequence[int]) -> DataFrame:
    """(node, label) of a 2D image: basins of the smoothed distance to boundary pixels, seeded at its maxima."""
    far = distance_transform(vox, threshold).select("y", "x", F.col("value").alias("value"))
    soft = keep(smooth(far, sigma) if sigma > 0 else far)
    seeds = extrema_seeds(soft, shape, maxima=True).where("label > 0")
    return seeded_watershed(soft.select("y", "x", (-F.col("value")).alias("value")), seeds, shape, "node_weighted")


def curve_curvature(points: DataFrame, reach: int = 2) -> DataFrame:
    """(curve, position, curvature): turning per length at the points (curve, position, y, x) of open curves."""
    w = Window.partitionBy("curve").orderBy("position")
    y0, x0, y1, x1 = F.lag("y", reach).over(w), F.lag("x", reach).over(w), F.lead("y", reach).over(w), F.lead("x", reach).over(w)
    ay, ax, by, bx = F.col("y") - y0, F.col("x") - x0, y1 - F.col("y"), x1 - F.col("x")
    turn = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    length = (F.sqrt(ay * ay + ax * ax) + F.sqrt(by * by + bx * bx)) / 2
    return points.select("curve", "position", F.when(length > 0, turn / length).otherwise(0.0).alias("curvature"))


# cell complexes of 2D label images, on the doubled grid


def cell_faces(vox: DataFrame) -> DataFrame:
    """Boundary faces (y, x on the doubled grid, u, v) between pixels of different labels."""
    c = contacts(vox, ("label",)).where("a_label <> b_label")
    return c.select((2 * F.col("y") + (F.col("axis") == "y").cast("int")).cast("long").alias("y"), (2 * F.col("x") + (F.col("axis") == "x").cast("int")).cast("long").alias("x"), F.least("a_label", "b_label").alias("u"), F.greatest("a_label", "b_label").alias("v"))


def cell_corners(vox: DataFrame) -> DataFrame:
    """Inner corners (y, x odd on the doubled grid) with their labels a b / c d and `kind`.

    kind: 0 none or straight, 1 junction, 2 two boundaries that pass by each other.
    """
    v = vox.select("y", "x", "label")
    wx = Window.partitionBy("y").orderBy("x")
    row = v.select("y", "x", F.col("label").alias("a"), F.lead("label").over(wx).alias("b")).where("b is not null")
    wy = Window.partitionBy("x").orderBy("y")
    q = row.select("y", "x", "a", "b", F.lead("a").over(wy).alias("c"), F.lead("b").over(wy).alias("d")).where("c is not null")
    sides = (F.col("a") != F.col("b")).cast("int") + (F.col("c") != F.col("d")).cast("int") + (F.col("a") != F.col("c")).cast("int") + (F.col("b") != F.col("d")).cast("int")
    diagonal = (F.col("a") == F.col("d")) | (F.col("b") == F.col("c"))
    kind = F.when(sides == 3, 1).when((sides == 4) & ~diagonal, 1).when(sides == 4, 2).otherwise(0)
    return q.select((2 * F.col("y") + 1).alias("y"), (2 * F.col("x") + 1).alias("x"), "a", "b", "c", "d", sides.alias("sides"), kind.alias("kind"))


def cells(vox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(0-cells: junction corners y, x; 1-cells: faces y, x, u, v with the number of their curve)."""
    corners = cell_corners(vox)
    faces = cell_faces(vox)
    node = lambda y, x: y * (1 << 31) + x
    y, x = F.col("y"), F.col("x")
    top, bottom, left, right = node(y - 1, x), node(y + 1, x), node(y, x - 1), node(y, x + 1)
    flags = [(F.col("a") != F.col("b"), top), (F.col("c") != F.col("d"), bottom), (F.col("a") != F.col("c"), left), (F.col("b") != F.col("d"), right)]
    two = corners.where("sides = 2").select(F.filter(F.array(*[F.when(f, n) for f, n in flags]), lambda n: n.isNotNull()).alias("n")).select(F.col("n")[0].alias("u"), F.col("n")[1].alias("v"))
    # of two curves that pass, those around equal diagonal labels join: a = d first
    join_ad = F.array(F.struct(top.alias("u"), right.alias("v")), F.struct(bottom.alias("u"), left.alias("v")))
    join_bc = F.array(F.struct(top.alias("u"), left.alias("v")), F.struct(bottom.alias("u"), right.alias("v")))
    passing = corners.where("kind = 2").select(F.explode(F.when(F.col("a") == F.col("d"), join_ad).otherwise(join_bc)).alias("e")).select("e.u", "e.v")
    ids = faces.select("y", "x", "u", "v", node(y, x).alias("node"))
    comp = connected_components(two.union(passing), ids.select("node"))
    return corners.where("kind = 1").select("y", "x"), ids.join(comp, "node").select("y", "x", "u", "v", F.col("component").alias("cell"))


def cell_counts(vox: DataFrame) -> DataFrame:
    """One row: numbers of 0-, 1- and 2-cells (the last is the largest label)."""
    zero, one = cells(vox)
    return zero.agg(F.count("*").alias("n0")).crossJoin(one.agg(F.countDistinct("cell").alias("n1"))).crossJoin(vox.agg(F.max("label").alias("n2")))


def cell_bounds(vox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(1-cells at each 0-cell: y, x, cells; 2-cells at each 1-cell: cell, u, v)."""
    zero, one = cells(vox)
    step = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    around = zero.select(F.col("y").alias("jy"), F.col("x").alias("jx"), F.explode(step).alias("s")).select("jy", "jx", (F.col("jy") + F.col("s.dy")).alias("y"), (F.col("jx") + F.col("s.dx")).alias("x"))
    b0 = around.join(one.select("y", "x", "cell"), ["y", "x"]).groupBy(F.col("jy").alias("y"), F.col("jx").alias("x")).agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    return b0, one.select("cell", "u", "v").distinct()


def cell_geometry(vox: DataFrame) -> DataFrame:
    """(cell, size, y, x): faces of each 1-cell and their center of mass."""
    return cells(vox)[1].groupBy("cell").agg(F.count("*").alias("size"), F.avg("y").alias("y"), F.avg("x").alias("x"))


def cell_mask(vox: DataFrame, show: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(y, x, dim): cells of the wanted dimensions on the doubled grid."""
    zero, one = cells(vox)
    parts = [zero.select("y", "x", F.lit(0).alias("dim")), one.select("y", "x", F.lit(1).alias("dim")), vox.select((2 * F.col("y")).alias("y"), (2 * F.col("x")).alias("x"), F.lit(2).alias("dim"))]
    out = None
    for k in show:
        out = parts[k] if out is None else out.union(parts[k])
    return out


def cell_features(vox: DataFrame) -> DataFrame:
    """(cell, size, size_ratio, u, v, value moments): geometry and topology of 1-cells with their regions' sizes."""
    one = cells(vox)[1]
    g = one.groupBy("cell", "u", "v").agg(F.count("*").alias("size"), F.max("y").alias("y1"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.min("x").alias("x0"))
    n = vox.groupBy("label").agg(F.count("*").alias("n"))
    j = g.join(n.select(F.col("label").alias("u"), F.col("n").alias("nu")), "u").join(n.select(F.col("label").alias("v"), F.col("n").alias("nv")), "v")
    span = F.sqrt((F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")) + (F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")))
    return j.select("cell", "u", "v", "size", span.alias("span"), (F.least("nu", "nv") / F.greatest("nu", "nv")).alias("size_ratio"))
