"""Image problems solved in tiles against the same problem solved whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import grid, images, kernels, tiles


def image(spark, a, gaps=()):
    return spark.createDataFrame([(y, x, float(a[y, x])) for y, x in np.ndindex(a.shape) if (y, x) not in gaps], "y long, x long, value double")


def whole(a, seeds, kernel, tall, gaps=()):
    h, w = a.shape
    near = [((y, x), (y + dy, x + dx)) for y, x in np.ndindex(a.shape) for dy, dx in ((0, 1), (1, 0)) if y + dy < h and x + dx < w]
    edges = [(p[0] * w + p[1], q[0] * w + q[1], max(float(a[p]), float(a[q]))) for p, q in near if p not in gaps and q not in gaps]
    return kernel(edges, seeds, *([{y * w + x: float(a[y, x]) for y, x in np.ndindex(a.shape)}] if tall else []))


def few(kernel, most):
    def run(edges, *rest):
        assert len(edges) <= most, "more than a tile and its halo"
        return kernel(edges, *rest)

    return run


@pytest.mark.parametrize("tall", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_watershed_in_tiles_equals_the_whole(spark, seed, tall):
    """Few heights, so that there are plateaus; few seeds, so that floods cross tiles; holes that cut pixels off."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 3 + 40 * (seed == 2), (24, 19))
    gaps = {(3, x) for x in range(6)} | {(y, 6) for y in range(4)} if seed == 1 else set()
    at = [(y, x) for y, x in np.ndindex(a.shape) if (y, x) not in gaps]
    seeds = {y * 19 + x: 1 + k % 5 for k, (y, x) in enumerate(at[i] for i in sorted(rng.choice(len(at), 8, replace=False)))}
    kernel = kernels.node_watershed if tall else kernels.kruskal_watershed
    marks = spark.createDataFrame(list(seeds.items()), "node long, label long")
    got = tiles.watershed(image(spark, a, gaps), marks, (1 << 20, 19), kernel, "max", tall, size=30, halo=2)
    rows = got.collect()
    assert len(rows) == len({r.node for r in rows})
    assert dict(rows) == whole(a, seeds, kernel, tall, gaps)


@pytest.mark.parametrize("tall", [False, True])
def test_a_task_holds_a_tile_and_not_the_image(spark, tall):
    a = np.random.default_rng(7).normal(size=(120, 8))
    vox = image(spark, a)
    seeds = images.extrema_seeds(vox, (1 << 20, 8))
    kernel = kernels.node_watershed if tall else kernels.kruskal_watershed
    got = tiles.watershed(vox, seeds, (1 << 20, 8), few(kernel, 40 * 8 * 2), "max", tall, size=64, halo=12)
    assert dict(got.collect()) == whole(a, dict(seeds.collect()), kernel, tall)


def test_distances_in_tiles(spark):
    """Walls far apart, a slice without any, and a slice with one."""
    rng = np.random.default_rng(1)
    a = (rng.random((3, 30, 17)) > 0.985).astype(float)
    a[1] = 0
    a[2] = 0
    a[2, 0, 0] = 1
    vox = spark.createDataFrame([(*map(int, at), float(a[at])) for at in np.ndindex(a.shape) if at[1:] != (4, 4)], "z long, y long, x long, value double")
    got = {(r.z, r.y, r.x): r.value for r in tiles.distances(vox, 0.5, size=20, halo=2).collect()}
    walls = [[(y, x) for y, x in np.ndindex(a.shape[1:]) if a[z, y, x] and (y, x) != (4, 4)] for z in range(3)]
    want = {(z, y, x): min([((y - p) ** 2 + (x - q) ** 2) ** 0.5 for p, q in walls[z]], default=np.inf) for z, y, x in np.ndindex(a.shape) if (y, x) != (4, 4)}
    assert got == want


def test_components_in_tiles(spark):
    a = np.random.default_rng(4).integers(0, 2, (40, 23))
    vox = spark.createDataFrame([(y, x, int(a[y, x])) for y, x in np.ndindex(a.shape)], "y long, x long, label long")
    e = [(y * 23 + x, (y + dy) * 23 + x + dx, 1.0) for y, x in np.ndindex(a.shape) for dy, dx in ((0, 1), (1, 0)) if y + dy < 40 and x + dx < 23 and a[y, x] == a[y + dy, x + dx]]
    s = kernels.Sets(range(a.size))
    for u, v, _ in e:
        s.union(u, v)
    inner, touching = tiles.components(vox, (1 << 20, 23), False, size=50)
    assert touching.count() > 0 and inner.select("part").distinct().count() > len(set(s.labels().values()))
    for background in (False, True):
        got = dict(images.image_components(vox, (1 << 20, 23), False, background).collect())
        assert got == {n: 0 if background and not a[n // 23, n % 23] else c for n, c in s.labels().items()}


def test_image_edges_come_from_the_image_and_not_from_its_shape(spark):
    vox = image(spark, np.random.default_rng(0).normal(size=(5, 4))).withColumn("label", F.lit(1).cast("long"))
    plan = images.image_components(vox, (1 << 40, 4), False)._jdf.queryExecution().analyzed().toString()
    assert "Range" not in plan and grid.grid_edges(spark, (2, 2)).count() == 4


def test_thin_filter_broadcasts_nothing(spark):
    rng = np.random.default_rng(3)
    v, lab = rng.normal(size=(21, 9)), rng.integers(0, 2, (21, 9))
    vox = spark.createDataFrame([(y, x, float(v[y, x]), int(lab[y, x])) for y, x in np.ndindex(v.shape)], "y long, x long, value double, label long")
    df = tiles.same_label_mean(vox, 0.6, 2, size=20)
    want = {}
    for y, x in np.ndindex(v.shape):
        near = [(np.exp(-((p - y) ** 2 + (q - x) ** 2) / 0.72), v[p, q]) for p, q in np.ndindex(v.shape) if max(abs(p - y), abs(q - x)) <= 2 and lab[p, q] == lab[y, x] and v[p, q] > 0]
        want[y, x] = sum(g * t for g, t in near) / sum(g for g, _ in near) if near else 0.0
    got = {(r.y, r.x): r.value for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = images.thin_filter(vox, 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
