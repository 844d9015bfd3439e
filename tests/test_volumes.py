"""Sources, skeletons, cell complexes, two passes and streams."""

import numpy as np
from pyspark.sql import functions as F
from test_regions import image

from tesserae.operators import features, grid, images, skeleton
from tesserae.plans import two_pass
from tesserae.sources import chunked, volumes
from tesserae.streaming import incremental


def test_volume_round_trip(spark, tmp_path):
    a = np.arange(60).reshape(3, 4, 5)
    vox = image(spark, a)
    b = grid.Blocking([0, 0, 0], [3, 4, 5], [2, 2, 2])
    volumes.write_volume(vox, str(tmp_path / "v"), b)
    part = volumes.read_volume(spark, str(tmp_path / "v"), (1, 1, 2), (3, 3, 5))
    assert sorted(r.label for r in part.collect()) == sorted(a[1:3, 1:3, 2:5].reshape(-1).tolist())
    assert "block_id" in part._jdf.queryExecution().executedPlan().toString()


def test_chunked_source(spark, tmp_path):
    a = np.arange(35, dtype=np.float32).reshape(5, 7)
    chunked.register(spark)
    for k, compress in enumerate((True, False)):
        chunked.write_array(a, str(tmp_path / str(k)), (2, 3), compress)
        got = spark.read.format("chunked").option("path", str(tmp_path / str(k))).load()
        assert {(r.y, r.x): r.value for r in got.collect()} == {(y, x): float(a[y, x]) for y, x in np.ndindex(a.shape)}


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(4,), (7,), (30,)], "node long")
    edges = spark.createDataFrame([(4, 30), (7, 30)], "u long, v long")
    volumes.write_graph(nodes, edges, str(tmp_path / "g"))
    ids, dense = volumes.read_dense_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, dense.select("u", "v").collect())) == [(0, 2), (1, 2)] and ids.count() == 3


def test_transformix(spark, tmp_path):
    line = "Point\t{0}\t; InputIndex = [ 1 2 3 ]\t; OutputPoint = [ {0}.5 2.5 -3.0 ]\t; Deformation = [ 0 0 0 ]\n"
    (tmp_path / "p.txt").write_text("".join(line.format(i) for i in range(3)))
    got = volumes.read_transformix(spark, str(tmp_path / "p.txt")).orderBy("id").collect()
    assert [(r.id, r.z, r.y, r.x) for r in got] == [(i, -3.0, 2.5, i + 0.5) for i in range(3)]


def test_skeletons(spark):
    n1 = [(0, 0, 0), (10, 10, 10), (15, 15, 15), (20, 20, 20), (25, 25, 25), (35, 35, 35)]
    n2 = [(60, 0, 0), (70, 10, 10), (75, 25, 25), (75, 45, 45), (80, 55, 55), (85, 65, 65)]

    def label(z, y, x):
        out = 1 if z < 50 else 0
        out = 2 if z >= 50 and y >= 50 and x >= 50 else out
        return 3 if z < 50 and y < 50 and x < 50 else out

    rows = [(s, i, *p, label(*p)) for s, ps in ((1, n1), (2, n2)) for i, p in enumerate(ps)]
    nodes = spark.createDataFrame(rows, "skel long, node long, z long, y long, x long, label long")
    edges = spark.createDataFrame([(s, i, i - 1) for s in (1, 2) for i in range(6)], "skel long, a long, b long")
    assert [r.label for r in nodes.orderBy("skel", "node").collect()] == [3] * 6 + [0, 0, 0, 0, 2, 2]
    assert dict(skeleton.split_scores(nodes, edges).collect()) == {1: 0.0, 2: 0.0}
    assert skeleton.explicit_merges(nodes).count() == 0
    vox = nodes.where("label <> 0").select("z", "y", "x", "label")
    assert sorted(r.label for r in skeleton.assign(nodes, vox).collect()) == sorted(r[-1] for r in rows)
    near = nodes.select((F.col("skel") * 10 + F.col("node")).alias("id"), "skel", (F.col("z") + 3).alias("z"), "y", "x")
    assert skeleton.heuristic_merges(nodes, near, (1, 1, 1), 3.0).count() == 0
    assert skeleton.heuristic_merges(nodes, near, (1, 1, 1), 2.9).count() == 12


def test_cell_complex(spark):
    c = images.cell_counts(image(spark, [[1, 1, 2], [1, 3, 1], [1, 1, 1]])).first()
    assert (c.n0, c.n1, c.n2) == (0, 2, 3)
    one = images.cells(image(spark, [[1, 2], [3, 4]]))
    assert one[0].count() == 1 and one[1].select("cell").distinct().count() == 4


def test_affine_identity(spark):
    rng = np.random.default_rng(2)
    v = rng.random((4, 5))
    vox = image(spark, np.zeros((4, 5), int), v)
    for order in (0, 1):
        out = images.affine(vox, [[1, 0, 0], [0, 1, 0]], (4, 5), order)
        assert all(abs(r.value - v[r.y, r.x]) < 1e-9 for r in out.collect())


def test_two_pass_separates_regions(spark):
    labels = np.zeros((8, 8), int)
    labels[:, 4:] = 1
    offsets = [[0, 1], [1, 0]]
    rows = []
    for y, x in np.ndindex(labels.shape):
        a = [1.0 if all(0 <= c < 8 for c in (y + dy, x + dx)) and labels[y + dy, x + dx] == labels[y, x] else -1.0 for dy, dx in offsets]
        rows.append((y, x, *a))
    aff = spark.createDataFrame(rows, "y long, x long, a0 double, a1 double")
    out = two_pass.two_pass(aff, offsets, grid.Blocking([0, 0], [8, 8], [4, 4]), (1, 1)).collect()
    by = {}
    for r in out:
        by.setdefault(int(labels[r.y, r.x]), set()).add(r.label)
    assert len(out) == 64 and all(len(s) == 1 for s in by.values()) and by[0] != by[1]


def test_stream_merges_like_a_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    vox = image(spark, rng.integers(0, 4, (10, 10)), rng.normal(size=(10, 10)))
    blocks = features.block_features(vox, grid.Blocking([0, 0], [10, 10], [5, 5])).drop("block_id")
    source = str(tmp_path / "in")
    blocks.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(incremental.SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = incremental.merge_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    got = incremental.merged(spark, str(tmp_path / "out"), last).orderBy("u", "v").collect()
    want = features.moments(features.boundary_samples(vox), ("u", "v")).orderBy("u", "v").collect()
    assert [(r.u, r.v, r["count"]) for r in got] == [(r.u, r.v, r["count"]) for r in want]
    assert all(abs(a.mean - b.mean) < 1e-9 for a, b in zip(got, want, strict=True))
