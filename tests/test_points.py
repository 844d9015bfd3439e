"""Points, skeletons and blocked graphs against brute force, and how much they copy."""

import math
import random

from tesserae.operators import images, skeleton
from tesserae.sources import volumes


def test_suppression_against_brute_force(spark):
    """Points off the grid, ties of dist, reaches from 0 to far beyond a tile."""
    rng = random.Random(1)
    pts = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300), float(rng.choice([0, 1, 3, 8, 9, 40, 64, 65, 250]))) for i in range(700)]
    df = images.non_maximum_suppression(spark.createDataFrame(pts, "id long, y double, x double, dist double"))
    want = {min((q for q in pts if (q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2 <= p[3] ** 2), key=lambda q: (-q[3], q[0]))[0] for p in pts}
    got = [r.id for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Join" not in df._jdf.queryExecution().analyzed().toString()


def test_heuristic_merges_against_brute_force(spark):
    rng = random.Random(2)
    nodes = [(rng.randrange(6), *[rng.randrange(-90, 90) for _ in range(3)]) for _ in range(120)]
    pts = [(i, rng.randrange(7), *[rng.randrange(-90, 90) for _ in range(3)]) for i in range(150)]
    res, most = (1.0, 0.5, 2.0), 30.0
    far = lambda p, n: math.dist([c * r for c, r in zip(p, res, strict=True)], [c * r for c, r in zip(n, res, strict=True)])
    want = {p[0] for p in pts if not any(n[0] == p[1] and far(p[2:], n[1:]) <= most for n in nodes)}
    n = spark.createDataFrame(nodes, "skel long, z long, y long, x long")
    got = skeleton.heuristic_merges(n, spark.createDataFrame(pts, "id long, skel long, z long, y long, x long"), res, most)
    assert {r.id for r in got.collect()} == want and 0 < len(want) < 150


def test_nodes_at_one_place_meet_the_boundary_once(spark):
    nodes = spark.createDataFrame([(k % 3, k, 0, k % 2, 0, 5) for k in range(600)], "skel long, node long, z long, y long, x long, label long")
    bound = spark.createDataFrame([(5, 0, 4, 3), (5, 0, 0, 7), (6, 0, 0, 0)], "label long, z long, y long, x long")
    df = skeleton.distance_statistics(nodes, bound)
    assert {(r.skel, r.label): (round(r.mean, 9), r.max) for r in df.collect()} == {(s, 5): (round((5 + math.sqrt(18)) / 2, 9), 5.0) for s in range(3)}
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "Distinct" in plan or "Deduplicate" in plan


def test_a_graph_of_many_blocks_takes_few_folders(spark, tmp_path):
    edges = spark.range(5000).selectExpr("id as u", "id + 1 as v", "id as block_id").repartition(4)
    volumes.write_graph(spark.range(5001).withColumnRenamed("id", "node"), edges, str(tmp_path / "g"))
    assert len(list((tmp_path / "g" / "edges").glob("*/*.parquet"))) <= 5
    some = volumes.read_graph(spark, str(tmp_path / "g"), [1, 2, 4999])[1]
    assert some.columns == ["u", "v", "block_id"] and sorted(r.u for r in some.collect()) == [1, 2, 4999]
    assert volumes.read_graph(spark, str(tmp_path / "g"))[1].count() == 5000
