"""The graph of users who share events, counted in tiles of pairs."""

import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

from tesserae.operators import graph
from tesserae.plans import views


def test_shared_events_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([3, 7, 2**40, *range(100, 120)]), rng.choice(["a", "b", None]), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(1200))) for _ in range(900)]
    spark.createDataFrame([*rows, (None, "a", rows[0][2]), (3, "a", None)], "user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    met: dict = {}
    for u, t, ts in rows:
        if t is not None:
            met.setdefault((t, ts.date(), ts.hour), set()).add(u)
    n = Counter(p for users in met.values() for p in combinations(sorted(users), 2))
    want = {p: float(k) for p, k in n.items() if k >= 4}
    for most in (4096, 5):
        monkeypatch.setattr(views, "USERS", most)
        g = views.g_tri(spark, str(tmp_path))
        assert {(r.u, r.v): r.w for r in g.collect()} == want and 0 < len(want) < len(n)
        # read back from files: the pairs are not joined again by each use
        assert "Join" not in g._jdf.queryExecution().analyzed().toString()


def test_chords(spark):
    edges = spark.createDataFrame([(1, 2), (4, 1), (3, 1), (2, 4), (4, 2), (5, 9)], "u long, v long")
    paths = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (1, 1, 9), (1, 2, 5)], "path_id long, position long, node long")
    assert sorted(map(tuple, graph.chords(paths, edges).collect())) == [(0, 1, 3), (0, 1, 4), (0, 2, 4)]
