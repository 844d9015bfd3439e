"""Many small components: how they are dealt to tasks, and groups that cross batches."""

import random

from pyspark.sql import functions as F
from test_graphs import frame

from tesserae.operators import kernels, solve


def test_small_components_are_not_solved_in_one_task(spark):
    e = frame(spark, [(3 * k, 3 * k + 1, 1.0) for k in range(60)] + [(3 * k + 1, 3 * k + 2, -1.0) for k in range(60)])
    labels = solve.per_component(e, kernels.greedy_additive)
    rows = labels.withColumn("p", F.spark_partition_id()).collect()
    assert {r.node: r.label for r in rows} == {n: n - n % 3 + 2 * (n % 3 == 2) for n in range(180)}
    assert len({r.p for r in rows}) > 1


def test_groups_cross_batches(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(100), g) for g in range(7) for _ in range(g * g)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = solve.by_group(spark.createDataFrame(rows, "x long, g long"), ["g"], lambda r: [(r[0][1], [x for x, _ in r])], "g long, xs array<long>")
        got = {r.g: r.xs for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {g: sorted(x for x, h in rows if h == g) for g in range(1, 7)}
