"""Graphs and label volumes derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tiles import deal
from .rounds import drop, keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def img(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of one row per vector: y, x, value."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value")).select("y", F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"))


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img with labels in tiles of 10 by 8."""
    return img(spark, sf_dir).withColumn("label", (F.floor(F.col("y") / 10) * 8 + F.floor(F.col("x") / 8)).cast("long"))


def seg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img with labels by value."""
    return img(spark, sf_dir).withColumn("label", F.floor((F.col("value") + 1) * 2).cast("long"))


def vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume of 100 rows a slice, with labels that no two slices share."""
    i = img(spark, sf_dir)
    z, y = F.floor(F.col("y") / 100), F.col("y") % 100
    label = z * 100 + F.floor(y / 20) * 8 + F.floor(F.col("x") / 8)
    return i.select(z.cast("long").alias("z"), y.cast("long").alias("y"), "x", "value", label.cast("long").alias("label"))


def vol_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume with one label over pairs of slices, so labels extend in z."""
    v = vol(spark, sf_dir)
    return v.withColumn("label", (F.floor(F.col("z") / 2) * 100 + F.col("label") % 100).cast("long"))


def g_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers that traded: u, v, w (mean price)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a, b = F.col("o_custkey") * 2, F.col("l_suppkey") * 2 + 1
    j = o.join(li, o.o_orderkey == li.l_orderkey).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "l_extendedprice")
    return j.groupBy("u", "v").agg(F.round(F.avg("l_extendedprice") / 1000 - 50, 6).alias("w"))


def g_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers of large, much discounted items: u, v, w (signed)."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_discount >= 0.09")
    a, b = F.col("l_partkey") * 2, F.col("l_suppkey") * 2 + 1
    return li.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "l_extendedprice").groupBy("u", "v").agg(F.round(F.avg("l_extendedprice") / 1000 - 50, 6).alias("w"))


#: Users of one side of a tile of pairs.
USERS = 4096
#: Kinds and hours that two users share at least.
SHARED = 4


def g_tri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who share at least four kinds and hours of events: u, v, w (how many).

    Pairs are counted in tiles of two groups of users, in an array of a task, so only
    events and the pairs that stay are moved. The table is written once and read back.
    """
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")).alias("hour"))
    e = keep(e.where("user_id is not null and event_type is not null and hour is not null").distinct())
    groups = max(1, -(-e.select("user_id").distinct().count() // USERS))
    own, other = F.pmod(F.xxhash64("user_id"), F.lit(groups)), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    rows = e.select("*", own.alias("own"), other.alias("other"))
    rows = rows.select("user_id", "event_type", "hour", (F.col("own") <= F.col("other")).alias("first"), F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    out = keep(deal(rows, "a", "b").groupBy("a", "b").applyInPandas(_shared, "u long, v long, w double"))
    drop(e)
    return out


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """(u, v, w): pairs of a user of the first group and one of the second, or of two of one group, with the number of shared kinds and hours."""
    one = pdf["a"].iloc[0] == pdf["b"].iloc[0]
    first = pdf["first"].to_numpy(bool)
    kind = np.unique(pd.factorize(pdf["event_type"])[0] * np.int64(1 << 40) + pdf["hour"].to_numpy(np.int64), return_inverse=True)[1]
    sides = []
    for part in (first, first if one else ~first):
        users, at = np.unique(pdf["user_id"].to_numpy()[part], return_inverse=True)
        order = np.argsort(kind[part], kind="stable")
        sides.append((users, at[order], np.searchsorted(kind[part][order], np.arange(kind.max() + 2))))
    (u, i, p), (v, j, q) = sides
    n = np.zeros((len(u), len(v)), np.uint16 if kind.max() < 65535 else np.int32)
    for k in range(kind.max() + 1):
        # a user has a kind once, so no cell is met twice
        n[i[p[k] : p[k + 1], None], j[q[k] : q[k + 1]]] += 1
    r, c = np.nonzero(n >= SHARED)
    if one:
        r, c = r[r < c], c[r < c]
    return pd.DataFrame({"u": np.minimum(u[r], v[c]), "v": np.maximum(u[r], v[c]), "w": n[r, c].astype(float)})


def g_cyc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g_tri with all its cycles, weights of both signs and hardly any ties."""
    g = g_tri(spark, sf_dir)
    return g.withColumn("w", F.round(F.col("w") - 4.7 + ((F.col("u") * 31 + F.col("v") * 17) % 101) / 101, 6))


def skel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as skeletons: nodes (skel, node, z, y, x, label) and edges (skel, a, b)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    n = li.select(F.col("l_orderkey").alias("skel"), (F.row_number().over(w) - 1).cast("long").alias("node"), F.col("l_linenumber").cast("long").alias("z"), (F.col("l_partkey") % 50).alias("y"), (F.col("l_suppkey") % 50).alias("x"), (F.col("l_suppkey") % 7).alias("label"))
    e = n.select("skel", F.col("node").alias("a"), (F.col("node") - 1).alias("b"))
    return n, e


SQL = {
    "img": "SELECT vec_id AS y, unnest(range(0, len(embedding))) AS x, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings",
    "seg": "SELECT y, x, value, CAST((y // 10) * 8 + x // 8 AS BIGINT) AS label FROM img",
    "seg2": "SELECT y, x, value, CAST(floor((value + 1) * 2) AS BIGINT) AS label FROM img",
    "vol": "SELECT CAST(y // 100 AS BIGINT) AS z, CAST(y % 100 AS BIGINT) AS y, x, value, CAST((y // 100) * 100 + ((y % 100) // 20) * 8 + x // 8 AS BIGINT) AS label FROM img",
    "vol_all": "SELECT z, y, x, value, CAST((z // 2) * 100 + label % 100 AS BIGINT) AS label FROM vol",
    "g_dense": "SELECT least(o_custkey * 2, l_suppkey * 2 + 1) AS u, greatest(o_custkey * 2, l_suppkey * 2 + 1) AS v, round(avg(l_extendedprice) / 1000 - 50, 6) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "g_sparse": "SELECT least(l_partkey * 2, l_suppkey * 2 + 1) AS u, greatest(l_partkey * 2, l_suppkey * 2 + 1) AS v, round(avg(l_extendedprice) / 1000 - 50, 6) AS w FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09 GROUP BY 1, 2",
    "kinds": "SELECT DISTINCT user_id, event_type, hour(ts) AS h, CAST(ts AS DATE) AS d FROM events",
    "g_tri": "SELECT a.user_id AS u, b.user_id AS v, CAST(count(*) AS DOUBLE) AS w FROM kinds a JOIN kinds b ON a.event_type = b.event_type AND a.h = b.h AND a.d = b.d AND a.user_id < b.user_id GROUP BY 1, 2 HAVING count(*) >= 4",
    "g_cyc": "SELECT u, v, round(w - 4.7 + ((u * 31 + v * 17) % 101) / 101, 6) AS w FROM g_tri",
    "skel_nodes": "SELECT l_orderkey AS skel, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS node, CAST(l_linenumber AS BIGINT) AS z, l_partkey % 50 AS y, l_suppkey % 50 AS x, l_suppkey % 7 AS label FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)",
    "skel_edges": "SELECT skel, node AS a, node - 1 AS b FROM skel_nodes",
    # contacts between face neighbours
    "seg_c": "SELECT a.y, a.x, 'x' AS axis, a.label AS la, b.label AS lb, a.value AS va, b.value AS vb FROM seg a JOIN seg b ON a.y = b.y AND a.x + 1 = b.x UNION ALL SELECT a.y, a.x, 'y', a.label, b.label, a.value, b.value FROM seg a JOIN seg b ON a.y + 1 = b.y AND a.x = b.x",
    "seg_e": "SELECT least(la, lb) AS u, greatest(la, lb) AS v, y, x, axis, CASE WHEN la < lb THEN va ELSE vb END AS vu, CASE WHEN la < lb THEN vb ELSE va END AS vv FROM seg_c WHERE la <> lb",
    "vol_c": "SELECT a.z, a.y, a.x, 'x' AS axis, a.label AS la, b.label AS lb, a.value AS va, b.value AS vb FROM vol a JOIN vol b ON a.z = b.z AND a.y = b.y AND a.x + 1 = b.x UNION ALL SELECT a.z, a.y, a.x, 'y', a.label, b.label, a.value, b.value FROM vol a JOIN vol b ON a.z = b.z AND a.y + 1 = b.y AND a.x = b.x UNION ALL SELECT a.z, a.y, a.x, 'z', a.label, b.label, a.value, b.value FROM vol a JOIN vol b ON a.z + 1 = b.z AND a.y = b.y AND a.x = b.x",
    "vol_e": "SELECT least(la, lb) AS u, greatest(la, lb) AS v, z, y, x, axis, CASE WHEN la < lb THEN va ELSE vb END AS vu, CASE WHEN la < lb THEN vb ELSE va END AS vv FROM vol_c WHERE la <> lb",
    "seg_ov": "SELECT s.label AS a, t.label AS b, count(*) AS cnt FROM seg s JOIN seg2 t ON s.y = t.y AND s.x = t.x GROUP BY 1, 2",
}


def sql(body: str, **extra: str) -> str:
    """body with the views it names, and theirs, as common table expressions."""
    import re

    known = {**SQL, **extra}
    order: list[str] = []
    open_: set[str] = set()

    def need(text: str) -> None:
        for name in known:
            if name not in open_ and re.search(rf"\b{name}\b", text):
                open_.add(name)
                need(known[name])
                order.append(name)

    need(body)
    if not order:
        return body
    recursive = any(" UNION " in known[n] and re.search(rf"\b{n}\b", known[n]) for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({known[n]})" for n in order) + f"\n{body}"
