"""Every registered query of the graph and volume engine, with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import histogram
from ..operators import features as fe
from ..operators import graph as ga
from ..operators import dense, grid, images, kernels, lookup, partition, rag, skeleton, solve
from ..sources import volumes
from . import views
from .rounds import shared_path
from .two_pass import two_pass
from .views import sql

FLAGSHIP = "rag_features"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since the order of summation is not fixed."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None, digits: int = 6, **extra: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
    if oracle is not None:
        ORACLE_SQL[name] = sql(oracle, **extra)


SEG_BLOCKS = grid.Blocking([0, 0], [1 << 20, 64], [25, 20])
VOL_BLOCKS = grid.Blocking([0, 0, 0], [1 << 12, 100, 64], [2, 30, 30])
OFFSETS = [[1, 0], [0, 1], [3, 2]]
MATRIX = [[1.0, 0.5, 0.25], [0.0, 0.5, 1.0]]


def _nodes(e: DataFrame) -> DataFrame:
    return ga.nodes_of(e)


def _mod_labels(e: DataFrame, m: int) -> DataFrame:
    return _nodes(e).select("node", (F.col("node") % m).alias("label"))


def _on_tri(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query on g_tri, which is counted once."""
    return lambda s, d: f(views.g_tri(s, d))


def _affinities(s, d):
    """Affinities of the seg view at OFFSETS: 1 - |difference| of values."""
    p = grid.offset_pairs(views.seg(s, d), OFFSETS, ("value",))
    return p.select("channel", "y", "x", (1 - F.abs(F.col("a_value") - F.col("b_value"))).alias("value"))


AFF = "SELECT a.y, a.x, o.channel, a.label AS la, b.label AS lb, 1 - abs(a.value - b.value) AS value FROM seg a CROSS JOIN (VALUES (0, 1, 0), (1, 0, 1), (2, 3, 2)) o(channel, dy, dx) JOIN seg b ON b.y = a.y + o.dy AND b.x = a.x + o.dx"
NODES = "SELECT DISTINCT unnest([u, v]) AS node FROM {}"
SYM = "SELECT u AS node, v AS neighbor, w FROM {0} UNION ALL SELECT v, u, w FROM {0}"
CC = "SELECT node, node AS root FROM cc_nodes UNION SELECT s.neighbor, r.root FROM cc_walk r JOIN cc_sym s ON s.node = r.node"


def cc_sql(edges: str, body: str, nodes: str | None = None, **extra: str) -> str:
    """body over cc(node, component), the components of a small edge view."""
    return sql(body, cc_sym=f"SELECT u AS node, v AS neighbor FROM {edges} UNION ALL SELECT v, u FROM {edges}", cc_nodes=nodes or NODES.format(edges), cc_walk=CC, cc="SELECT node, min(root) AS component FROM cc_walk GROUP BY node", **extra)


def add_cc(name: str, query, edges: str, body: str, nodes: str | None = None, **extra: str) -> None:
    add(name, query)
    ORACLE_SQL[name] = cc_sql(edges, body, nodes, **extra)


# lookups and projections

add("take", lambda s, d: lookup.take(views.seg(s, d).select("y", "x", "label"), views.seg(s, d).select(F.col("label").alias("node"), (F.col("label") % 7).alias("label")).distinct()), "SELECT y, x, label % 7 AS label FROM seg")
add("take_dict", lambda s, d: lookup.take_dict(views.seg2(s, d).select("y", "x", "label"), views.seg2(s, d).select(F.col("label").alias("node"), (F.col("label") * 10).alias("label")).distinct()), "SELECT y, x, label * 10 AS label FROM seg2")
add("map_features", lambda s, d: lookup.map_features(views.seg(s, d), fe.node_mean_and_length(views.seg(s, d)).where("node % 3 = 0").select("node", F.col("mean").alias("feature")), 6).select("y", "x", "feature"), "SELECT y, x, round(CASE WHEN label % 3 = 0 AND label <> 6 THEN avg(value) OVER (PARTITION BY label) ELSE 0 END, 6) AS feature FROM seg")
add("inflate_labeling", lambda s, d: lookup.inflate(views.g_sparse(s, d).select(F.col("u").alias("node")).distinct().select("node", (F.col("node") * 3).alias("label")), 4500, -1), "SELECT r.node, coalesce(g.u * 3, -1) AS label FROM (SELECT unnest(range(0, 4501)) AS node) r LEFT JOIN (SELECT DISTINCT u FROM g_sparse) g ON g.u = r.node")
add("compose_labelings", lambda s, d: lookup.compose(_mod_labels(views.g_sparse(s, d), 11), s.range(11).select(F.col("id").alias("node"), (F.col("id") * F.col("id")).alias("label"))), "SELECT node, (node % 11) * (node % 11) AS label FROM nodes", nodes=NODES.format("g_sparse"))
add("node_labels_to_pixels", lambda s, d: lookup.take(views.vol(s, d).select("z", "y", "x", "label"), rag.region_nodes(views.vol(s, d)).select("node", F.floor(F.col("node") / 100).alias("label"))), "SELECT z, y, x, label // 100 AS label FROM vol")
add("edges_to_volume", lambda s, d: rag.edges_to_volume(views.seg(s, d), rag.edge_lengths(views.seg(s, d)).withColumn("w", F.col("length").cast("double"))), "SELECT s.y, s.x, coalesce(p.w, 0.0) AS w FROM seg s LEFT JOIN (SELECT y, x, arg_max(w, u * 1000000 + v) AS w FROM (SELECT e.*, CAST(count(*) OVER (PARTITION BY u, v) / 2 AS DOUBLE) AS w FROM both_sides e) GROUP BY y, x) p ON p.y = s.y AND p.x = s.x", both_sides="SELECT y, x, u, v FROM seg_e UNION ALL SELECT CASE WHEN axis = 'y' THEN y + 1 ELSE y END, CASE WHEN axis = 'x' THEN x + 1 ELSE x END, u, v FROM seg_e")
add("node_to_edge_labels", _on_tri(lambda e: lookup.node_to_edge_labels(_mod_labels(e, 4), e.select("u", "v"))), "SELECT u, v, u % 4 <> v % 4 AS cut FROM g_tri")
add("edge_map_from_nodes", lambda s, d: lookup.edge_map_from_nodes(rag.region_graph(views.seg(s, d)), fe.node_mean_and_length(views.seg(s, d)), "mean", lambda a, b: F.abs(a - b)), "SELECT e.u, e.v, round(abs(a.m - b.m), 6) AS w FROM (SELECT DISTINCT u, v FROM seg_e) e JOIN means a ON a.label = e.u JOIN means b ON b.label = e.v", means="SELECT label, avg(value) AS m FROM seg GROUP BY label")
add("edge_ids", lambda s, d: lookup.with_edge_ids(views.g_dense(s, d).select("u", "v")), "SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS edge_id FROM g_dense")
add("find_edges", lambda s, d: lookup.find_edges(views.g_sparse(s, d).select(F.col("v").alias("a"), F.when(F.col("u") % 4 == 0, F.col("u")).otherwise(F.col("u") + 1).alias("b")).distinct(), lookup.with_edge_ids(views.g_sparse(s, d))), "SELECT q.a, q.b, coalesce(i.edge_id, -1) AS edge_id FROM (SELECT DISTINCT v AS a, CASE WHEN u % 4 = 0 THEN u ELSE u + 1 END AS b FROM g_sparse) q LEFT JOIN ids i ON i.u = least(q.a, q.b) AND i.v = greatest(q.a, q.b)", ids="SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS edge_id FROM g_sparse")
add("graph_counts", lambda s, d: lookup.graph_counts(views.g_dense(s, d)), "SELECT count(DISTINCT n) AS n_nodes, max(n) AS max_node, count(*) // 2 AS n_edges FROM (SELECT unnest([u, v]) AS n FROM g_dense)")
add("neighborhoods", lambda s, d: lookup.neighborhoods(_nodes(views.g_dense(s, d)).where("node % 10 = 0"), views.g_dense(s, d)), "SELECT node, neighbor FROM sym WHERE node % 10 = 0", sym=SYM.format("g_dense"))
add("subgraph_inner", lambda s, d: lookup.subgraph(_nodes(views.g_dense(s, d)).where("node % 3 = 0"), views.g_dense(s, d).select("u", "v"))[0], "SELECT u, v FROM g_dense WHERE u % 3 = 0 AND v % 3 = 0")
add("subgraph_outer", lambda s, d: lookup.subgraph(_nodes(views.g_dense(s, d)).where("node % 3 = 0"), views.g_dense(s, d).select("u", "v"))[1], "SELECT u, v FROM g_dense WHERE (u % 3 = 0) <> (v % 3 = 0)")
add("edges_from_nodes", _on_tri(lambda e: lookup.edges_from_nodes(_nodes(e).where("node % 2 = 0"), e)), "SELECT u, v, w FROM g_tri WHERE u % 2 = 0 AND v % 2 = 0")
add("unique_labels", lambda s, d: views.seg2(s, d).select("label").distinct(), "SELECT DISTINCT label FROM seg2")
add("make_dense", lambda s, d: lookup.make_dense(_nodes(views.g_sparse(s, d)), "node"), "SELECT node, dense_rank() OVER (ORDER BY node) - 1 AS dense FROM nodes", nodes=NODES.format("g_sparse"))
add("run_lengths", lambda s, d: lookup.run_lengths(views.img(s, d).select("y", "x", (F.col("value") > 0).cast("int").alias("bit")), "y", "x"), "SELECT y, run, count(*) FILTER (WHERE x >= 0) AS length FROM (SELECT y, x, sum(ch) OVER (PARTITION BY y ORDER BY x) - 1 + (CASE WHEN first_value(bit) OVER (PARTITION BY y ORDER BY x) = 1 THEN 1 ELSE 0 END) AS run FROM (SELECT *, CASE WHEN lag(bit) OVER (PARTITION BY y ORDER BY x) = bit THEN 0 ELSE 1 END AS ch FROM bits)) GROUP BY y, run UNION ALL SELECT y, 0, 0 FROM bits WHERE x = 0 AND bit = 1", bits="SELECT y, x, CASE WHEN value > 0 THEN 1 ELSE 0 END AS bit FROM img")
add("probability_from_affinities", lambda s, d: lookup.probability_from_affinities(views.img(s, d).select("y", "x", F.col("value").alias("ay"), (-F.col("value")).alias("ax"))), "SELECT y, x, round((value - value + coalesce(lag(value) OVER (PARTITION BY x ORDER BY y), 0) + coalesce(lag(-value) OVER (PARTITION BY y ORDER BY x), 0)) / 4, 6) AS value FROM img")

# grids

add("grid_nodes", lambda s, d: grid.grid_nodes(s, (20, 30)), "SELECT y * 30 + x AS node, y, x FROM (SELECT unnest(range(0, 20)) AS y) CROSS JOIN (SELECT unnest(range(0, 30)) AS x)")
add("grid_edges", lambda s, d: grid.grid_edges(s, (7, 8, 9)), "SELECT (z * 8 + y) * 9 + x AS u, ((z + dz) * 8 + y + dy) * 9 + x + dx AS v, axis FROM (SELECT unnest(range(0, 7)) AS z) CROSS JOIN (SELECT unnest(range(0, 8)) AS y) CROSS JOIN (SELECT unnest(range(0, 9)) AS x) CROSS JOIN (VALUES ('z', 1, 0, 0), ('y', 0, 1, 0), ('x', 0, 0, 1)) o(axis, dz, dy, dx) WHERE z + dz < 7 AND y + dy < 8 AND x + dx < 9")
add("long_range_grid", lambda s, d: grid.long_range_grid_edges(s, (4, 8, 9), [[1, 0, 0], [0, -3, 2], [2, 2, -1]]), "SELECT least(a, b) AS u, greatest(a, b) AS v, channel FROM (SELECT (z * 8 + y) * 9 + x AS a, ((z + dz) * 8 + y + dy) * 9 + x + dx AS b, channel FROM (SELECT unnest(range(0, 4)) AS z) CROSS JOIN (SELECT unnest(range(0, 8)) AS y) CROSS JOIN (SELECT unnest(range(0, 9)) AS x) CROSS JOIN (VALUES (0, 1, 0, 0), (1, 0, -3, 2), (2, 2, 2, -1)) o(channel, dz, dy, dx) WHERE z + dz BETWEEN 0 AND 3 AND y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 8)")
for mode, expr in {"min": "least(va, vb)", "max": "greatest(va, vb)", "sum": "va + vb", "prod": "va * vb", "l1": "abs(va - vb)", "l2": "(va - vb) * (va - vb)"}.items():
    add(f"image_to_edges_{mode}", lambda s, d, mode=mode: grid.image_to_edges(views.img(s, d), (1 << 20, 64), mode), f"SELECT y * 64 + x AS u, (y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END)) * 64 + x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END) AS v, round({expr}, 6) AS w FROM seg_c")
add("image_to_edges_interpixel", lambda s, d: grid.image_to_edges(views.img(s, d).where("x < 63"), (1 << 20, 32), "interpixel"), "SELECT (y // 2) * 32 + x // 2 AS u, ((y + 1) // 2) * 32 + (x + 1) // 2 AS v, round(value, 6) AS w FROM img WHERE x < 63 AND (y % 2) + (x % 2) = 1")
CHANNELS = "SELECT y, x, [value, value * value + 1.0] AS c FROM img"
for name, expr in {"l1": "abs(a.c[1] - b.c[1]) + abs(a.c[2] - b.c[2])", "l2": "sqrt((a.c[1] - b.c[1]) * (a.c[1] - b.c[1]) + (a.c[2] - b.c[2]) * (a.c[2] - b.c[2]))", "cosine": "1 - (a.c[1] * b.c[1] + a.c[2] * b.c[2]) / sqrt((a.c[1] * a.c[1] + a.c[2] * a.c[2]) * (b.c[1] * b.c[1] + b.c[2] * b.c[2]))"}.items():
    add(f"channels_to_edges_{name}", lambda s, d, name=name: grid.channels_to_edges(views.img(s, d).withColumn("value", F.array(F.col("value"), F.col("value") * F.col("value") + 1.0)), name, OFFSETS, (2, 2)).select("y", "x", "channel", "w"), f"SELECT a.y, a.x, o.channel, round({expr}, 6) AS w FROM chan a CROSS JOIN (VALUES (0, 1, 0), (1, 0, 1), (2, 3, 2)) o(channel, dy, dx) JOIN chan b ON b.y = a.y + dy AND b.x = a.x + dx WHERE a.y % 2 = 0 AND a.x % 2 = 0", chan=CHANNELS)
add("affinities_to_edges", lambda s, d: grid.affinities_to_edges(_affinities(s, d), (1 << 20, 64), OFFSETS, (2, 4)), "SELECT y * 64 + x AS u, (y + dy) * 64 + x + dx AS v, channel, round(value, 6) AS w FROM (SELECT a.*, dy, dx FROM aff a JOIN (VALUES (0, 1, 0), (1, 0, 1), (2, 3, 2)) o(c, dy, dx) ON o.c = a.channel) WHERE channel < 2 OR (y % 2 = 0 AND x % 4 = 0)", aff=AFF)
add("euclidean_edges", lambda s, d: grid.euclidean_edges(views.img(s, d).withColumn("value", (F.col("value") > -0.1).cast("int")), (1 << 20, 64), (4.0, 1.5)), "SELECT y * 64 + x AS u, (y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END)) * 64 + x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END) AS v, CASE WHEN va <= -0.1 OR vb <= -0.1 THEN CAST('Infinity' AS DOUBLE) WHEN axis = 'y' THEN 4.0 ELSE 1.5 END AS w FROM seg_c")
add("edges_to_pixels", lambda s, d: grid.project_edges_to_pixels(lookup.with_edge_ids(grid.grid_edges(s, (9, 11))), s, (9, 11)), "SELECT o.axis, y, x, coalesce(edge_id, -1) AS edge_id FROM (SELECT unnest(range(0, 9)) AS y) CROSS JOIN (SELECT unnest(range(0, 11)) AS x) CROSS JOIN (VALUES ('y'), ('x')) o(axis) LEFT JOIN (SELECT u, axis, row_number() OVER (ORDER BY u, v) - 1 AS edge_id FROM (SELECT y * 11 + x AS u, (y + dy) * 11 + x + dx AS v, axis FROM (SELECT unnest(range(0, 9)) AS y) CROSS JOIN (SELECT unnest(range(0, 11)) AS x) CROSS JOIN (VALUES ('y', 1, 0), ('x', 0, 1)) p(axis, dy, dx) WHERE y + dy < 9 AND x + dx < 11)) e ON e.u = y * 11 + x AND e.axis = o.axis")
add("block_ids", lambda s, d: views.img(s, d).select("y", "x", SEG_BLOCKS.block_id([F.col("y"), F.col("x")]).alias("block_id")), "SELECT y, x, (y // 25) * 4 + x // 20 AS block_id FROM img")
add("block_table", lambda s, d: grid.Blocking([0, 0, 0], [5, 6, 7], [3, 3, 3], [0, 1, 0]).table(s, (1, 1, 1)))
add("block_neighbors", lambda s, d: s.range(12).select("id", *[grid.Blocking([0, 0, 0], [5, 6, 7], [3, 3, 3]).neighbor(F.col("id"), k, low).alias(f"n{k}{int(low)}") for k in range(3) for low in (True, False)]), "SELECT id, CASE WHEN id // 6 = 0 THEN -1 ELSE id - 6 END AS n01, CASE WHEN id // 6 = 1 THEN -1 ELSE id + 6 END AS n00, CASE WHEN id // 3 % 2 = 0 THEN -1 ELSE id - 3 END AS n11, CASE WHEN id // 3 % 2 = 1 THEN -1 ELSE id + 3 END AS n10, CASE WHEN id % 3 = 0 THEN -1 ELSE id - 1 END AS n21, CASE WHEN id % 3 = 2 THEN -1 ELSE id + 1 END AS n20 FROM (SELECT unnest(range(0, 12)) AS id)")
add("blocks_in_box", lambda s, d: grid.Blocking([0, 0], [100, 64], [30, 20]).in_box(s, (10, 10), (70, 50), False), "SELECT p * 4 + q AS block_id FROM (SELECT unnest(range(0, 4)) AS p) CROSS JOIN (SELECT unnest(range(0, 4)) AS q) WHERE p * 30 < 70 AND least(p * 30 + 30, 100) > 10 AND q * 20 < 50 AND least(q * 20 + 20, 64) > 10")

# region graphs

add("region_graph", lambda s, d: rag.region_graph(views.seg(s, d)), "SELECT DISTINCT u, v FROM seg_e")
add("region_graph_3d", lambda s, d: rag.region_graph(views.vol(s, d), True), "SELECT DISTINCT u, v FROM vol_e WHERE u <> 0")
add("stacked_region_graph", lambda s, d: rag.stacked_region_graph(views.vol(s, d)), "SELECT DISTINCT u, v, axis <> 'z' AS in_slice, z FROM vol_e")
add("slice_summary", lambda s, d: rag.slice_summary(views.vol(s, d)), "SELECT z, min(label) AS min_label, max(label) AS max_label, count(DISTINCT label) AS n_nodes FROM vol GROUP BY z")
add("slice_edge_counts", lambda s, d: rag.slice_edge_counts(rag.stacked_region_graph(views.vol(s, d))), "SELECT z, n_in, n_between, CAST(sum(n_in) OVER (ORDER BY z) - n_in AS BIGINT) AS in_offset, CAST(sum(n_between) OVER (ORDER BY z) - n_between + sum(n_in) OVER () AS BIGINT) AS between_offset FROM (SELECT z, CAST(sum(CASE WHEN axis <> 'z' THEN 1 ELSE 0 END) AS BIGINT) AS n_in, CAST(sum(CASE WHEN axis = 'z' THEN 1 ELSE 0 END) AS BIGINT) AS n_between FROM (SELECT DISTINCT u, v, z, CASE WHEN axis = 'z' THEN 'z' ELSE 'xy' END AS axis FROM vol_e) GROUP BY z)")
add("block_region_graph", lambda s, d: rag.block_region_graph(views.seg(s, d), SEG_BLOCKS), "SELECT DISTINCT ((y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END)) // 25) * 4 + (x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END)) // 20 AS block_id, u, v FROM seg_e")
add("merge_subgraphs", lambda s, d: rag.merge_subgraphs(rag.block_region_graph(views.seg(s, d), SEG_BLOCKS)), "SELECT DISTINCT u, v FROM seg_e")
add("map_edge_ids", lambda s, d: rag.map_edge_ids(rag.block_region_graph(views.seg(s, d), SEG_BLOCKS), lookup.with_edge_ids(rag.region_graph(views.seg(s, d)))), "SELECT b.u, b.v, b.block_id, i.edge_id FROM (SELECT DISTINCT ((y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END)) // 25) * 4 + (x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END)) // 20 AS block_id, u, v FROM seg_e) b JOIN ids i ON i.u = b.u AND i.v = b.v", ids="SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS edge_id FROM (SELECT DISTINCT u, v FROM seg_e)")
add("coarser_blocks", lambda s, d: rag.coarser_blocks(rag.block_region_graph(views.seg(s, d), SEG_BLOCKS), SEG_BLOCKS, grid.Blocking([0, 0], [1 << 20, 64], [50, 40])), "SELECT DISTINCT ((y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END)) // 50) * 2 + (x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END)) // 40 AS block_id, u, v FROM seg_e")
add("long_range_adjacency", lambda s, d: rag.long_range_adjacency(views.vol(s, d), 3), "SELECT DISTINCT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v, a.z, b.z - a.z AS dz FROM vol a JOIN vol b ON a.y = b.y AND a.x = b.x AND b.z - a.z BETWEEN 2 AND 3 WHERE a.label <> b.label")
add("lifted_edges_from_offsets", lambda s, d: rag.lifted_edges(views.seg(s, d), rag.region_graph(views.seg(s, d)), [[9, 9], [0, 17], [-12, 3]]), "SELECT DISTINCT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v FROM seg a CROSS JOIN (VALUES (9, 9), (0, 17), (-12, 3)) o(dy, dx) JOIN seg b ON b.y = a.y + dy AND b.x = a.x + dx WHERE a.label <> b.label AND NOT EXISTS (SELECT 1 FROM rag r WHERE r.u = least(a.label, b.label) AND r.v = greatest(a.label, b.label))", rag="SELECT DISTINCT u, v FROM seg_e")
add("edge_coordinates", lambda s, d: rag.edge_coordinates(views.seg(s, d)).select("u", "v", "y", "x", "side"), "SELECT least(la, lb) AS u, greatest(la, lb) AS v, y, x, la AS side FROM seg_c WHERE la <> lb UNION ALL SELECT least(la, lb), greatest(la, lb), y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END), x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END), lb FROM seg_c WHERE la <> lb")
add("topological_coordinates", lambda s, d: rag.topological_coordinates(views.seg(s, d)), "SELECT u, v, 2 * y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END) AS y, 2 * x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END) AS x FROM seg_e")
add("edge_lengths", lambda s, d: rag.edge_lengths(views.vol(s, d)), "SELECT u, v, count(*) AS length FROM vol_e GROUP BY u, v")
add("one_axis_edges", lambda s, d: rag.one_axis_edges(views.seg2(s, d)), "SELECT least(la, lb) AS u, greatest(la, lb) AS v, CASE WHEN count(DISTINCT axis) = 1 THEN 1 ELSE 2 END::BIGINT AS kind FROM (SELECT a.label AS la, b.label AS lb, 'x' AS axis FROM seg2 a JOIN seg2 b ON a.y = b.y AND a.x + 1 = b.x UNION ALL SELECT a.label, b.label, 'y' FROM seg2 a JOIN seg2 b ON a.y + 1 = b.y AND a.x = b.x) WHERE la <> lb GROUP BY 1, 2")
add("block_boundary_edges", lambda s, d: rag.block_boundary_edges(views.seg(s, d), SEG_BLOCKS), "SELECT DISTINCT u, v FROM seg_e WHERE (axis = 'y' AND (y + 1) % 25 = 0) OR (axis = 'x' AND (x + 1) % 20 = 0)")
add("z_extended", lambda s, d: rag.z_extended(views.vol_all(s, d)), "SELECT label AS node FROM vol_all GROUP BY label HAVING count(DISTINCT z) > 1")
add("skip_edges", lambda s, d: rag.skip_edges(views.vol(s, d), [1]), "SELECT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v, a.z, b.z - a.z AS dz, count(*) AS length FROM vol a JOIN vol b ON a.y = b.y AND a.x = b.x AND a.z = 0 AND b.z = 2 WHERE a.label <> b.label GROUP BY 1, 2, 3, 4")
add("nodes_to_blocks", lambda s, d: rag.nodes_to_blocks(views.seg(s, d), SEG_BLOCKS, (2, 3)), "SELECT DISTINCT p * 4 + q AS block_id, label FROM seg JOIN (SELECT unnest(range(0, (SELECT (max(y) + 2) // 25 + 1 FROM img))) AS p) ON y >= p * 25 - 2 AND y < p * 25 + 27 JOIN (SELECT unnest(range(0, 4)) AS q) ON x >= q * 20 - 3 AND x < q * 20 + 23")
add("block_mapping", lambda s, d: rag.block_mapping(views.seg2(s, d), grid.Blocking([0, 0], [1 << 20, 64], [10, 4])), "SELECT label, p * 10 AS begin0, p * 10 + 10 AS end0, min(q) * 4 AS begin1, max(q) * 4 + 4 AS end1 FROM (SELECT label, p, q, q - row_number() OVER (PARTITION BY label, p ORDER BY q) AS g FROM (SELECT DISTINCT label, y // 10 AS p, x // 4 AS q FROM seg2)) GROUP BY label, p, g")

# features

SAMPLES = "SELECT u, v, unnest([vu, vv]) AS value FROM seg_e"
MOM = "round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS count"
add("rag_features", lambda s, d: fe.mean_and_length(fe.boundary_samples(views.seg(s, d))), "SELECT u, v, round(avg(value), 6) AS mean, count(*) AS count FROM samples GROUP BY u, v", samples=SAMPLES)
add("node_features", lambda s, d: fe.node_mean_and_length(views.seg(s, d)), "SELECT label AS node, round(avg(value), 6) AS mean, count(*) AS count FROM seg GROUP BY label")
add("edge_moments", lambda s, d: fe.moments(fe.boundary_samples(views.seg(s, d)), ("u", "v")), f"SELECT u, v, {MOM} FROM samples GROUP BY u, v", samples=SAMPLES)
add("node_moments", lambda s, d: fe.moments(views.vol(s, d), ("label",)), f"SELECT label, {MOM} FROM vol GROUP BY label")
HIST = "SELECT u, v, bin, sum(n) AS n FROM (SELECT u, v, unnest([lo, least(lo + 1, 39)]) AS bin, unnest([1 - (b - lo), b - lo]) AS n FROM (SELECT u, v, b, floor(b) AS lo FROM (SELECT u, v, greatest(0.0, least(1.0, value + 0.5)) * 39 AS b FROM samples))) GROUP BY u, v, bin"
CUM = "SELECT u, v, bin, n, sum(n) OVER (PARTITION BY u, v ORDER BY bin) - n AS cum, sum(n) OVER (PARTITION BY u, v) AS total FROM hist WHERE n > 0"
QS = ", ".join(f"round(arg_min(CASE WHEN bin = 0 THEN -0.5 ELSE -0.5 + (bin - 1 + 0.0125 + (total * {q} - cum) / n) / 39 END, bin) FILTER (WHERE cum <= total * {q} AND cum + n >= total * {q}), 4) AS q{int(q * 100)}" for q in histogram.QUANTILES)
add("standard_features", lambda s, d: rounded(fe.standard_features(fe.boundary_samples(views.seg(s, d)), ("u", "v"), -0.5, 0.5).select("u", "v", *[f"q{int(q * 100)}" for q in histogram.QUANTILES]), 4), f"SELECT u, v, {QS} FROM cum GROUP BY u, v", samples=SAMPLES, hist=HIST, cum=CUM)
add("edge_histograms", lambda s, d: histogram.fill(fe.boundary_samples(views.seg(s, d)), ["u", "v"], "value", -0.5, 0.5).select("u", "v", F.posexplode("hist").alias("bin", "n")).where("n > 1e-9"), "SELECT u, v, CAST(bin AS INTEGER) AS bin, round(n, 6) AS n FROM hist WHERE n > 1e-9", samples=SAMPLES, hist=HIST)
add("edge_features_one_side", lambda s, d: fe.moments(fe.boundary_samples(views.seg(s, d), 1), ("u", "v")), f"SELECT u, v, {MOM} FROM (SELECT u, v, vu AS value FROM seg_e) GROUP BY u, v")
add("slice_features_xy", lambda s, d: fe.slice_features(views.vol(s, d), "xy"), f"SELECT u, v, {MOM} FROM (SELECT u, v, unnest([vu, vv]) AS value FROM vol_e WHERE axis <> 'z') GROUP BY u, v")
add("slice_features_z", lambda s, d: fe.slice_features(views.vol(s, d), "z", 2), f"SELECT u, v, {MOM} FROM (SELECT u, v, vv AS value FROM vol_e WHERE axis = 'z') GROUP BY u, v")
add("geometric_nodes", lambda s, d: fe.geometric_nodes(views.vol(s, d)), "SELECT label AS node, count(*) AS count, round(avg(z), 6) AS center_z, round(avg(y), 6) AS center_y, round(avg(x), 6) AS center_x, " + ", ".join(f"round(covar_pop({a}, {b}), 6) AS cov_{a}{b}" for a, b in ("zz", "zy", "zx", "yy", "yx", "xx")) + " FROM vol GROUP BY label")
add("principal_axes", lambda s, d: fe.principal_axes(views.seg(s, d)))
D2 = "sqrt(({0}y - {1}y) * ({0}y - {1}y) + ({0}x - {1}x) * ({0}x - {1}x))"
add("geometric_edges", lambda s, d: fe.geometric_edges(views.seg(s, d)), f"SELECT e.u, e.v, size, abs(a.n - b.n) AS diff, a.n + b.n AS sum, a.n * b.n AS product, least(a.n, b.n) AS min, greatest(a.n, b.n) AS max, round(least(a.n, b.n) / greatest(a.n, b.n), 6) AS ratio, round(size / least(a.n, b.n), 6) AS ratio_min, round(size / greatest(a.n, b.n), 6) AS ratio_max, round({D2.format('a.', 'b.')}, 6) AS d_uv, round({D2.format('a.', 'e.')}, 6) AS d_ue, round({D2.format('b.', 'e.')}, 6) AS d_ve, round(((a.y - e.y) * (b.y - e.y) + (a.x - e.x) * (b.x - e.x)) / ({D2.format('a.', 'e.')} * {D2.format('b.', 'e.')}), 6) AS cosine FROM (SELECT u, v, count(*) AS size, avg(y) AS y, avg(x) AS x FROM seg_e GROUP BY u, v) e JOIN geo a ON a.label = e.u JOIN geo b ON b.label = e.v", geo="SELECT label, count(*) AS n, avg(y) AS y, avg(x) AS x FROM seg GROUP BY label")
add("affinity_means", lambda s, d: fe.affinity_means(fe.affinity_samples(views.seg(s, d), _affinities(s, d), OFFSETS), rag.region_graph(views.seg(s, d))), "SELECT r.u, r.v, round(coalesce(m.mean, 0), 6) AS mean FROM (SELECT DISTINCT u, v FROM seg_e) r LEFT JOIN (SELECT least(la, lb) AS u, greatest(la, lb) AS v, avg(value) AS mean FROM aff WHERE la <> lb GROUP BY 1, 2) m ON m.u = r.u AND m.v = r.v", aff=AFF)
WEIGHTED = "round(sum(w * value) / sum(w), 6) AS mean, round(sum(w), 6) AS length, round(max(value), 6) AS max FROM (SELECT *, [2.0, 4.0, 0.5][channel + 1] AS w FROM aff)"
add("weighted_affinities", lambda s, d: fe.weighted_affinities(fe.affinity_samples(views.seg(s, d), _affinities(s, d), OFFSETS), [2, 4, 0.5]), f"SELECT least(la, lb) AS u, greatest(la, lb) AS v, {WEIGHTED} WHERE la <> lb GROUP BY 1, 2", aff=AFF)
add("weighted_affinities_inside", lambda s, d: fe.weighted_affinities(fe.affinity_samples(views.seg(s, d), _affinities(s, d), OFFSETS), [2, 4, 0.5], inside=True), f"SELECT la AS node, {WEIGHTED} WHERE la = lb GROUP BY 1", aff=AFF)
NEAR = "SELECT least(la, lb) AS u, greatest(la, lb) AS v, value FROM aff WHERE la <> lb"
add("affinity_features_local", lambda s, d: fe.lifted_affinities(fe.affinity_samples(views.seg(s, d), _affinities(s, d), OFFSETS), rag.region_graph(views.seg(s, d)))[0], f"SELECT u, v, {MOM} FROM near SEMI JOIN rag USING (u, v) GROUP BY u, v", aff=AFF, near=NEAR, rag="SELECT DISTINCT u, v FROM seg_e")
add("affinity_features_lifted", lambda s, d: fe.lifted_affinities(fe.affinity_samples(views.seg(s, d), _affinities(s, d), OFFSETS), rag.region_graph(views.seg(s, d)))[1], f"SELECT u, v, {MOM} FROM near ANTI JOIN rag USING (u, v) GROUP BY u, v", aff=AFF, near=NEAR, rag="SELECT DISTINCT u, v FROM seg_e")
add("long_range_features", lambda s, d: fe.long_range_features(views.vol(s, d), grid.offset_pairs(views.vol(s, d), [[2, 0, 0], [3, 0, 0]], ("value",)).select("channel", "z", "y", "x", (F.col("a_value") + F.col("b_value")).alias("value")), 3), f"SELECT least(la, lb) AS u, greatest(la, lb) AS v, dz, {MOM} FROM (SELECT a.label AS la, b.label AS lb, b.z - a.z AS dz, a.value + b.value AS value FROM vol a JOIN vol b ON a.y = b.y AND a.x = b.x AND b.z - a.z BETWEEN 2 AND 3) WHERE la <> lb GROUP BY 1, 2, 3")
add("block_features", lambda s, d: fe.block_features(views.seg(s, d), SEG_BLOCKS), f"SELECT ((y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END)) // 25) * 4 + (x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END)) // 20 AS block_id, u, v, {MOM} FROM (SELECT y, x, axis, u, v, unnest([vu, vv]) AS value FROM seg_e) GROUP BY 1, 2, 3")
add("merge_features", lambda s, d: fe.merge_features(fe.block_features(views.seg(s, d), SEG_BLOCKS), ("u", "v")), f"SELECT u, v, {MOM} FROM samples GROUP BY u, v", samples=SAMPLES)
add("features_on_graph", lambda s, d: fe.features_on_graph(views.seg(s, d), rag.region_graph(views.seg(s, d)).where("u % 2 = 0"), True), f"SELECT u, v, {MOM} FROM samples WHERE u % 2 = 0 AND u <> 0 GROUP BY u, v", samples=SAMPLES)
MORPH = "label, count(*) AS size, round(avg(z), 6) AS com_z, round(avg(y), 6) AS com_y, round(avg(x), 6) AS com_x, min(z) AS min_z, min(y) AS min_y, min(x) AS min_x, max(z) AS max_z, max(y) AS max_y, max(x) AS max_x FROM vol_all GROUP BY label"
add("morphology", lambda s, d: fe.morphology(views.vol_all(s, d)), f"SELECT {MORPH}")
add("merge_morphology", lambda s, d: fe.merge_morphology(fe.morphology(views.vol_all(s, d).where("z % 2 = 0")).union(fe.morphology(views.vol_all(s, d).where("z % 2 = 1"))), ("z", "y", "x")), f"SELECT {MORPH}")
add("central_moments", lambda s, d: fe.central_moments(views.seg(s, d), ("label",)), "SELECT label, round(m, 6) AS mean, round(sum(value), 6) AS sum, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg((value - m) * (value - m)), 6) AS moment2, round(avg((value - m) * (value - m) * (value - m)), 6) AS moment3 FROM (SELECT *, avg(value) OVER (PARTITION BY label) AS m FROM seg) GROUP BY label, m")

# partitions

OV = lambda s, d: partition.overlaps(views.seg(s, d), views.seg2(s, d))
add("overlaps", OV, "SELECT a, b, cnt FROM seg_ov")
add("overlap_lists", lambda s, d: partition.overlap_lists(OV(s, d)), "SELECT a, b, cnt, row_number() OVER (PARTITION BY a ORDER BY cnt DESC, b) AS rank, round(cnt / sum(cnt) OVER (PARTITION BY a), 6) AS share FROM seg_ov")
add("different_overlap", lambda s, d: partition.different_overlap(rag.region_graph(views.seg(s, d)), OV(s, d)), digits=10, oracle="SELECT e.u, e.v, round(1 - coalesce(sum(p.share * q.share), 0), 10) AS different FROM (SELECT DISTINCT u, v FROM seg_e) e LEFT JOIN shares p ON p.a = e.u LEFT JOIN shares q ON q.a = e.v AND q.b = p.b GROUP BY e.u, e.v", shares="SELECT a, b, cnt / sum(cnt) OVER (PARTITION BY a) AS share FROM seg_ov")
add("bleeding", lambda s, d: partition.bleeding(OV(s, d)), "SELECT a, round(max(cnt) / sum(cnt), 6) AS bleeding FROM seg_ov GROUP BY a")
add("max_overlap", lambda s, d: partition.max_overlap(OV(s, d)), "SELECT a, b AS label, cnt FROM seg_ov QUALIFY row_number() OVER (PARTITION BY a ORDER BY cnt DESC, b) = 1")
add("max_overlap_ignore", lambda s, d: partition.max_overlap(OV(s, d), ignore=2), "SELECT a, b AS label, cnt FROM seg_ov WHERE b <> 2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY cnt DESC, b) = 1")
add("max_overlap_downvote", lambda s, d: partition.max_overlap(OV(s, d), downvote=1), "SELECT a, b AS label, cnt FROM seg_ov QUALIFY row_number() OVER (PARTITION BY a ORDER BY (b <> 1) DESC, cnt DESC, b) = 1")
add("overlaps_zero", lambda s, d: partition.overlaps_zero(OV(s, d).withColumn("b", F.col("b") - 2)), "SELECT a, bool_or(b = 2) AS zero FROM seg_ov GROUP BY a")
add("merge_overlaps", lambda s, d: partition.merge_overlaps(OV(s, d).withColumn("a", F.floor(F.col("a") / 2)), s.range(300).select(F.col("id").alias("label"))), "SELECT l.a, coalesce(m.b, 0) AS label, coalesce(m.c, 0) AS cnt FROM (SELECT unnest(range(0, 300)) AS a) l LEFT JOIN (SELECT a // 2 AS a, b, CAST(sum(cnt) AS BIGINT) AS c FROM seg_ov GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a // 2 ORDER BY sum(cnt) DESC, b) = 1) m ON m.a = l.a")
RAND = "SELECT round(tt, 6) AS true_joins, round(t - ta - tb + tt, 6) AS true_cuts, round(tb - tt, 6) AS false_joins, round(ta - tt, 6) AS false_cuts, round(tt / tb, 6) AS join_precision, round(tt / ta, 6) AS join_recall, round((t - ta - tb + tt) / (t - tb), 6) AS cut_precision, round((t - ta - tb + tt) / (t - ta), 6) AS cut_recall, round((t - ta - tb + 2 * tt) / t, 6) AS rand_index, round((ta + tb - 2 * tt) / t, 6) AS rand_error FROM (SELECT sum(cnt::DOUBLE) * (sum(cnt::DOUBLE) - 1) / 2 AS t, sum(cnt::DOUBLE * (cnt - 1) / 2) AS tt FROM o) CROSS JOIN (SELECT sum(s::DOUBLE * (s - 1) / 2) AS ta FROM (SELECT sum(cnt) AS s FROM o GROUP BY a)) CROSS JOIN (SELECT sum(s::DOUBLE * (s - 1) / 2) AS tb FROM (SELECT sum(cnt) AS s FROM o GROUP BY b))"
add("rand_error", lambda s, d: partition.rand_error(OV(s, d)), RAND, o="SELECT * FROM seg_ov")
add("rand_error_ignore", lambda s, d: partition.rand_error(OV(s, d), True), RAND, o="SELECT * FROM seg_ov WHERE a <> 0 AND b <> 0")
VI = "SELECT round(2 * hab - ha - hb, 6) AS vi, round(hab - ha, 6) AS vi_false_cut, round(hab - hb, 6) AS vi_false_join FROM (SELECT -sum(cnt / t * log2(cnt / t)) AS hab FROM o, tot) CROSS JOIN (SELECT -sum(s / t * log2(s / t)) AS ha FROM (SELECT sum(cnt) AS s FROM o GROUP BY a), tot) CROSS JOIN (SELECT -sum(s / t * log2(s / t)) AS hb FROM (SELECT sum(cnt) AS s FROM o GROUP BY b), tot)"
add("variation_of_information", lambda s, d: partition.variation_of_information(OV(s, d)), VI, o="SELECT * FROM seg_ov", tot="SELECT sum(cnt)::DOUBLE AS t FROM o")


def _votes(s, d):
    li = views.table(s, d, "lineitem")
    return li.select((F.col("l_suppkey") % 20).alias("u"), (F.col("l_partkey") % 30 + 20).alias("v"), (F.col("l_quantity") > 25).cast("int").alias("indicator"), F.col("l_linenumber").alias("size"), (F.col("l_orderkey") % 2).alias("half"))


VOTES = "SELECT l_suppkey % 20 AS u, l_partkey % 30 + 20 AS v, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS indicator, l_linenumber AS size FROM lineitem"
add("merge_votes", lambda s, d: partition.merge_votes(_votes(s, d)), "SELECT u, v, CAST(sum(indicator) AS BIGINT) AS merges, count(*) AS total FROM votes GROUP BY u, v", votes=VOTES)
add("merge_votes_weighted", lambda s, d: partition.merge_votes(_votes(s, d), True), "SELECT u, v, CAST(sum(indicator * size) AS BIGINT) AS merges, CAST(sum(size) AS BIGINT) AS total FROM votes GROUP BY u, v", votes=VOTES)
add("merge_merged_votes", lambda s, d: partition.merge_merged_votes(partition.merge_votes(_votes(s, d).where("half = 0")).union(partition.merge_votes(_votes(s, d).where("half = 1")))), "SELECT u, v, CAST(sum(indicator) AS BIGINT) AS merges, count(*) AS total FROM votes GROUP BY u, v", votes=VOTES)
add("edge_mapping_new", lambda s, d: partition.edge_mapping(views.g_dense(s, d), _mod_labels(views.g_dense(s, d), 37))[0], "SELECT nu, nv, row_number() OVER (ORDER BY nu, nv) - 1 AS edge_id, n FROM (SELECT least(u % 37, v % 37) AS nu, greatest(u % 37, v % 37) AS nv, count(*) AS n FROM g_dense WHERE u % 37 <> v % 37 GROUP BY 1, 2)")
add("edge_mapping_old", lambda s, d: partition.edge_mapping(views.g_sparse(s, d), _mod_labels(views.g_sparse(s, d), 7))[1], "SELECT g.u, g.v, coalesce(n.edge_id, -1) AS edge_id FROM g_sparse g LEFT JOIN (SELECT nu, nv, row_number() OVER (ORDER BY nu, nv) - 1 AS edge_id FROM (SELECT DISTINCT least(u % 7, v % 7) AS nu, greatest(u % 7, v % 7) AS nv FROM g_sparse WHERE u % 7 <> v % 7)) n ON n.nu = least(g.u % 7, g.v % 7) AND n.nv = greatest(g.u % 7, g.v % 7)")
for how, expr in {"sum": "sum(w)", "mean": "avg(w)", "min": "min(w)", "max": "max(w)", "abs_max": "arg_max(w, abs(w))", "gmean2": "sqrt(avg(w * w))"}.items():
    add(f"map_edge_values_{how}", lambda s, d, how=how: partition.map_edge_values(views.g_sparse(s, d), _mod_labels(views.g_sparse(s, d), 13), how), f"SELECT least(u % 13, v % 13) AS nu, greatest(u % 13, v % 13) AS nv, round({expr}, 6) AS w FROM g_sparse WHERE u % 13 <> v % 13 GROUP BY 1, 2")
add("multicut_energy", lambda s, d: partition.multicut_energy(views.g_dense(s, d), _mod_labels(views.g_dense(s, d), 5)), "SELECT round(sum(w), 2) AS energy FROM g_dense WHERE u % 5 <> v % 5", digits=2)


def _unaries(e: DataFrame) -> DataFrame:
    return _nodes(e).select("node", (F.col("node") % 10 * 3.0).alias("c0"), (F.col("node") % 7 * 2.0).alias("c1"))


add("st_cut_energy", lambda s, d: partition.st_cut_energy(views.g_sparse(s, d), _unaries(views.g_sparse(s, d)), _mod_labels(views.g_sparse(s, d), 2)), "SELECT round((SELECT sum(w) FROM g_sparse WHERE u % 2 <> v % 2) + (SELECT sum(CASE WHEN node % 2 = 0 THEN node % 10 * 3.0 ELSE node % 7 * 2.0 END) FROM nodes), 6) AS energy", nodes=NODES.format("g_sparse"))
MULTI = "SELECT y // 6 AS \"by\", x // 6 AS bx, label, count(*) AS cnt FROM seg2 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY y // 6, x // 6 ORDER BY count(*) DESC, label) <= 2"
add("downsample_multiset", lambda s, d: partition.downsample_multiset(views.seg2(s, d), 6, 2), "SELECT * FROM multi", multi=MULTI)
add("multiset_argmax", lambda s, d: partition.multiset_argmax(partition.downsample_multiset(views.seg2(s, d), 6, 2), ["by", "bx"]), 'SELECT "by", bx, label FROM multi QUALIFY row_number() OVER (PARTITION BY "by", bx ORDER BY cnt DESC, label) = 1', multi=MULTI)
add("multiset_groups", lambda s, d: partition.multiset_groups(partition.downsample_multiset(views.seg2(s, d), 6, 2), ["by", "bx"]).groupBy("n").agg(F.count("*").alias("groups")), "SELECT n, count(*) AS groups FROM (SELECT entries, count(*) AS n FROM (SELECT \"by\", bx, string_agg(label || ':' || cnt, ',' ORDER BY label) AS entries FROM multi GROUP BY \"by\", bx) GROUP BY entries) GROUP BY n", multi=MULTI)

# graphs

add_cc("connected_components", lambda s, d: ga.connected_components(views.g_sparse(s, d)), "g_sparse", "SELECT node, component FROM cc")
add_cc("components_from_node_labels", lambda s, d: ga.components_from_node_labels(views.g_sparse(s, d), _mod_labels(views.g_sparse(s, d), 2).withColumn("label", F.floor(F.col("node") / 800))), "same", "SELECT node, component FROM cc", NODES.format("g_sparse"), same="SELECT u, v FROM g_sparse WHERE u // 800 = v // 800")
add_cc("components_from_edge_labels", lambda s, d: ga.components_from_edge_labels(views.g_sparse(s, d).withColumn("cut", F.col("w") < 0)), "kept", "SELECT node, component FROM cc", NODES.format("g_sparse"), kept="SELECT u, v FROM g_sparse WHERE NOT w < 0")
add_cc("union_find_sets", lambda s, d: ga.sets_of(ga.union_find(views.g_sparse(s, d).select(F.col("u").alias("a"), F.col("v").alias("b")))).select("root", F.size("members").alias("n")), "g_sparse", "SELECT component AS root, CAST(count(*) AS INTEGER) AS n FROM cc GROUP BY component")
HOPS = "SELECT node, node AS target, 0 AS h FROM ns UNION SELECT r.node, s.neighbor, r.h + 1 FROM hops r JOIN sym s ON s.node = r.target WHERE r.h < 3"
add("pairs_within", lambda s, d: ga.pairs_within(views.g_sparse(s, d), 3), "SELECT node AS u, target AS v, CAST(min(h) AS BIGINT) AS hops FROM hops WHERE node < target GROUP BY 1, 2", ns=NODES.format("g_sparse"), sym=SYM.format("g_sparse"), hops=HOPS)
add("lifted_neighborhood", lambda s, d: ga.lifted_neighborhood(views.g_sparse(s, d), 3), "SELECT node AS u, target AS v, CAST(min(h) AS BIGINT) AS hops FROM hops WHERE node < target GROUP BY 1, 2 HAVING min(h) >= 2", ns=NODES.format("g_sparse"), sym=SYM.format("g_sparse"), hops=HOPS)
add("lifted_from_labels", lambda s, d: ga.lifted_from_labels(views.g_sparse(s, d), _mod_labels(views.g_sparse(s, d), 3), 3, "same"), "SELECT node AS u, target AS v, CAST(min(h) AS BIGINT) AS hops FROM hops WHERE node < target AND node % 3 = target % 3 AND node % 3 <> 0 GROUP BY 1, 2 HAVING min(h) >= 2", ns=NODES.format("g_sparse"), sym=SYM.format("g_sparse"), hops=HOPS)
add("lifted_from_node", lambda s, d: ga.lifted_from_node(views.g_sparse(s, d), views.g_sparse(s, d).agg(F.max("v")).first()[0], 3), "SELECT least(node, target) AS u, greatest(node, target) AS v, CAST(min(h) AS BIGINT) AS hops FROM hops WHERE node = (SELECT max(v) FROM g_sparse) GROUP BY 1, 2 HAVING min(h) >= 2", ns=NODES.format("g_sparse"), sym=SYM.format("g_sparse"), hops=HOPS)


def _positive(s, d):
    return views.g_sparse(s, d).withColumn("w", F.abs("w"))


# the graph is a forest at this size, so a walk without return is the only path
WALK = "SELECT node, node AS target, 0.0::DOUBLE AS dist, CAST(NULL AS BIGINT) AS previous FROM ns UNION ALL SELECT r.node, s.neighbor, r.dist + abs(s.w), r.target FROM walk r JOIN sym s ON s.node = r.target AND s.neighbor IS DISTINCT FROM r.previous"
add("shortest_distances", lambda s, d: ga.shortest_distances(_positive(s, d), _nodes(views.g_sparse(s, d))), "SELECT node AS source, target AS node, round(dist, 6) AS dist, previous FROM walk", ns=NODES.format("g_sparse"), sym=SYM.format("g_sparse"), walk=WALK)


def _path_pairs(s, d):
    n = _nodes(views.g_sparse(s, d)).select(F.col("node").alias("source"))
    c = ga.connected_components(views.g_sparse(s, d))
    return n.join(c.select(F.col("node").alias("source"), "component"), "source").select("source", F.col("component").alias("target"))


add_cc("shortest_paths", lambda s, d: ga.shortest_paths(_positive(s, d), _path_pairs(s, d)).select("source", "target", F.size("path").alias("n"), "dist"), "g_sparse", "SELECT w.node AS source, w.target, w.n, round(w.dist, 6) AS dist FROM walk w JOIN cc ON cc.node = w.node AND cc.component = w.target", sym=SYM.format("g_sparse"), walk="SELECT node, node AS target, 0.0::DOUBLE AS dist, CAST(NULL AS BIGINT) AS previous, 1 AS n FROM cc_nodes UNION ALL SELECT r.node, s.neighbor, r.dist + abs(s.w), r.target, r.n + 1 FROM walk r JOIN sym s ON s.node = r.target AND s.neighbor IS DISTINCT FROM r.previous")


def _bellman_ford(s, d):
    e = views.g_sparse(s, d)
    start = e.agg(F.max("v")).first()[0]
    arcs = e.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.abs("w").alias("w")).union(e.select("v", "u", F.abs("w")))
    return ga.bellman_ford(arcs, start)


add("bellman_ford", _bellman_ford, "SELECT target AS node, round(dist, 6) AS dist FROM walk", sym=SYM.format("g_sparse"), walk="SELECT target, 0.0::DOUBLE AS dist, CAST(NULL AS BIGINT) AS previous FROM (SELECT max(v) AS target FROM g_sparse) UNION ALL SELECT s.neighbor, r.dist + abs(s.w), r.target FROM walk r JOIN sym s ON s.node = r.target AND s.neighbor IS DISTINCT FROM r.previous")
add("triangles", lambda s, d: ga.triangles(views.g_tri(s, d)), "SELECT a.u AS a, a.v AS b, c.v AS c FROM g_tri a JOIN g_tri b ON b.u = a.v JOIN g_tri c ON c.u = a.u AND c.v = b.v")


def _tri_paths(e):
    from pyspark.sql import Window

    n = _nodes(e).select((F.col("node") % 9).alias("path_id"), "node")
    return n.withColumn("position", F.row_number().over(Window.partitionBy("path_id").orderBy("node")))


add("chords", _on_tri(lambda e: ga.chords(_tri_paths(e), e)), "SELECT p.path_id, g.u, g.v FROM g_tri g JOIN path p ON p.node = g.u JOIN path q ON q.node = g.v AND q.path_id = p.path_id WHERE abs(p.position - q.position) > 1", path="SELECT node % 9 AS path_id, node, row_number() OVER (PARTITION BY node % 9 ORDER BY node) AS position FROM ns", ns=NODES.format("g_tri"))
add("label_propagation", lambda s, d: ga.label_propagation(views.g_tri(s, d), 5, "w"))
add("contract", lambda s, d: ga.contract(views.g_dense(s, d), _mod_labels(views.g_dense(s, d), 50)), "SELECT least(u % 50, v % 50) AS u, greatest(u % 50, v % 50) AS v, round(sum(w), 3) AS w FROM g_dense WHERE u % 50 <> v % 50 GROUP BY 1, 2", digits=3)
add("random_graph", lambda s, d: ga.random_graph(s, 50, 200, 1))
add("spanning_forest", lambda s, d: ga.spanning_forest(views.g_sparse(s, d)), "SELECT u, v, w FROM g_sparse")

# agglomeration and partitioning; on a forest the best multicut joins all positive edges

POSITIVE = "SELECT u, v FROM g_sparse WHERE w > 0"


def add_multicut(name: str, kernel: Callable, positive: bool = True) -> None:
    add_cc(name, lambda s, d: solve.per_component(views.g_sparse(s, d), kernel, positive), "pos", "SELECT node, component AS label FROM cc", NODES.format("g_sparse"), pos=POSITIVE)


add_multicut("multicut_greedy_additive", kernels.greedy_additive)
add_multicut("multicut_greedy_fixation", kernels.greedy_fixation)
add_multicut("multicut_kernighan_lin", kernels.kernighan_lin, False)
add_multicut("multicut_fusion_moves", kernels.fusion_moves, False)
add_multicut("multicut_chained", kernels.chained(kernels.greedy_additive, kernels.kernighan_lin))
for rule in ("mean", "sum", "max", "abs_max"):
    add_multicut(f"gasp_{rule}", lambda e, rule=rule: kernels.gasp(e, rule), False)
add_multicut("gasp_constrained", lambda e: kernels.gasp(e, "mean", constraints=True), False)
# rules and energies on a graph with cycles and both signs

RULES = {"sum": "sum(w)", "mean": "avg(w)", "max": "max(w)", "min": "min(w)", "abs_max": "max_by(w, struct(abs(w), w))"}


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends lie in different clusters, by pair of clusters (a, b)."""
    j = lookup.with_node_values(edges, labels.withColumnRenamed("label", "cluster"), "cluster")
    return j.where("cluster_u <> cluster_v").withColumn("a", F.least("cluster_u", "cluster_v")).withColumn("b", F.greatest("cluster_u", "cluster_v"))


def _gasp_rule(rule: str, s, d) -> DataFrame:
    """A linkage rule at its end: pairs of clusters that the rule itself would still join, and clusters that positive paths do not hold together."""
    e = views.g_cyc(s, d)
    labels = solve.per_component(e, lambda x: kernels.gasp(x, rule))
    left = _between(e, labels).groupBy("a", "b").agg(F.expr(RULES[rule]).alias("x")).where("x > 1e-9").agg(F.count("*").alias("joinable"))
    held = ga.connected_components(e.where("w > 0").select("u", "v"), _nodes(e))
    torn = labels.join(held, "node").groupBy("label").agg(F.countDistinct("component").alias("parts")).where("parts > 1").agg(F.count("*").alias("torn"))
    return left.join(torn).select(F.lit(rule).alias("rule"), "joinable", "torn")


for rule in RULES:
    add(f"gasp_end_{rule}", lambda s, d, rule=rule: _gasp_rule(rule, s, d), f"SELECT '{rule}' AS rule, 0 AS joinable, 0 AS torn")

SOLVERS = {"greedy_additive": kernels.greedy_additive, "greedy_fixation": kernels.greedy_fixation, "kernighan_lin": kernels.kernighan_lin, "fusion_moves": kernels.fusion_moves, "chained": kernels.chained(kernels.greedy_additive, kernels.kernighan_lin)}


def _multicut_energies(s, d) -> DataFrame:
    """Each solver's energy against three easy partitions: all in one, each alone, and components of positive edges."""
    e = views.g_cyc(s, d)

    def cut(labels: DataFrame) -> float:
        return partition.multicut_energy(e, labels).first()[0] or 0.0

    positive = ga.connected_components(e.where("w > 0").select("u", "v"), _nodes(e)).withColumnRenamed("component", "label")
    found = {name: cut(solve.per_component(e, kernel)) for name, kernel in SOLVERS.items()}
    easy = min(0.0, cut(_nodes(e).withColumn("label", F.col("node"))), cut(positive)) + 1e-6
    return s.createDataFrame([(name, x <= easy, x <= found["greedy_additive"] + 1e-6) for name, x in found.items() if name != "greedy_fixation"], "solver string, below_easy boolean, below_greedy boolean")


add("multicut_energies", _multicut_energies, "SELECT unnest(['greedy_additive', 'kernighan_lin', 'fusion_moves', 'chained']) AS solver, true AS below_easy, true AS below_greedy")
add("spanning_forest_cyclic", lambda s, d: _forest_facts(s, d))


def _forest_facts(s, d) -> DataFrame:
    """The forest of a graph with cycles: as many edges as nodes less components."""
    e = views.g_cyc(s, d)
    f = ga.spanning_forest(e)
    comps = ga.connected_components(e.select("u", "v")).agg(F.countDistinct("component").alias("c"), F.count("*").alias("n"))
    own = ga.connected_components(f.select("u", "v")).agg(F.countDistinct("component").alias("fc"))
    return f.agg(F.count("*").alias("edges")).join(comps).join(own).select((F.col("edges") == F.col("n") - F.col("c")).alias("acyclic"), (F.col("fc") == F.col("c")).alias("spans"))


ORACLE_SQL["spanning_forest_cyclic"] = "SELECT true AS acyclic, true AS spans"


def _seeded_facts(s, d, kernel) -> DataFrame:
    """A watershed from several seeds a component: nodes without a label, seeds that lost theirs, and labels that are torn apart."""
    e = views.g_cyc(s, d).withColumn("w", F.abs("w"))
    seeds = _nodes(e).where("node % 3 = 0").select("node", (F.col("node") + 1).alias("label"))
    labels = solve.per_component_seeded(e, seeds, kernel)
    lost = labels.join(seeds.withColumnRenamed("label", "seed"), "node").where("label <> seed").agg(F.count("*").alias("lost"))
    j = lookup.with_node_values(e.select("u", "v"), labels.withColumnRenamed("label", "cluster"), "cluster")
    parts = ga.connected_components(j.where("cluster_u = cluster_v").select("u", "v"), _nodes(e))
    torn = parts.join(labels.where("label > 0"), "node").groupBy("label").agg(F.countDistinct("component").alias("n")).where("n > 1").agg(F.count("*").alias("torn"))
    return lost.join(torn)


for name, kernel in {"kruskal": kernels.kruskal_watershed, "prim": kernels.prim_watershed}.items():
    add(f"watershed_{name}_cyclic", lambda s, d, kernel=kernel: _seeded_facts(s, d, kernel), "SELECT 0 AS lost, 0 AS torn")


add_cc("multicut_decomposer", lambda s, d: solve.decompose(views.g_sparse(s, d)), "pos", "SELECT node, component AS label FROM cc", NODES.format("g_sparse"), pos=POSITIVE)
add_cc("block_multicut", lambda s, d: solve.block_multicut(views.g_sparse(s, d), _nodes(views.g_sparse(s, d)).select("node", F.floor(F.col("node") / 500).alias("block"))), "pos", "SELECT node, component AS label FROM cc", NODES.format("g_sparse"), pos=POSITIVE)
add("perturb_and_map", lambda s, d: solve.perturb_and_map(views.g_sparse(s, d), 8, "normal", 1.0))
add("perturb_and_map_certain", lambda s, d: solve.perturb_and_map(views.g_sparse(s, d), 4, "less_certain", 0.5), "SELECT u, v, CASE WHEN w > 0 THEN 0.0 ELSE 1.0 END AS cut_share FROM g_sparse")


def _lifted(s, d):
    return ga.lifted_neighborhood(views.g_sparse(s, d), 2).select("u", "v", ((F.col("u") + F.col("v")) % 9 - 4.0).alias("w"))


add("lifted_greedy_additive", lambda s, d: solve.per_component_lifted(views.g_sparse(s, d), _lifted(s, d), kernels.lifted_greedy_additive))
add("lifted_kernighan_lin", lambda s, d: solve.per_component_lifted(views.g_sparse(s, d), _lifted(s, d), kernels.lifted_kernighan_lin))
add("lifted_fusion_moves", lambda s, d: solve.per_component_lifted(views.g_sparse(s, d), _lifted(s, d), kernels.lifted_fusion_moves))
add("lifted_clustering", lambda s, d: solve.per_component_lifted(_positive(s, d), _lifted(s, d), kernels.lifted_clustering))
add_cc("edge_weighted_clustering", lambda s, d: solve.per_component(_positive(s, d), kernels.edge_weighted_clustering), "g_sparse", "SELECT node, component AS label FROM cc")
add_cc("size_limit_clustering", lambda s, d: solve.per_component(_positive(s, d), lambda e: kernels.size_limit_clustering(e, {}, 1e9)), "g_sparse", "SELECT node, component AS label FROM cc")
add_cc("node_edge_clustering", lambda s, d: solve.per_component(_positive(s, d), lambda e: kernels.node_edge_clustering(e, {x: [x % 10] for x in kernels.nodes_of(e)})), "g_sparse", "SELECT node, component AS label FROM cc")
add_cc("mala_clustering", lambda s, d: solve.per_component(views.g_sparse(s, d).withColumn("w", F.when(F.col("w") > 0, 0.2).otherwise(0.8)), kernels.mala_clustering), "pos", "SELECT node, component AS label FROM cc", NODES.format("g_sparse"), pos=POSITIVE)
add_cc("dual_clustering", lambda s, d: solve.per_component(views.g_sparse(s, d).withColumn("w", F.when(F.col("w") > 0, 0.9).otherwise(0.1)), lambda e: kernels.dual_clustering(e, [(u, v, 1 - w) for u, v, w in e])), "pos", "SELECT node, component AS label FROM cc", NODES.format("g_sparse"), pos=POSITIVE)
add("dendrogram", lambda s, d: solve.dendrogram(_positive(s, d)).groupBy("component").agg(F.count("*").alias("merges")))
ORACLE_SQL["dendrogram"] = cc_sql("g_sparse", "SELECT component, count(*) - 1 AS merges FROM cc GROUP BY component")
ORACLE_SQL["lifted_clustering"] = cc_sql("g_sparse", "SELECT node, component AS label FROM cc")
add("ucm_features", lambda s, d: solve.ucm_features(_positive(s, d), [0.1, 0.5, 0.9]))


def _seeds(s, d):
    return ga.connected_components(views.g_sparse(s, d)).where("node = component").select("node", (F.col("node") % 100 + 1).alias("label"))


SEEDED = "SELECT node, component % 100 + 1 AS label FROM cc"
add_cc("edge_watershed_kruskal", lambda s, d: solve.per_component_seeded(_positive(s, d), _seeds(s, d), kernels.kruskal_watershed), "g_sparse", SEEDED)
add_cc("edge_watershed_prim", lambda s, d: solve.per_component_seeded(_positive(s, d), _seeds(s, d), kernels.prim_watershed), "g_sparse", SEEDED)
add_cc("node_watershed", lambda s, d: solve.per_component_seeded(_positive(s, d), _seeds(s, d), kernels.node_watershed, _nodes(views.g_sparse(s, d)).select("node", (F.col("node") % 17).cast("double").alias("height"))), "g_sparse", SEEDED)
add_cc("carving", lambda s, d: solve.per_component_seeded(_positive(s, d), _seeds(s, d), lambda e, k: kernels.carve(e, k, 0.5, 10.0)), "g_sparse", SEEDED)
add("st_cut", lambda s, d: solve.st_cut(_positive(s, d), _unaries(views.g_sparse(s, d))))

# skeletons

SN = lambda s, d: views.skel(s, d)[0]
SE = lambda s, d: views.skel(s, d)[1]
LE = "SELECT e.skel, e.a, e.b, n.label AS la, m.label AS lb, sqrt((n.z - m.z) * (n.z - m.z) + (n.y - m.y) * (n.y - m.y) + (n.x - m.x) * (n.x - m.x)) AS len FROM skel_edges e JOIN skel_nodes n ON n.skel = e.skel AND n.node = e.a JOIN skel_nodes m ON m.skel = e.skel AND m.node = e.b WHERE e.b >= 0 AND n.label <> 0 AND m.label <> 0"
add("skeleton_assign", lambda s, d: skeleton.assign(SN(s, d), views.vol(s, d)).select("skel", "node", "label"), "SELECT n.skel, n.node, coalesce(v.label, 0) AS label FROM skel_nodes n LEFT JOIN vol v ON v.z = n.z AND v.y = n.y AND v.x = n.x")
add("skeleton_split_scores", lambda s, d: skeleton.split_scores(SN(s, d), SE(s, d)), "SELECT k.skel, round(coalesce(avg(CASE WHEN la <> lb THEN 1.0 ELSE 0.0 END), 0), 6) AS split FROM (SELECT DISTINCT skel FROM skel_nodes) k LEFT JOIN le ON le.skel = k.skel GROUP BY k.skel", le=LE)
add("skeleton_split_pairs", lambda s, d: skeleton.false_split_pairs(SN(s, d), SE(s, d)), "SELECT DISTINCT skel, least(la, lb) AS u, greatest(la, lb) AS v FROM le WHERE la <> lb", le=LE)
add("skeleton_run_lengths", lambda s, d: skeleton.split_run_lengths(SN(s, d), SE(s, d)), "SELECT skel, la AS label, round(sum(len), 6) AS length FROM le WHERE la = lb GROUP BY 1, 2", le=LE)
add("skeleton_lengths", lambda s, d: skeleton.skeleton_lengths(SN(s, d), SE(s, d)), "SELECT skel, round(sum(len), 6) AS length FROM le GROUP BY 1", le=LE)
add("skeleton_explicit_merges", lambda s, d: skeleton.explicit_merges(SN(s, d)), "SELECT label, count(DISTINCT skel) AS n_skel FROM skel_nodes WHERE label <> 0 GROUP BY label HAVING count(DISTINCT skel) > 1")
ODD = "SELECT skel, node, z, y, x, CASE WHEN label % 2 = 1 THEN label ELSE skel * 10 + 8 END AS label FROM skel_nodes"
LEO = LE.replace("skel_nodes", "odd")
MERO = "SELECT label FROM odd GROUP BY label HAVING count(DISTINCT skel) > 1"


def _odd(s, d):
    """Half of the labels made unique to their skeleton, so that some merge and some do not."""
    return SN(s, d).withColumn("label", F.when(F.col("label") % 2 == 1, F.col("label")).otherwise(F.col("skel") * 10 + 8))


add("skeleton_merge_scores", lambda s, d: skeleton.merge_scores(_odd(s, d), SE(s, d)), "SELECT skel, round(avg(CASE WHEN la = lb AND la IN (SELECT label FROM mero) THEN 1.0 ELSE 0.0 END), 6) AS merge, CAST(sum(CASE WHEN la <> lb AND (la IN (SELECT label FROM mero) OR lb IN (SELECT label FROM mero)) THEN 1 ELSE 0 END) AS BIGINT) AS points FROM leo GROUP BY skel", odd=ODD, leo=LEO, mero=MERO)
add("skeleton_edge_shares", lambda s, d: skeleton.edge_shares(_odd(s, d), SE(s, d)), "SELECT round(avg(CASE WHEN la = lb AND la NOT IN (SELECT label FROM mero) THEN 1.0 ELSE 0.0 END), 6) AS correct, round(avg(CASE WHEN la <> lb THEN 1.0 ELSE 0.0 END), 6) AS split, round(avg(CASE WHEN la = lb AND la IN (SELECT label FROM mero) THEN 1.0 ELSE 0.0 END), 6) AS merge, CAST(sum(CASE WHEN la <> lb AND (la IN (SELECT label FROM mero) OR lb IN (SELECT label FROM mero)) THEN 1 ELSE 0 END) AS BIGINT) AS points FROM leo", odd=ODD, leo=LEO, mero=MERO)
add("skeleton_heuristic_merges", lambda s, d: skeleton.heuristic_merges(SN(s, d), SN(s, d).where("node % 3 = 0").select((F.col("skel") * 100 + F.col("node")).alias("id"), "skel", "z", ((F.col("y") + 11) % 50).alias("y"), "x"), (1.0, 1.0, 1.0), 12.0).select("id"), "SELECT p.skel * 100 + p.node AS id FROM skel_nodes p WHERE p.node % 3 = 0 AND NOT EXISTS (SELECT 1 FROM skel_nodes n WHERE n.skel = p.skel AND (n.z - p.z) * (n.z - p.z) + (n.y - (p.y + 11) % 50) * (n.y - (p.y + 11) % 50) + (n.x - p.x) * (n.x - p.x) <= 144)")
add("skeleton_in_merges", lambda s, d: skeleton.nodes_in_merges(_odd(s, d)), "SELECT skel, node, label FROM odd WHERE label IN (SELECT label FROM mero)", odd=ODD, mero=MERO)
add("skeleton_distances", lambda s, d: skeleton.distance_statistics(skeleton.assign(SN(s, d), views.vol(s, d)), rag.edge_coordinates(views.vol(s, d)).select(F.col("side").alias("label"), "z", "y", "x").distinct()), "SELECT skel, label, round(avg(dd), 6) AS mean, round(max(dd), 6) AS max FROM (SELECT n.skel, n.node, n.label, min(sqrt((n.z - b.z) * (n.z - b.z) + (n.y - b.y) * (n.y - b.y) + (n.x - b.x) * (n.x - b.x))) AS dd FROM placed n JOIN bound b ON b.label = n.label GROUP BY 1, 2, 3) GROUP BY 1, 2", placed="SELECT s.skel, s.node, s.z, s.y, s.x, v.label FROM skel_nodes s JOIN vol v ON v.z = s.z AND v.y = s.y AND v.x = s.x WHERE v.label <> 0", bound="SELECT DISTINCT la AS label, z, y, x FROM vol_c WHERE la <> lb UNION ALL SELECT DISTINCT lb, z + (CASE WHEN axis = 'z' THEN 1 ELSE 0 END), y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END), x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END) FROM vol_c WHERE la <> lb")
add("skeleton_blocks", lambda s, d: skeleton.by_block(SN(s, d), grid.Blocking([0, 0, 0], [8, 50, 50], [4, 25, 25])), "SELECT ((z // 4) * 2 + y // 25) * 2 + x // 25 AS block_id, skel, count(*) AS n FROM skel_nodes GROUP BY 1, 2")

# images

add("segment_edges", lambda s, d: images.segment_edges(views.seg2(s, d)), "SELECT s.y, s.x, CAST(max(CASE WHEN t.label <> s.label THEN 1 ELSE 0 END) AS BIGINT) AS edge FROM seg2 s JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx) ON true LEFT JOIN seg2 t ON t.y = s.y + dy AND t.x = s.x + dx GROUP BY s.y, s.x")
add("offset_flags", lambda s, d: images.offset_flags(views.seg2(s, d), [[-1, 0], [0, -1], [4, -3]]), "SELECT s.y, s.x, o.channel, CAST(CASE WHEN t.label <> s.label THEN 1 ELSE 0 END AS BIGINT) AS flag FROM seg2 s CROSS JOIN (VALUES (0, -1, 0), (1, 0, -1), (2, 4, -3)) o(channel, dy, dx) LEFT JOIN seg2 t ON t.y = s.y + dy AND t.x = s.x + dx")
add("slice_offset_flags", lambda s, d: images.slice_offset_flags(views.vol(s, d), [[0, 0, 9], [1, 2, 0], [-1, 0, 0]], 1, 100), "SELECT a.y, a.x, o.channel, CAST(CASE WHEN b.label IS NULL THEN 0 WHEN a.label = 100 OR b.label = 100 THEN 2 WHEN a.label <> b.label THEN 1 ELSE 0 END AS BIGINT) AS flag FROM vol a CROSS JOIN (VALUES (0, 0, 0, 9), (1, 1, 2, 0), (2, -1, 0, 0)) o(channel, dz, dy, dx) LEFT JOIN vol b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.z = 1")
add("thin_filter", lambda s, d: images.thin_filter(views.seg2(s, d), 0.6), "SELECT s.y, s.x, round(coalesce(sum(g * t.value) / sum(g), 0), 6) AS value FROM seg2 s LEFT JOIN (SELECT i AS dy, j AS dx, exp(-(i * i + j * j) / 0.72) AS g FROM (SELECT unnest(range(-2, 3)) AS i) CROSS JOIN (SELECT unnest(range(-2, 3)) AS j)) o ON true LEFT JOIN seg2 t ON t.y = s.y + dy AND t.x = s.x + dx AND t.label = s.label AND t.value > 0 WHERE t.value IS NOT NULL OR (dy = 0 AND dx = 0) GROUP BY s.y, s.x")
G = "SELECT i AS k, exp(-(i * i) / 2.0) AS g FROM (SELECT unnest(range(-3, 4)) AS i)"
add("gaussian_smoothing", lambda s, d: images.smooth(views.img(s, d), 1.0), "SELECT a.y, a.x, round(sum(g * b.value) / sum(g), 6) AS value FROM pass1 a JOIN gk ON true JOIN pass1 b ON b.y = a.y AND b.x = a.x + k GROUP BY a.y, a.x", gk=G, pass1="SELECT a.y, a.x, sum(g * b.value) / sum(g) AS value FROM img a JOIN gk ON true JOIN img b ON b.x = a.x AND b.y = a.y + k GROUP BY a.y, a.x")
add("gradient_magnitude", lambda s, d: images.gradient(views.img(s, d)), "SELECT y, x, round(sqrt(gy * gy + gx * gx), 6) AS value FROM (SELECT y, x, (coalesce(yn, value) - coalesce(yp, value)) / (CASE WHEN yn IS NOT NULL AND yp IS NOT NULL THEN 2.0 ELSE 1.0 END) AS gy, (coalesce(xn, value) - coalesce(xp, value)) / (CASE WHEN xn IS NOT NULL AND xp IS NOT NULL THEN 2.0 ELSE 1.0 END) AS gx FROM (SELECT *, lead(value) OVER (PARTITION BY x ORDER BY y) AS yn, lag(value) OVER (PARTITION BY x ORDER BY y) AS yp, lead(value) OVER (PARTITION BY y ORDER BY x) AS xn, lag(value) OVER (PARTITION BY y ORDER BY x) AS xp FROM img))")
add("hessian_strongest", lambda s, d: images.hessian_strongest(views.img(s, d)))
add("disk_median", lambda s, d: images.disk_median(views.img(s, d), 1), "SELECT a.y, a.x, round(list_sort(list(b.value))[CAST(floor((count(*) + 1) / 2) AS BIGINT)], 6) AS value FROM img a JOIN img b ON abs(a.y - b.y) + abs(a.x - b.x) <= 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.y, a.x")
EXT = "SELECT a.y, a.x, round(a.value, 6) AS value FROM img a JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx) ON true LEFT JOIN img b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x, a.value HAVING a.value {0} {1}(b.value)"
add("local_minima", lambda s, d: images.extrema(views.img(s, d)), EXT.format("<", "min"))
add("local_maxima", lambda s, d: images.extrema(views.img(s, d), True), EXT.format(">", "max"))
add("image_components", lambda s, d: images.image_components(views.seg2(s, d), (1 << 20, 64), False))
ORACLE_SQL["image_components"] = cc_sql("same", "SELECT node, component FROM cc", "SELECT y * 64 + x AS node FROM seg2", same="SELECT a.y * 64 + a.x AS u, b.y * 64 + b.x AS v FROM seg2 a JOIN seg2 b ON a.label = b.label AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x))")
add("extrema_seeds", lambda s, d: images.extrema_seeds(views.img(s, d), (1 << 20, 64)), "SELECT y * 64 + x AS node, row_number() OVER (ORDER BY y * 64 + x) AS label FROM ext", ext=EXT.format("<", "min"))


def _points(s, d):
    return views.img(s, d).select((F.col("y") * 64 + F.col("x")).alias("id"), "y", "x", (F.abs("value") * 20 + 1).alias("dist"))


PTS = "SELECT y * 64 + x AS id, y, x, abs(value) * 20 + 1 AS dist FROM img"
add("non_maximum_suppression", lambda s, d: images.non_maximum_suppression(_points(s, d)), "SELECT DISTINCT qid AS id FROM (SELECT p.id, q.id AS qid FROM pts p JOIN pts q ON q.y BETWEEN p.y - 12 AND p.y + 12 AND (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x) <= p.dist * p.dist QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY q.dist DESC, q.id) = 1)", pts=PTS)
add("affine_nearest", lambda s, d: images.affine(views.img(s, d), MATRIX, (1 << 20, 64), 0, -1.0, ((0, 0), (40, 30))), "SELECT o.y, o.x, round(coalesce(i.value, -1), 6) AS value FROM outp o LEFT JOIN img i ON i.y = CAST(floor(o.y + 0.5 * o.x + 0.25 + 0.5) AS BIGINT) AND i.x = CAST(floor(0.5 * o.x + 1.0 + 0.5) AS BIGINT)", outp="SELECT y, x FROM (SELECT unnest(range(0, 40)) AS y) CROSS JOIN (SELECT unnest(range(0, 30)) AS x)")
add("affine_linear", lambda s, d: images.affine(views.img(s, d), MATRIX, (1 << 20, 64), 1, -1.0, ((0, 0), (40, 30))), "SELECT y, x, round(CASE WHEN count(*) FILTER (WHERE value IS NULL) > 0 THEN -1 ELSE sum(w * value) END, 6) AS value FROM (SELECT o.y, o.x, i.value, (CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM outp o CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dy, dx) LEFT JOIN img i ON i.y = CAST(floor(py) AS BIGINT) + dy AND i.x = CAST(floor(px) AS BIGINT) + dx) WHERE w > 0 GROUP BY y, x", outp="SELECT y, x, y + 0.5 * x + 0.25 AS py, 0.5 * x + 1.0 AS px FROM (SELECT unnest(range(0, 40)) AS y) CROSS JOIN (SELECT unnest(range(0, 30)) AS x)")
add("read_coordinates", lambda s, d: images.read_coordinates(views.img(s, d), s.range(500).select("id", (F.col("id") * 3 % 120).alias("y"), (F.col("id") * 7 % 70).alias("x"))), "SELECT p.id, round(coalesce(i.value, 0), 6) AS value FROM (SELECT unnest(range(0, 500)) AS id) p LEFT JOIN img i ON i.y = p.id * 3 % 120 AND i.x = p.id * 7 % 70")
add("upsample", lambda s, d: images.upsample(views.seg2(s, d), 2).select("y", "x", "label"), "SELECT y * 2 + i AS y, x * 2 + j AS x, label FROM seg2 CROSS JOIN (SELECT unnest(range(0, 2)) AS i) CROSS JOIN (SELECT unnest(range(0, 2)) AS j)")
add("cell_faces", lambda s, d: images.cell_faces(views.seg(s, d)), "SELECT 2 * y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END) AS y, 2 * x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END) AS x, u, v FROM seg_e")
# tiles of a regular grid: every inner corner of four is a junction, every edge one curve
add("cell_counts", lambda s, d: images.cell_counts(views.seg(s, d)), "SELECT (SELECT count(*) FROM seg a WHERE (y + 1) % 10 = 0 AND (x + 1) % 8 = 0 AND x < 63 AND y < (SELECT max(y) FROM img)) AS n0, (SELECT count(*) FROM (SELECT DISTINCT u, v FROM seg_e)) AS n1, (SELECT max(label) FROM seg) AS n2")
add("cell_bounds", lambda s, d: images.cell_bounds(views.seg(s, d))[0].select("y", "x", F.size("cells").alias("n")), "SELECT 2 * y + 1 AS y, 2 * x + 1 AS x, 4 AS n FROM seg WHERE (y + 1) % 10 = 0 AND (x + 1) % 8 = 0 AND x < 63 AND y < (SELECT max(y) FROM img)")
add("cell_geometry", lambda s, d: images.cell_geometry(views.seg(s, d)).select("size", "y", "x"), "SELECT count(*) AS size, round(avg(2 * y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END)), 6) AS y, round(avg(2 * x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END)), 6) AS x FROM seg_e GROUP BY u, v")
add("cell_mask", lambda s, d: images.cell_mask(views.seg(s, d), (1, 2)), "SELECT 2 * y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END) AS y, 2 * x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END) AS x, 1 AS dim FROM seg_e UNION ALL SELECT 2 * y, 2 * x, 2 FROM img")
add("cell_features", lambda s, d: images.cell_features(views.seg(s, d)).drop("cell"), "SELECT u, v, count(*) AS size, round(sqrt((max(ty) - min(ty)) * (max(ty) - min(ty)) + (max(tx) - min(tx)) * (max(tx) - min(tx))), 6) AS span, round(least(any_value(a.n), any_value(b.n)) / greatest(any_value(a.n), any_value(b.n)), 6) AS size_ratio FROM (SELECT u, v, 2 * y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END) AS ty, 2 * x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END) AS tx FROM seg_e) e JOIN n a ON a.label = e.u JOIN n b ON b.label = e.v GROUP BY u, v", n="SELECT label, count(*) AS n FROM seg GROUP BY label")


# blocked form

def _full(s, d) -> grid.Blocking:
    """Blocks over the whole image, whose height the table tells."""
    return grid.Blocking([0, 0], [views.img(s, d).agg(F.max("y")).first()[0] + 1, 64], [100, 24])


def _blocks(s, d):
    return dense.to_blocks(views.seg(s, d), _full(s, d))


add("dense_region_graph", lambda s, d: dense.region_graph(_blocks(s, d)), "SELECT DISTINCT u, v FROM seg_e")
add("dense_edge_features", lambda s, d: dense.edge_features(_blocks(s, d)), f"SELECT u, v, {MOM} FROM (SELECT u, v, unnest([vu, vv]) AS value FROM seg_e) GROUP BY u, v")

# files: written to the shared folder and read back


def _roi(s, d):
    path = shared_path(s, "volume")
    volumes.write_volume(views.vol(s, d), path, VOL_BLOCKS)
    return volumes.read_volume(s, path, (0, 20, 10), (3, 70, 40))


def _graph_io(s, d):
    path = shared_path(s, "graph")
    volumes.write_graph(_nodes(views.g_sparse(s, d)), views.g_sparse(s, d), path)
    return volumes.read_dense_graph(s, path)[1]


def _overlap_io(s, d):
    path = shared_path(s, "overlaps")
    volumes.write_overlaps(OV(s, d), path)
    return volumes.read_overlaps(s, path, 100, 200)


def _block_graph_io(s, d):
    path = shared_path(s, "block-graph")
    volumes.write_graph(rag.region_nodes(views.seg(s, d)), rag.block_region_graph(views.seg(s, d), SEG_BLOCKS), path)
    return volumes.read_graph(s, path, [1, 2])[1].select("u", "v").distinct()


def _two_pass(s, d):
    i = views.seg(s, d)
    p = grid.offset_pairs(i, [[0, 1], [1, 0]], ("label",)).select("y", "x", "channel", F.when(F.col("a_label") == F.col("b_label"), 1.0).otherwise(-1.0).alias("w"))
    wide = i.select("y", "x").join(p.groupBy("y", "x").pivot("channel", [0, 1]).agg(F.first("w")), ["y", "x"], "left")
    wide = wide.select("y", "x", F.coalesce(F.col("0"), F.lit(-1.0)).alias("a0"), F.coalesce(F.col("1"), F.lit(-1.0)).alias("a1"))
    out = two_pass(wide, [[0, 1], [1, 0]], grid.Blocking([0, 0], [1 << 20, 64], [8, 8]), (1, 1))
    return out.join(i.select("y", "x", F.col("label").alias("region")), ["y", "x"]).groupBy("label").agg(F.min("region").alias("region"), F.countDistinct("region").alias("regions"), F.count("*").alias("n")).drop("label")


add("volume_region_read", _roi, "SELECT z, y, x, round(value, 6) AS value, label FROM vol WHERE z < 3 AND y >= 20 AND y < 70 AND x >= 10 AND x < 40")
add("graph_dense_read", _graph_io, "SELECT least(a.i, b.i) AS u, greatest(a.i, b.i) AS v FROM g_sparse g JOIN ids a ON a.node = g.u JOIN ids b ON b.node = g.v", ns=NODES.format("g_sparse"), ids="SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM ns")
add("overlaps_range_read", _overlap_io, "SELECT a, b, cnt FROM seg_ov WHERE a >= 100 AND a < 200")
add("block_graph_read", _block_graph_io, "SELECT DISTINCT u, v FROM seg_e WHERE ((y + (CASE WHEN axis = 'y' THEN 1 ELSE 0 END)) // 25) * 4 + (x + (CASE WHEN axis = 'x' THEN 1 ELSE 0 END)) // 20 IN (1, 2)")
add("multiset_labels", lambda s, d: volumes.multiset_labels(OV(s, d).select("a", F.col("b").alias("label"), "cnt"), ["a"]), "SELECT a, b AS label FROM seg_ov QUALIFY row_number() OVER (PARTITION BY a ORDER BY cnt DESC, b) = 1")
add("two_pass_agglomeration", _two_pass, "SELECT label AS region, 1 AS regions, count(*) AS n FROM seg GROUP BY label")


# further operators

add("filter_features", lambda s, d: fe.filter_features(views.seg(s, d), [1.0]), f"SELECT u, v, 1.0 AS sigma, {MOM} FROM (SELECT u, v, unnest([va, vb]) AS value FROM (SELECT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v, a.value AS va, b.value AS vb FROM soft a JOIN soft b ON (b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1) WHERE a.label <> b.label)) GROUP BY u, v", gk=G, pass1="SELECT a.y, a.x, sum(g * b.value) / sum(g) AS value FROM img a JOIN gk ON true JOIN img b ON b.x = a.x AND b.y = a.y + k GROUP BY a.y, a.x", soft="SELECT a.y, a.x, any_value(s.label) AS label, sum(g * b.value) / sum(g) AS value FROM pass1 a JOIN gk ON true JOIN pass1 b ON b.y = a.y AND b.x = a.x + k JOIN seg s ON s.y = a.y AND s.x = a.x GROUP BY a.y, a.x")
add("pixel_wise_energy", lambda s, d: partition.pixel_wise_energy(views.seg(s, d), _affinities(s, d), OFFSETS), "SELECT round(sum(value), 4) AS energy FROM aff WHERE la <> lb", digits=4, aff=AFF)
add("two_way_cut", lambda s, d: partition.multicut_energy(views.g_sparse(s, d), solve.per_component(views.g_sparse(s, d), kernels.two_way_cut)), "SELECT round(sum(w), 6) AS energy FROM g_sparse WHERE w < 0")
add("lifted_ucm_features", lambda s, d: solve.lifted_ucm_features(_positive(s, d), _lifted(s, d), [0.1, 0.9]).select("u", "v", F.size("heights").alias("n")), "SELECT node AS u, target AS v, 2 AS n FROM hops WHERE node < target GROUP BY 1, 2 HAVING min(h) = 2", ns=NODES.format("g_sparse"), sym=SYM.format("g_sparse"), hops=HOPS)
add("channels_random_stride", lambda s, d: grid.channels_to_edges(views.img(s, d).withColumn("value", F.array("value", "value")), "l1", OFFSETS, (2, 2), seed=3).select("y", "x", "channel", "w"))
add("seeded_watershed_edges", lambda s, d: images.seeded_watershed(views.img(s, d), images.extrema_seeds(views.img(s, d), (1 << 20, 64)), (1 << 20, 64)))
add("seeded_watershed_nodes", lambda s, d: images.seeded_watershed(views.img(s, d), images.extrema_seeds(views.img(s, d), (1 << 20, 64)), (1 << 20, 64), "node_weighted"))
add("distance_transform", lambda s, d: images.distance_transform(views.vol(s, d), 0.2), "SELECT a.z, a.y, a.x, round(sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))), 6) AS value FROM vol a JOIN vol b ON a.z = b.z AND b.value > 0.2 GROUP BY a.z, a.y, a.x")
add("distance_transform_watershed", lambda s, d: images.distance_transform_watershed(views.img(s, d), 0.15, 1.0, (1 << 20, 64)))
CURVE = "SELECT y AS curve, x AS position, x + 0.0 AS cx, value * 10 AS cy FROM img"
add("curve_curvature", lambda s, d: images.curve_curvature(views.img(s, d).select(F.col("y").alias("curve"), F.col("x").alias("position"), (F.col("value") * 10).alias("y"), (F.col("x") + 0.0).alias("x"))), "SELECT curve, position, round(CASE WHEN len > 0 THEN atan2(ax * by_ - ay * bx, ax * bx + ay * by_) / len ELSE 0 END, 6) AS curvature FROM (SELECT *, (sqrt(ay * ay + ax * ax) + sqrt(by_ * by_ + bx * bx)) / 2 AS len FROM (SELECT curve, position, cy - lag(cy, 2) OVER w AS ay, cx - lag(cx, 2) OVER w AS ax, lead(cy, 2) OVER w - cy AS by_, lead(cx, 2) OVER w - cx AS bx FROM curve_points WINDOW w AS (PARTITION BY curve ORDER BY position)))", curve_points=CURVE)

ORACLE_SQL["block_table"] = "SELECT (p * 3 + q) * 3 + r AS block_id, p AS pos0, b0 AS begin0, e0 AS end0, greatest(b0 - 1, 0) AS outer_begin0, least(e0 + 1, 5) AS outer_end0, q AS pos1, b1 AS begin1, e1 AS end1, greatest(b1 - 1, 0) AS outer_begin1, least(e1 + 1, 6) AS outer_end1, r AS pos2, b2 AS begin2, e2 AS end2, greatest(b2 - 1, 0) AS outer_begin2, least(e2 + 1, 7) AS outer_end2 FROM (SELECT p, q, r, p * 3 AS b0, least(p * 3 + 3, 5) AS e0, greatest(q * 3 - 1, 0) AS b1, least(q * 3 + 2, 6) AS e1, r * 3 AS b2, least(r * 3 + 3, 7) AS e2 FROM (SELECT unnest(range(0, 2)) AS p) CROSS JOIN (SELECT unnest(range(0, 3)) AS q) CROSS JOIN (SELECT unnest(range(0, 3)) AS r))"
ORACLE_SQL["hessian_strongest"] = sql("SELECT y, x, round((yy + xx) / 2 + sqrt(((yy - xx) / 2) * ((yy - xx) / 2) + xy * xy), 6) AS value FROM (SELECT y, x, yy, xx, (coalesce(lead(gx) OVER wy, gx) - coalesce(lag(gx) OVER wy, gx)) / 2 AS xy FROM second WINDOW wy AS (PARTITION BY x ORDER BY y))", second="SELECT y, x, coalesce(lead(value) OVER wy, value) - 2 * value + coalesce(lag(value) OVER wy, value) AS yy, coalesce(lead(value) OVER wx, value) - 2 * value + coalesce(lag(value) OVER wx, value) AS xx, (coalesce(lead(value) OVER wx, value) - coalesce(lag(value) OVER wx, value)) / 2 AS gx FROM img WINDOW wy AS (PARTITION BY x ORDER BY y), wx AS (PARTITION BY y ORDER BY x)")
