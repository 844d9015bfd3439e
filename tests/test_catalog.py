"""Registered queries against their SQL, on the smallest tables; all of them run against SQL at sf0.01 by the driver."""

import math
from pathlib import Path

import duckdb
import pytest

from tesserae.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
SOME = ["rag_features", "standard_features", "connected_components", "multicut_kernighan_lin", "gasp_mean", "pairs_within", "rand_error", "variation_of_information", "edge_mapping_new", "affine_linear", "skeleton_merge_scores", "shortest_distances"]


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=2e-6, rel_tol=1e-9))
    return str(a) == str(b)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_every_oracle_parses(con):
    for sql in catalog.ORACLE_SQL.values():
        con.sql(f"EXPLAIN {sql}")
