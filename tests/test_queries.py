"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from parallaxis.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "conversations")


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 7) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    relation = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    at = [relation.columns.index(c) for c in df.columns]
    want = sorted(repr(tuple(_plain(r[i]) for i in at)) for r in relation.fetchall())
    assert sorted(repr(tuple(map(_plain, r))) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ("hull_coverage", "homography_ransac", "keypoint_mask_join", "yaw_search", "result_table"))
def test_keypoint_queries_take_all_pairs(spark, name):
    sf = SF.replace("0.001", "0.01")
    pairs = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey").distinct().count()
    assert pairs > 1000 and registry.queries()[name](spark, sf).count() == pairs


@pytest.mark.parametrize("name", ["dedup_images", "adjacency_explode"])
def test_queries_take_all_orders(spark, name):
    assert registry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_resize_takes_all_pixels(spark):
    """Every pair keeps pixels: their columns are folded, not left out."""
    pairs = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert registry.queries()["seg_resize"](spark, SF).select("pair_id").distinct().count() == pairs
