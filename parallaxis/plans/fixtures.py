"""Inputs of the queries, derived from the driver's tables; each has the same formula as a SQL common table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image metadata from orders; k is the input order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as id",
        "o_orderkey as k",
        "60.16D + (o_custkey % 50) * 1e-4D + ((o_orderkey % 7) - 3) * 4e-6D as lat",
        "24.93D + (o_custkey div 50) * 2e-4D + ((o_orderkey % 5) - 2) * 6e-6D as lon",
        "case when o_orderkey % 11 = 0 then null else cast((o_orderkey * 37) % 360 as double) end as compass_angle",
        "o_orderkey % 3 = 0 as is_pano",
        "case when o_orderkey % 13 = 0 then null else unix_millis(cast(o_orderdate as timestamp)) end as captured_at",
    )


IMAGES = """images AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k,
         60.16::DOUBLE + (o_custkey % 50) * 1e-4::DOUBLE + ((o_orderkey % 7) - 3) * 4e-6::DOUBLE AS lat,
         24.93::DOUBLE + (o_custkey // 50) * 2e-4::DOUBLE + ((o_orderkey % 5) - 2) * 6e-6::DOUBLE AS lon,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 360 AS DOUBLE) END AS compass_angle,
         o_orderkey % 3 = 0 AS is_pano,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE epoch_us(o_orderdate) // 1000 END AS captured_at
  FROM orders
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image metadata with times of day, from events."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(event_id as string) as id",
        "event_id as k",
        "60.16D + (user_id % 15) * 1e-4D as lat",
        "24.93D + (user_id div 15) * 1e-4D as lon",
        "cast(null as double) as compass_angle",
        "false as is_pano",
        "unix_millis(cast(ts as timestamp)) as captured_at",
    )


EVENTS = """images AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id AS k,
         60.16::DOUBLE + (user_id % 15) * 1e-4::DOUBLE AS lat, 24.93::DOUBLE + (user_id // 15) * 1e-4::DOUBLE AS lon,
         CAST(NULL AS DOUBLE) AS compass_angle, FALSE AS is_pano, epoch_us(ts) // 1000 AS captured_at
  FROM events
)"""

WIDTH, HEIGHT = 1024, 512


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched keypoints, a pair for each part."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey as pair_id",
        "l_orderkey * 10 + l_linenumber as kp",
        "cast((l_orderkey * 131 + l_linenumber * 17) % 1024 as double) as lx",
        "cast((l_orderkey * 71 + l_linenumber * 29) % 512 as double) as ly",
        """cast(((l_orderkey * 131 + l_linenumber * 17) + (l_partkey % 36) * 28
             + (case when l_linenumber = 1 then l_orderkey % 400 else (l_suppkey % 9) - 4 end) + 1024) % 1024 as double) as rx""",
        "cast((l_orderkey * 71 + l_linenumber * 29) % 512 as double) + (l_suppkey % 5) - 2 as ry",
        "l_linenumber",
    )


MATCHES = """matches AS (
  SELECT l_partkey AS pair_id, l_orderkey * 10 + l_linenumber AS kp, l_linenumber,
         CAST((l_orderkey * 131 + l_linenumber * 17) % 1024 AS DOUBLE) AS lx,
         CAST((l_orderkey * 71 + l_linenumber * 29) % 512 AS DOUBLE) AS ly,
         CAST(((l_orderkey * 131 + l_linenumber * 17) + (l_partkey % 36) * 28
           + (CASE WHEN l_linenumber = 1 THEN l_orderkey % 400 ELSE (l_suppkey % 9) - 4 END) + 1024) % 1024 AS DOUBLE) AS rx,
         CAST((l_orderkey * 71 + l_linenumber * 29) % 512 AS DOUBLE) + (l_suppkey % 5) - 2 AS ry
  FROM lineitem
)"""

ROAD, SKY, TEMPORARY = (0,), (10,), tuple(range(11, 19))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned label masks, a pair for each supplier."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as pair_id",
        "cast(l_linenumber as int) as y",
        "cast(l_orderkey as int) as x",
        "cast(l_quantity as int) % 19 as left_label",
        "cast(case when l_orderkey % 3 = 0 then cast(l_quantity as int) % 19 else l_partkey % 19 end as int) as right_label",
    )


PIXELS = """pixels AS (
  SELECT l_suppkey AS pair_id, CAST(l_linenumber AS INTEGER) AS y, CAST(l_orderkey AS INTEGER) AS x,
         CAST(l_quantity AS INTEGER) % 19 AS left_label,
         CAST(CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_quantity AS INTEGER) % 19 ELSE l_partkey % 19 END AS INTEGER) AS right_label
  FROM lineitem
)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with metrics as text, sentinels included."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey as string) as id_left",
        "cast(l_orderkey * 10 + l_linenumber as string) as id_right",
        """case l_linenumber when 7 then 'NA' when 6 then 'NaN' else cast(l_discount * 10 as string) end as lightglue_match_ratio""",
        "case when l_linenumber = 5 then 'inf' else cast(l_tax as string) end as lightglue_avg_distance",
        "l_quantity / 50 as lightglue_keypoint_coverage_min",
    )


RESULTS = """results AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id_left, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS id_right,
         CASE WHEN l_linenumber IN (6, 7) THEN NULL ELSE l_discount * 10 END AS ratio,
         CASE WHEN l_linenumber = 5 THEN 'infinity'::DOUBLE ELSE l_tax END AS distance,
         l_quantity / 50 AS coverage
  FROM lineitem
)"""


def explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair CSV's columns, with blanks and aliases; k is the row order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as k",
        "case when o_orderkey % 4 = 0 then ' ' else concat('img', o_orderkey, '.jpg') end as filename_left",
        "concat('alt', o_orderkey, '.png') as left_filename",
        "concat('dir/right', o_custkey, '.jpeg') as filename_b",
        "case when o_orderkey % 5 = 0 then null else cast(o_orderkey as string) end as id_left",
        "case when o_orderkey % 6 = 0 then cast(cast(o_orderdate as date) as string) end as date_1",
    )


EXPLICIT = """explicit AS (
  SELECT o_orderkey AS k, o_custkey AS c,
         CASE WHEN o_orderkey % 4 = 0 THEN 'alt' || o_orderkey || '.png' ELSE 'img' || o_orderkey || '.jpg' END AS f,
         CASE WHEN o_orderkey % 4 = 0 THEN 'alt' || o_orderkey ELSE 'img' || o_orderkey END AS stem,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS id_left,
         CASE WHEN o_orderkey % 6 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d
  FROM orders
)"""


def descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Left and right keypoint descriptors of pairs."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("pair_id"), F.col("vec_id").alias("kp"), F.col("embedding").alias("vector")
    )
    return rows.where("kp % 2 = 0"), rows.where("kp % 2 = 1")
