"""Queries on given pairs, result tables, deciles and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import ordering, results, sampling
from ..sources import pair_tables
from . import fixtures as fx


def csv_explicit_pairs(spark, sf):
    return pair_tables.load(fx.explicit(spark, sf), "k")


def _turns(spark, sf):
    return fx.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("index"),
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.concat(F.col("role"), F.lit(".png")).alias("filename"),
        F.col("turn").alias("k"),
    )


def csv_grouped_pairs(spark, sf):
    return pair_tables.load(_turns(spark, sf), "k")


def cap_per_group(spark, sf):
    return pair_tables.load(_turns(spark, sf), "k", most=5)


def csv_indices(spark, sf):
    return pair_tables.load(_turns(spark, sf), "k", indices=[1, "2", 7]).groupBy("index").agg(F.count(F.lit(1)).alias("n"))


def adjacency_explode(spark, sf):
    """Customers with their orders as neighbours."""
    points = fx.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.collect_list(F.struct(F.col("o_orderkey").alias("id"))).alias("conflicting_neighbors")
    ).select(F.struct(F.col("o_custkey").alias("id_left")).alias("point_info"), "conflicting_neighbors")
    return pair_tables.neighbour_pairs(points).select("id_left", "id_right")


def resolve_files(spark, sf):
    """Names from customers against a listing with other cases and endings."""
    c = fx.table(spark, sf, "customer")
    wanted = c.select(F.col("c_custkey").alias("key"), F.concat("c_name", F.lit(".png")).alias("filename"), F.concat(F.lit("id"), "c_custkey").alias("id"))
    name = (
        F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit(".png")))
        .when(F.col("c_custkey") % 5 == 1, F.upper(F.concat("c_name", F.lit(".png"))))
        .when(F.col("c_custkey") % 5 == 2, F.concat(F.lit("id"), "c_custkey", F.lit(".jpg")))
        .when(F.col("c_custkey") % 5 == 3, F.concat(F.lit("ID"), "c_custkey", F.lit(".JPEG")))
    )
    return pair_tables.resolve_files(wanted, c.select(name.alias("name")).where("name is not null")).select("key", "path")


def folder_pairs(spark, sf):
    o = fx.table(spark, sf, "orders")
    folder = F.concat_ws("_", F.concat(F.lit("a"), "o_custkey"), F.col("o_orderkey").cast("string"))
    left = o.select(folder.alias("folder"), F.concat(F.lit("a"), "o_custkey", F.lit(".png")).alias("name"))
    right = o.where("o_orderkey % 2 = 0").select(folder.alias("folder"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")).alias("name"))
    return pair_tables.folder_pairs(left.unionByName(right))


def filter_results(spark, sf):
    t = results.active(match_ratio_min=0.2, avg_distance_max=0.05, keypoint_coverage_min=0.5)
    return results.passing(fx.results(spark, sf), t).select("id_left", "id_right")


_METRICS = ("lightglue_match_ratio", "lightglue_avg_distance", "lightglue_keypoint_coverage_min")


def metric_deciles(spark, sf):
    binned = sampling.deciles(fx.results(spark, sf), _METRICS, ["id_left", "id_right"])
    return binned.groupBy("metric", "decile").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def decile_sample(spark, sf):
    return sampling.decile_sample(fx.results(spark, sf), _METRICS, ["id_left", "id_right"], 3).select("metric", "label", "id_left", "id_right")


def timing_slowest(spark, sf):
    """Stages of each order are its lines; seconds are their taxes and discounts."""
    stage = F.concat(F.lit("s"), F.col("l_linenumber").cast("string"))
    rows = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id_left"), (F.col("l_orderkey") + 1).alias("id_right"), stage.alias("stage"),
        (F.col("l_tax") * 3 + F.col("l_discount") + F.col("l_linenumber") * 1e-4).alias("seconds"),
    ).groupBy("id_left", "id_right", "stage").agg(F.max("seconds").alias("seconds"))
    return results.slowest_stage(rows)


def rendered_results(spark, sf):
    rows = fx.results(spark, sf).select(
        "id_left", "id_right",
        text.number(F.col("lightglue_match_ratio")).alias("ratio"), text.number(F.col("lightglue_avg_distance")).alias("distance"),
    )
    return results.rendered(rows, {"ratio": 2, "distance": 3}).groupBy("ratio", "distance").agg(F.count(F.lit(1)).alias("n"))


def safe_labels(spark, sf):
    return fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), text.safe_label(F.concat(F.lit(" /"), "p_type", F.lit(" & "), "p_brand", F.lit(" "))).alias("label")
    )


def id_shards(spark, sf):
    return fx.images(spark, sf).groupBy(text.shard(F.col("id")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def seeded_order(spark, sf):
    rows = fx.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"))
    keyed = rows.withColumn("key", ordering.seeded(7, F.col("id")))
    return ordering.positions(keyed, "key").select("id", "position")


_NUMBERS = """numbers AS (
  SELECT 'lightglue_match_ratio' AS metric, ratio AS value, id_left, id_right FROM results WHERE ratio IS NOT NULL
  UNION ALL SELECT 'lightglue_avg_distance', distance, id_left, id_right FROM results WHERE distance < 'infinity'::DOUBLE
  UNION ALL SELECT 'lightglue_keypoint_coverage_min', coverage, id_left, id_right FROM results
), edges AS (
  SELECT metric, list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM numbers GROUP BY metric
), binned AS (
  SELECT n.*, CAST(greatest(len(list_filter(e, lambda x: x < value)), 1) - 1 AS INTEGER) AS decile FROM numbers AS n JOIN edges USING (metric)
)"""
_GROUPED = """turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS index, conv_id || '-' || turn AS id, role || '.png' AS filename,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations
), pairs AS (
  SELECT l.id AS id_left, l.filename AS filename_left, 'N/A' AS date_left, r.id AS id_right, r.filename AS filename_right, 'N/A' AS date_right,
         l.index, row_number() OVER (PARTITION BY l.index ORDER BY l.n, r.n) AS p
  FROM turns AS l JOIN turns AS r ON l.index = r.index AND l.n < r.n
)"""

QUERIES = {
    "csv_explicit_pairs": (
        csv_explicit_pairs,
        f"""WITH {fx.EXPLICIT} SELECT coalesce(id_left, stem) AS id_left, 'right' || c AS id_right, coalesce(d, 'N/A') AS date_left, 'N/A' AS date_right,
        f AS filename_left, 'dir/right' || c || '.jpeg' AS filename_right, CAST(row_number() OVER (ORDER BY k) AS VARCHAR) AS index FROM explicit""",
    ),
    "csv_grouped_pairs": (csv_grouped_pairs, f"WITH {_GROUPED} SELECT * EXCLUDE (p) FROM pairs"),
    "cap_per_group": (cap_per_group, f"WITH {_GROUPED} SELECT * EXCLUDE (p) FROM pairs WHERE p <= 5"),
    "csv_indices": (csv_indices, f"WITH {_GROUPED} SELECT index, count(*) AS n FROM pairs WHERE index IN ('1', '2', '7') GROUP BY index"),
    "adjacency_explode": (
        adjacency_explode,
        "SELECT CAST(o_custkey AS VARCHAR) AS id_left, CAST(o_orderkey AS VARCHAR) AS id_right FROM orders",
    ),
    "resolve_files": (
        resolve_files,
        """SELECT c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN c_name || '.png' WHEN 1 THEN upper(c_name || '.png')
        WHEN 2 THEN 'id' || c_custkey || '.jpg' WHEN 3 THEN 'ID' || c_custkey || '.JPEG' END AS path FROM customer""",
    ),
    "folder_pairs": (
        folder_pairs,
        """SELECT 'a' || o_custkey || '_' || o_orderkey AS folder, 'a' || o_custkey AS id_left, CAST(o_orderkey AS VARCHAR) AS id_right
        FROM orders WHERE o_orderkey % 2 = 0""",
    ),
    "filter_results": (
        filter_results,
        f"WITH {fx.RESULTS} SELECT id_left, id_right FROM results WHERE ratio >= 0.2 AND distance <= 0.05 AND coverage >= 0.5",
    ),
    "metric_deciles": (
        metric_deciles,
        f"WITH {fx.RESULTS}, {_NUMBERS} SELECT metric, decile, count(*) AS n, min(value) + 0 AS low, max(value) + 0 AS high FROM binned GROUP BY ALL",
    ),
    "decile_sample": (
        decile_sample,
        f"""WITH {fx.RESULTS}, {_NUMBERS}, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY metric, decile ORDER BY md5('42:' || id_left || ':' || id_right)) AS p FROM binned)
        SELECT metric, printf('p%02d_%03d', decile * 10, (decile + 1) * 10) AS label, id_left, id_right FROM ranked WHERE p <= 3""",
    ),
    "timing_slowest": (
        timing_slowest,
        """WITH t AS (SELECT l_orderkey AS id_left, l_orderkey + 1 AS id_right, 's' || l_linenumber AS stage,
          max(l_tax * 3 + l_discount + l_linenumber * 1e-4::DOUBLE) AS seconds FROM lineitem GROUP BY ALL)
        SELECT id_left, id_right, round(sum(seconds), 6) AS total, max_by(stage, (seconds, stage)) AS slowest, max(seconds) AS slowest_seconds FROM t GROUP BY ALL""",
    ),
    "rendered_results": (
        rendered_results,
        f"""WITH {fx.RESULTS} SELECT coalesce(CAST(round(ratio, 2) + 0 AS VARCHAR), 'NA') AS ratio,
        CASE WHEN distance = 'infinity'::DOUBLE THEN 'inf' ELSE CAST(round(distance, 3) + 0 AS VARCHAR) END AS distance, count(*) AS n FROM results GROUP BY ALL""",
    ),
    "safe_labels": (
        safe_labels,
        """SELECT p_partkey AS key, regexp_replace(regexp_replace(lower(trim(' /' || p_type || ' & ' || p_brand || ' ')), '[^0-9a-zA-Z]+', '_', 'g'), '^_+|_+$', '', 'g') AS label FROM part""",
    ),
    "id_shards": (id_shards, f"WITH {fx.IMAGES} SELECT substr(id, 1, 2) AS shard, count(*) AS n FROM images GROUP BY 1"),
    "seeded_order": (
        seeded_order,
        "SELECT CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (ORDER BY md5('7:' || p_partkey)) - 1 AS position FROM part",
    ),
}
