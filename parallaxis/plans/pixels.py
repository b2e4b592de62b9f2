"""Queries on label masks as pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import rounded
from ..operators import masks
from . import fixtures as fx

_LABELS = ("road", "sidewalk", "building", "Railroad", "pole", "traffic light", "sky", "person", "Car", "caravan", "vegetation", "bus stop", "scarf")


def _rounded(df, *columns):
    return df.select(*(rounded(c, 8).alias(c) if c in columns else F.col(c) for c in df.columns))


def seg_iou(spark, sf):
    return _rounded(masks.per_class_iou(masks.valid(fx.pixels(spark, sf))), "iou")


def seg_summary(spark, sf):
    return _rounded(masks.iou_summary(fx.pixels(spark, sf), fx.ROAD).drop("per_class_json"), "mean_iou", "road_iou")


def seg_temp_masked(spark, sf):
    return _rounded(masks.iou_summary(fx.pixels(spark, sf), fx.ROAD, fx.TEMPORARY).drop("per_class_json"), "mean_iou", "road_iou")


def seg_invalid(spark, sf):
    """Label 255 on either side takes a pixel out."""
    rows = fx.pixels(spark, sf).withColumn("left_label", F.expr("case when x % 5 = 0 then 255 else left_label end"))
    return _rounded(masks.iou_summary(rows, fx.ROAD).drop("per_class_json"), "mean_iou", "road_iou")


def seg_per_class_json(spark, sf):
    """The JSON form, read back as rows."""
    made = masks.iou_summary(fx.pixels(spark, sf), fx.ROAD).select("pair_id", F.from_json("per_class_json", "map<string,double>").alias("m"))
    return made.select("pair_id", F.explode("m").alias("class", "iou")).select("pair_id", "class", rounded("iou", 8).alias("iou"))


def seg_props(spark, sf):
    return _rounded(masks.class_shares(fx.pixels(spark, sf), "left"), "share")


def seg_share_summary(spark, sf):
    return _rounded(masks.share_summary(fx.pixels(spark, sf), fx.TEMPORARY), "before", "after", "union_fraction")


def seg_crop(spark, sf):
    """Rows 1 to 7 of masks eight rows high, without the upper quarter and the lowest tenth."""
    rows = masks.crop_rows(fx.pixels(spark, sf), 8, 0.25, 0.1)
    return _rounded(masks.iou_summary(rows, fx.ROAD).drop("per_class_json"), "mean_iou", "road_iou")


def seg_resize(spark, sf):
    """Nearest neighbour from 8 x 64 to 5 x 100; all pixels, folded into 64 columns."""
    mask = fx.pixels(spark, sf).groupBy("pair_id", "y", (F.col("x") % 64).alias("x")).agg(F.min("left_label").alias("label"))
    return masks.resized(mask, 5, 100, 8, 64).groupBy("pair_id", "y", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("xs"))


def class_sets(spark, sf):
    rows = spark.createDataFrame(list(enumerate(_LABELS)), "id int, label string")
    return masks.class_sets(rows)


def named_shares(spark, sf):
    """Shares as JSON with class names, read back."""
    names = F.create_map(*(F.lit(x) for i, n in enumerate(_LABELS[:10]) for x in (i, n)))
    shares = masks.class_shares(fx.pixels(spark, sf), "left").groupBy("pair_id").agg(
        F.map_from_entries(F.collect_list(F.struct("class", rounded("share", 8).alias("share")))).alias("m")
    )
    made = shares.select("pair_id", F.from_json(F.to_json(text.named_shares(F.col("m"), names)), "map<string,double>").alias("n"))
    return made.select("pair_id", F.explode("n").alias("class", "share"))


_W = 360


def _yaw_pixels(spark, sf):
    """Masks 360 columns wide: the right one is the left one, turned by three degrees for each pair's last digit."""
    rows = fx.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as pair_id", "cast(l_linenumber as int) as y", "cast(l_orderkey % 360 as int) as x",
        "cast(l_quantity as int) % 19 as label", "cast(l_suppkey % 5 as int) as turn",
    ).groupBy("pair_id", "y", "x", "turn").agg(F.min("label").alias("label"))
    right = rows.select("pair_id", "y", F.pmod(F.col("x") + 3 * F.col("turn"), F.lit(_W)).alias("x"), F.col("label").alias("right_label"))
    return rows.select("pair_id", "y", "x", F.col("label").alias("left_label")).join(right, ["pair_id", "y", "x"])


def semantic_yaw_scores(spark, sf):
    scores = masks.agreement_by_yaw(_yaw_pixels(spark, sf), _W, (0, 3, 6, 9, 350), fx.SKY + fx.TEMPORARY)
    return _rounded(scores.drop("place"), "score")


def semantic_rerank(spark, sf):
    return _rounded(masks.rerank_yaw(_yaw_pixels(spark, sf), _W, 6, 6, 3, fx.SKY + fx.TEMPORARY), "best_score")


def semantic_rerank_own(spark, sf):
    """Each pair starts from a yaw of its own, one step beside the true one or further."""
    pixels = _yaw_pixels(spark, sf)
    first = pixels.select("pair_id").distinct().select("pair_id", F.pmod(F.col("pair_id") * 3, F.lit(12)).cast("int").alias("best_yaw"))
    return _rounded(masks.rerank_yaw(pixels, _W, first, 3, 3, fx.SKY + fx.TEMPORARY), "best_score")


def masks_turned(spark, sf):
    """After the turn that they were made with, both masks of a pair are the same."""
    pixels = _yaw_pixels(spark, sf)
    yaws = pixels.select("pair_id").distinct().select("pair_id", (F.col("pair_id") % 5 * 3).cast("int").alias("best_yaw"))
    return masks.turned(pixels, yaws, _W).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("left_label") == F.col("right_label")).alias("same"))


_TEMP = "(left_label BETWEEN 11 AND 18 OR right_label BETWEEN 11 AND 18)"


def _iou(source: str) -> str:
    return f"""{fx.PIXELS}, use AS ({source}), classes AS (
  SELECT pair_id, left_label AS class, 1 AS l, CAST(right_label = left_label AS INTEGER) AS i FROM use
  UNION ALL SELECT pair_id, right_label, 0, 0 FROM use WHERE right_label <> left_label
), iou AS (SELECT pair_id, class, CAST(sum(i) AS DOUBLE) / count(*) AS iou FROM classes GROUP BY ALL)"""


def _summary(source: str) -> str:
    return f"WITH {_iou(source)} SELECT pair_id, round(avg(iou), 8) AS mean_iou, round(avg(iou) FILTER (class = 0), 8) AS road_iou FROM iou GROUP BY 1"


_YAW = f"""base AS (
  SELECT l_suppkey AS pair_id, CAST(l_linenumber AS INTEGER) AS y, CAST(l_orderkey % 360 AS INTEGER) AS x, min(CAST(l_quantity AS INTEGER) % 19) AS label,
         CAST(l_suppkey % 5 AS INTEGER) AS turn FROM lineitem GROUP BY ALL
), pix AS (
  SELECT l.pair_id, l.y, l.x, l.label AS left_label, r.label AS right_label FROM base AS l JOIN base AS r
  ON l.pair_id = r.pair_id AND l.y = r.y AND l.x = (r.x + 3 * r.turn) % 360
), met AS (
  SELECT a.pair_id, yaw, a.left_label AS lab, b.right_label AS other FROM pix AS a, pix AS b, (SELECT unnest([{{yaws}}]) AS yaw)
  WHERE a.pair_id = b.pair_id AND a.y = b.y AND a.x = (b.x - yaw + 720) % 360
), scores AS (
  SELECT pair_id, yaw, coalesce(avg(CAST(lab = other AS DOUBLE)) FILTER (lab NOT BETWEEN 10 AND 18 AND other NOT BETWEEN 10 AND 18), 0) AS score FROM met GROUP BY ALL
)"""

QUERIES = {
    "seg_iou": (seg_iou, f"WITH {_iou('SELECT * FROM pixels')} SELECT pair_id, class, round(iou, 8) AS iou FROM iou"),
    "seg_summary": (seg_summary, _summary("SELECT * FROM pixels")),
    "seg_temp_masked": (seg_temp_masked, _summary(f"SELECT * FROM pixels WHERE NOT {_TEMP}")),
    "seg_invalid": (seg_invalid, _summary("SELECT * FROM pixels WHERE x % 5 <> 0")),
    "seg_per_class_json": (
        seg_per_class_json,
        f"WITH {_iou('SELECT * FROM pixels')} SELECT pair_id, CAST(class AS VARCHAR) AS class, round(iou, 8) AS iou FROM iou",
    ),
    "seg_props": (
        seg_props,
        f"""WITH {fx.PIXELS} SELECT pair_id, left_label AS class, round(count(*) / sum(count(*)) OVER (PARTITION BY pair_id), 8) AS share
        FROM pixels GROUP BY pair_id, left_label""",
    ),
    "seg_share_summary": (
        seg_share_summary,
        f"""WITH {fx.PIXELS}, long AS (
          SELECT pair_id, 'left' AS side, left_label AS class, {_TEMP} AS moving FROM pixels
          UNION ALL SELECT pair_id, 'right', right_label, {_TEMP} FROM pixels
        ), t AS (SELECT pair_id, side, count(*) AS n, count(*) FILTER (NOT moving) AS s FROM long GROUP BY ALL)
        SELECT pair_id, side, class, round(count(*) / any_value(n), 8) AS before,
               CASE WHEN count(*) FILTER (NOT moving) > 0 THEN round(count(*) FILTER (NOT moving) / any_value(s), 8) END AS after,
               round(1 - any_value(s) / any_value(n), 8) AS union_fraction
        FROM long JOIN t USING (pair_id, side) GROUP BY ALL""",
    ),
    "seg_crop": (seg_crop, _summary("SELECT * FROM pixels WHERE y >= 2 AND y < 7")),
    "seg_resize": (
        seg_resize,
        f"""WITH {fx.PIXELS}, mask AS (SELECT pair_id, y, x % 64 AS x, min(left_label) AS label FROM pixels GROUP BY ALL)
        SELECT pair_id, CAST(ty AS INTEGER) AS y, label, count(*) AS n, CAST(sum(tx) AS BIGINT) AS xs FROM mask, range(5) AS a(ty), range(100) AS b(tx)
        WHERE y = floor(ty * 8 / 5) AND x = floor(tx * 64 / 100) GROUP BY ALL""",
    ),
    "class_sets": (
        class_sets,
        "WITH c(id, label) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_LABELS)) + """)
        SELECT CAST(id AS INTEGER) AS id, label, contains(lower(label), 'road') AS road, contains(lower(label), 'sky') AS sky,
        regexp_matches(lower(label), 'person|people|pedestrian|rider|car|van|taxi|trailer|truck|bus|train|tram|motorcycle|bicycle|bike|vehicle') AS temporary FROM c""",
    ),
    "named_shares": (
        named_shares,
        "WITH names(class, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_LABELS[:10])) + f"""), {fx.PIXELS},
        s AS (SELECT pair_id, left_label AS class, round(count(*) / sum(count(*)) OVER (PARTITION BY pair_id), 8) AS share FROM pixels GROUP BY pair_id, left_label)
        SELECT pair_id, coalesce(name, 'class_' || class) AS class, share FROM s LEFT JOIN names USING (class)""",
    ),
    "semantic_yaw_scores": (
        semantic_yaw_scores,
        f"WITH {_YAW.format(yaws='0, 3, 6, 9, 350')} SELECT pair_id, CAST(yaw AS INTEGER) AS yaw, round(score, 8) AS score FROM scores",
    ),
    "semantic_rerank": (
        semantic_rerank,
        f"""WITH {_YAW.format(yaws='0, 3, 6, 9, 12')}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, yaw) AS p FROM scores)
        SELECT pair_id, CAST(yaw AS INTEGER) AS best_yaw, round(score, 8) AS best_score FROM r WHERE p = 1""",
    ),
    "semantic_rerank_own": (
        semantic_rerank_own,
        f"""WITH {_YAW.format(yaws='0, 3, 6, 9, 12, 357')}, near AS (SELECT *, list_position([-3, 0, 3], (CAST(yaw AS INTEGER) - pair_id * 3 % 12 + 540) % 360 - 180) AS o FROM scores),
        r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, o) AS p FROM near WHERE o IS NOT NULL)
        SELECT pair_id, CAST(yaw AS INTEGER) AS best_yaw, round(score, 8) AS best_score FROM r WHERE p = 1""",
    ),
    "masks_turned": (
        masks_turned,
        f"""WITH {_YAW.format(yaws='0, 3, 6, 9, 12')} SELECT a.pair_id, count(*) AS n, count(*) FILTER (a.left_label = b.right_label) AS same
        FROM pix AS a JOIN pix AS b ON a.pair_id = b.pair_id AND a.y = b.y AND a.x = (b.x - a.pair_id % 5 * 3 + 360) % 360 GROUP BY 1""",
    ),
}
