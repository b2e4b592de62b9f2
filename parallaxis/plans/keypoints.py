"""Queries on matched keypoints, yaw, crops, transforms and image arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import features
from ..operators import matches as m
from ..operators import raster
from . import fixtures as fx
from .pixels import _TEMP, _iou

W, H = fx.WIDTH, fx.HEIGHT


def _rounded(df, places, *columns):
    return df.select(*(rounded(c, places).alias(c) if c in columns else F.col(c) for c in df.columns))


def mutual_nn_match(spark, sf):
    return m.mutual_nearest(*fx.descriptors(spark, sf)).select("pair_id", "left_kp", "right_kp")


def match_metrics(spark, sf):
    rows = fx.matches(spark, sf)
    counts = rows.groupBy("pair_id").agg((F.count(F.lit(1)) + 5).alias("left_allowed"), (F.count(F.lit(1)) * 2).alias("right_allowed"))
    counts = counts.unionByName(counts.select(-F.col("pair_id") - 1, F.lit(0).cast("long").alias("left_allowed"), F.lit(3).cast("long").alias("right_allowed")).toDF("pair_id", "left_allowed", "right_allowed"))
    return _rounded(m.metrics(rows, counts, W, H), 8, "match_ratio", "avg_distance")


def keypoint_mask_join(spark, sf):
    """Keypoints on a mask that blocks every seventh column and lacks some rows."""
    rows = fx.matches(spark, sf)
    mask = rows.select("pair_id", F.rint("ly").cast("int").alias("y"), F.rint("lx").cast("int").alias("x")).distinct()
    mask = mask.where("y % 3 <> 0").withColumn("ok", F.col("x") % 7 != 0)
    return m.allowed(rows.select("pair_id", "kp", "lx", "ly"), mask, W, H, "lx", "ly").groupBy("pair_id").agg(
        F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("n")
    )


def robust_fence(spark, sf):
    """Left points inside their fences, one far point added to each pair."""
    rows = fx.matches(spark, sf).select("pair_id", "lx", "ly")
    far = rows.select("pair_id").distinct().select("pair_id", F.lit(9000.0).alias("lx"), F.lit(-9000.0).alias("ly"))
    kept = m.fenced(rows.unionByName(far), ["lx", "ly"])
    return kept.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.max("lx").alias("far"))


def robust_pairs(spark, sf):
    """All four axes; without a way back to all points."""
    kept = m.fenced(fx.matches(spark, sf), ["lx", "ly", "rx", "ry"], least_range=1e-6, fall_back=False)
    return kept.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))


def fov_crop(spark, sf):
    kept = m.fenced(fx.matches(spark, sf).select("pair_id", "lx", "ly"), ["lx", "ly"])
    return _rounded(m.crop_boxes(kept, "lx", "ly", W, H), 8, "fraction")


def fov_pair_crops(spark, sf):
    """Some pairs have too few matches for a crop."""
    rows = fx.matches(spark, sf).where("pair_id % 3 <> 0 or l_linenumber = 1 and kp % 5 = 0")
    columns = [f"fov_{c}_fraction" for c in ("crop", "left_retained", "right_retained", "left_cropped", "right_cropped")]
    return _rounded(m.fov_crops(rows, W, H), 8, *columns)


def yaw_vote(spark, sf):
    return _rounded(m.yaw_votes(fx.matches(spark, sf), W, 10), 6, "yaw", "concentration")


def yaw_vote_weak(spark, sf):
    """Few, scattered matches: most pairs lack support."""
    return _rounded(m.yaw_votes(fx.matches(spark, sf).where("l_linenumber = 1"), W, 10), 6, "yaw", "concentration")


def yaw_one_shot(spark, sf):
    return m.one_shot_yaw(m.yaw_votes(fx.matches(spark, sf).where("l_linenumber <= 2"), W, 10)).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def yaw_search(spark, sf):
    return m.search_yaw(fx.matches(spark, sf), W, 10)


def yaw_search_weak(spark, sf):
    """One match of each order: most pairs have no vote and take the coarse round."""
    return m.search_yaw(fx.matches(spark, sf).where("l_linenumber = 1"), W, 10)


def homography_distortion(spark, sf):
    """Homographies near the identity, from lineitem's numbers."""
    rows, k = fx.table(spark, sf, "lineitem"), F.col("l_orderkey")
    h = [1 + (k % 5) * 0.01, (k % 3) * 0.02, k % 7, (k % 2) * 0.01, 1 - (k % 4) * 0.02, k % 11, (k % 3) * 1e-5, (k % 5) * 1e-5, F.lit(1.0)]
    h = [x.cast("double") for x in h]
    score = m.distortion_score(h, F.lit(float(W)), F.lit(float(H)), F.col("l_discount"))
    return rows.select(k.alias("id"), rounded(score, 8).alias("score"))


def warp_choice(spark, sf):
    """Of both directions, the lower score; the first if equal."""
    rows = fx.table(spark, sf, "lineitem").select("l_partkey", F.col("l_linenumber").alias("o"), rounded("l_tax", 2).alias("score"))
    rows = rows.groupBy("l_partkey", "o").agg(F.min("score").alias("score")).withColumn("direction", F.concat(F.lit("d"), F.col("o").cast("string")))
    return m.first_best(rows, ["l_partkey"], "direction", "score", "o").select("l_partkey", "direction", (F.col("score") + 0).alias("score"))


def image_stats(spark, sf):
    """Four statistics that columns express, over each supplier's quantities as grey values."""
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_quantity") * 5).alias("v"))
    return _rounded(
        rows.groupBy("image_id").agg(
            F.avg("v").alias("brightness"), F.median("v").alias("median_brightness"),
            F.avg((F.col("v") < 80).cast("double")).alias("dark_fraction"), F.stddev_pop("v").alias("contrast"),
        ), 8, "brightness", "dark_fraction", "contrast",
    )


def horizon_lines(spark, sf):
    rows = fx.matches(spark, sf).select(
        F.col("pair_id").alias("image_id"), F.col("lx").alias("x1"), F.col("ly").alias("y1"), (F.col("lx") + 100).alias("x2"), (F.col("ly") + (F.col("kp") % 60) - 30).alias("y2")
    )
    return _rounded(m.weighted_horizon(rows), 8, "horizon_angle")


def hull_coverage(spark, sf):
    return raster.hulls_by_pair(fx.matches(spark, sf), H, W)


def result_table(spark, sf):
    """All blocks of a result row, for all pairs; those without masks have no class overlap."""
    found = fx.matches(spark, sf)
    counts = found.groupBy("pair_id").agg(F.count(F.lit(1)).alias("left_allowed"), (F.count(F.lit(1)) + 3).alias("right_allowed"))
    name = lambda c: F.concat(F.lit(c), F.col("pair_id").cast("string"))
    pairs = counts.select("pair_id", name("l").alias("id_left"), F.lit("N/A").alias("date_left"), name("r").alias("id_right"),
                          F.lit("N/A").alias("date_right"), F.col("pair_id").cast("string").alias("index"))
    frame = features.Frame(W, H, fx.ROAD, fx.TEMPORARY, ignore_temporary=True)
    out = features.result_table(pairs, found, counts, frame, fx.pixels(spark, sf))
    return out.select(
        "id_left", "id_right", "index", *(rounded(c, 8).alias(c) for c in (
            "lightglue_match_ratio", "lightglue_avg_distance", "seg_overlap_mean_iou", "seg_overlap_road_iou")),
        "seg_temp_union_fraction",
    )


def _pairs_of(found):
    counts = found.groupBy("pair_id").agg(F.count(F.lit(1)).alias("left_allowed"), (F.count(F.lit(1)) + 3).alias("right_allowed"))
    name = lambda c: F.concat(F.lit(c), F.col("pair_id").cast("string"))
    pairs = counts.select("pair_id", name("l").alias("id_left"), F.lit("N/A").alias("date_left"), name("r").alias("id_right"),
                          F.lit("N/A").alias("date_right"), F.col("pair_id").cast("string").alias("index"))
    return pairs, counts


def result_panorama(spark, sf):
    """Rows of panorama mode: the right image turned by the best yaw, and the metrics before."""
    found = fx.matches(spark, sf)
    pairs, counts = _pairs_of(found)
    out = features.result_table(pairs, found, counts, features.Frame(W, H), mode=features.Mode("panorama"))
    return out.select(
        "id_left", "id_right", "best_yaw_deg", "panorama_alignment_method", *(rounded(c, 8).alias(c) for c in (
            "lightglue_match_ratio", "lightglue_avg_distance", "orig_lightglue_match_ratio", "orig_lightglue_avg_distance")),
    )


def result_fov(spark, sf):
    """Rows of field-of-view mode: both images cropped to what they share, and the metrics before; masks follow the crops."""
    found = fx.matches(spark, sf)
    pairs, counts = _pairs_of(found)
    frame = features.Frame(W, H, fx.ROAD, fx.TEMPORARY, ignore_temporary=True)
    out = features.result_table(pairs, found, counts, frame, fx.pixels(spark, sf), mode=features.Mode("fov", reproject=True))
    return out.select(
        "id_left", "id_right", *(rounded(c, 8).alias(c) for c in (
            "lightglue_match_ratio", "lightglue_avg_distance", "orig_lightglue_match_ratio", "orig_lightglue_avg_distance",
            "orig_seg_overlap_mean_iou", "fov_crop_fraction", "fov_left_retained_fraction", "fov_right_retained_fraction",
            "fov_left_cropped_fraction", "fov_right_cropped_fraction")),
    )


def homography_ransac(spark, sf):
    return raster.homographies_by_pair(fx.matches(spark, sf))


def _gray_images(spark, sf):
    """16 x 16 grey images from embeddings."""
    v = fx.table(spark, sf, "embeddings")
    pixel = F.transform("embedding", lambda x: F.pmod((x * 997).cast("int"), F.lit(256)))
    text = F.array_join(F.transform(pixel, lambda p: F.lpad(F.hex(p), 2, "0")), "")
    return v.select(F.col("vec_id").alias("image_id"), F.lit(16).alias("height"), F.lit(16).alias("width"), F.unhex(F.repeat(text, 4)).alias("data"))


def image_quality(spark, sf):
    out = raster.images_by_row(_gray_images(spark, sf)).drop("error")
    return _rounded(out, 8, "brightness", "median_brightness", "dark_fraction", "contrast", "sharpness", "noise")


def sky_heuristic(spark, sf):
    """12 x 32 RGB images, bright above and dark below a line."""
    rows = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(12).alias("height"), F.lit(32).alias("width"))
    top = F.pmod("image_id", F.lit(12)).cast("int")
    data = F.concat(F.repeat(F.lit("78B4F0"), top * 32), F.repeat(F.lit("203010"), (12 - top) * 32))
    return raster.sky_by_row(rows.withColumn("data", F.unhex(data))).select("image_id", rounded("sky_share", 8).alias("sky_share"))


def perspective_views(spark, sf):
    """Mean brightness of four views out of panoramas of 32 x 64 grey pixels, one for each supplier."""
    step = F.col("image_id") % 4
    grey = F.transform(F.sequence(F.lit(0), F.lit(32 * 64 - 1)), lambda i: F.lpad(F.hex(F.floor(i / 64) + (i % 64) * step), 2, "0"))
    rows = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(32).alias("height"), F.lit(64).alias("width"))
    views = raster.perspectives_by_row(rows.withColumn("data", F.unhex(F.array_join(grey, ""))), size=(16, 16))
    shades = views.select("image_id", F.col("yaw").cast("int").alias("yaw"), F.explode(F.split(F.hex("data"), "(?<=\\G..)")).alias("h"))
    shades = shades.where("h <> ''").select("image_id", "yaw", F.conv("h", 16, 10).cast("int").alias("v"))
    return _rounded(shades.groupBy("image_id", "yaw").agg(F.avg("v").alias("mean")), 8, "mean")


_VOTES = f"""offsets AS (SELECT pair_id, (((rx - lx) / 1024 * 360.0) % 360 + 360) % 360 AS o FROM use),
bins AS (SELECT pair_id, CAST(least(floor(o / 10), 35) AS INTEGER) AS bin, count(*) AS n FROM offsets GROUP BY ALL),
best AS (SELECT pair_id, sum(n) AS total, arg_max(bin, (n, -bin)) AS bin FROM bins GROUP BY 1),
near AS (SELECT pair_id, o, total FROM offsets JOIN best USING (pair_id) WHERE abs(((o - ((bin + 0.5) * 10) % 360 + 180) % 360 + 360) % 360 - 180) <= 15),
found AS (SELECT pair_id, any_value(total) AS total, count(*) AS support, (degrees(atan2(avg(sin(radians(o))), avg(cos(radians(o))))) + 360) % 360 AS yaw FROM near GROUP BY 1),
spread AS (SELECT pair_id, 1 - avg(abs(((o - yaw + 180) % 360 + 360) % 360 - 180)) / 180 AS c FROM near JOIN found USING (pair_id) GROUP BY 1),
votes AS (SELECT pair_id, CAST(total AS BIGINT) AS total, support,
  CASE WHEN total >= 8 AND support >= 8 AND support / total >= 0.25 THEN round(yaw, 6) END AS yaw,
  CASE WHEN total >= 8 AND support >= 8 AND support / total >= 0.25 THEN round(c, 6) END AS concentration FROM found JOIN spread USING (pair_id))"""


def _votes(where: str) -> str:
    return f"{fx.MATCHES}, use AS (SELECT * FROM matches WHERE {where}), {_VOTES}"


def _scores(name: str, candidates: str) -> str:
    return f"""{name} AS (
  SELECT pair_id, yaw, o, avg(sqrt(pow(lx - ((rx - round(yaw / 360.0 * 1024) + 1024) % 1024), 2) + pow(ly - ry, 2))) / (1 + 0.3 * ln(1 + count(*))) AS score
  FROM ({candidates}) JOIN use USING (pair_id) GROUP BY ALL
)"""


def _search(where: str) -> str:
    return f"""WITH {_votes(where)}, centres AS (SELECT pair_id, CAST(round_even(yaw, 0) AS INTEGER) AS c FROM votes WHERE yaw IS NOT NULL),
{_scores('refined', 'SELECT pair_id, (c + d + 360) % 360 AS yaw, d AS o FROM centres, range(-20, 21, 2) AS r(d)')},
{_scores('coarse', 'SELECT pair_id, y AS yaw, y - 1000 AS o FROM votes, range(0, 360, 10) AS r(y) WHERE yaw IS NULL')},
tops AS (SELECT pair_id, arg_min(yaw, (score, o)) AS c FROM coarse GROUP BY 1),
{_scores('later', 'SELECT pair_id, (c + d + 360) % 360 AS yaw, d AS o FROM tops, range(-20, 21, 2) AS r(d)')}
SELECT pair_id, CAST(arg_min(yaw, (score, o)) AS INTEGER) AS best_yaw, 'keypoint_one_shot_refine' AS method FROM refined GROUP BY 1
UNION ALL SELECT pair_id, CAST(arg_min(yaw, (score, o)) AS INTEGER), 'coarse_fine_search' FROM (SELECT * FROM coarse UNION ALL SELECT * FROM later) GROUP BY 1"""


_FENCED = """fences AS (
  SELECT pair_id, count(*) AS n, quantile_cont(lx, 0.25) AS xl, quantile_cont(lx, 0.75) AS xh, quantile_cont(ly, 0.25) AS yl, quantile_cont(ly, 0.75) AS yh FROM pts GROUP BY 1
), marked AS (
  SELECT pair_id, lx, ly, n, (xh - xl <= 0 OR lx BETWEEN xl - 1.5 * (xh - xl) AND xh + 1.5 * (xh - xl)) AND (yh - yl <= 0 OR ly BETWEEN yl - 1.5 * (yh - yl) AND yh + 1.5 * (yh - yl)) AS ok
  FROM pts JOIN fences USING (pair_id)
), counted AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY pair_id) AS good FROM marked),
kept AS (SELECT * FROM counted WHERE ok OR n < 4 OR good < 4)"""
_AXIS = "({c}h - {c}l <= 1e-6 OR {c} BETWEEN {c}l - 1.5 * ({c}h - {c}l) AND {c}h + 1.5 * ({c}h - {c}l))"
_QUARTERS = ", ".join(f"quantile_cont({c}, 0.25) AS {c}l, quantile_cont({c}, 0.75) AS {c}h" for c in ("lx", "ly", "rx", "ry"))



def _fraction(s: str) -> str:
    """A side's box with padding, clamped, as a share of the frame; the boxes here are never empty."""
    x, y = f"{s}x", f"{s}y"
    return (
        f"(least(1024, ceil({x}1 + greatest(1, ({x}1 - {x}0) * 0.02))) - greatest(0, floor({x}0 - greatest(1, ({x}1 - {x}0) * 0.02))))"
        f" * (least(512, ceil({y}1 + greatest(1, ({y}1 - {y}0) * 0.02))) - greatest(0, floor({y}0 - greatest(1, ({y}1 - {y}0) * 0.02)))) / (1024 * 512)"
    )


def _ends(s: str, c: str, size: int) -> tuple[str, str]:
    """Both edges of a side's box on an axis."""
    a, b = f"{s}{c}0", f"{s}{c}1"
    pad = f"greatest(1, ({b} - {a}) * 0.02)"
    return f"greatest(0, floor({a} - {pad}))", f"least({size}, ceil({b} + {pad}))"


def _sides() -> str:
    parts = [(s, c, *_ends(s, c, n)) for s in "lr" for c, n in (("x", 1024), ("y", 512))]
    return ", ".join(f"{a} AS {s}{c}a, {b} AS {s}{c}b" for s, c, a, b in parts)


def _place(s: str, c: str) -> str:
    size = 1024 if c == "x" else 512
    return f"(({s}{c} - coalesce({s}{c}a, 0)) / (coalesce({s}{c}b, {size}) - coalesce({s}{c}a, 0)) * {size})"


_INSIDE = " AND ".join(f"{s}{c} BETWEEN coalesce({s}{c}a, 0) AND coalesce({s}{c}b, {1024 if c == 'x' else 512})" for s in "lr" for c in "xy")
_pixel_iou = _iou(f"SELECT * FROM pixels WHERE NOT {_TEMP}")

QUERIES = {
    "mutual_nn_match": (
        mutual_nn_match,
        """WITH d AS (
          SELECT l.label AS pair_id, l.vec_id AS left_kp, r.vec_id AS right_kp, list_inner_product(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS s
          FROM embeddings AS l JOIN embeddings AS r ON l.label = r.label WHERE l.vec_id % 2 = 0 AND r.vec_id % 2 = 1
        ), x AS (SELECT *, row_number() OVER (PARTITION BY pair_id, left_kp ORDER BY s DESC, right_kp) AS a, row_number() OVER (PARTITION BY pair_id, right_kp ORDER BY s DESC, left_kp) AS b FROM d)
        SELECT pair_id, left_kp, right_kp FROM x WHERE a = 1 AND b = 1""",
    ),
    "match_metrics": (
        match_metrics,
        f"""WITH {fx.MATCHES}, p AS (SELECT pair_id, count(*) AS n, avg(sqrt(pow(lx - rx, 2) + pow(ly - ry, 2))) AS d FROM matches GROUP BY 1)
        SELECT pair_id, round(n / least(n + 5, 2 * n), 8) AS match_ratio, round(d / sqrt(1024 * 1024 + 512 * 512), 8) AS avg_distance FROM p
        UNION ALL SELECT -pair_id - 1, 0, 'infinity'::DOUBLE FROM p""",
    ),
    "keypoint_mask_join": (
        keypoint_mask_join,
        f"""WITH {fx.MATCHES} SELECT pair_id, count(*) FILTER (CAST(ly AS INTEGER) % 3 = 0 OR CAST(lx AS INTEGER) % 7 <> 0) AS allowed, count(*) AS n
        FROM matches GROUP BY 1""",
    ),
    "robust_fence": (
        robust_fence,
        f"""WITH {fx.MATCHES}, pts AS (SELECT pair_id, lx, ly FROM matches UNION ALL SELECT DISTINCT pair_id, 9000::DOUBLE, -9000::DOUBLE FROM matches), {_FENCED}
        SELECT pair_id, count(*) AS n, max(lx) AS far FROM kept GROUP BY 1""",
    ),
    "robust_pairs": (
        robust_pairs,
        f"""WITH {fx.MATCHES}, q AS (SELECT pair_id, count(*) AS n, {_QUARTERS} FROM matches GROUP BY 1)
        SELECT pair_id, count(*) AS n FROM matches JOIN q USING (pair_id) WHERE q.n < 4 OR ({" AND ".join(_AXIS.format(c=c) for c in ("lx", "ly", "rx", "ry"))}) GROUP BY 1""",
    ),
    "fov_crop": (
        fov_crop,
        f"""WITH {fx.MATCHES}, pts AS (SELECT pair_id, lx, ly FROM matches), {_FENCED}, e AS (SELECT pair_id, min(lx) AS a, max(lx) AS b, min(ly) AS c, max(ly) AS d FROM kept GROUP BY 1),
        box AS (SELECT pair_id, CAST(greatest(0, floor(a - greatest(1, (b - a) * 0.02))) AS INTEGER) AS x1, CAST(greatest(0, floor(c - greatest(1, (d - c) * 0.02))) AS INTEGER) AS y1,
          CAST(least(1024, ceil(b + greatest(1, (b - a) * 0.02))) AS INTEGER) AS x2, CAST(least(512, ceil(d + greatest(1, (d - c) * 0.02))) AS INTEGER) AS y2 FROM e)
        SELECT *, round((x2 - x1) * (y2 - y1) / (1024 * 512), 8) AS fraction FROM box""",
    ),
    "fov_pair_crops": (
        fov_pair_crops,
        f"""WITH {fx.MATCHES}, use AS (SELECT * FROM matches WHERE pair_id % 3 <> 0 OR l_linenumber = 1 AND kp % 5 = 0),
        q AS (SELECT pair_id, count(*) AS n, {_QUARTERS} FROM use GROUP BY 1),
        kept AS (SELECT use.* FROM use JOIN q USING (pair_id) WHERE q.n < 4 OR ({" AND ".join(_AXIS.format(c=c) for c in ("lx", "ly", "rx", "ry"))})),
        e AS (SELECT pair_id, {", ".join(f"min({c}) AS {c}0, max({c}) AS {c}1" for c in ("lx", "ly", "rx", "ry"))} FROM kept GROUP BY 1 HAVING count(*) >= 4),
        f AS (SELECT pair_id, {_fraction("l")} AS l, {_fraction("r")} AS r FROM e),
        g AS (SELECT pair_id, coalesce(l, 1) AS l, coalesce(r, 1) AS r FROM (SELECT DISTINCT pair_id FROM use) LEFT JOIN f USING (pair_id))
        SELECT pair_id, round(least(l, r), 8) AS fov_crop_fraction, round(l, 8) AS fov_left_retained_fraction, round(r, 8) AS fov_right_retained_fraction,
               round(1 - l, 8) AS fov_left_cropped_fraction, round(1 - r, 8) AS fov_right_cropped_fraction FROM g""",
    ),
    "yaw_vote": (yaw_vote, f"WITH {_votes('true')} SELECT * FROM votes"),
    "yaw_vote_weak": (yaw_vote_weak, f"WITH {_votes('l_linenumber = 1')} SELECT * FROM votes"),
    "yaw_one_shot": (
        yaw_one_shot,
        f"""WITH {_votes('l_linenumber <= 2')} SELECT CASE WHEN yaw IS NULL THEN 'keypoint_one_shot_failed_yaw0' ELSE 'keypoint_one_shot' END AS method, count(*) AS n FROM votes GROUP BY 1""",
    ),
    "yaw_search": (yaw_search, _search("true")),
    "yaw_search_weak": (yaw_search_weak, _search("l_linenumber = 1")),
    "homography_distortion": (
        homography_distortion,
        """WITH h AS (
          SELECT row_number() OVER () AS rid, l_orderkey AS id, l_discount AS v, 1 + (l_orderkey % 5) * 0.01::DOUBLE AS a, (l_orderkey % 3) * 0.02::DOUBLE AS b, (l_orderkey % 7)::DOUBLE AS c,
            (l_orderkey % 2) * 0.01::DOUBLE AS d, 1 - (l_orderkey % 4) * 0.02::DOUBLE AS e, (l_orderkey % 11)::DOUBLE AS f, (l_orderkey % 3) * 1e-5::DOUBLE AS g, (l_orderkey % 5) * 1e-5::DOUBLE AS i
          FROM lineitem
        ), p AS (SELECT rid, id, v, n, (a * x + b * y + c) / (g * x + i * y + 1) AS u, (d * x + e * y + f) / (g * x + i * y + 1) AS w
          FROM h, (VALUES (0, 0, 0), (1, 1024, 0), (2, 1024, 512), (3, 0, 512)) AS t(n, x, y)
        ), q AS (SELECT l.rid, l.id, l.v, l.u * r.w - r.u * l.w AS z, ln(sqrt(pow(r.u - l.u, 2) + pow(r.w - l.w, 2)) / CASE WHEN l.n % 2 = 0 THEN 1024 ELSE 512 END) AS g
          FROM p AS l JOIN p AS r ON l.rid = r.rid AND r.n = (l.n + 1) % 4)
        SELECT any_value(id) AS id, round(abs(ln(abs(sum(z)) / 2 / (1024 * 512))) + avg(abs(g)) + stddev_pop(g) + 0.25 * (1 - any_value(v)), 8) AS score FROM q GROUP BY rid""",
    ),
    "warp_choice": (
        warp_choice,
        """WITH s AS (SELECT l_partkey, l_linenumber AS o, min(round(l_tax, 2)) + 0 AS score FROM lineitem GROUP BY ALL)
        SELECT l_partkey, 'd' || arg_min(o, (score, o)) AS direction, min(score) AS score FROM s GROUP BY 1""",
    ),
    "image_stats": (
        image_stats,
        """SELECT l_suppkey AS image_id, round(avg(l_quantity * 5), 8) AS brightness, quantile_cont(l_quantity * 5, 0.5) AS median_brightness,
        round(avg(CAST(l_quantity * 5 < 80 AS DOUBLE)), 8) AS dark_fraction, round(stddev_pop(l_quantity * 5), 8) AS contrast FROM lineitem GROUP BY 1""",
    ),
    "horizon_lines": (
        horizon_lines,
        f"""WITH {fx.MATCHES}, a AS (SELECT pair_id, atan2((kp % 60) - 30, 100) AS t, sqrt(pow((kp % 60) - 30, 2) + 10000) AS len FROM matches)
        SELECT pair_id AS image_id, round(degrees(sum(t * len) FILTER (degrees(t) BETWEEN -20 AND 20) / sum(len) FILTER (degrees(t) BETWEEN -20 AND 20)), 8) AS horizon_angle FROM a GROUP BY 1""",
    ),
    "result_table": (
        result_table,
        f"""WITH {fx.MATCHES}, {_pixel_iou}, p AS (SELECT pair_id, avg(sqrt(pow(lx - rx, 2) + pow(ly - ry, 2))) AS d FROM matches GROUP BY 1),
        i AS (SELECT pair_id, round(avg(iou), 8) AS a, round(avg(iou) FILTER (class = 0), 8) AS b FROM iou GROUP BY 1),
        t AS (SELECT pair_id, round(avg(CAST(left_label BETWEEN 11 AND 18 OR right_label BETWEEN 11 AND 18 AS DOUBLE)), 6) AS u FROM pixels GROUP BY 1)
        SELECT 'l' || pair_id AS id_left, 'r' || pair_id AS id_right, CAST(pair_id AS VARCHAR) AS index, 1::DOUBLE AS lightglue_match_ratio,
               round(d / sqrt(1024 * 1024 + 512 * 512), 8) AS lightglue_avg_distance, a AS seg_overlap_mean_iou, b AS seg_overlap_road_iou, u AS seg_temp_union_fraction
        FROM p LEFT JOIN i USING (pair_id) LEFT JOIN t USING (pair_id)""",
    ),
    "result_panorama": (
        result_panorama,
        f"""WITH best AS ({_search("true")}), {fx.MATCHES}, p AS (
          SELECT pair_id, best_yaw, method, avg(sqrt(pow(lx - rx, 2) + pow(ly - ry, 2))) AS d,
                 avg(sqrt(pow(lx - ((rx - round(best_yaw / 360.0 * 1024) + 1024) % 1024), 2) + pow(ly - ry, 2))) AS e
          FROM matches JOIN best USING (pair_id) GROUP BY ALL)
        SELECT 'l' || pair_id AS id_left, 'r' || pair_id AS id_right, best_yaw AS best_yaw_deg, method AS panorama_alignment_method, 1::DOUBLE AS lightglue_match_ratio,
               round(e / sqrt(1024 * 1024 + 512 * 512), 8) AS lightglue_avg_distance, 1::DOUBLE AS orig_lightglue_match_ratio,
               round(d / sqrt(1024 * 1024 + 512 * 512), 8) AS orig_lightglue_avg_distance FROM p""",
    ),
    "result_fov": (
        result_fov,
        f"""WITH {fx.MATCHES}, {_pixel_iou}, q AS (SELECT pair_id, count(*) AS n, {_QUARTERS} FROM matches GROUP BY 1),
        kept AS (SELECT matches.* FROM matches JOIN q USING (pair_id) WHERE q.n < 4 OR ({" AND ".join(_AXIS.format(c=c) for c in ("lx", "ly", "rx", "ry"))})),
        e AS (SELECT pair_id, {", ".join(f"min({c}) AS {c}0, max({c}) AS {c}1" for c in ("lx", "ly", "rx", "ry"))} FROM kept GROUP BY 1 HAVING count(*) >= 4),
        f AS (SELECT pair_id, {_fraction("l")} AS l, {_fraction("r")} AS r, {_sides()} FROM e),
        g AS (SELECT pair_id, count(*) AS n, avg(sqrt(pow(lx - rx, 2) + pow(ly - ry, 2))) AS d,
                coalesce(any_value(l), 1) AS l, coalesce(any_value(r), 1) AS r,
                count(*) FILTER ({_INSIDE}) AS m, avg(sqrt(pow({_place("l", "x")} - {_place("r", "x")}, 2) + pow({_place("l", "y")} - {_place("r", "y")}, 2))) FILTER ({_INSIDE}) AS c
              FROM matches LEFT JOIN f USING (pair_id) GROUP BY 1),
        i AS (SELECT pair_id, round(avg(iou), 8) AS a FROM iou GROUP BY 1)
        SELECT 'l' || pair_id AS id_left, 'r' || pair_id AS id_right, round(m / n, 8) AS lightglue_match_ratio,
               CASE WHEN m = 0 THEN 'infinity'::DOUBLE ELSE round(c / sqrt(1024 * 1024 + 512 * 512), 8) END AS lightglue_avg_distance,
               1::DOUBLE AS orig_lightglue_match_ratio, round(d / sqrt(1024 * 1024 + 512 * 512), 8) AS orig_lightglue_avg_distance, a AS orig_seg_overlap_mean_iou,
               round(least(l, r), 8) AS fov_crop_fraction, round(l, 8) AS fov_left_retained_fraction, round(r, 8) AS fov_right_retained_fraction,
               round(1 - l, 8) AS fov_left_cropped_fraction, round(1 - r, 8) AS fov_right_cropped_fraction FROM g LEFT JOIN i USING (pair_id)""",
    ),
    "sky_heuristic": (sky_heuristic, None),
    "hull_coverage": (hull_coverage, None),
    "homography_ransac": (homography_ransac, None),
    "image_quality": (
        image_quality,
        """WITH p AS (
          SELECT vec_id AS image_id, i // 16 AS y, i % 16 AS x, (CAST(trunc(embedding[i % 64 + 1] * 997::FLOAT) AS INTEGER) % 256 + 256) % 256 AS v
          FROM embeddings, range(256) AS r(i)
        ), s AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) AS a(dy), (VALUES (-1), (0), (1)) AS b(dx)
        ), n AS (
          SELECT a.image_id, a.y, a.x, any_value(a.v) AS v, quantile_cont(b.v, 0.5) AS m FROM p AS a, s JOIN p AS b
          ON b.image_id = a.image_id AND b.y = least(15, greatest(0, a.y + dy)) AND b.x = least(15, greatest(0, a.x + dx)) GROUP BY a.image_id, a.y, a.x
        ), l AS (
          SELECT a.image_id, a.y, a.x, sum(b.v) - 4 * any_value(a.v) AS v FROM p AS a, s JOIN p AS b
          ON b.image_id = a.image_id AND b.y = 15 - abs(15 - abs(a.y + dy)) AND b.x = 15 - abs(15 - abs(a.x + dx)) WHERE abs(dy) + abs(dx) = 1 GROUP BY a.image_id, a.y, a.x
        ), k AS (SELECT image_id, var_pop(v) AS sharpness FROM l GROUP BY 1)
        SELECT image_id, round(avg(v), 8) AS brightness, round(quantile_cont(v, 0.5), 8) AS median_brightness, round(avg(CAST(v < 80 AS DOUBLE)), 8) AS dark_fraction,
               round(stddev_pop(v), 8) AS contrast, round(any_value(sharpness), 8) AS sharpness, round(avg(abs(v - m)), 8) AS noise
        FROM n JOIN k USING (image_id) GROUP BY image_id""",
    ),
    "perspective_views": (
        perspective_views,
        """WITH ray AS (
          SELECT s_suppkey AS image_id, s_suppkey % 4 AS step, yaw, i - 7.5::DOUBLE AS x, j - 7.5::DOUBLE AS y, sqrt(pow(i - 7.5, 2) + pow(j - 7.5, 2) + 64) AS n
          FROM supplier, range(16) AS a(i), range(16) AS b(j), (VALUES (0), (90), (180), (270)) AS q(yaw)
        ), spot AS (
          SELECT image_id, step, yaw, (atan2((cos(radians(yaw)) * x + sin(radians(yaw)) * 8) / n, (cos(radians(yaw)) * 8 - sin(radians(yaw)) * x) / n) / (2 * pi()) + 0.5) * 64 AS u,
                 greatest(0, least(31, (asin(y / n) / pi() + 0.5) * 32)) AS v FROM ray
        ), near AS (
          SELECT image_id, step, yaw, u - floor(u) AS fu, v - floor(v) AS fv, (CAST(floor(u) AS INTEGER) % 64 + 64) % 64 AS l, (CAST(floor(u) AS INTEGER) % 64 + 65) % 64 AS r,
                 CAST(floor(v) AS INTEGER) AS t, least(31, CAST(floor(v) AS INTEGER) + 1) AS b FROM spot
        )
        SELECT image_id, CAST(yaw AS INTEGER) AS yaw, round(avg(round_even(((t + l * step) * (1 - fu) + (t + r * step) * fu) * (1 - fv) + ((b + l * step) * (1 - fu) + (b + r * step) * fu) * fv, 0)), 8) AS mean
        FROM near GROUP BY image_id, yaw""",
    ),
}
