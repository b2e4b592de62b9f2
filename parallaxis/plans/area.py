"""Queries of area mode: scans, pairs, time rules, orders, sampling plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeparts
from ..operators import ordering, pairing, sampling
from ..sources import images as scans
from . import fixtures as fx

AREA = "POLYGON((24.9305 60.1605, 24.9355 60.1605, 24.9355 60.1645, 24.933 60.1622, 24.9305 60.1645, 24.9305 60.1605))"
HOLED = (
    "MULTIPOLYGON(((24.9301 60.1601, 24.9341 60.1601, 24.9341 60.1641, 24.9301 60.1641, 24.9301 60.1601), "
    "(24.9311 60.1611, 24.9331 60.1611, 24.9331 60.1631, 24.9311 60.1631, 24.9311 60.1611)), "
    "((24.9361 60.1601, 24.9381 60.1601, 24.9371 60.1631, 24.9361 60.1601)))"
)
OLD, NEW = (1995, 1996), (2000, 2001)
QUOTA = 50

# ---------------------------------------------------------------- SQL parts

_ARC = "sqrt(pow(sin(radians({r}lat - {l}lat) / 2), 2) + cos(radians({l}lat)) * cos(radians({r}lat)) * pow(sin(radians({r}lon - {l}lon) / 2), 2))"
HAVERSINE = "2 * 6371000.0 * asin(" + _ARC.format(l="l.", r="r.") + ")"
ANGLE = "least(abs(l.compass_angle - r.compass_angle) % 360, 360 - abs(l.compass_angle - r.compass_angle) % 360)"


def _year(c: str) -> str:
    return f"year(make_timestamp({c} * 1000))"


def _month(c: str) -> str:
    return f"month(make_timestamp({c} * 1000))"


def _season(c: str) -> str:
    m = _month(c)
    return f"CASE WHEN {m} IN (3, 4, 5) THEN 'spring' WHEN {m} IN (6, 7, 8) THEN 'summer' WHEN {m} IN (9, 10, 11) THEN 'autumn' WHEN {m} IS NOT NULL THEN 'winter' END"


def _daytime(ms: str, lat: str, lon: str) -> str:
    """Published solar position equations, written out for SQL."""
    g = f"((dayofyear(make_timestamp({ms} * 1000)) - 1) * 2 * pi() / 365)"
    eq = f"(229.18 * (0.000075 + 0.001868 * cos({g}) - 0.032077 * sin({g}) - 0.014615 * cos(2 * {g}) - 0.040849 * sin(2 * {g})))"
    dec = (
        f"(0.006918 - 0.399912 * cos({g}) + 0.070257 * sin({g}) - 0.006758 * cos(2 * {g}) + 0.000907 * sin(2 * {g})"
        f" - 0.002697 * cos(3 * {g}) + 0.00148 * sin(3 * {g}))"
    )
    ha = f"degrees(acos(cos(radians(90.833)) / (cos(radians({lat})) * cos({dec})) - tan(radians({lat})) * tan({dec})))"
    t = f"({ms} % 86400000 / 60000.0)"
    return f"({t} BETWEEN 720 - 4 * ({lon} + {ha}) - {eq} AND 720 - 4 * ({lon} - {ha}) - {eq})"


def _pairs(images: str, where: str = "", distance: float = 2.5) -> str:
    """CTEs up to pairs(l, r) as structs, by a box join with the exact distance."""
    return f"""{images}, used AS (SELECT * FROM images {where}), plane AS (
  SELECT *, lon * (pi() / 180 * 6371000.0) * cos(radians((SELECT avg(lat) FROM used))) AS x, lat * (pi() / 180 * 6371000.0) AS y FROM used
), cells AS (
  SELECT *, CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy FROM plane
), pairs AS (
  SELECT l, r FROM cells AS l, (SELECT c.*, cx + i AS nx, cy + j AS ny FROM cells AS c, range(-1, 2) AS a(i), range(-1, 2) AS b(j)) AS r
  WHERE l.cx = r.nx AND l.cy = r.ny AND l.k < r.k AND sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) <= {distance}
)"""


def _inside(wkt: str) -> str:
    """Even-odd ray cast over the edges, boundary excluded."""
    from ..functions.geo import parse_wkt

    rows = [(*a, *b) for ring in parse_wkt(wkt) for a, b in zip(ring, ring[1:], strict=False)]
    values = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)" for a, b, c, d in rows)
    return f"""edges(x1, y1, x2, y2) AS (VALUES {values}), hits AS (
  SELECT id, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) AS n,
         bool_or((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
                 AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge
  FROM images, edges GROUP BY id
), inside AS (SELECT id FROM hits WHERE n % 2 = 1 AND NOT edge)"""


_TILE_X = "CAST(floor((lon + 180) / 360 * 16384) AS INTEGER)"
_TILE_Y = "CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384) AS INTEGER)"

# ---------------------------------------------------------------- queries


def _images(spark, sf):
    return fx.images(spark, sf)


def _ids(pairs):
    return pairs.select(F.col("l.id").alias("id_left"), F.col("r.id").alias("id_right"))


_IDS = "SELECT l.id AS id_left, r.id AS id_right FROM pairs"


def scan_polygon(spark, sf):
    tiled = scans.tiled(scans.normalized(_images(spark, sf)))
    return scans.scan_area(tiled, AREA).select("id", "lat", "lon")


def scan_multipolygon(spark, sf):
    tiled = scans.tiled(scans.normalized(_images(spark, sf)))
    return scans.scan_area(tiled, HOLED, "panorama").select("id", "is_pano")


def scan_tiles(spark, sf):
    return scans.tiled(_images(spark, sf)).groupBy("tile_z", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))


def tile_list(spark, sf):
    return scans.tiles(spark, AREA)


def dedup_images(spark, sf):
    """Each image comes twice, the copy further east; the first in tile order stays."""
    one = _images(spark, sf)
    two = one.withColumn("lon", F.col("lon") + 0.05)
    blank = one.limit(0).unionByName(one.withColumn("id", F.lit("")))
    return scans.first_by_id(scans.tiled(one.unionByName(two).unionByName(blank)), "lat", "lon").select("id", "lon", "tile_x")


def image_types(spark, sf):
    rows = _images(spark, sf).withColumn("is_pano", F.expr("case when k % 7 = 0 then null else is_pano end"))
    parts = [scans.of_type(rows, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("type"), "n") for t in ("all", "panorama", "flat")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pair_proximity(spark, sf):
    return _ids(pairing.area_pairs(_images(spark, sf), order="k", distinct=True))


def pair_duplicates(spark, sf):
    """Ids come twice or not at all: rows are paired by place in the table, not by id."""
    rows = _images(spark, sf).withColumn("id", F.expr("case when k % 5 > 0 then cast(k div 2 as string) end"))
    return _ids(pairing.area_pairs(rows))


def pair_same_place(spark, sf):
    """Each image comes twice, and only pairs of the same place count."""
    rows = _images(spark, sf)
    return _ids(pairing.area_pairs(rows.unionByName(rows.withColumn("id", F.concat("id", F.lit("b")))), 0.0))


def pair_angle(spark, sf):
    return _ids(pairing.area_pairs(_images(spark, sf), most_angle=30, order="k", distinct=True))


def pair_metadata(spark, sf):
    pairs = pairing.with_metadata(pairing.area_pairs(_images(spark, sf), order="k", distinct=True))
    return pairs.select(
        F.col("l.id").alias("id_left"), F.col("r.id").alias("id_right"), "dist_m", "angle_diff_deg",
        F.col("l.is_pano").alias("is_pano_left"), F.col("r.is_pano").alias("is_pano_right"),
        *(F.round(F.col(f"{s}.{c}"), 7).alias(f"{c}_{side}") for s, side in (("l", "left"), ("r", "right")) for c in ("lat", "lon")),
    )


def pair_flagship(spark, sf):
    rows = pairing.in_years(_images(spark, sf), OLD, NEW)
    pairs = pairing.area_pairs(rows, most_angle=30, year_group_left=OLD, year_group_right=NEW, order="k", distinct=True)
    return pairing.with_metadata(pairs).select(
        F.col("l.id").alias("id_left"), F.col("r.id").alias("id_right"), "dist_m", "angle_diff_deg"
    )


def _time(*rules):
    def query(spark, sf):
        return _ids(pairing.area_pairs(_images(spark, sf), time_filters=rules, order="k", distinct=True))

    return query


def _time_sql(*conditions: str) -> str:
    both = " AND ".join(f"({c})" for c in conditions)
    return f"WITH {_pairs(fx.IMAGES)} {_IDS} WHERE l.captured_at IS NULL OR r.captured_at IS NULL OR ({both})"


def time_daynight(spark, sf):
    return _ids(pairing.area_pairs(fx.events(spark, sf), 5.0, time_filters=["time"], order="k", distinct=True))


def daytime_rows(spark, sf):
    rows = fx.events(spark, sf)
    return rows.select("id", timeparts.daytime(F.col("captured_at"), F.col("lat"), F.col("lon")).alias("daytime"))


def capture_parts(spark, sf):
    rows = fx.events(spark, sf).unionByName(_images(spark, sf))
    ms = timeparts.millis()
    return rows.groupBy(timeparts.year(ms).alias("year"), timeparts.month(ms).alias("month"), timeparts.season(ms).alias("season")).agg(
        F.count(F.lit(1)).alias("n")
    )


def year_groups(spark, sf):
    return _ids(pairing.area_pairs(_images(spark, sf), year_group_left=OLD, year_group_right=NEW, order="k", distinct=True))


def year_prefilter_counts(spark, sf):
    return pairing.year_counts(pairing.in_years(_images(spark, sf), OLD, NEW))


def area_summary(spark, sf):
    return pairing.area_summary(_images(spark, sf))


def capture_range(spark, sf):
    return pairing.capture_range(_images(spark, sf))


def resume_anti_join(spark, sf):
    """Every third pair is done, half of those the other way round."""
    pairs = _ids(pairing.area_pairs(_images(spark, sf), order="k", distinct=True))
    left = F.col("id_left").cast("long")
    done = pairs.where(left % 3 == 0).select(
        F.when(left % 2 == 0, F.col("id_left")).otherwise(F.col("id_right")).alias("id_left"),
        F.when(left % 2 == 0, F.col("id_right")).otherwise(F.col("id_left")).alias("id_right"),
    )
    return pairing.pending(pairs, done)


def manifest_anti_join(spark, sf):
    """Done pairs count one way round only."""
    pairs = _ids(pairing.area_pairs(_images(spark, sf), order="k", distinct=True))
    left = F.col("id_left").cast("long")
    done = pairs.where(left % 3 == 0).select(
        F.when(left % 2 == 0, F.col("id_left")).otherwise(F.col("id_right")).alias("id_left"),
        F.when(left % 2 == 0, F.col("id_right")).otherwise(F.col("id_left")).alias("id_right"),
    )
    return pairing.pending(pairs, done, ordered=True)


def round_robin_order(spark, sf):
    rows = _images(spark, sf).withColumn("year", timeparts.year(F.col("captured_at")))
    turns = ordering.round_robin(rows, F.col("year"), F.col("id"), 42)
    return ordering.positions(turns, "turn", "turn_key").select("id", "year", "turn", "position")


def balanced_pairs(spark, sf):
    rows = scans.tiled(_images(spark, sf), 18)
    pairs = pairing.area_pairs(rows, time_filters=["year"], order="k", distinct=True).where("l.captured_at is not null and r.captured_at is not null")
    return ordering.balanced_pairs(pairs, ["year"]).groupBy("turn").agg(F.count(F.lit(1)).alias("n"))


def dry_run_counts(spark, sf):
    """Images, pairs, pairs that pass, done and pending, in one row."""
    rows = _images(spark, sf)
    base = pairing.area_pairs(rows, order="k", distinct=True)
    passing = base.select("l", "r", (pairing.angle_ok(30) & pairing.time_ok(["year"])).alias("ok"))
    counts = passing.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if("ok").alias("passing"),
        F.count_if(F.col("ok") & (F.col("l.k") % 3 == 0)).alias("done"),
    )
    total = rows.agg(F.count(F.lit(1)).alias("images"))
    return total.join(F.broadcast(counts)).withColumn("pending", F.col("passing") - F.col("done"))


def _strata(spark, sf, mode):
    rows = sampling.time_columns(_images(spark, sf))
    return rows, sampling.strata(mode, OLD, NEW)


def sample_groups(spark, sf):
    rows, groups = _strata(spark, sf, "same-season")
    return sampling.plan(rows, groups, QUOTA).select("year_group", "available")


def sample_plan(spark, sf):
    rows, groups = _strata(spark, sf, "year")
    existing = sampling.members(rows, groups).where("k % 50 = 0").select("id", "year_group")
    return sampling.plan(rows, groups, QUOTA, existing, allow_short=True)


def sample_quota(spark, sf):
    rows, groups = _strata(spark, sf, "same-season")
    return sampling.quota_sample(rows, groups, QUOTA).select("id", "year_group")


def sample_resume(spark, sf):
    """A run that goes on after an earlier one: existing ids stay out, and their number counts."""
    rows, groups = _strata(spark, sf, "season")
    existing = sampling.members(rows, groups).where("k % 100 = 0").select("id", "year_group")
    return sampling.quota_sample(rows, groups, 40, existing).select("id", "year_group")


def sample_months(spark, sf):
    rows, groups = _strata(spark, sf, "month")
    return sampling.plan(rows, groups, 10).select("year_group", "available", "remaining")


def sample_daynight(spark, sf):
    rows = sampling.time_columns(fx.events(spark, sf), with_daytime=True)
    return sampling.plan(rows, sampling.strata("time"), QUOTA).select("year_group", "available")


def sample_counts(spark, sf):
    rows, groups = _strata(spark, sf, "year")
    return sampling.members(rows, groups).groupBy("year_group", "year").agg(F.count(F.lit(1)).alias("n"))


_TIMED = f"""{fx.IMAGES}, timed AS (
  SELECT *, {_year('captured_at')} AS year, {_month('captured_at')} AS month, {_season('captured_at')} AS season FROM images WHERE captured_at IS NOT NULL
)"""
_SEASON_GROUPS = f"""{_TIMED}, labels AS (
  SELECT a || '_' || s AS year_group, row_number() OVER () AS o FROM (VALUES ('winter', 1), ('spring', 2), ('summer', 3), ('autumn', 4)) AS t(s, i), (VALUES ('old', 1), ('new', 2)) AS u(a, j)
), members AS (
  SELECT id, k, year, CASE WHEN year IN (1995, 1996) THEN 'old_' ELSE 'new_' END || season AS year_group FROM timed WHERE year IN (1995, 1996, 2000, 2001)
)"""
_YEAR_GROUPS = f"""{_TIMED}, members AS (
  SELECT id, k, year, CASE WHEN year IN (1995, 1996) THEN 'old' ELSE 'new' END AS year_group FROM timed WHERE year IN (1995, 1996, 2000, 2001)
)"""
_DONE = "CAST(id_left AS BIGINT) % 3 = 0"
_YL, _YR = _year("l.captured_at"), _year("r.captured_at")
_ML, _MR = _month("l.captured_at"), _month("r.captured_at")
_SL, _SR = _season("l.captured_at"), _season("r.captured_at")
_GROUPS = f"(({_YL} IN (1995, 1996) AND {_YR} IN (2000, 2001)) OR ({_YL} IN (2000, 2001) AND {_YR} IN (1995, 1996)))"
_ANGLE_OK = f"(l.compass_angle IS NULL OR r.compass_angle IS NULL OR {ANGLE} <= 30)"
_META = f"l.id AS id_left, r.id AS id_right, round({HAVERSINE}, 3) AS dist_m, round({ANGLE}, 2) AS angle_diff_deg"
_ROUND = f"""{fx.IMAGES}, rows_ AS (
  SELECT id, {_year('captured_at')} AS year FROM images
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY md5('42:' || id)) AS turn FROM rows_
)"""
_MID_DAY = _daytime("l.captured_at", "((l.lat + r.lat) / 2)", "((l.lon + r.lon) / 2)")
_MID_DAY2 = _daytime("r.captured_at", "((l.lat + r.lat) / 2)", "((l.lon + r.lon) / 2)")

QUERIES = {
    "scan_polygon": (scan_polygon, f"WITH {fx.IMAGES}, {_inside(AREA)} SELECT id, lat, lon FROM images JOIN inside USING (id)"),
    "scan_multipolygon": (scan_multipolygon, f"WITH {fx.IMAGES}, {_inside(HOLED)} SELECT id, is_pano FROM images JOIN inside USING (id) WHERE is_pano"),
    "scan_tiles": (scan_tiles, f"WITH {fx.IMAGES} SELECT 14 AS tile_z, {_TILE_X} AS tile_x, {_TILE_Y} AS tile_y, count(*) AS n FROM images GROUP BY ALL"),
    "tile_list": (
        tile_list,
        f"""WITH box(lon, lat) AS (VALUES (24.9305::DOUBLE, 60.1645::DOUBLE), (24.9355::DOUBLE, 60.1605::DOUBLE)),
        ends AS (SELECT min({_TILE_X}) AS x0, max({_TILE_X}) AS x1, min({_TILE_Y}) AS y0, max({_TILE_Y}) AS y1 FROM box)
        SELECT 14 AS tile_z, CAST(x AS INTEGER) AS tile_x, CAST(y AS INTEGER) AS tile_y
        FROM ends, range(x0, x1 + 1) AS a(x), range(y0, y1 + 1) AS b(y)""",
    ),
    "dedup_images": (dedup_images, f"WITH {fx.IMAGES} SELECT id, lon, {_TILE_X} AS tile_x FROM images"),
    "image_types": (
        image_types,
        f"""WITH {fx.IMAGES} SELECT 'all' AS type, count(*) AS n FROM images
        UNION ALL SELECT 'panorama', count(*) FROM images WHERE is_pano AND k % 7 <> 0
        UNION ALL SELECT 'flat', count(*) FROM images WHERE NOT is_pano OR k % 7 = 0""",
    ),
    "pair_proximity": (pair_proximity, f"WITH {_pairs(fx.IMAGES)} {_IDS}"),
    "pair_duplicates": (
        pair_duplicates,
        f"""WITH {_pairs(fx.IMAGES)}, named AS (
          SELECT CASE WHEN l.k % 5 > 0 THEN CAST(l.k // 2 AS VARCHAR) END AS a, CASE WHEN r.k % 5 > 0 THEN CAST(r.k // 2 AS VARCHAR) END AS b FROM pairs)
        SELECT CASE WHEN b IS NULL OR b < a THEN b ELSE a END AS id_left, CASE WHEN b IS NULL OR b < a THEN a ELSE b END AS id_right FROM named""",
    ),
    "pair_same_place": (
        pair_same_place,
        f"""WITH {fx.IMAGES}, both_ AS (SELECT id, lon, lat FROM images UNION ALL SELECT id || 'b', lon, lat FROM images)
        SELECT least(l.id, r.id) AS id_left, greatest(l.id, r.id) AS id_right FROM both_ AS l JOIN both_ AS r
        ON l.lon = r.lon AND l.lat = r.lat AND l.id < r.id""",
    ),
    "pair_angle": (pair_angle, f"WITH {_pairs(fx.IMAGES)} {_IDS} WHERE {_ANGLE_OK}"),
    "pair_metadata": (
        pair_metadata,
        f"""WITH {_pairs(fx.IMAGES)} SELECT {_META}, l.is_pano AS is_pano_left, r.is_pano AS is_pano_right,
        round(l.lat, 7) AS lat_left, round(l.lon, 7) AS lon_left, round(r.lat, 7) AS lat_right, round(r.lon, 7) AS lon_right FROM pairs""",
    ),
    "pair_flagship": (
        pair_flagship,
        f"WITH {_pairs(fx.IMAGES, 'WHERE ' + _year('captured_at') + ' IN (1995, 1996, 2000, 2001)')} SELECT {_META} FROM pairs WHERE {_ANGLE_OK} AND {_GROUPS}",
    ),
    "time_year": (_time("year"), _time_sql(f"{_YL} <> {_YR}")),
    "time_month": (_time("month"), _time_sql(f"{_YL} <> {_YR} OR {_ML} <> {_MR}")),
    "time_season": (_time("season"), _time_sql(f"{_SL} <> {_SR}")),
    "time_same_season": (_time("same-season"), _time_sql(f"{_YL} <> {_YR}", f"{_SL} = {_SR}")),
    "time_year_and_season": (_time("any", "year", "season"), _time_sql(f"{_YL} <> {_YR}", f"{_SL} <> {_SR}")),
    "time_daynight": (
        time_daynight,
        f"WITH {_pairs(fx.EVENTS, '', 5.0)} {_IDS} WHERE {_MID_DAY} <> {_MID_DAY2}",
    ),
    "daytime_rows": (daytime_rows, f"WITH {fx.EVENTS} SELECT id, {_daytime('captured_at', 'lat', 'lon')} AS daytime FROM images"),
    "capture_parts": (
        capture_parts,
        f"""WITH {fx.EVENTS.replace('images AS', 'a AS')}, {fx.IMAGES.replace('images AS', 'b AS')}, c AS (SELECT captured_at FROM a UNION ALL SELECT captured_at FROM b)
        SELECT {_year('captured_at')} AS year, {_month('captured_at')} AS month, {_season('captured_at')} AS season, count(*) AS n FROM c GROUP BY ALL""",
    ),
    "year_groups": (year_groups, f"WITH {_pairs(fx.IMAGES)} {_IDS} WHERE {_GROUPS}"),
    "year_prefilter_counts": (
        year_prefilter_counts,
        f"WITH {fx.IMAGES} SELECT {_year('captured_at')} AS year, count(*) AS n FROM images WHERE {_year('captured_at')} IN (1995, 1996, 2000, 2001) GROUP BY ALL",
    ),
    "area_summary": (
        area_summary,
        f"WITH {fx.IMAGES} SELECT count(*) AS images, count(*) FILTER (is_pano) AS panoramas, count(*) FILTER (NOT is_pano) AS flat, min(captured_at) AS first_ms, max(captured_at) AS last_ms FROM images",
    ),
    "capture_range": (
        capture_range,
        f"""WITH {fx.IMAGES} SELECT CAST(min(CAST(make_timestamp(captured_at * 1000) AS DATE)) AS VARCHAR) AS first_day,
        CAST(max(CAST(make_timestamp(captured_at * 1000) AS DATE)) AS VARCHAR) AS last_day FROM images""",
    ),
    "resume_anti_join": (resume_anti_join, f"WITH {_pairs(fx.IMAGES)}, ids AS ({_IDS}) SELECT * FROM ids WHERE NOT ({_DONE})"),
    "manifest_anti_join": (
        manifest_anti_join,
        f"WITH {_pairs(fx.IMAGES)}, ids AS ({_IDS}) SELECT * FROM ids WHERE NOT ({_DONE} AND CAST(id_left AS BIGINT) % 2 = 0)",
    ),
    "round_robin_order": (
        round_robin_order,
        f"""WITH {_ROUND} SELECT id, year, turn,
        row_number() OVER (ORDER BY turn, md5('42:' || turn || ':' || coalesce(CAST(year AS VARCHAR), 'none'))) - 1 AS position FROM turns""",
    ),
    "balanced_pairs": (
        balanced_pairs,
        f"""WITH {_pairs(fx.IMAGES)}, b AS (
          SELECT {_YL} AS ly, {_YR} AS ry, l.lon AS llon, l.lat AS llat, r.lon AS rlon, r.lat AS rlat FROM pairs WHERE {_YL} <> {_YR}
        ), t AS (
          SELECT least(ly, ry) AS y0, greatest(ly, ry) AS y1,
                 [CAST(floor((llon + 180) / 360 * 262144) AS BIGINT), CAST(floor((1 - asinh(tan(radians(llat))) / pi()) / 2 * 262144) AS BIGINT)] AS a,
                 [CAST(floor((rlon + 180) / 360 * 262144) AS BIGINT), CAST(floor((1 - asinh(tan(radians(rlat))) / pi()) / 2 * 262144) AS BIGINT)] AS b FROM b
        ), sizes AS (SELECT count(*) AS n FROM t GROUP BY y0, y1, least(a, b), greatest(a, b))
        SELECT CAST(turn AS BIGINT) AS turn, count(*) AS n FROM sizes, range(1, n + 1) AS r(turn) GROUP BY turn""",
    ),
    "dry_run_counts": (
        dry_run_counts,
        f"""WITH {_pairs(fx.IMAGES)}, f AS (SELECT l.k AS k, {_ANGLE_OK} AND (l.captured_at IS NULL OR r.captured_at IS NULL OR {_YL} <> {_YR}) AS ok FROM pairs)
        SELECT (SELECT count(*) FROM images) AS images, count(*) AS pairs, count(*) FILTER (ok) AS passing,
               count(*) FILTER (ok AND k % 3 = 0) AS done, count(*) FILTER (ok AND k % 3 <> 0) AS pending FROM f""",
    ),
    "sample_groups": (
        sample_groups,
        f"WITH {_SEASON_GROUPS} SELECT labels.year_group, count(id) AS available FROM labels LEFT JOIN members USING (year_group) GROUP BY 1",
    ),
    "sample_plan": (
        sample_plan,
        f"""WITH {_YEAR_GROUPS}, c AS (
          SELECT year_group, count(*) AS available, count(*) FILTER (k % 50 <> 0) AS candidates, count(*) FILTER (k % 50 = 0) AS existing FROM members GROUP BY 1)
        SELECT year_group, available, candidates, existing, least({QUOTA}, available) AS target, greatest(0, least({QUOTA}, available) - existing) AS remaining FROM c""",
    ),
    "sample_quota": (
        sample_quota,
        f"""WITH {_SEASON_GROUPS}, n AS (SELECT id, year_group, row_number() OVER (PARTITION BY year_group ORDER BY md5('42:' || id)) AS n FROM members)
        SELECT id, year_group FROM n WHERE n <= {QUOTA}""",
    ),
    "sample_resume": (
        sample_resume,
        f"""WITH {_TIMED}, had AS (SELECT season, count(*) AS h FROM timed WHERE k % 100 = 0 GROUP BY 1),
        n AS (SELECT id, season, row_number() OVER (PARTITION BY season ORDER BY md5('42:' || id)) AS n FROM timed WHERE k % 100 <> 0)
        SELECT id, season AS year_group FROM n LEFT JOIN had USING (season) WHERE n <= greatest(0, 40 - coalesce(h, 0))""",
    ),
    "sample_months": (
        sample_months,
        f"""WITH {_TIMED} SELECT 'month_' || lpad(CAST(m AS VARCHAR), 2, '0') AS year_group, count(id) AS available, CAST(10 AS BIGINT) AS remaining
        FROM range(1, 13) AS r(m) LEFT JOIN timed ON month = m GROUP BY m""",
    ),
    "sample_daynight": (
        sample_daynight,
        f"""WITH {fx.EVENTS} SELECT CASE WHEN {_daytime('captured_at', 'lat', 'lon')} THEN 'day' ELSE 'night' END AS year_group, count(*) AS available
        FROM images WHERE {_daytime('captured_at', 'lat', 'lon')} IS NOT NULL GROUP BY 1""",
    ),
    "sample_counts": (sample_counts, f"WITH {_YEAR_GROUPS} SELECT year_group, year, count(*) AS n FROM members GROUP BY ALL"),
}
