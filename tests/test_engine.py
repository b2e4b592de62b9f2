"""Helpers and operators of the image engine: null rules, edges and ties on small inputs."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis import manifest, settings
from parallaxis.functions import geo, text, timeparts
from parallaxis.functions.register import register
from parallaxis.operators import masks, matches, ordering, pairing, raster, results, sampling
from parallaxis.operators.models import BatchModel, TableMatcher, TableSegmenter, sampler_fields, with_stored
from parallaxis.sources import images as scans
from parallaxis.sources import pair_tables, tiles, vector_tiles

IMAGE = "id string, lat double, lon double, compass_angle double, is_pano boolean, captured_at long"
Y2020, Y2024 = 1577836800000, 1704067200000


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_capture_parts(spark):
    df = spark.createDataFrame([("1704067200000",), (None,), ("text",)], "captured_at string")
    assert [r[0] for r in df.select(timeparts.year(timeparts.millis())).collect()] == [2024, None, None]
    assert one(spark, timeparts.season(F.lit(Y2024))) == "winter"
    assert one(spark, timeparts.year(F.lit(-1))) == 1969


def test_daytime_is_null_in_polar_night(spark):
    noon = Y2024 + 12 * 3_600_000
    at = lambda lat: one(spark, timeparts.daytime(F.lit(noon), F.lit(lat), F.lit(25.0)))
    assert at(60.0) is True and at(80.0) is None
    assert one(spark, timeparts.daytime(F.lit(Y2024), F.lit(60.0), F.lit(25.0))) is False


def test_labels_stems_and_numbers(spark):
    assert one(spark, text.safe_label(F.lit("Road / Sidewalk"))) == "road_sidewalk"
    assert one(spark, text.safe_label(F.lit(" -- "))) == "class"
    assert one(spark, text.file_stem(F.lit("a/b.c.jpg"))) == "b.c"
    assert one(spark, text.file_stem(F.lit(".hidden"))) == ".hidden"
    assert one(spark, text.number(F.lit("inf"))) == math.inf
    assert one(spark, text.number(F.lit("NA"))) is None and one(spark, text.number(F.lit("NaN"))) is None
    m = F.create_map(F.lit(10), F.lit(0.5), F.lit(2), F.lit(0.25))
    assert one(spark, text.shares_json(m)) == '{"2":0.25,"10":0.5}'
    names = F.create_map(F.lit(2), F.lit("sky"))
    assert one(spark, F.to_json(text.named_shares(m, names))) in ('{"class_10":0.5,"sky":0.25}', '{"sky":0.25,"class_10":0.5}')


def test_polygon_excludes_its_boundary(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.0, 0.5), (1.0, 1.0), (0.5, 1.5), (0.25, 0.25)], "lon double, lat double")
    square = "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0), (0.2 0.2, 0.3 0.2, 0.3 0.3, 0.2 0.3, 0.2 0.2))"
    assert rows_of(df.where(geo.within(square))) == [(0.5, 0.5)]
    with pytest.raises(ValueError):
        geo.parse_wkt("LINESTRING(0 0, 1 1)")


def test_angle_difference_and_projection(spark):
    assert one(spark, geo.angle_diff(F.lit(5.0), F.lit(355.0))) == 10.0
    assert one(spark, geo.circular_distance(F.lit(1.0), F.lit(359.0))) == 2.0
    lon, lat = geo.tile_position(F.lit(0), F.lit(0), F.lit(10.0), F.lit(11.0), F.lit(51.0), F.lit(50.0))
    assert (one(spark, lon), one(spark, lat)) == (10.0, 51.0)


def test_two_images_pair_once(spark):
    df = spark.createDataFrame(
        [("a", 60.0, 25.0, 5.0, True, Y2020), ("b", 60.0, 25.00001, 355.0, True, Y2024)], IMAGE
    )
    got = pairing.with_metadata(pairing.area_pairs(df, 2.0, 30, ["year"])).select("l.id", "r.id", "dist_m", "angle_diff_deg").collect()
    assert len(got) == 1 and got[0][:2] == ("a", "b") and got[0][2] > 0 and got[0][3] == 10.0
    assert pairing.area_pairs(df, 2.0, 5).count() == 0
    assert pairing.area_pairs(df.limit(0), 2.0).count() == 0


def test_null_rules_differ_between_time_and_year_groups(spark):
    df = spark.createDataFrame([("a", 60.0, 25.0, None, None, None), ("b", 60.0, 25.0, 10.0, True, Y2024)], IMAGE)
    assert pairing.area_pairs(df, 1.0, 5, ["year", "season"]).count() == 1
    assert pairing.area_pairs(df, 1.0, year_group_left=[2020], year_group_right=[2024]).count() == 0
    assert pairing.area_pairs(df, 1.0, year_group_left=[2020]).count() == 1
    assert pairing.in_years(df, [2024], [2020]).count() == 1
    with pytest.raises(ValueError):
        pairing.time_ok(["decade"])


def test_grid_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    points = [(f"{i:04d}", 60 + float(a) * 1e-4, 25 + float(b) * 2e-4, None, False, None) for i, (a, b) in enumerate(rng.random((300, 2)))]
    df = spark.createDataFrame(points, IMAGE)
    mean = math.radians(sum(p[1] for p in points) / len(points))
    scale = math.pi / 180 * geo.EARTH_RADIUS_M
    xy = [(p[2] * scale * math.cos(mean), p[1] * scale) for p in points]
    for d in (0.5, 2.5):
        want = {(points[i][0], points[j][0]) for i in range(300) for j in range(i + 1, 300) if math.dist(xy[i], xy[j]) <= d}
        got = [tuple(r) for r in pairing.area_pairs(df, d).select("l.id", "r.id").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_equal_and_missing_ids(spark):
    """Rows are paired by place, whatever their ids; identical rows as well."""
    rows = [("a", 60.0, 24.0), ("a", 60.0, 24.0), (None, 60.0, 24.0), ("b", 60.0, 24.0), (None, 60.0, 24.0), ("c", 61.0, 24.0)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double").withColumns(
        {"captured_at": F.lit(None).cast("long"), "compass_angle": F.lit(None).cast("double"), "is_pano": F.lit(False)}
    )
    got = Counter((r[0], r[1]) for r in pairing.area_pairs(df, 2.0).select("l.id", "r.id").collect())
    assert got == {(None, "a"): 4, (None, "b"): 2, ("a", "a"): 1, (None, None): 1, ("a", "b"): 2}
    assert pairing.area_pairs(df, 0.0).count() == 10 and pairing.area_pairs(df, -1.0).count() == 0
    line = [("x", 60.0 + i * 1.8e-5, 24.0) for i in range(6)]
    df = spark.createDataFrame(line, "id string, lat double, lon double").withColumns(
        {"captured_at": F.lit(None).cast("long"), "compass_angle": F.lit(None).cast("double"), "is_pano": F.lit(False)}
    )
    assert pairing.area_pairs(df, 2.1).count() == 5


def test_done_pairs_count_either_way_round(spark):
    pairs = spark.createDataFrame([("1", "2"), ("3", "4"), ("5", "6")], "id_left string, id_right string")
    done = spark.createDataFrame([("2", "1"), ("3", "4")], "id_left string, id_right string")
    assert rows_of(pairing.pending(pairs, done)) == [("5", "6")]
    assert rows_of(pairing.pending(pairs, done, ordered=True)) == [("1", "2"), ("5", "6")]


def test_scan_keeps_the_first_of_an_id(spark):
    df = spark.createDataFrame(
        [("a", 60.0, 25.0, math.nan, None, None), ("a", 60.0, 25.5, 1.0, True, None), ("", 60.0, 25.0, 1.0, True, None)], IMAGE
    )
    tiled = scans.tiled(scans.normalized(df))
    assert [(r["id"], r["lon"], r["compass_angle"], r["is_pano"]) for r in scans.first_by_id(tiled, "lon").collect()] == [("a", 25.0, None, False)]
    with pytest.raises(ValueError):
        scans.of_type(df, "round")


def test_round_robin_visits_each_bucket_in_turn(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", None)], "id string, y int")
    got = ordering.positions(ordering.round_robin(df, F.col("y"), F.col("id")), "turn", "turn_key").orderBy("position").collect()
    assert [r["turn"] for r in got] == [1, 1, 1, 2, 3] and [r["position"] for r in got] == list(range(5))
    assert {r["y"] for r in got[:3]} == {1, 2, None}


def test_explicit_pairs_fall_back_and_fail(spark):
    df = spark.createDataFrame(
        [(1, "x/one.png", "two.jpg", None, " 2020 "), (2, "three.png", "four.png", "left", None)],
        "k int, left_filename string, filename_2 string, id_a string, date_left string",
    )
    got = pair_tables.load(df, "k").orderBy("index").collect()
    assert [tuple(r)[:4] for r in got] == [("one", "two", "2020", "N/A"), ("left", "four", "N/A", "N/A")]
    assert [r["index"] for r in got] == ["1", "2"]
    with pytest.raises(ValueError):
        pair_tables.load(df, "k", indices=[1])
    with pytest.raises(Exception, match="lacks a file name"):
        pair_tables.load(df.withColumn("left_filename", F.lit(" ")), "k").collect()
    with pytest.raises(ValueError):
        pair_tables.load(spark.range(1), "id")


def test_thresholds_drop_what_is_not_a_number(spark):
    df = spark.createDataFrame([("a", "0.5", "0.01"), ("b", "NaN", "0.01"), ("c", "NA", "inf")], "id string, lightglue_match_ratio string, lightglue_avg_distance string")
    assert [r["id"] for r in results.passing(df, results.active(match_ratio_min=0.2, avg_distance_max=0.08)).collect()] == ["a"]
    assert results.passing(df, []).count() == 3
    with pytest.raises(ValueError, match="seg_overlap_road_iou"):
        results.passing(df, results.active(road_iou_min=0.1))
    assert "brightness_left" not in results.columns(image_metrics=False)
    assert not [c for c in results.columns("fov", image_metrics=False) if "brightness" in c]
    assert results.columns("panorama", area=True)[-1] == "lon_right"


def test_filtered_output_counts_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", "0.5"), ("b", "0.1")], "id string, lightglue_match_ratio string")
    summary = results.write_passing(df, results.active(match_ratio_min=0.2), str(tmp_path / "out"))
    assert (summary["source_rows"], summary["filtered_rows"]) == (2, 1)


def test_appending_a_run_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "results")
    for batch, n in (("one", 3), ("two", 2), ("one", 3)):
        results.append(spark.range(n), path, batch)
    assert spark.read.parquet(path).count() == 5


def test_deciles_of_a_constant_metric_are_empty(spark):
    df = spark.createDataFrame([(i, "1.0", str(float(i))) for i in range(20)], "id int, a string, b string")
    got = sampling.deciles(df, ["a", "b"], ["id"]).groupBy("metric", "decile").count().collect()
    assert len(got) == 10 and all(r["metric"] == "b" and r["count"] == 2 for r in got)


def test_empty_strata_stay_in_the_plan(spark):
    df = spark.createDataFrame([("a", Y2024), ("b", Y2024 + 31 * timeparts.DAY_MS), ("c", None)], "id string, captured_at long")
    plan = {r["year_group"]: r["available"] for r in sampling.plan(sampling.time_columns(df), sampling.strata("month"), 1).collect()}
    assert plan["month_01"] == 1 and plan["month_02"] == 1 and plan["month_03"] == 0 and len(plan) == 12
    with pytest.raises(ValueError):
        sampling.mode_of(["year", "month"])


def test_image_in_two_groups_is_used_once(spark):
    df = sampling.time_columns(spark.createDataFrame([("a", Y2024)], "id string, captured_at long"))
    groups = sampling.strata("year", [2024], [2024])
    assert rows_of(sampling.quota_sample(df, groups, 5).select("id", "year_group")) == [("a", "old")]


def test_iou_ignores_temporary_pixels(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 0, 1, 0, 1), (1, 0, 2, 13, 0), (1, 0, 3, 255, 0)], "pair_id int, y int, x int, left_label int, right_label int")
    got = masks.iou_summary(df, [0], [13]).first()
    assert (got["mean_iou"], got["road_iou"]) == (0.25, 0.5) and got["per_class_json"] == '{"0":0.5,"1":0.0}'
    shares = {(r["side"], r["class"]): (r["before"], r["after"]) for r in masks.share_summary(df, [13]).collect()}
    assert shares["left", 13] == (pytest.approx(1 / 3), None) and shares["left", 0] == (pytest.approx(2 / 3), 1.0)


def test_fences_need_four_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 1.0), (1, 99.0, 0.0)], "pair_id int, x double, y double")
    assert matches.fenced(df, ["x", "y"]).count() == 3


def test_metrics_without_matches_are_zero_and_infinite(spark):
    empty = spark.createDataFrame([], "pair_id int, lx double, ly double, rx double, ry double")
    counts = spark.createDataFrame([(1, 5, 5)], "pair_id int, left_allowed long, right_allowed long")
    assert tuple(matches.metrics(empty, counts, 3, 4).first()) == (1, 0.0, math.inf)


def test_hull_coverage_and_outliers():
    points = np.array([[10, 55], [80, 55], [80, 85], [10, 85], [40, 60], [50, 70]], float)
    mask = np.zeros((100, 100), bool)
    mask[50:] = True
    share = raster.hull_coverage(points, 100, 100, mask)
    assert 0.3 < share < 0.5
    near = points / 4 + [20, 50]
    assert abs(raster.hull_coverage(np.vstack([near, [[99, 75]]]), 100, 100, mask) - raster.hull_coverage(near, 100, 100, mask)) < 0.03
    square = np.array([[10, 10], [40, 10], [40, 40], [10, 40]], float)
    assert raster.hull_iou(square, square, 100, 100) == 1.0
    assert raster.hull_iou(square, square + 40, 100, 100) < 0.05
    assert raster.fill_convex(square.astype(int), 100, 100).sum() == 31 * 31
    assert raster.hull_coverage(points[:2], 100, 100) == 0.0


def test_homography_is_found_among_outliers():
    rng = np.random.default_rng(0)
    h = np.array([[1.1, 0.02, 5], [-0.03, 0.95, 7], [1e-4, -5e-5, 1]])
    src = rng.random((40, 2)) * 500
    dst = raster.apply_homography(h, src)
    dst[30:] += 200 * rng.random((10, 2)) + 50
    n, total, ratio = raster.homography_support(src, dst)
    assert (n, total) == (30, 40) and ratio == 0.75
    assert raster.homography_support(src[:3], dst[:3]) == (0, 0, 0.0)
    same = raster.fit_similarity(src, src * 2 + 3)
    assert np.allclose(same, [[2, 0, 3], [0, 2, 3], [0, 0, 1]])
    m, label = raster.align_similarity(src, src * 2 + 3)
    assert label == "affine_keypoints_40_inliers" and np.allclose(m[:2, 2], 3)
    assert raster.align_similarity(src[:5], src[:5])[1] == "not_enough_matches"


def test_images_and_masks_in_numpy():
    flat = np.full((8, 8), 128, np.uint8)
    got = raster.quality(flat)
    assert got["brightness"] == 128 and got["sharpness"] == got["noise"] == got["contrast"] == got["dark_fraction"] == 0
    assert raster.crop_band(np.zeros((5, 4)), 0.6, panorama=False).shape == (3, 4)
    rows = np.arange(10)[:, None]
    assert raster.crop_band(rows, 0.5, 1.0)[0, 0] == 0 and raster.crop_band(rows, 0.5, 1.0, panorama=False)[0, 0] == 5
    blocked = np.zeros((9, 9), bool)
    blocked[2:7, 2:7] = True
    assert raster.allowed_mask(blocked, 2)[3, 3] and not raster.allowed_mask(blocked, 2)[4, 4]
    assert not raster.allowed_mask(np.ones((3, 3), bool)).any() and raster.allowed_mask(~np.ones((3, 3), bool)).all()
    assert raster.turned(np.arange(8)[None], 90).tolist() == [[2, 3, 4, 5, 6, 7, 0, 1]]
    assert raster.mosaic([np.zeros((2, 3, 3), np.uint8)] * 3, 2).shape == (4, 6, 3)
    assert raster.perspective(np.full((16, 32, 3), 7, np.uint8), 30).min() == 7
    assert raster.colored(np.array([[1]], np.uint8), {1: (1, 2, 3)}).tolist() == [[[1, 2, 3]]]


def test_sky_hangs_together_with_the_top():
    rgb = np.zeros((20, 20, 3), np.uint8)
    rgb[:5] = (120, 180, 240)
    rgb[9:11, 5:9] = (120, 180, 240)
    found = raster.sky(rgb)
    assert found[:4].all() and not found[8:].any()


def test_bad_images_get_an_error_row(spark):
    df = spark.createDataFrame([(1, 2, 2, bytearray(4)), (2, 2, 2, bytearray(3))], "image_id int, height int, width int, data binary")
    got = {r["image_id"]: r for r in raster.images_by_row(df).collect()}
    assert got[1]["error"] is None and got[2]["error"] and got[2]["noise"] is None


def test_settings_order_and_checks(tmp_path, monkeypatch):
    config = tmp_path / "run.toml"
    config.write_text('[common]\noutput = "a"\nnot-known = 1\n[area]\nmax-distance = 4.0\ntime-filter = ["season"]\n')
    env = tmp_path / ".env"
    env.write_text("# note\nIMAGE_ACCESS_TOKEN='from file'\n")
    monkeypatch.delenv("IMAGE_ACCESS_TOKEN", raising=False)
    got = settings.load({"output": "b", "area_wkt": "x"}, config, env)
    assert (got.output, got.max_distance, got.time_filter, got.access_token) == ("b", 4.0, ("season",), "from file")
    monkeypatch.setenv("IMAGE_ACCESS_TOKEN", "real")
    assert settings.load({}, None, env).access_token == "real"
    both = settings.load({"area_wkt": "x", "year_group_left": [1], "year_group_right": [2]}, None, env).checked()
    assert both.time_filter == ("any", "year")
    for wrong in ({}, {"area_wkt": "x", "year_group_left": [1]}, {"area_wkt": "x", "panorama": True, "scale_search": True}):
        with pytest.raises(ValueError):
            settings.load(wrong, None, env).checked()
    assert settings.load({"filter_road_iou_min": 0.5}, None, env).thresholds() == {"road_iou_min": 0.5}


def test_manifest_hides_secrets(tmp_path):
    from datetime import UTC, datetime

    doc = manifest.build({"access_token": "abc", "output": "x"}, ["run", "--access-token", "abc", "--api-key=k", "--output", "x"], "ok", datetime.now(UTC))
    manifest.write(tmp_path / "m" / "run.json", doc)
    text_ = (tmp_path / "m" / "run.json").read_text()
    assert "abc" not in text_ and '"k"' not in text_ and doc["settings"]["output"] == "x"
    assert doc["command"] == ["run", "--access-token", manifest.HIDDEN, f"--api-key={manifest.HIDDEN}", "--output", "x"]


def fetch_tile(z, x, y):
    yield {"id": f"{x}-{y}", "lat": 60.1, "lon": 24.9, "is_pano": True}


def _number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _part(field, data):
    return _number(field << 3 | 2) + _number(len(data)) + data


def vector_tile(z, x, y):
    """A tile of two layers; one image a quarter into the tile, and two in one feature."""
    zigzag = lambda n: n * 2 if n >= 0 else -2 * n - 1
    points = lambda *steps: _part(4, b"".join(_number(n) for n in (len(steps) << 3 | 1, *(zigzag(v) for s in steps for v in s))))
    tags = lambda *n: _part(2, bytes(n))
    keys = b"".join(_part(3, k) for k in (b"compass_angle", b"captured_at", b"is_pano", b"id"))
    values = [b"\x19" + np.float64(12.5).tobytes(), _number(5 << 3) + _number(1577836800000), _number(7 << 3) + b"\x01", _number(6 << 3) + _number(13), _number(4 << 3) + _number(99)]
    one = _part(2, tags(0, 0, 1, 1, 2, 2, 3, 4) + _number(3 << 3) + b"\x01" + points((1024, 1024)))
    two = _part(2, _number(1 << 3) + _number(300) + tags(1, 3) + _number(3 << 3) + b"\x01" + points((0, 0), (4096, -10)))
    line = _part(2, _number(3 << 3) + b"\x02" + points((5, 5)))
    layer = _part(1, b"image") + one + two + line + keys + b"".join(_part(4, v) for v in values) + _number(5 << 3) + _number(4096) + _number(15 << 3) + b"\x02"
    return _part(3, _part(1, b"sequence") + one) + _part(3, layer)


def test_vector_tiles(spark):
    x, y = (int(spark.range(1).select(f(F.lit(v), 14)).first()[0]) for f, v in ((geo.tile_x, 24.93), (geo.tile_y, 60.16)))
    west, south, east, north = vector_tiles.tile_bounds(14, x, y)
    assert west <= 24.93 < east and south < 60.16 <= north
    rows = list(vector_tiles.points(vector_tile(14, x, y), 14, x, y, "image"))
    assert len(rows) == 3 and {k: rows[0][k] for k in ("compass_angle", "captured_at", "is_pano", "id")} == {"compass_angle": 12.5, "captured_at": 1577836800000, "is_pano": True, "id": 99}
    assert rows[1]["id"] == 300 and rows[1]["captured_at"] == -7 and rows[2]["lon"] == east and rows[2]["lat"] > north
    lon, lat = geo.tile_position(F.lit(1024), F.lit(1024), *(F.lit(v) for v in (west, east, north, south)))
    assert spark.range(1).select(lon, lat).first() == (rows[0]["lon"], rows[0]["lat"])
    assert list(vector_tiles.points(vector_tile(14, x, y), 14, x, y, "none")) == []
    spark.dataSource.register(tiles.TileSource)
    wkt = f"POLYGON(({west + 1e-4} {south + 1e-4}, {east - 1e-4} {south + 1e-4}, {east - 1e-4} {north - 1e-4}, {west + 1e-4} {south + 1e-4}))"
    df = spark.read.format("image_tiles").option("wkt", wkt).option("fetch", "tests.test_engine:vector_tile").load()
    assert {r["id"] for r in df.collect()} == {"99", "300"} and df.where("id = '99'").first()["tile_x"] == x


def test_tile_source_reads_one_partition_a_tile(spark):
    spark.dataSource.register(tiles.TileSource)
    wkt = "POLYGON((24.93 60.16, 24.96 60.16, 24.96 60.17, 24.93 60.16))"
    df = spark.read.format("image_tiles").option("wkt", wkt).option("fetch", "tests.test_engine:fetch_tile").load()
    x0, x1, y0, y1 = geo.tile_range(wkt)
    assert df.count() == (x1 - x0 + 1) * (y1 - y0 + 1) and df.first()["tile_z"] == 14

    class Answer:
        def __init__(self, code):
            self.status_code = code

    answers, waits = [Answer(429), Answer(429), Answer(200)], []
    assert tiles.with_backoff(lambda: answers.pop(0), 0.1, 5, 60, waits.append).status_code == 200
    assert waits == [0.1, 60, 0.1, 60, 0.1]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT angle_diff(5, 355), season(12), capture_year(1704067200000)").first() == (10.0, "winter", 2024)
    assert spark.sql("SELECT count(*) FROM tiles_of('POLYGON((0 0, 0.1 0, 0.1 0.1, 0 0))')").first()[0] > 0
    box = "(VALUES (0D, 0D), (1023D, 0D), (1023D, 511D), (0D, 511D)) AS t(x, y)"
    assert spark.sql(f"SELECT hull_coverage(x, y) FROM {box}").first()[0] == 1.0
    assert spark.sql(f"SELECT hull_iou(x, y, x, y) FROM {box}").first()[0] == 1.0
    spots = ", ".join(f"({(i * 37) % 101}D, {(i * 53) % 97}D)" for i in range(20))
    assert spark.sql(f"SELECT homography_inliers(x, y, x + 5, y - 3) FROM (VALUES {spots}) AS t(x, y)").first()[0] == 20


def test_model_interfaces(spark):
    pairs = spark.createDataFrame([("a", "b")], "id_left string, id_right string")
    table = spark.createDataFrame([("a", "b", 1, 0.0, 0.0, 1.0, 1.0), ("x", "y", 1, 0.0, 0.0, 1.0, 1.0)], "id_left string, id_right string, kp long, lx double, ly double, rx double, ry double")
    assert TableMatcher(table).matches(pairs).count() == 1
    stored = spark.createDataFrame([("a", 1)], "id string, v int")
    wanted = spark.createDataFrame([("a",), ("b",)], "id string")
    assert TableSegmenter(stored).masks(wanted).count() == 1
    model = BatchModel(lambda: 10, lambda m, rows: rows.assign(v=m), "id string, v int")
    assert rows_of(with_stored(wanted, stored, ["id"], model.apply)) == [("a", 1), ("b", 10)]
    props = spark.createDataFrame([("a", {0: 0.5}, {})], "id string, props map<int,double>, no_temp_props map<int,double>")
    wide = sampler_fields(props, {0: "Road", 7: "big tree"})
    assert wide.columns == ["id", "prop_000_road", "no_temp_prop_000_road", "prop_007_big_tree", "no_temp_prop_007_big_tree"]
    assert wide.first()["prop_000_road"] == 0.5


def test_rules_in_words():
    assert pairing.describe(["any"]) == "any time"
    assert pairing.describe(["year", "season", "year"], [2020], [2023, 2021]) == "different years; different seasons; years 2020 against 2021, 2023"


def test_fetching_keeps_failures_as_rows(spark):
    def get(id_):
        if id_ == "b":
            raise OSError("gone")
        return id_.encode() if id_ != "c" else None

    from parallaxis.sources import fetch

    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "id string")
    got = {r["id"]: r for r in fetch.fetch(ids, get).collect()}
    assert bytes(got["a"]["data"]) == b"a" and got["b"]["error"] == "OSError: gone" and got["c"]["error"] == "empty"
    stored = spark.createDataFrame([("a", bytearray(b"x"), None), ("b", None, "old")], fetch.SCHEMA)
    assert {r["id"] for r in fetch.fetch_missing(ids, stored, get).collect()} == {"b", "c"}
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "id_left string, id_right string")
    assert fetch.ready_pairs(pairs, stored).count() == 1
    assert fetch.pair_folder(pairs, "out").first()["folder"] == "out/a/a_a"


def test_fov_rows_show_whole_image_coverage(spark):
    names = [c for c in results.FEATURE if "coverage" in c or "hull" in c]
    df = spark.range(1).select(*(F.lit(0.1).alias(c) for c in names), *(F.lit(0.9).alias(f"orig_{c}") for c in names))
    assert results.with_original_coverage(df, "fov").first()[names[0]] == 0.9
    assert results.with_original_coverage(df, "plain").first()[names[0]] == 0.1


def test_leveled_view_has_a_level_horizon():
    gray = np.zeros((120, 200), np.uint8)
    for x in range(200):
        gray[60 + round(np.tan(np.radians(6)) * (x - 100)) :, x] = 200
    turned, angle = raster.leveled(gray)
    assert abs(angle - 6) < 1.5 and abs(raster.horizon_angle(turned[20:100, 30:170])) < 2
    assert raster.colored(np.array([[13]], np.uint8), {k: c for k, (_, c) in masks.STREET_CLASSES.items()}).tolist() == [[[0, 0, 142]]]


def test_homography_of_few_inliers():
    """A fifth of the matches is right, at random places; most such pairs are found."""
    h, found = np.array([[1.02, 0.01, 20], [0.01, 0.98, 5], [1e-5, 1e-5, 1]]), 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        src, dst = rng.random((100, 2)) * [1024, 512], rng.random((100, 2)) * [1024, 512]
        right = rng.permutation(100)[:20]
        dst[right] = raster.apply_homography(h, src[right])
        found += raster.homography_support(src, dst)[0] >= 20
    assert found >= 35, found


def test_rounding_follows_the_double(spark):
    """333/640 times 10^6 is a double below the half."""
    from parallaxis.functions.numbers import rounded

    row = spark.sql("select 333 / 640D as a, -2.5D as b, double('inf') as c, 0.125D as d").select(rounded("a", 6), rounded("b", 0), rounded("c", 3), rounded("d", 2)).first()
    assert tuple(row) == (0.520312, -3.0, float("inf"), 0.13)


def test_temporary_share_is_a_rounded_quotient(spark):
    from parallaxis.operators import features

    rows = spark.range(640).selectExpr("1 as pair_id", "0 as y", "cast(id as int) as x", "cast(if(id < 333, 11, 0) as int) as left_label", "0 as right_label")
    assert features.mask_columns(rows, features.Frame(640, 1, (0,), (11,))).first()["seg_temp_union_fraction"] == 0.520312


def test_quantile_edges_equal_the_sql_to_the_last_bit(spark):
    """Equal neighbours, too: an edge between them can differ from both by one bit."""
    import duckdb

    shares = ", ".join(str(i / 10) for i in range(11))
    rows = [(f"m{n}", round(((i * 7919) % n) * 0.01 // 0.05 * 0.05 + 0.01 * (n % 3), 2)) for n in range(2, 60) for i in range(n)]
    found = {r[0]: r[1] for r in sampling.quantile_edges(spark.createDataFrame(rows, "metric string, value double"), 10).collect()}
    for m in found:
        values = ", ".join(f"({v}::double)" for k, v in rows if k == m)
        want = duckdb.sql(f"select list_sort(list_distinct(quantile_cont(v, [{shares}]))) from (values {values}) as t(v)").fetchall()[0][0]
        assert found[m] == want, m


def test_equal_distances_in_another_order_score_equally():
    points = np.random.default_rng(1).integers(0, 360, (4, 30)).astype(float)
    orders = [np.random.default_rng(i).permutation(30) for i in range(20)]
    scores = {tuple(matches._yaw_scores(points[:, o], np.arange(0, 360, 10), 360)) for o in orders}
    assert len(scores) == 1


def test_voted_halves_round_to_even(spark):
    """Offsets symmetric about 157.5 degrees and the like: their mean is a half up to the last bits of sines."""
    rows = [(p, k, 0.0, 0.0, float((10 * p + d) % 360), 0.0) for p in range(36) for k, d in enumerate((4, 5, 6, 7, 8, 9, 10, 11))]
    found = matches.search_yaw(spark.createDataFrame(rows, "pair_id int, kp int, lx double, ly double, rx double, ry double"), 360)
    assert {r.best_yaw % 2 for r in found.where(f"method = '{matches.ONE_SHOT_REFINED}'").collect()} == {0}


def test_hulls_of_many_groups_equal_one_at_a_time(spark):
    """With outliers, points outside the frame, repeats, lines and too few points."""
    rng = np.random.default_rng(5)
    groups = [rng.normal(40, 30, (n, 4)).round(k % 3) for k, n in enumerate((0, 1, 3, 4, 5, 9, 40, 40, 41))]
    groups += [np.tile(groups[5], (2, 1)), np.repeat(np.arange(9.0)[:, None], 4, axis=1), np.full((6, 4), 3.0)]
    points, starts = np.concatenate(groups), np.cumsum([0, *map(len, groups)])
    found = np.array(raster.hulls_of_groups(*points.T, starts, 64, 96)).T
    for g, row in zip(groups, found, strict=True):
        left, right = g[:, :2], g[:, 2:]
        cover = [raster.hull_coverage(p, 64, 96) for p in (left, right)]
        assert row.tolist() == [*cover, min(cover), raster.hull_iou(left, right, 64, 96)]


def test_hulls_and_homographies_of_many_pairs_are_quick(spark):
    """A pair took 25 ms in one, and 11 ms in the other, when each was a table of its own."""
    import time

    rng = np.random.default_rng(6)
    src = rng.uniform(0, 500, (60, 30, 2))
    dst = src + rng.normal(0, 1, src.shape)
    began = time.thread_time()
    supports = [raster.homography_support(s, d) for s, d in zip(src, dst, strict=True)]
    flat = [np.ascontiguousarray(p[..., c].ravel()) for p in (src, dst) for c in (0, 1)]
    raster.hulls_of_groups(*flat, np.arange(0, 1801, 30), 512, 1024)
    assert (time.thread_time() - began) / 60 < 0.012
    assert min(s[0] for s in supports) >= 25


def test_streamed_pairs_are_found_once(spark, monkeypatch):
    """Neither the deliveries nor any batch may search for the pairs again: after the search they are read from a table."""
    from parallaxis.plans import streams

    found, real = [], streams._ids
    monkeypatch.setattr(streams, "_ids", lambda pairs: found.append(spark.sparkContext.accumulator(0)) or counted(real(pairs), found[-1]))

    def counted(rows, seen):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(run, rows.schema)

    pairs = streams.pairing.area_pairs(streams.fx.images(spark, "/root/testdata/sf0.001"), order="k", distinct=True).count()
    streams.stream_resume(spark, "/root/testdata/sf0.001")
    assert found[0].value == pairs


def test_kept_samples_do_not_hold_whole_permutations():
    picks = raster._picks(300, 50, 4, 1)
    assert picks.base is None and picks.shape == (50, 4)


POINTS = "pair_id int, lx double, ly double, rx double, ry double"


def _some_points(pairs: int) -> list[tuple]:
    """Pairs of 0 to 9 moved points, and one of 500."""
    rng = np.random.default_rng(8)
    sizes = [500, *(k % 10 for k in range(1, pairs))]
    return [(k, *map(float, p), *(float(c) + 7.0 for c in p)) for k, n in enumerate(sizes) for p in rng.integers(0, 200, (n, 2))]


def test_array_work_of_pairs_stays_in_many_tasks(spark):
    """Few bytes made one task of all pairs, whatever the work in them."""
    found = spark.createDataFrame(_some_points(64), POINTS)
    assert raster.homographies_by_pair(found).groupBy(F.spark_partition_id()).count().count() > 4
    assert raster.hulls_by_pair(found, 256, 256).groupBy(F.spark_partition_id()).count().count() > 4


def test_pairs_that_cross_batches_are_whole(spark):
    rows = _some_points(40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        got = {}
        for size in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got[size] = rows_of(raster.features_by_pair(spark.createDataFrame(rows, POINTS), 256, 256))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[1] == got[7] == got[10_000]
    totals = {r[0]: r[6] for r in got[7]}
    sizes = Counter(r[0] for r in rows)
    assert {k: totals[k] for k, n in sizes.items() if n > 5} == {k: n for k, n in sizes.items() if n > 5}
    assert set(totals) == set(sizes) and not any(totals[k] for k, n in sizes.items() if n < 4)


def test_field_of_view_rows_take_each_fit_once(spark):
    """Homographies of whole images for three readers, boxes for four, and hulls that the whole images' replace were each made again."""
    from parallaxis.plans import registry

    plan = registry.queries()["result_fov"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "percentile" not in plan


def test_panorama_rows_search_each_yaw_once(spark):
    """The turned matches have two readers, each of which searched for the yaws again."""
    from parallaxis.plans import registry

    plan = registry.queries()["result_panorama"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "collect_list" not in plan


def test_fits_have_the_last_direction_below_nine_rows():
    src = np.array([[0, 0], [9, 1], [8, 7], [1, 9]], float)
    m = np.array([[1.1, 0.1, 3], [-0.2, 0.9, 5], [1e-3, 2e-3, 1]])
    assert np.allclose(raster.fit_homography(src, raster.apply_homography(m, src)), m)


def test_plain_rows_gather_a_pairs_points_once(spark):
    """Hulls and homographies gathered, sorted and read the same points one after the other."""
    from parallaxis.plans import registry

    plan = registry.queries()["result_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "collect_list(struct(lx" not in plan
