"""Whole runs on small tables, and the warps behind field-of-view crops."""

from __future__ import annotations

import json

import numpy as np
import pytest

from parallaxis import app
from parallaxis.operators import features, masks, matches, raster, results
from parallaxis.sources import fetch

WKT = "POLYGON((24.9 60.1, 25.1 60.1, 25.1 60.3, 24.9 60.3, 24.9 60.1))"
IMAGE = "id string, lat double, lon double, compass_angle double, is_pano boolean, captured_at long"
YEAR_MS = 31_557_600_000


@pytest.fixture
def world(spark, tmp_path):
    rows = [(f"i{k}", 60.2, 25.0 + k * 1e-5, 10.0 * k, k % 2 == 0, (45 + k) * YEAR_MS) for k in range(6)]
    spark.createDataFrame([*rows, ("far", 10.0, 10.0, 0.0, True, 0)], IMAGE).write.parquet(str(tmp_path / "images"))
    found = [(f"i{a}", f"i{b}", n, 10.0 * n % 70, 7.0 * n % 50, 10.0 * n % 70 + 1, 7.0 * n % 50) for a in range(6) for b in range(a + 1, 6) for n in range(12)]
    spark.createDataFrame(found, "id_left string, id_right string, kp int, lx double, ly double, rx double, ry double").write.parquet(str(tmp_path / "matches"))
    return tmp_path


def test_area_run_resumes_and_filters(spark, world):
    out = str(world / "out")
    words = ["area", "--area-wkt", WKT, "--images", str(world / "images"), "--matches", str(world / "matches"), "--output", out, "--frame", "100", "60",
             "--max-distance", "1.2", "--filter-match-ratio-min", "0.5", "--filtered-output", str(world / "kept"), "--access-token", "hidden!"]
    app.main(words)
    first = spark.read.parquet(out)
    assert first.columns[: len(results.KEY)] == list(results.KEY) and {r["dist_m"] for r in first.collect()} != {None}
    n = first.count()
    assert n == 9  # neighbours, and those two steps away
    app.main(words)
    assert spark.read.parquet(out).count() == n, "finished pairs are not done again"
    doc = json.loads((world / "out_manifest.json").read_text())
    assert doc["status"] == "completed" and "hidden!" not in json.dumps(doc)
    assert doc["extra"]["filter"]["filtered_rows"] == n


def test_csv_sample_and_decile_runs(spark, world, capsys):
    (world / "pairs.csv").write_text("filename_left,filename_right,index\ni0.png,i1.png,1\ni1.png,i2.png,2\n")
    out = str(world / "csv")
    app.main(["csv", "--input-csv", str(world / "pairs.csv"), "--matches", str(world / "matches"), "--output", out])
    got = spark.read.parquet(out)
    assert got.count() == 2 and got.first()["lightglue_match_ratio"] == 1.0
    app.main(["deciles", "--results", out, "--metrics", "lightglue_match_ratio", "--output", str(world / "picked")])
    assert spark.read.text(str(world / "picked")).count() == 0  # one value has no deciles
    picked = str(world / "sampled")
    words = ["sample", "--area-wkt", WKT, "--images", str(world / "images"), "--output", picked, "--samples-per-group", "2", "--allow-short"]
    app.main(words)
    assert spark.read.parquet(picked).count() == 2
    app.main(words)
    assert spark.read.parquet(picked).count() == 2, "the quota is filled"
    with pytest.raises(ValueError, match="any"):
        app.main([*words[:-2], "100", "--no-allow-short", "--output", str(world / "more")])
    app.main(["area", "--area-wkt", WKT, "--images", str(world / "images"), "--output", str(world / "none"), "--dry-run"])
    assert "'images': 6" in capsys.readouterr().out


def test_decile_previews_and_sampled_shares(spark, world):
    rows = [(f"i{a}", f"i{b}", float(a + b / 10)) for a in range(6) for b in range(6) if a < b]
    spark.createDataFrame(rows, "id_left string, id_right string, lightglue_match_ratio double").write.parquet(str(world / "rated"))
    images = [(f"i{k}", 4, 6, bytearray([k] * 72)) for k in range(5)]
    spark.createDataFrame(images, "image_id string, height int, width int, data binary").write.parquet(str(world / "arrays"))
    app.main(["deciles", "--results", str(world / "rated"), "--images", str(world / "arrays"), "--output", str(world / "picks")])
    docs = [json.loads(r["value"]) for r in spark.read.text(str(world / "picks")).collect()]
    shown = spark.read.parquet(str(world / "picks_previews")).collect()
    assert {(d["id_left"], d["id_right"]) for d in docs if "i5" not in (d["id_left"], d["id_right"])} == {(r["id_left"], r["id_right"]) for r in shown}
    first = np.frombuffer(bytes(shown[0]["data"]), np.uint8).reshape(shown[0]["height"], shown[0]["width"], 3)
    assert np.array_equal(first, raster.side_by_side(*(np.full((4, 6, 3), int(shown[0][c][1]), np.uint8) for c in ("id_left", "id_right"))))
    shares = [("i0", {0: 0.5, 10: 0.5}, {0: 1.0})]
    spark.createDataFrame(shares, "id string, props map<int,double>, no_temp_props map<int,double>").write.parquet(str(world / "shares"))
    app.main(["sample", "--area-wkt", WKT, "--images", str(world / "images"), "--shares", str(world / "shares"), "--samples-per-group", "9", "--allow-short", "--output", str(world / "shared")])
    got = {r["id"]: r for r in spark.read.parquet(str(world / "shared")).collect()}
    assert got["i0"]["prop_000_road"] == got["i0"]["prop_010_sky"] == 0.5 and got["i0"]["no_temp_prop_000_road"] == 1.0 and got["i1"]["prop_000_road"] == 0.0


def picture(id_, size):
    """A fetcher: bytes of one image, none of another."""
    if id_ == "i3":
        raise OSError("gone")
    return f"{id_} {size}".encode()


def test_panorama_run_turns_masks_and_matches(spark, world):
    """The right image is the left one, turned by 90 degrees: after the search, distances vanish and masks agree."""
    width, height = 360, 40
    found = [("i0", "i1", n, 23.0 * n % width, 7.0 * n % height, (23.0 * n + 90) % width, 7.0 * n % height) for n in range(40)]
    spark.createDataFrame(found, "id_left string, id_right string, kp int, lx double, ly double, rx double, ry double").write.parquet(str(world / "pano"))
    label = lambda x, y: (x // 20 + y // 10) % 9
    cells = [("i0", "i1", y, x, label(x, y), label((x - 90) % width, y)) for y in range(0, height, 4) for x in range(width)]
    spark.createDataFrame(cells, "id_left string, id_right string, y int, x int, left_label int, right_label int").write.parquet(str(world / "pixels"))
    names = ("brightness", "median_brightness", "dark_fraction", "contrast", "sharpness", "noise")
    spark.createDataFrame([("i0", *[1.0] * 6), ("i1", *[2.0] * 6)], "image_id string, " + ", ".join(f"{n} double" for n in names)).write.parquet(str(world / "quality"))
    (world / "one.csv").write_text("filename_left,filename_right\ni0.png,i1.png\n")
    words = ["csv", "--input-csv", str(world / "one.csv"), "--matches", str(world / "pano"), "--pixels", str(world / "pixels"), "--quality", str(world / "quality"),
             "--frame", "360", "40", "--segmentation", "--panorama", "--crop-keep", "1", "--profile-timing", "--ignore-temporary"]
    app.main([*words, "--panorama-semantic-rerank", "--output", str(world / "turned")])
    row = spark.read.parquet(str(world / "turned")).first()
    assert row["best_yaw_deg"] == 90 and row["panorama_alignment_method"].endswith("+semantic_rerank")
    assert row["lightglue_avg_distance"] < 1e-9 < row["orig_lightglue_avg_distance"] and row["brightness_right"] == 2.0
    assert row["seg_overlap_mean_iou"] == 1.0 and row["lightglue_homography_inliers"] == 40
    assert "pairs_and_metrics" in json.loads((world / "turned_manifest.json").read_text())["extra"]["seconds"]
    app.main([*words, "--panorama-fast-yaw", "--no-image-metrics", "--no-segmentation", "--output", str(world / "fast")])
    row = spark.read.parquet(str(world / "fast")).first()
    assert row["best_yaw_deg"] == 90 and row["panorama_alignment_method"] == "keypoint_one_shot" and "brightness_left" not in row
    assert row["seg_overlap_mean_iou"] is None


def test_fov_run_crops_both_images(spark, world):
    """The right image shows the left one's middle, twice as large."""
    rng = np.random.default_rng(4)
    spots = rng.uniform(0, 1, (60, 2)) * [50, 30] + [25, 15]
    found = [("i0", "i1", n, x, y, (x - 25) * 2, (y - 15) * 2) for n, (x, y) in enumerate(spots.tolist())]
    spark.createDataFrame(found, "id_left string, id_right string, kp int, lx double, ly double, rx double, ry double").write.parquet(str(world / "fov"))
    label = lambda x, y: int(x // 8 + y // 6) % 7
    cells = [("i0", "i1", y, x, label(x, y), label(x / 2 + 25, y / 2 + 15)) for y in range(60) for x in range(100)]
    spark.createDataFrame(cells, "id_left string, id_right string, y int, x int, left_label int, right_label int").write.parquet(str(world / "fov_pixels"))
    (world / "one.csv").write_text("filename_left,filename_right\ni0.png,i1.png\n")
    app.main(["csv", "--input-csv", str(world / "one.csv"), "--matches", str(world / "fov"), "--pixels", str(world / "fov_pixels"), "--frame", "100", "60",
              "--segmentation", "--scale-search", "--scale-reproject", "--output", str(world / "cropped"), "--fetcher", "tests.test_app:picture", "--request-delay", "0"])
    row = spark.read.parquet(str(world / "cropped")).first()
    assert 0.2 < row["fov_left_retained_fraction"] < 0.35 and row["fov_right_retained_fraction"] > 0.9
    assert row["lightglue_avg_distance"] < 0.03 < row["orig_lightglue_avg_distance"] and row["lightglue_keypoint_hull_iou"] == row["orig_lightglue_keypoint_hull_iou"]
    assert row["scale_reproject_seg_overlap_mean_iou"] > 0.9 > row["orig_seg_overlap_mean_iou"] and row["seg_overlap_mean_iou"] > 0.7
    stored = {r["id"]: r for r in spark.read.parquet(str(world / "cropped_images")).collect()}
    assert bytes(stored["i0"]["data"]) == b"i0 2048" and stored["i1"]["error"] is None


def test_sky_and_narrow_masks(spark):
    frame = features.Frame(20, 20, sky=(10,), mask_width=10, mask_height=10)
    found = spark.createDataFrame([(1, n, 10.0, y, 10.0, 18.0) for n, y in enumerate((0.0, 7.0, 19.0))] + [(2, 9, 1.0, 1.0, 1.0, 1.0)], "pair_id int, kp int, lx double, ly double, rx double, ry double")
    pixels = spark.createDataFrame([(1, y, x, 10 if y < 5 else 0, 0) for y in range(10) for x in range(10)], "pair_id int, y int, x int, left_label int, right_label int")
    kept = lambda boundary: sorted(r["kp"] for r in features.without_sky(found, pixels, frame, boundary).collect())
    assert kept(0) == [2, 9] and kept(1) == kept(4) == [1, 2, 9] and kept(5) == [0, 1, 2, 9]
    low, height, width = masks.narrowed(pixels, 10, 10, 5)
    assert (height, width) == (5, 5) and low.count() == 25 and {(r["y"], r["left_label"]) for r in low.collect()} == {(0, 10), (1, 10), (2, 10), (3, 0), (4, 0)}
    assert masks.narrowed(pixels, 10, 10, None)[0] is pixels
    band = matches.in_band(found, 20, 0.5)
    assert sorted(r["kp"] for r in band.collect()) == []
    assert sorted(r["kp"] for r in matches.in_band(found, 20, 0.5, -1.0).collect()) == [2]


def test_polite_requests():
    class Answer:
        def __init__(self, code, content=b""):
            self.status_code, self.content = code, content

    answers = iter([Answer(429), Answer(200, b"x")])
    assert fetch.polite(lambda i: next(answers), 0, 3, 0)("a") == b"x"
    with pytest.raises(OSError):
        fetch.polite(lambda i: Answer(404), 0, 3, 0)("a")


def test_warps():
    rng = np.random.default_rng(2)
    image = np.repeat(np.repeat(rng.integers(0, 255, (12, 16, 3)), 5, axis=0), 5, axis=1).astype(np.uint8)
    h = np.array([[1, 0, 4], [0, 1, -3], [0, 0, 1]], float)
    laid, valid = raster.warp(image, h, 60, 80)
    assert np.array_equal(laid[0:50, 10:70], image[3:53, 6:66]) and not valid[:, :4].any()
    src = rng.random((30, 2)) * [79, 59]
    found = raster.warp_to_match(image, image, src, raster.apply_homography(h, src))
    assert found["inliers"] == 30 and found["score"] < 0.2 and np.allclose(found["matrix"], h, atol=1e-6)
    best = raster.least_distorted(image, image, src, raster.apply_homography(h, src))
    assert best["direction"] in ("right_to_left", "left_to_right")
    assert raster.warp_to_match(image, image, src[:5], src[:5]) is None
    assert raster.distortion(np.eye(3), 10, 20, 1.0) == 0 and raster.distortion(np.zeros((3, 3)) + np.diag([0, 0, 1]), 10, 20, 1) == float("inf")
    small, other = raster.to_smallest(image, image[:30])
    assert small.shape == other.shape == (30, 80, 3)
    assert raster.side_by_side(image, image[:30]).shape[0] == 30 + 34


def test_table_forms_of_image_work(spark):
    """Each row gives what the array function gives."""
    rng = np.random.default_rng(9)
    flat = np.repeat(np.repeat(rng.integers(0, 255, (12, 16, 3)), 5, axis=0), 5, axis=1).astype(np.uint8)
    images = spark.createDataFrame([(n, 60, 80, bytearray(flat.tobytes())) for n in "ab"], "image_id string, height int, width int, data binary")
    array = lambda r: np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], 3)
    for r in raster.perspectives_by_row(images, (0, 45), size=(20, 10)).collect():
        assert np.array_equal(array(r), raster.perspective(flat, r["yaw"], size=(20, 10)))
    assert all(np.array_equal(array(r), raster.crop_band(flat, 0.5, 0.3)) for r in raster.bands_by_row(images, 0.5, 0.3).collect())
    assert all(np.array_equal(array(r), raster.leveled(flat)[0]) for r in raster.leveled_by_row(images).collect())
    h = np.array([[1, 0, 4], [0, 1, -3], [0, 0, 1]], float)
    src = rng.random((30, 2)) * [79, 59]
    found = [(7, *p, *q) for p, q in zip(src.tolist(), raster.apply_homography(h, src).tolist(), strict=True)] + [(8, 1.0, 1.0, 1.0, 1.0)]
    pairs = spark.createDataFrame([(7, "a", "b"), (8, "a", "b"), (9, "a", "x")], "pair_id int, id_left string, id_right string")
    got = raster.warps_by_pair(images, pairs, spark.createDataFrame(found, "pair_id int, lx double, ly double, rx double, ry double")).collect()
    assert [(r["pair_id"], r["inliers"]) for r in got] == [(7, 30)] and got[0]["score"] < 0.3


def test_horizon():
    gray = np.zeros((120, 200), np.uint8)
    for x in range(200):
        gray[60 + round(np.tan(np.radians(4)) * (x - 100)) :, x] = 200
    assert abs(raster.horizon_angle(gray) - 4) < 1.5
    assert raster.horizon_angle(np.zeros((50, 50), np.uint8)) is None
