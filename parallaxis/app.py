"""Whole runs: area and CSV pairs to a result table, stratified sampling, decile sampling.

    python -m parallaxis.app area    --area-wkt "POLYGON((...))" --images images.parquet --matches matches.parquet --output out
    python -m parallaxis.app csv     --input-csv pairs.csv --matches matches.parquet --output out
    python -m parallaxis.app sample  --area-wkt "POLYGON((...))" --images images.parquet --time-filter season --output out
    python -m parallaxis.app deciles --results out --metrics lightglue_match_ratio --output picked

Features and masks come from tables (see operators.models for other ways).
"""

from __future__ import annotations

import argparse
import functools
import importlib
import sys
import time
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest
from . import settings as settings_
from .operators import features, masks, models, ordering, pairing, raster, results, sampling
from .settings import Settings
from .sources import fetch, pair_tables
from .sources import images as scans

_KEY = ("id_left", "id_right")


def area_pairs(images: DataFrame, s: Settings, done: DataFrame | None = None) -> DataFrame:
    """Scan, year filter, range join, anti-join with finished work, balanced order: pairs with their area columns."""
    inside = scans.scan_area(scans.tiled(scans.normalized(images)), s.area_wkt, s.image_type)
    used = pairing.in_years(inside, s.year_group_left, s.year_group_right)
    pairs = pairing.area_pairs(
        used, s.max_distance, s.max_angle_diff, s.time_filter, s.year_group_left or None, s.year_group_right or None, distinct=True
    )
    ordered = ordering.balanced_pairs(pairing.with_metadata(pairs), s.time_filter, s.pair_random_seed)
    rows = ordering.positions(ordered, "turn", "turn_key", name="index").select(
        F.col("l.id").alias("id_left"),
        F.col("l.captured_at").cast("string").alias("date_left"),
        F.col("r.id").alias("id_right"),
        F.col("r.captured_at").cast("string").alias("date_right"),
        F.col("index").cast("string").alias("index"),
        "dist_m",
        "angle_diff_deg",
        F.col("l.is_pano").alias("is_pano_left"),
        F.col("r.is_pano").alias("is_pano_right"),
        *(F.round(F.col(f"{s_}.{c}"), 7).alias(f"{c}_{side}") for s_, side in (("l", "left"), ("r", "right")) for c in ("lat", "lon")),
    )
    return rows if done is None else pairing.pending(rows, done)


def csv_pairs(table: DataFrame, order: str, s: Settings) -> DataFrame:
    return pair_tables.load(table, order, list(s.indices) or None, s.max_pairs_per_index)


def frame_of(s: Settings, size: tuple[int, int], mask: tuple[int, int] | None, classes: DataFrame | None = None) -> features.Frame:
    """Sizes of images and masks, and the classes by their labels (those of street scenes without a table id, label)."""
    sets = {"road": [0], "sky": [10], "temporary": list(range(11, 19))}
    if classes is not None:
        rows = masks.class_sets(classes.select(F.col("id").cast("int"), "label")).collect()  # a mask model's classes
        sets = {k: sorted(r["id"] for r in rows if r[k]) for k in sets}
    width, height = mask or size
    return features.Frame(
        *size, sets["road"], sets["temporary"], s.ignore_temporary, s.seg_crop_top_frac, s.seg_crop_bottom_frac, height, width, sets["sky"]
    )


def mode_of(s: Settings, aligned: DataFrame | None = None, aligned_quality: DataFrame | None = None) -> features.Mode:
    return features.Mode(
        "panorama" if s.panorama else "fov" if s.scale_search else "plain",
        s.yaw_step,
        s.crop_keep,
        s.crop_top_bias,
        s.panorama_fast_yaw,
        s.panorama_semantic_rerank,
        s.semantic_rerank_radius,
        s.semantic_rerank_step,
        s.scale_reproject,
        aligned,
        aligned_quality,
    )


def measure(
    pairs: DataFrame,
    matches: DataFrame,
    counts: DataFrame,
    frame: features.Frame,
    s: Settings,
    pixels: DataFrame | None = None,
    quality: DataFrame | None = None,
    area: bool = False,
    aligned: DataFrame | None = None,
    aligned_quality: DataFrame | None = None,
) -> DataFrame:
    """Result rows of pairs; matches, counts, pixels and aligned matches are keyed by (id_left, id_right), quality by image_id."""
    keyed = pairs.withColumn("pair_id", F.to_json(F.array(*_KEY)))
    ids = keyed.select("pair_id", *_KEY)

    def own(table: DataFrame | None) -> DataFrame | None:
        return None if table is None else table.join(ids, list(_KEY)).drop(*_KEY)

    found, known, pixels, aligned = own(matches), own(counts), own(pixels if s.segmentation else None), own(aligned)
    if pixels is not None:
        pixels, height, width = masks.narrowed(pixels, frame.mask_height, frame.mask_width, s.segmentation_max_width)
        frame = replace(frame, mask_height=height, mask_width=width)
        if s.ignore_sky_keypoints:
            found = features.without_sky(found, pixels, frame, s.sky_keypoint_boundary_px)
    images = (quality, aligned_quality) if s.image_metrics else (None, None)
    return features.result_table(keyed, found, known, frame, pixels, images[0], area, mode_of(s, aligned, images[1]))


def fetched(pairs: DataFrame, s: Settings, get: Callable[[str], object], store: str, batch: str) -> DataFrame:
    """Pairs whose images are in the store, after those that it lacks have been fetched at the settings' pace."""
    spark = pairs.sparkSession
    ids = pairs.select(F.explode(F.array(*_KEY)).alias("id")).distinct()
    stored = _existing(spark, store)
    known = spark.createDataFrame([], fetch.SCHEMA) if stored is None else stored.select("id", "data", "error")
    get = fetch.polite(get, s.request_delay, s.max_retries, s.retry_delay)
    # one request at a time keeps the pace that the delay asks for
    results.append(fetch.fetch_missing(ids, known, get, 1), store, batch)
    return fetch.ready_pairs(pairs, spark.read.parquet(store))


def dry_run(images: DataFrame, s: Settings, done: DataFrame | None = None) -> dict:
    """Counts of what an area run would do."""
    inside = scans.scan_area(scans.tiled(scans.normalized(images)), s.area_wkt, s.image_type)
    used = pairing.in_years(inside, s.year_group_left, s.year_group_right)
    base = pairing.area_pairs(used, s.max_distance, s.max_angle_diff, distinct=True)
    passing = area_pairs(images, s)
    left = area_pairs(images, s, done)
    return {"images": used.count(), "pairs": base.count(), "passing": passing.count(), "pending": left.count()}


def sample(images: DataFrame, s: Settings, existing: DataFrame | None = None) -> DataFrame:
    """New images by stratum, at most samples_per_group each."""
    mode = sampling.mode_of(s.time_filter)
    inside = scans.scan_area(scans.tiled(scans.normalized(images)), s.area_wkt, s.image_type)
    rows = sampling.time_columns(inside, with_daytime=mode == "time")
    groups = sampling.strata(mode, s.year_group_old, s.year_group_new, s.old_label, s.new_label)
    if not s.allow_short:
        plan = sampling.plan(rows, groups, s.samples_per_group, existing)
        short = [r["year_group"] for r in plan.where("candidates < remaining").collect()]
        if short:
            raise ValueError(f"too few images for {', '.join(sorted(short))}; allow_short takes what there is")
    return sampling.quota_sample(rows, groups, s.samples_per_group, existing, s.seed)


def decile_picks(table: DataFrame, metrics: list[str], s: Settings) -> DataFrame:
    return sampling.decile_sample(table, metrics, list(_KEY), s.samples_per_decile, s.seed)


def decile_manifest(picked: DataFrame) -> DataFrame:
    """One JSON document for each sampled pair: metric, decile label, value and ids."""
    return picked.select(F.to_json(F.struct("metric", F.col("label").alias("decile"), F.col("value").alias("metric_value"), *_KEY)).alias("value"))


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def main(words: list[str] | None = None) -> None:
    words = sys.argv[1:] if words is None else words
    parser = argparse.ArgumentParser(prog="parallaxis", description="Georeferenced image pairs on Spark.")
    parser.add_argument("mode", choices=("area", "csv", "sample", "deciles"))
    for name in ("--config", "--images", "--matches", "--counts", "--results", "--pixels", "--quality", "--classes", "--aligned", "--aligned-quality", "--shares"):
        parser.add_argument(name)
    parser.add_argument("--fetcher", help="module:function(id, size) that gives an image's bytes; images_dir is their store")
    parser.add_argument("--mask", type=int, nargs=2, metavar=("WIDTH", "HEIGHT"))
    parser.add_argument("--frame", type=int, nargs=2, default=(1024, 512), metavar=("WIDTH", "HEIGHT"))
    parser.add_argument("--metrics", nargs="+", default=["lightglue_match_ratio"])
    for f in settings_.fields(Settings):
        flag, default = "--" + f.name.replace("_", "-"), f.default
        if isinstance(default, bool):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        elif isinstance(default, tuple):
            parser.add_argument(flag, nargs="+", type=str if "str" in f.type else int)
        else:
            number = next((k for k in (int, float) if k.__name__ in f.type), str)
            parser.add_argument(flag, type=number)
    args = parser.parse_args(words)
    known = {f.name for f in settings_.fields(Settings)}
    given = {k: v for k, v in vars(args).items() if k in known and v is not None}
    s = settings_.load(given, args.config)
    s = s if args.mode == "deciles" else s.checked()
    started, status, extra = datetime.now(UTC), "failed", {}
    spark = SparkSession.builder.appName("parallaxis").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        extra = _run(spark, args, s, started)
        status = "completed"
    finally:
        if not s.dry_run:
            manifest.write(f"{s.output}_manifest.json", manifest.build(s, words, status, started, extra))


def _run(spark: SparkSession, args, s: Settings, started: datetime) -> dict:
    batch = f"{started:%Y%m%dT%H%M%S}-{started.microsecond:06d}"
    seconds: dict[str, float] = {}

    def timed(name: str, began: float) -> float:
        """Seconds of a stage, if asked for; the next one begins."""
        now = time.perf_counter()
        if s.profile_timing:
            seconds[name] = round(now - began, 3)
        return now

    began = time.perf_counter()
    if args.mode == "deciles":
        picked = decile_picks(_table(spark, args.results), args.metrics, s)
        decile_manifest(picked).write.mode("overwrite").text(s.output)
        if args.images:  # as arrays: image_id, height, width, data
            raster.previews_by_pair(picked, _table(spark, args.images)).write.mode("overwrite").parquet(f"{s.output}_previews")
        return {"metrics": args.metrics}
    done = _existing(spark, s.output)
    if args.mode == "sample":
        rows = sample(_table(spark, args.images), s, done)
        if args.shares:  # id, props and no_temp_props: maps of class to share
            names = {k: name for k, (name, _) in masks.STREET_CLASSES.items()}
            if args.classes:
                names = {r["id"]: r["label"] for r in _table(spark, args.classes).select(F.col("id").cast("int"), "label").collect()}
            rows = models.sampler_fields(rows.join(_table(spark, args.shares).select("id", "props", "no_temp_props"), "id", "left"), names)
        results.append(rows, s.output, batch)
        return {"mode": "sample"}
    if args.mode == "area":
        images = _table(spark, args.images)
        if s.dry_run:
            print(dry_run(images, s, done))
            return {}
        pairs = area_pairs(images, s, done)
    else:
        table = pair_tables.read_csv(spark, s.input_csv).withColumn("__order", F.monotonically_increasing_id())
        every = csv_pairs(table, "__order", s)
        pairs = every if done is None else pairing.pending(every, done, ordered=True)
        if s.dry_run:
            print({"rows": table.count(), "pairs": every.count(), "pending": pairs.count()})
            return {}
    if args.fetcher:
        module, _, name = args.fetcher.partition(":")
        get = getattr(importlib.import_module(module), name)
        pairs = fetched(pairs, s, functools.partial(_sized, get, s.image_size), s.images_dir or f"{s.output}_images", batch)
        began = timed("fetch", began)
    matches = _table(spark, args.matches)
    counts = _table(spark, args.counts) if args.counts else matches.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("left_allowed"), F.count(F.lit(1)).alias("right_allowed")
    )
    pixels, quality, classes, aligned, aligned_quality = (
        _table(spark, path) if path else None for path in (args.pixels, args.quality, args.classes, args.aligned, args.aligned_quality)
    )
    frame = frame_of(s, tuple(args.frame), tuple(args.mask) if args.mask else None, classes)
    measured = measure(pairs, matches, counts, frame, s, pixels, quality, args.mode == "area", aligned, aligned_quality)
    results.append(measured, s.output, batch)
    began = timed("pairs_and_metrics", began)
    extra: dict = {"filter": {"enabled": False}}
    if s.filtered_output:
        extra = {"filter": results.write_passing(spark.read.parquet(s.output), results.active(**s.thresholds()), s.filtered_output)}
        timed("filter", began)
    return extra | ({"seconds": seconds} if s.profile_timing else {})


def _sized(get: Callable[[str, str], object], size: str, id_: str) -> object:
    return get(id_, size)


if __name__ == "__main__":
    main()
