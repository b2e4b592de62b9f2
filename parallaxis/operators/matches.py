"""Matched keypoints: rows (pair_id, kp, lx, ly, rx, ry), positions in pixels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geo import circular_distance, circular_mean
from ..functions.numbers import rounded

FENCE = 1.5

# How a yaw was found.
ONE_SHOT, ONE_SHOT_FAILED = "keypoint_one_shot", "keypoint_one_shot_failed_yaw0"
ONE_SHOT_REFINED, SEARCHED = "keypoint_one_shot_refine", "coarse_fine_search"
RERANKED = "+semantic_rerank"


#: Places behind the point at which two products count as equal.
PRODUCT_PLACES = 12
#: Places to which a voted yaw counts: a mean of halves must not fall to either side with the order of its terms.
YAW_PLACES = 6


def mutual_nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right (pair_id, kp, vector) to (pair_id, left_kp, right_kp, score): each other's best by dot product.

    A stand-in for a learned matcher, which can be given instead as any table of matches. A pair's
    keypoints come together once and meet in one matrix product; a pair has at most a few thousand
    of them. Of equally good keypoints the smallest wins.
    """

    def sided(table: pa.Table, side: int) -> tuple[pa.ChunkedArray, np.ndarray]:
        table = table.filter(pc.equal(table["side"], side)).sort_by("kp").combine_chunks()
        if not table.num_rows:
            return table["kp"], np.zeros((0, 0))
        vectors = table["vector"].combine_chunks()
        return table["kp"], vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)

    def run(table: pa.Table) -> pa.Table:
        (left_kp, a), (right_kp, b) = sided(table, 0), sided(table, 1)
        if not len(a) or not len(b):
            return kind.empty_table()
        product = np.round(a @ b.T, PRODUCT_PLACES)
        to_right, to_left = product.argmax(axis=1), product.argmax(axis=0)
        mine = np.flatnonzero(to_left[to_right] == np.arange(len(a)))
        theirs = to_right[mine]
        pairs = table["pair_id"].take(pa.array(np.zeros(len(mine), np.int64)))
        columns = [pairs, left_kp.take(pa.array(mine)), right_kp.take(pa.array(theirs)), pa.array(product[mine, theirs])]
        return pa.table(dict(zip(kind.names, columns, strict=True))).cast(kind)

    keypoint = left.schema["kp"].dataType
    schema = T.StructType([left.schema["pair_id"], *(T.StructField(f"{s}_kp", keypoint) for s in ("left", "right")), T.StructField("score", T.DoubleType())])
    kind = to_arrow_schema(schema)
    sides = [t.select("pair_id", F.lit(i).alias("side"), F.col("kp").cast(keypoint).alias("kp"), "vector") for i, t in enumerate((left, right))]
    return sides[0].unionByName(sides[1]).groupBy("pair_id").applyInArrow(run, schema)


def allowed(points: DataFrame, mask: DataFrame, width: int, height: int, x: str = "x", y: str = "y") -> DataFrame:
    """points with column allowed, looked up in mask(pair_id, y, x, ok) at the rounded, clipped position; no pixel means allowed."""
    px = F.least(F.greatest(F.rint(x), F.lit(0)), F.lit(width - 1)).cast("int")
    py = F.least(F.greatest(F.rint(y), F.lit(0)), F.lit(height - 1)).cast("int")
    spots = mask.select("pair_id", F.col("y").alias("__y"), F.col("x").alias("__x"), "ok")
    placed = points.withColumns({"__x": px, "__y": py})
    return (
        placed.join(spots, ["pair_id", "__y", "__x"], "left")
        .withColumn("allowed", F.coalesce("ok", F.lit(True)))
        .drop("__x", "__y", "ok")
    )


def metrics(matches: DataFrame, counts: DataFrame, width: float, height: float) -> DataFrame:
    """match_ratio = matches / smaller number of allowed keypoints; avg_distance over the image diagonal, infinite without matches.

    counts(pair_id, left_allowed, right_allowed) has every pair.
    """
    dx, dy = F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")
    distance = F.sqrt(dx * dx + dy * dy)
    per = matches.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(distance).alias("d")
    )
    smaller = F.least("left_allowed", "right_allowed")
    return counts.join(per, "pair_id", "left").select(
        "pair_id",
        F.coalesce(F.when(smaller > 0, F.col("n") / smaller), F.lit(0.0)).alias("match_ratio"),
        F.coalesce(F.col("d") / (width**2 + height**2) ** 0.5, F.lit(float("inf"))).alias("avg_distance"),
    )


def together(rows: DataFrame) -> DataFrame:
    """Rows of a pair in one partition, once: what is grouped and joined by pair after that moves nothing more.

    A pair has a few thousand keypoints at most, so no pair is large.
    """
    return rows.repartition("pair_id")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a pair in one of a fixed number of partitions, for array work.

    Its time does not follow bytes, by which Spark merges partitions: all pairs of a small table would wait in one task.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, "pair_id")


def _inside(value: str, q: Column, least_range: float) -> Column:
    low, high = F.get(q, 0), F.get(q, 1)
    spread = high - low
    return (spread <= least_range) | F.col(value).between(low - FENCE * spread, high + FENCE * spread)


def fenced(points: DataFrame, axes: Sequence[str], least_points: int = 4, least_range: float = 0.0, fall_back: bool = True) -> DataFrame:
    """Points inside the quartile fences of all axes; axes without spread do not count.

    Fences come from all points of a pair. With fall_back, pairs that would keep fewer than
    least_points keep all; pairs with fewer points keep all, too.
    """
    points = together(points)
    quartiles = [F.percentile(a, F.array(F.lit(0.25), F.lit(0.75))).alias(f"__q_{a}") for a in axes]
    fences = points.groupBy("pair_id").agg(F.count(F.lit(1)).alias("__n"), *quartiles)
    ok = F.col("__n") < least_points
    for i, a in enumerate(axes):
        inside = _inside(a, F.col(f"__q_{a}"), least_range)
        every = inside if i == 0 else every & inside
    marked = points.join(fences, "pair_id").withColumn("__ok", ok | every)
    if fall_back:
        kept = marked.groupBy("pair_id").agg(F.count_if("__ok").alias("__kept"))
        marked = marked.join(kept, "pair_id").withColumn("__ok", F.col("__ok") | (F.col("__kept") < least_points))
    return marked.where("__ok").select(*points.columns)


def crop_boxes(points: DataFrame, x: str, y: str, width: int, height: int, padding: float = 0.02) -> DataFrame:
    """(pair_id, x1, y1, x2, y2, fraction): the points' box with padding, clamped; the whole image if that is empty."""
    box = points.groupBy("pair_id").agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d"))
    px = F.greatest(F.lit(1.0), (F.col("b") - F.col("a")) * padding)
    py = F.greatest(F.lit(1.0), (F.col("d") - F.col("c")) * padding)
    box = box.select(
        "pair_id",
        F.greatest(F.lit(0), F.floor(F.col("a") - px)).cast("int").alias("x1"),
        F.greatest(F.lit(0), F.floor(F.col("c") - py)).cast("int").alias("y1"),
        F.least(F.lit(width), F.ceil(F.col("b") + px)).cast("int").alias("x2"),
        F.least(F.lit(height), F.ceil(F.col("d") + py)).cast("int").alias("y2"),
    )
    empty = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    whole = {"x1": 0, "y1": 0, "x2": width, "y2": height}
    box = box.select("pair_id", *(F.when(empty, v).otherwise(F.col(k)).alias(k) for k, v in whole.items()))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return box.withColumn("fraction", area / F.lit(width * height))


def fov_boxes(matches: DataFrame, width: int, height: int, padding: float = 0.02) -> DataFrame:
    """(pair_id, l_x1 .. l_y2, l_fraction, r_x1 .. r_fraction): boxes of the matches that are plausible in both images.

    Pairs with fewer than four such matches stay whole, with fractions of 1.
    """
    kept = fenced(matches, ["lx", "ly", "rx", "ry"], least_range=1e-6, fall_back=False)
    enough = kept.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("pair_id")
    use = kept.join(enough, "pair_id", "left_semi")
    whole = {"x1": 0, "y1": 0, "x2": width, "y2": height, "fraction": 1.0}
    out = matches.select("pair_id").distinct()
    for s in ("l", "r"):
        box = crop_boxes(use, f"{s}x", f"{s}y", width, height, padding)
        out = out.join(box.select("pair_id", *(F.col(c).alias(f"{s}_{c}") for c in whole)), "pair_id", "left")
    return out.select("pair_id", *(F.coalesce(f"{s}_{c}", F.lit(v)).alias(f"{s}_{c}") for s in ("l", "r") for c, v in whole.items()))


def fov_crops(matches: DataFrame, width: int, height: int, padding: float = 0.02) -> DataFrame:
    """(pair_id, left and right crop fractions) of fov_boxes."""
    return fractions(fov_boxes(matches, width, height, padding))


def fractions(boxes: DataFrame) -> DataFrame:
    """(pair_id, left and right crop fractions) of boxes as fov_boxes gives them."""
    left, right = F.col("l_fraction"), F.col("r_fraction")
    return boxes.select(
        "pair_id",
        F.least(left, right).alias("fov_crop_fraction"),
        left.alias("fov_left_retained_fraction"),
        right.alias("fov_right_retained_fraction"),
        (1 - left).alias("fov_left_cropped_fraction"),
        (1 - right).alias("fov_right_cropped_fraction"),
    )


def cropped(matches: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Matches inside both of a pair's boxes, measured in crops that are as large as the images again.

    Stands in for matches of the crops themselves, which a matcher may give instead.
    """
    met = matches.join(boxes, "pair_id")
    inside = reduce(
        lambda p, q: p & q,
        (F.col(f"{s}{c}").between(F.col(f"{s}_{c}1"), F.col(f"{s}_{c}2")) for s in ("l", "r") for c in ("x", "y")),
    )

    def placed(s: str, c: str, size: int) -> Column:
        low, high = F.col(f"{s}_{c}1"), F.col(f"{s}_{c}2")
        return ((F.col(f"{s}{c}") - low) / (high - low) * size).alias(f"{s}{c}")

    moved = [placed(s, c, n) for s in ("l", "r") for c, n in (("x", width), ("y", height))]
    return met.where(inside).select(*(c for c in matches.columns if c not in ("lx", "ly", "rx", "ry")), *moved)


def in_band(matches: DataFrame, height: int, keep: float, top_bias: float = 0.0) -> DataFrame:
    """Matches in a panorama's band of rows on both sides; a positive bias moves the band up."""
    if keep >= 1:
        return matches
    size = max(1, round(height * keep))
    spare = height - size
    start = max(0, min(spare, round(spare / 2 * (1 - max(-1.0, min(1.0, top_bias))))))
    inside = [(F.col(c) >= start) & (F.col(c) < start + size) for c in ("ly", "ry")]
    return matches.where(inside[0] & inside[1])


def turned(matches: DataFrame, yaws: DataFrame, width: int) -> DataFrame:
    """Matches with the right image turned by its pair's yaw(pair_id, best_yaw); pairs without a yaw stay as they are."""
    shift = F.rint(F.pmod(F.coalesce("best_yaw", F.lit(0)), F.lit(360)) / 360.0 * width)
    met = matches.join(yaws.select("pair_id", "best_yaw"), "pair_id", "left")
    return met.withColumn("rx", F.pmod(F.col("rx") - shift, F.lit(float(width)))).select(*matches.columns)


def yaw_votes(matches: DataFrame, width: float, yaw_step: float = 10, min_support: int = 8, min_ratio: float = 0.25) -> DataFrame:
    """One row for each pair with matches: total, support, and yaw with concentration where support is enough, else null.

    The first fullest bin of offsets wins; offsets within max(1.5 bins, 8 degrees) of its middle support it.
    """
    bin_width = max(1.0, float(yaw_step))
    offset = F.pmod((F.col("rx") - F.col("lx")) / width * 360.0, F.lit(360.0))
    bins = int(-(-(360.0 + bin_width) // bin_width)) - 1
    # the last bin is closed on the right, too
    bin_ = F.least(F.floor(F.col("offset") / bin_width), F.lit(bins - 1)).cast("int")
    marked = together(matches.select("pair_id", offset.alias("offset"))).withColumn("bin", bin_)
    counts = marked.groupBy("pair_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("pair_id").agg(F.sum("n").alias("total"), F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("best"))
    centre = F.pmod((F.col("best") + 0.5) * bin_width, F.lit(360.0))
    near = marked.join(best, "pair_id").where(circular_distance("offset", centre) <= max(1.5 * bin_width, 8.0))
    support = near.groupBy("pair_id").agg(F.count(F.lit(1)).alias("support"), circular_mean("offset").alias("yaw"))
    spread = near.join(support, "pair_id").groupBy("pair_id").agg(
        (1 - F.avg(circular_distance("offset", "yaw")) / 180).alias("concentration")
    )
    enough = (F.col("total") >= min_support) & (F.col("support") >= min_support) & (F.col("support") / F.col("total") >= min_ratio)
    return best.join(support, "pair_id").join(spread, "pair_id").select(
        "pair_id",
        "total",
        "support",
        F.when(enough, F.col("yaw")).alias("yaw"),
        F.when(enough, F.col("concentration")).alias("concentration"),
    )


def one_shot_yaw(votes: DataFrame) -> DataFrame:
    """(pair_id, best_yaw, method): the vote, or yaw 0 under a label that says so."""
    return votes.select(
        "pair_id",
        F.coalesce(F.pmod(F.rint(rounded("yaw", YAW_PLACES)).cast("int"), F.lit(360)), F.lit(0)).alias("best_yaw"),
        F.when(F.col("yaw").isNotNull(), ONE_SHOT).otherwise(ONE_SHOT_FAILED).alias("method"),
    )


def score_yaws(matches: DataFrame, width: int, candidates: DataFrame) -> DataFrame:
    """candidates(pair_id, yaw, o) to (pair_id, yaw, o, score, n): mean distance after turning, over 1 + 0.3 ln(1 + n).

    Matches stay the same for all yaws here; a matcher that depends on yaw gives its own table with a yaw column.
    """
    shift = F.rint(F.pmod("yaw", F.lit(360)) / 360.0 * width)
    met = candidates.join(matches, "pair_id").withColumn("turned", F.pmod(F.col("rx") - shift, F.lit(float(width))))
    distance = F.hypot(F.col("lx") - F.col("turned"), F.col("ly") - F.col("ry"))
    return met.groupBy("pair_id", "yaw", "o").agg(
        (F.avg(distance) / (1 + 0.3 * F.log1p(F.count(F.lit(1)).cast("double")))).alias("score"), F.count(F.lit(1)).alias("n")
    )


def _yaw_scores(points: np.ndarray, yaws: np.ndarray, width: int) -> np.ndarray:
    """score_yaws' score of each yaw for one pair's matches, rows (lx, ly, rx, ry).

    Sums are exact for distances on a grid of 2^-32 pixels, so equal distances in another order give equal scores.
    """
    lx, ly, rx, ry = points[:, :, None]
    turned = np.mod(rx - np.rint(np.mod(yaws, 360) / 360.0 * width), width)
    distance = np.sqrt((lx - turned) ** 2 + (ly - ry) ** 2)
    return np.rint(distance * 2.0**32).sum(axis=0) / (2.0**32 * points.shape[1]) / (1 + 0.3 * np.log1p(points.shape[1]))


def search_yaw(matches: DataFrame, width: int, yaw_step: int = 10) -> DataFrame:
    """(pair_id, best_yaw, method): the vote refined within two steps; without a vote a coarse round, then a fine one.

    The first of equally good candidates wins. A pair's matches (as many as an image has keypoints
    at most) come together once, and each pair is searched where they are.
    """
    fine = max(1, yaw_step // 4)
    steps, coarse = np.arange(-2 * yaw_step, 2 * yaw_step + 1, fine), np.arange(0, 360, yaw_step)
    votes = yaw_votes(matches, width, yaw_step).select("pair_id", F.rint(rounded("yaw", YAW_PLACES)).cast("int").alias("centre"))
    point = F.struct(*(F.col(c).cast("double").alias(c) for c in ("lx", "ly", "rx", "ry")))
    gathered = dealt(matches).groupBy("pair_id").agg(F.collect_list(point).alias("points")).join(votes, "pair_id")

    def best(points: np.ndarray, centre: int | None) -> int:
        if centre is not None:
            tried = (centre + steps) % 360
        else:
            first = coarse[_yaw_scores(points, coarse, width).argmin()]
            tried = np.concatenate([coarse, (first + steps) % 360])
        return int(tried[_yaw_scores(points, tried, width).argmin()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, lists, centres = batch.columns
            flat = np.stack([c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()])
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            centres = centres.to_pylist()
            found = [best(flat[:, i:j], c) for i, j, c in zip(edges[:-1], edges[1:], centres, strict=True)]
            names = [SEARCHED if c is None else ONE_SHOT_REFINED for c in centres]
            yield pa.RecordBatch.from_arrays(
                [pairs, pa.array(found, pa.int32()), pa.array(names, pa.string())], names=["pair_id", "best_yaw", "method"]
            )

    kind = T.StructType([matches.schema["pair_id"], T.StructField("best_yaw", T.IntegerType()), T.StructField("method", T.StringType())])
    return gathered.mapInArrow(run, kind)


def distortion_score(h: Sequence[Column], width: Column, height: Column, valid_fraction: Column) -> Column:
    """How much a homography (nine columns, row by row) changes an image's shape; infinite if it degenerates."""

    def corner(x, y) -> tuple[Column, Column]:
        w = h[6] * x + h[7] * y + h[8]
        return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w

    zero = F.lit(0.0)
    corners = [corner(zero, zero), corner(width, zero), corner(width, height), corner(zero, height)]
    turns = list(zip(corners, corners[1:] + corners[:1], strict=True))
    area = F.abs(sum((a[0] * b[1] - b[0] * a[1] for a, b in turns), zero)) / 2
    edges = [F.hypot(b[0] - a[0], b[1] - a[1]) for a, b in turns]
    logs = [F.log(F.greatest(e / s, F.lit(1e-6))) for e, s in zip(edges, (width, height, width, height), strict=True)]
    mean = sum(logs, zero) / 4
    deviation = F.sqrt(sum(((x - mean) * (x - mean) for x in logs), zero) / 4)
    bends = sum((F.abs(x) for x in logs), zero) / 4
    score = F.abs(F.log(F.greatest(area / (width * height), F.lit(1e-6)))) + bends + deviation + 0.25 * (
        1 - F.greatest(zero, F.least(F.lit(1.0), valid_fraction))
    )
    flat = (width * height <= 0) | (area <= 1e-6) | (F.least(*edges) <= 1e-6)
    return F.when(flat, float("inf")).otherwise(score)


def first_best(rows: DataFrame, key: Sequence[str], value: str, score: str, order: str) -> DataFrame:
    """The value with the lowest score of each key; the first in order of equal ones."""
    return rows.groupBy(*key).agg(F.min_by(value, F.struct(score, order)).alias(value), F.min(score).alias(score))


def weighted_horizon(lines: DataFrame) -> DataFrame:
    """lines(image_id, x1, y1, x2, y2) to (image_id, horizon_angle): mean of near-level line angles by length, null if none."""
    angle, length = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    level = F.degrees(angle).between(-20, 20)
    weight = F.when(level, length)
    return lines.groupBy("image_id").agg(F.degrees(F.sum(F.when(level, angle * length)) / F.sum(weight)).alias("horizon_angle"))
