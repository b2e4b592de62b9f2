"""Label masks as pixel tables: (pair_id, y, x, left_label, right_label)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INVALID = 255

# Parts of class names that mark things that move or stay only for a while.
TEMPORARY_WORDS = (
    "person", "people", "pedestrian", "rider", "car", "van", "taxi", "trailer", "caravan", "truck", "bus", "train",
    "tram", "motorcycle", "bicycle", "bike", "vehicle",
)


# The street-scene classes of a widely used label set, with their display colours.
STREET_CLASSES = {
    0: ("road", (128, 64, 128)),
    1: ("sidewalk", (244, 35, 232)),
    2: ("building", (70, 70, 70)),
    3: ("wall", (102, 102, 156)),
    4: ("fence", (190, 153, 153)),
    5: ("pole", (153, 153, 153)),
    6: ("traffic light", (250, 170, 30)),
    7: ("traffic sign", (220, 220, 0)),
    8: ("vegetation", (107, 142, 35)),
    9: ("terrain", (152, 251, 152)),
    10: ("sky", (70, 130, 180)),
    11: ("person", (220, 20, 60)),
    12: ("rider", (255, 0, 0)),
    13: ("car", (0, 0, 142)),
    14: ("truck", (0, 0, 70)),
    15: ("bus", (0, 60, 100)),
    16: ("train", (0, 80, 100)),
    17: ("motorcycle", (0, 0, 230)),
    18: ("bicycle", (119, 11, 32)),
}


def class_sets(classes: DataFrame) -> DataFrame:
    """classes(id, label) with flags road, sky and temporary, by parts of the lower-cased label."""
    name = F.lower("label")
    flag = {
        "road": F.contains(name, F.lit("road")),
        "sky": F.contains(name, F.lit("sky")),
        "temporary": F.exists(F.array(*map(F.lit, TEMPORARY_WORDS)), lambda w: F.contains(name, w)),
    }
    return classes.withColumns(flag)


def _temporary(temporary: Sequence[int], *sides: str) -> Column:
    out = F.lit(False)
    for side in sides:
        out = out | F.col(side).isin(list(temporary))
    return out


def valid(pixels: DataFrame) -> DataFrame:
    return pixels.where((F.col("left_label") != INVALID) & (F.col("right_label") != INVALID))


def crop_rows(pixels: DataFrame, height: Column | int, top: float = 0.0, bottom: float = 0.0) -> DataFrame:
    """Rows from rint(h * top) up to rint(h * (1 - bottom)); the whole mask if that leaves none."""
    if top <= 0 and bottom <= 0:
        return pixels
    h = height if isinstance(height, Column) else F.lit(height)
    first = F.rint(h * min(1.0, max(0.0, top)))
    last = F.rint(h * (1.0 - min(1.0, max(0.0, bottom))))
    return pixels.where((last <= first) | ((F.col("y") >= first) & (F.col("y") < last)))


def resized(mask: DataFrame, height: int, width: int, source_height: int, source_width: int) -> DataFrame:
    """Nearest neighbour: mask(pair_id, y, x, label) at the target size; pixel (y, x) takes floor(y*sh/h), floor(x*sw/w)."""
    if (height, width) == (source_height, source_width):
        return mask
    # target rows that read a source row y: from ceil(y*h/sh) up to ceil((y+1)*h/sh), likewise columns

    def targets(c: str, size: int, source: int) -> Column:
        low = F.ceil(F.col(c) * size / source).cast("int")
        high = F.ceil((F.col(c) + 1) * size / source).cast("int")
        return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))

    rows = mask.select("pair_id", "label", "x", F.explode(targets("y", height, source_height)).alias("ty"))
    return rows.select("pair_id", "label", "ty", F.explode(targets("x", width, source_width)).alias("tx")).select(
        "pair_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "label"
    )


def narrowed(pixels: DataFrame, height: int, width: int, most: int | None) -> tuple[DataFrame, int, int]:
    """Pixels of masks at most so many columns wide, by nearest neighbour, and their height and width."""
    if not most or width <= most:
        return pixels, height, width
    low = max(1, round(height * most / width))
    both = pixels.select("pair_id", "y", "x", F.struct("left_label", "right_label").alias("label"))
    return resized(both, low, most, height, width).select("pair_id", "y", "x", "label.*"), low, most


def per_class_iou(pixels: DataFrame, ignore: Sequence[int] = ()) -> DataFrame:
    """(pair_id, class, iou) over classes of either side; pixels with an ignored class on either side do not count."""
    use = pixels.where(~_temporary(ignore, "left_label", "right_label")) if ignore else pixels
    # equal labels count once on both sides: partial sums by (pair, left, right) first
    met = use.groupBy("pair_id", "left_label", "right_label").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("left_label") == F.col("right_label")
    both = F.array(
        F.struct(F.col("left_label").alias("class"), F.col("n").alias("union"), F.when(same, F.col("n")).otherwise(0).alias("inter")),
        F.struct(F.col("right_label").alias("class"), F.when(same, 0).otherwise(F.col("n")).alias("union"), F.lit(0).cast("bigint").alias("inter")),
    )
    long = met.select("pair_id", F.explode(both).alias("c")).select("pair_id", "c.class", "c.union", "c.inter")
    return long.groupBy("pair_id", "class").agg((F.sum("inter") / F.sum("union")).alias("iou"))


def iou_summary(pixels: DataFrame, road: Sequence[int], temporary: Sequence[int] = ()) -> DataFrame:
    """(pair_id, mean_iou, road_iou, per_class_json); temporary classes are ignored if given."""
    each = per_class_iou(valid(pixels), temporary)
    return each.groupBy("pair_id").agg(
        F.avg("iou").alias("mean_iou"),
        F.avg(F.when(F.col("class").isin(list(road)), F.col("iou"))).alias("road_iou"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "iou"))))).alias("per_class_json"),
    )


def class_shares(pixels: DataFrame, side: str) -> DataFrame:
    """(pair_id, class, share) of one side's labels."""
    counts = pixels.groupBy("pair_id", F.col(f"{side}_label").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("pair_id").agg(F.sum("n").alias("total"))
    return counts.join(total, "pair_id").select("pair_id", "class", (F.col("n") / F.col("total")).alias("share"))


def share_summary(pixels: DataFrame, temporary: Sequence[int]) -> DataFrame:
    """(pair_id, side, class, before, after, union_fraction): shares with all pixels, and without those where either side is temporary."""
    moving = _temporary(temporary, "left_label", "right_label")
    seen = valid(pixels).withColumn("moving", moving)
    long = seen.select(
        "pair_id",
        "moving",
        F.explode(
            F.array(
                F.struct(F.lit("left").alias("side"), F.col("left_label").alias("class")),
                F.struct(F.lit("right").alias("side"), F.col("right_label").alias("class")),
            )
        ).alias("p"),
    ).select("pair_id", "moving", "p.side", "p.class")
    counts = long.groupBy("pair_id", "side", "class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("moving")).alias("still")
    )
    total = counts.groupBy("pair_id", "side").agg(F.sum("n").alias("all"), F.sum("still").alias("all_still"))
    return counts.join(total, ["pair_id", "side"]).select(
        "pair_id",
        "side",
        "class",
        (F.col("n") / F.col("all")).alias("before"),
        F.when(F.col("still") > 0, F.col("still") / F.col("all_still")).alias("after"),
        ((F.col("all") - F.col("all_still")) / F.col("all")).alias("union_fraction"),
    )


def ignored(sky: Sequence[int], temporary: Sequence[int]) -> tuple[int, ...]:
    """Classes that say nothing about where a camera looks."""
    return tuple(sorted({*sky, *temporary}))


def ignored_classes(sky: Column, temporary: Column) -> Column:
    return F.array_sort(F.array_union(sky, temporary))


def _agreements(y, x, left_label, right_label, width: int, yaws: Sequence[int], ignore: Sequence[int]) -> list[float | None]:
    """Share of equal labels of one pair's masks for each yaw; 0 if only ignored classes meet, None if nothing meets."""
    inside = (x >= 0) & (x < width)
    shape = (int(y.max()) + 1, width)
    left, right = np.full(shape, -1, np.int32), np.full(shape, -1, np.int32)
    left[y[inside], x[inside]] = left_label[inside]
    right[y, np.mod(x, width)] = right_label
    blocked = [np.isin(side, list(ignore)) for side in (left, right)]
    out: list[float | None] = []
    for yaw in yaws:
        shift = -round((yaw % 360) / 360.0 * width)
        there, hidden = np.roll(right, shift, axis=1), np.roll(blocked[1], shift, axis=1)
        met = (left >= 0) & (there >= 0)
        use = met & ~blocked[0] & ~hidden
        out.append(float((left[use] == there[use]).mean()) if use.any() else (0.0 if met.any() else None))
    return out


def agreement_by_yaw(pixels: DataFrame, width: int, yaws: Sequence[int] | DataFrame, ignore: Sequence[int] = ()) -> DataFrame:
    """(pair_id, yaw, place, score): share of equal labels after turning the right mask, ignored classes left out; 0 without pixels.

    yaws: for all pairs, or a table (pair_id, yaws array<int>). A pair's masks come together once, and are turned there.
    """
    pixel = F.struct(*(F.col(c).cast("int").alias(c) for c in ("y", "x", "left_label", "right_label")))
    gathered = pixels.groupBy("pair_id").agg(F.collect_list(pixel).alias("pixels"))
    if isinstance(yaws, DataFrame):
        gathered = gathered.join(yaws.select("pair_id", "yaws"), "pair_id")
    else:
        gathered = gathered.withColumn("yaws", F.array(*(F.lit(int(v)) for v in yaws)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, lists, wanted = batch.columns
            columns = [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at, yaw, place, score = [], [], [], []
            for k, (i, j, tried) in enumerate(zip(edges[:-1], edges[1:], wanted.to_pylist(), strict=True)):
                for n, value in enumerate(_agreements(*(c[i:j] for c in columns), width, tried, ignore)):
                    if value is not None:
                        at.append(k), yaw.append(tried[n]), place.append(n), score.append(value)
            arrays = [pairs.take(pa.array(at, pa.int64())), pa.array(yaw, pa.int32()), pa.array(place, pa.int32()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["pair_id", "yaw", "place", "score"])

    kinds = (("yaw", T.IntegerType()), ("place", T.IntegerType()), ("score", T.DoubleType()))
    return gathered.mapInArrow(run, T.StructType([pixels.schema["pair_id"], *(T.StructField(n, k) for n, k in kinds)]))


def rerank_yaw(
    pixels: DataFrame, width: int, initial: int | DataFrame, radius: int = 8, step: int = 2, ignore: Sequence[int] = ()
) -> DataFrame:
    """(pair_id, best_yaw, best_score): the first of the yaws round an initial one with the highest agreement.

    initial: for all pairs, or each pair's own, as a table (pair_id, best_yaw).
    """
    step, radius = max(1, int(step)), max(0, int(radius))
    steps = list(range(-radius, radius + 1, step))
    if isinstance(initial, DataFrame):
        yaws = initial.select("pair_id", F.array(*(F.pmod(F.col("best_yaw") + d, F.lit(360)) for d in steps)).alias("yaws"))
    else:
        yaws = [(initial + d) % 360 for d in steps]
    scores = agreement_by_yaw(pixels, width, yaws, ignore)
    best = F.max_by(F.struct("yaw", "score"), F.struct(F.col("score"), -F.col("place")))
    return scores.groupBy("pair_id").agg(best.alias("b")).select(
        "pair_id", F.col("b.yaw").alias("best_yaw"), F.col("b.score").alias("best_score")
    )


def turned(pixels: DataFrame, yaws: DataFrame, width: int) -> DataFrame:
    """Pixels with each pair's right mask turned by its yaw(pair_id, best_yaw); pairs without a yaw stay as they are."""
    shift = F.rint(F.pmod(F.coalesce("best_yaw", F.lit(0)), F.lit(360)) / 360.0 * width).cast("int")
    right = pixels.select("pair_id", "y", "x", "right_label").join(yaws.select("pair_id", "best_yaw"), "pair_id", "left")
    right = right.select("pair_id", "y", F.pmod(F.col("x") - shift, F.lit(width)).alias("x"), "right_label")
    return pixels.select("pair_id", "y", "x", "left_label").join(right, ["pair_id", "y", "x"])


def reprojected(pixels: DataFrame, matrices: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """Left pixels with the right label where matrices(pair_id, h: nine numbers by row) takes them; those that leave the mask go.

    scale: mask pixels for each pixel that the matrices count in. Pairs without a matrix go.
    """
    h = [F.col("h")[i] for i in range(9)]
    x, y = F.col("x") / scale_x, F.col("y") / scale_y
    w = h[6] * x + h[7] * y + h[8]
    u, v = (F.rint((h[i] * x + h[i + 1] * y + h[i + 2]) / w * s).cast("int") for i, s in ((0, scale_x), (3, scale_y)))
    left = pixels.select("pair_id", "y", "x", "left_label").join(matrices.where("h is not null").select("pair_id", "h"), "pair_id")
    placed = left.where(w != 0).select("pair_id", "y", "x", "left_label", u.alias("u"), v.alias("v"))
    right = pixels.select("pair_id", F.col("x").alias("u"), F.col("y").alias("v"), "right_label")
    return placed.join(right, ["pair_id", "u", "v"]).select("pair_id", "y", "x", "left_label", "right_label")
