"""Seeded orders: round-robin over buckets, with hash keys instead of a random generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeparts
from ..sources import scratch


def seeded(seed: int, *parts: Column | str) -> Column:
    """An order key that any engine can compute: the MD5 of seed and parts, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def year_pair(left: Column, right: Column) -> Column:
    """Both capture years, older first; null if one is missing."""
    a, b = timeparts.year(left), timeparts.year(right)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("-", F.least(a, b), F.greatest(a, b)))


def tile_pair(left: str = "l", right: str = "r") -> Column:
    """Both tiles in order; null if a part is missing."""
    tiles = [F.struct(*(F.col(f"{s}.tile_{c}") for c in "zxy")) for s in (left, right)]
    known = [F.col(f"{s}.tile_{c}").isNotNull() for s in (left, right) for c in "zxy"]
    ordered = F.sort_array(F.array(*tiles))
    return F.when(F.array_min(F.array(*known)), F.to_json(ordered))


def round_robin(rows: DataFrame, bucket: Column, key: Column, seed: int = 42) -> DataFrame:
    """Column turn: each bucket's rows in hash order; column turn_key: the order of buckets within a turn.

    Sorting by (turn, turn_key) goes round the buckets, each time in another order. A bucket of any
    size is numbered by many tasks.
    """
    name = F.coalesce(bucket.cast("string"), F.lit("none"))
    step = rows.withColumns({"__bucket": name, "__key": seeded(seed, key)})
    step = positions(step, "__key", name="turn", within=("__bucket",)).withColumn("turn", F.col("turn") + 1)
    return step.withColumn("turn_key", seeded(seed, F.col("turn").cast("string"), F.col("__bucket"))).drop("__bucket", "__key")


def positions(rows: DataFrame, *order: str, name: str = "position", within: Sequence[str] = ()) -> DataFrame:
    """0, 1, 2, ... in an order, within groups if given: range partitions, numbered inside and shifted by the sizes of those before.

    The partitions are written to a scratch table first: their bounds come from samples, and must be
    the same for the sizes and for the rows. No task sees more than its own range, whatever a group's size.
    """
    parts = scratch.written(rows.repartitionByRange(*(F.col(c) for c in (*within, *order))).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*within, "__part").agg(F.count(F.lit(1)).alias("__size"))
    # as many rows as there are partitions and groups
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*within, "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__shift"))
    place = F.row_number().over(Window.partitionBy(*within, "__part").orderBy(*order))
    numbered = parts.withColumn("__at", place).join(shifts, [*within, "__part"])
    return numbered.withColumn(name, F.col("__at") + F.col("__shift") - 1).drop("__part", "__at", "__shift")


def balanced_pairs(pairs: DataFrame, time_filters=(), seed: int = 42) -> DataFrame:
    """Area pairs by tile combination, and by year combination if the year rule is on."""
    year = year_pair(F.col("l.captured_at"), F.col("r.captured_at")) if "year" in time_filters else F.lit(None)
    bucket = F.concat_ws("|", F.coalesce(year, F.lit("-")), F.coalesce(tile_pair(), F.lit("-")))
    return round_robin(pairs, bucket, F.concat_ws(":", "l.id", "r.id"), seed)
