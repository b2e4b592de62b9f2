"""Deciles, strata, quotas and resumption of sampling runs."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeparts
from ..functions.text import number
from ..sources import scratch
from .ordering import seeded


def interpolated(low: float, high: float, part: float) -> float:
    """low * (1 - part) + high * part with one rounding of the first product and the sum, as a fused multiply-add gives it.

    Values that equal an edge belong below it, so an edge's last bit decides the bin of all of them; the SQL's engine fuses.
    """
    return float(Fraction(low) * Fraction(1 - part) + Fraction(high * part))


def quantile_edges(values: DataFrame, bins: int) -> DataFrame:
    """values(metric, value) to (metric, edges): the exact quantiles at 0, 1/bins, ..., interpolated, equal ones merged.

    Values are counted, laid out by range and summed up range by range, so that no task holds a whole metric.
    """
    counts = values.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    parts = scratch.written(counts.repartitionByRange("metric", "value").withColumn("part", F.spark_partition_id()), "counts")
    sizes = parts.groupBy("metric", "part").agg(F.sum("n").alias("size"))
    # as many rows as there are partitions and metrics
    whole = Window.partitionBy("metric")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("metric", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"), F.sum("size").over(whole).alias("total"))
    up_to = F.sum("n").over(Window.partitionBy("metric", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumn("up_to", up_to).join(shifts, ["metric", "part"])
    end, wanted = F.col("up_to") + F.col("shift"), F.array(*map(F.lit, range(bins + 1)))
    shares = F.array(*(F.lit(i / bins) for i in range(bins + 1)))

    def at(i: Column) -> Column:
        return (F.col("total") - 1).cast("double") * F.get(shares, i)

    def here(place: Column) -> Column:
        return (place >= end - F.col("n")) & (place < end)

    hits = F.filter(wanted, lambda i: here(F.floor(at(i))) | here(F.ceil(at(i))))
    found = placed.withColumn("hits", hits).where(F.size("hits") > 0).withColumn("i", F.explode("hits")).withColumn("at", at(F.col("i")))
    low = F.max(F.when(here(F.floor("at")), F.col("value")))
    high = F.max(F.when(here(F.ceil("at")), F.col("value")))
    # eleven rows a metric, for ten bins
    edge = F.when(F.floor("at") == F.ceil("at"), F.col("low")).otherwise(F.udf(lambda *x: interpolated(*x), "double")("low", "high", F.col("at") - F.floor("at")))
    each = found.groupBy("metric", "i", "at").agg(low.alias("low"), high.alias("high")).select("metric", edge.alias("edge"))
    return each.groupBy("metric").agg(F.array_sort(F.collect_set("edge")).alias("edges"))


def deciles(rows: DataFrame, metrics: Sequence[str], id_: Sequence[str], bins: int = 10) -> DataFrame:
    """(ids, metric, value, decile): quantile bins of each metric's finite values, equal edges merged.

    A metric with one value only has no bins and gives no rows.
    """
    long = rows.select(
        *id_, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), number(F.col(m)).alias("value")) for m in metrics))).alias("x")
    ).select(*id_, "x.metric", "x.value")
    finite = long.where(F.col("value").isNotNull() & (F.abs("value") != float("inf")))
    edges = quantile_edges(finite.select("metric", "value"), bins).where(F.size("edges") > 1)
    below = F.size(F.filter("edges", lambda e: e < F.col("value")))
    # one row a metric
    return finite.join(F.broadcast(edges), "metric").select(
        *id_, "metric", "value", (F.greatest(below, F.lit(1)) - 1).alias("decile")
    )


def decile_label(decile: Column) -> Column:
    return F.format_string("p%02d_%03d", decile * 10, (decile + 1) * 10)


def per_group(rows: DataFrame, groups: Sequence[str], n: int, key: Column, limit: Column | None = None) -> DataFrame:
    """The first n of each group in key order, or as many of them as a limit says; no partition passes on more than n of a group."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(key))
    first = rows.withColumn("__place", place).where(F.col("__place") <= n)
    return (first if limit is None else first.where(F.col("__place") <= limit)).drop("__place")


def decile_sample(rows: DataFrame, metrics, id_: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    binned = deciles(rows, metrics, id_)
    return per_group(binned, ["metric", "decile"], n, seeded(seed, *id_)).withColumn("label", decile_label(F.col("decile")))


def time_columns(images: DataFrame, with_daytime: bool = False) -> DataFrame:
    """year, month, season (and day or night); images without a time go."""
    ms = timeparts.millis()
    out = images.withColumns({"year": timeparts.year(ms), "month": timeparts.month(ms), "season": timeparts.season(ms)})
    out = out.where(F.col("year").isNotNull())
    if not with_daytime:
        return out
    up = timeparts.daytime(ms, F.col("lat"), F.col("lon"))
    return out.withColumn("daytime", F.when(up, "day").when(~up, "night")).where("daytime is not null")


def strata(
    mode: str,
    old: Sequence[int] = (),
    new: Sequence[int] = (),
    old_label: str = "old",
    new_label: str = "new",
) -> dict[str, Column]:
    """Label to condition, for any, year, month, season, same-season or time."""
    in_old, in_new = F.col("year").isin(list(old)), F.col("year").isin(list(new))
    seasons = list(timeparts.SEASONS)
    if mode == "any":
        return {"any": F.lit(True)}
    if mode == "year":
        return {old_label: in_old, new_label: in_new}
    if mode == "month":
        return {f"month_{m:02d}": F.col("month") == m for m in range(1, 13)}
    if mode == "season":
        return {s: F.col("season") == s for s in seasons}
    if mode == "same-season":
        return {
            f"{label}_{s}": years & (F.col("season") == s)
            for s in seasons
            for label, years in ((old_label, in_old), (new_label, in_new))
        }
    if mode == "time":
        return {"day": F.col("daytime") == "day", "night": F.col("daytime") == "night"}
    raise ValueError(f"unknown sampling mode {mode!r}")


def mode_of(time_filters: Sequence[str]) -> str:
    rules = [f for f in time_filters if f != "any"]
    if len(rules) > 1:
        raise ValueError("sampling takes one time filter at a time")
    return rules[0] if rules else "any"


def members(images: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """images once for each stratum that they are in."""
    labels = F.filter(F.array(*(F.when(c, F.lit(label)) for label, c in groups.items())), lambda x: x.isNotNull())
    return images.withColumn("year_group", F.explode(labels))


def plan(images: DataFrame, groups: dict[str, Column], target: int, existing: DataFrame | None = None, allow_short: bool = False) -> DataFrame:
    """One row a stratum, empty ones too: available, existing, target, remaining, candidates."""
    spark = images.sparkSession
    labels = spark.createDataFrame([(g,) for g in groups], "year_group string")
    inside = members(images, groups).select("id", "year_group")
    if existing is None:
        existing = inside.where(F.lit(False))
    done = existing.select(F.col("id").alias("done_id")).distinct()
    counted = inside.join(done, inside["id"] == done["done_id"], "left").groupBy("year_group").agg(
        F.count(F.lit(1)).alias("available"), F.count_if(F.col("done_id").isNull()).alias("candidates")
    )
    had = existing.groupBy("year_group").agg(F.count(F.lit(1)).alias("existing"))
    out = labels.join(counted, "year_group", "left").join(had, "year_group", "left").na.fill(0)
    wanted = F.least(F.lit(target), F.col("available")) if allow_short else F.lit(target)
    return out.withColumn("target", wanted.cast("long")).withColumn(
        "remaining", F.greatest(F.lit(0), F.col("target") - F.col("existing")).cast("long")
    )


def quota_sample(images: DataFrame, groups: dict[str, Column], target: int, existing: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """At most `remaining` new images a stratum; an image is used once, in the first stratum that it is in."""
    inside = members(images, groups)
    rank = {g: i for i, g in enumerate(groups)}
    number_ = F.coalesce(*(F.when(F.col("year_group") == g, i) for g, i in rank.items()))
    if existing is not None:
        inside = inside.join(existing.select("id"), "id", "left_anti")
    once = inside.withColumn("__rank", number_)
    first = Window.partitionBy("id").orderBy("__rank")
    once = once.withColumn("__use", F.row_number().over(first)).where("__use = 1").drop("__use", "__rank")
    quota = plan(images, groups, target, existing).select("year_group", "remaining")
    # one row a stratum
    return per_group(once.join(F.broadcast(quota), "year_group"), ["year_group"], target, seeded(seed, F.col("id")), F.col("remaining")).drop("remaining")
