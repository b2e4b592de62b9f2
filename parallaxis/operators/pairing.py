"""Pairs of nearby images: a spatial range self-join and its predicates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, timeparts
from ..sources import scratch

TIME_FILTERS = ("any", "year", "month", "season", "same-season", "time")


def in_years(images: DataFrame, left: Sequence[int] | None, right: Sequence[int] | None) -> DataFrame:
    """Images of either year group; all images unless both groups are given. Missing times go."""
    if not left or not right:
        return images
    return images.where(timeparts.year(timeparts.millis()).isin(sorted({*left, *right})))


def planar(images: DataFrame) -> DataFrame:
    """Columns x, y in metres, at the mean latitude of these images (one row, so it is safe to send everywhere)."""
    mean = images.agg(F.avg("lat").alias("__mean"))
    scale = F.lit(math.pi / 180 * geo.EARTH_RADIUS_M)
    return images.join(F.broadcast(mean)).withColumns(
        {"x": F.col("lon") * scale * F.cos(F.radians("__mean")), "y": F.col("lat") * scale}
    ).drop("__mean")


def angle_ok(most: float | None, left: str = "l", right: str = "r") -> Column:
    """Missing angles pass."""
    if most is None:
        return F.lit(True)
    a, b = F.col(f"{left}.compass_angle"), F.col(f"{right}.compass_angle")
    return a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b) | (geo.angle_diff(a, b) <= most)


def time_ok(filters: Sequence[str], left: str = "l", right: str = "r") -> Column:
    """All named rules hold; missing times pass."""
    unknown = set(filters) - set(TIME_FILTERS)
    if unknown:
        raise ValueError(f"unknown time filters {sorted(unknown)}")
    a, b = (F.col(f"{s}.captured_at") for s in (left, right))
    years, months = [timeparts.year(t) for t in (a, b)], [timeparts.month(t) for t in (a, b)]
    seasons = [timeparts.season_of(m) for m in months]

    def rule(name: str) -> Column:
        if name == "year":
            return years[0] != years[1]
        if name == "month":
            return (years[0] != years[1]) | (months[0] != months[1])
        if name == "season":
            return seasons[0] != seasons[1]
        if name == "same-season":
            return (years[0] != years[1]) & (seasons[0] == seasons[1])
        lat, lon = ((F.col(f"{left}.{c}") + F.col(f"{right}.{c}")) / 2 for c in ("lat", "lon"))
        return F.coalesce(timeparts.daytime(a, lat, lon) != timeparts.daytime(b, lat, lon), F.lit(False))

    rules = [rule(f) for f in dict.fromkeys(filters) if f != "any"]
    return a.isNull() | b.isNull() | reduce(lambda p, q: p & q, rules, F.lit(True))


def year_groups_ok(
    group_left: Sequence[int] | None, group_right: Sequence[int] | None, left: str = "l", right: str = "r"
) -> Column:
    """One image in each group, either way round; missing times fail. No condition unless both groups are given."""
    if not group_left or not group_right:
        return F.lit(True)
    a, b = (timeparts.year(F.col(f"{s}.captured_at")) for s in (left, right))
    one, other = list(group_left), list(group_right)
    return F.coalesce((a.isin(one) & b.isin(other)) | (a.isin(other) & b.isin(one)), F.lit(False))


#: Cells are at least so wide, in metres, whatever the distance.
LEAST_CELL = 0.01


def nearby_pairs(
    images: DataFrame, most_m: float = 2.5, order: str = "id", extra: Column | None = None, distinct: bool = False
) -> DataFrame:
    """(l, r) structs of unordered pairs at most `most_m` metres apart on the plane; l comes first in `order`.

    Every two rows make a pair, also where they share an order value or have none (nulls come
    first): then rows are numbered first. `distinct` says that each row has an order value of its
    own, which saves that. A distance of 0 pairs rows of the same place; a negative one, none.

    Images fall into square cells as wide as the distance. A cell meets itself and four of
    its neighbours, so each pair meets once, in an equi-join that Spark hashes, sorts or
    splits as it sees fit; the exact distance and all other conditions are its residual.
    """
    row = F.struct(*images.columns)
    if distinct:
        cells, rank = planar(images), F.col(order)
    else:
        cells, rank = planar(scratch.written(images.withColumn("__number", F.monotonically_increasing_id()), "numbered")), F.struct(F.col(order), F.col("__number"))
    width = max(most_m, LEAST_CELL)
    cells = cells.withColumns({"cx": F.floor(F.col("x") / width), "cy": F.floor(F.col("y") / width)})
    home = cells.select(row.alias("l"), rank.alias("before"), "x", "y", "cx", "cy")
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))))
    away = cells.select(row.alias("r"), rank.alias("after"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", F.explode(steps).alias("s"))
    away = away.select("r", "after", "x2", "y2", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"),
                       ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("same"))
    turn = F.col("before") > F.col("after")
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    met = home.join(away, ["cx", "cy"]).where(
        (~F.col("same") | (F.col("before") < F.col("after"))) & (F.sqrt(dx * dx + dy * dy) <= most_m)
    )
    # a neighbouring cell's pair comes either way round
    pairs = met.select(F.when(turn, F.col("r")).otherwise(F.col("l")).alias("l"), F.when(turn, F.col("l")).otherwise(F.col("r")).alias("r"))
    return pairs if extra is None else pairs.where(extra)


def area_pairs(
    images: DataFrame,
    most_m: float = 2.5,
    most_angle: float | None = None,
    time_filters: Sequence[str] = (),
    year_group_left: Sequence[int] | None = None,
    year_group_right: Sequence[int] | None = None,
    order: str = "id",
    distinct: bool = False,
) -> DataFrame:
    """Pairs under all predicates: cheap ones in order, the sun's position last. See nearby_pairs."""
    conditions = (
        angle_ok(most_angle) & year_groups_ok(year_group_left, year_group_right) & time_ok(time_filters)
    )
    return nearby_pairs(images, most_m, order, conditions, distinct)


def with_metadata(pairs: DataFrame) -> DataFrame:
    """dist_m (great circle, 3 decimals) and angle_diff_deg (2 decimals, null where an angle is missing)."""
    return pairs.withColumns(
        {
            "dist_m": F.round(geo.haversine_m("l.lat", "l.lon", "r.lat", "r.lon"), 3),
            "angle_diff_deg": F.round(geo.angle_diff("l.compass_angle", "r.compass_angle"), 2),
        }
    )


def pending(pairs: DataFrame, done: DataFrame, ordered: bool = False) -> DataFrame:
    """Pairs (id_left, id_right) that are not done; either way round counts as done unless ordered."""

    def key(prefix: str) -> list[Column]:
        a, b = F.col(f"{prefix}.id_left").cast("string"), F.col(f"{prefix}.id_right").cast("string")
        return [a, b] if ordered else [F.least(a, b), F.greatest(a, b)]

    same = reduce(lambda p, q: p & q, (x == y for x, y in zip(key("p"), key("d"), strict=True)))
    return pairs.alias("p").join(done.select("id_left", "id_right").alias("d"), same, "left_anti")


def year_counts(images: DataFrame) -> DataFrame:
    return images.groupBy(timeparts.year(timeparts.millis()).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def area_summary(images: DataFrame) -> DataFrame:
    """One row: images, panoramas, flat ones, first and last capture."""
    pano = F.coalesce("is_pano", F.lit(False))
    return images.agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(pano).alias("panoramas"),
        F.count_if(~pano).alias("flat"),
        F.min("captured_at").alias("first_ms"),
        F.max("captured_at").alias("last_ms"),
    )


def describe(time_filters: Sequence[str], group_left: Sequence[int] = (), group_right: Sequence[int] = ()) -> str:
    """The pairing rules in words."""
    words = {
        "year": "different years",
        "month": "different year and month",
        "season": "different seasons",
        "same-season": "same season of different years",
        "time": "one by day and one by night",
    }
    parts = [words[f] for f in dict.fromkeys(time_filters) if f != "any"] or ["any time"]
    if group_left and group_right:
        years = [", ".join(map(str, sorted(g))) for g in (group_left, group_right)]
        parts.append(f"years {years[0]} against {years[1]}")
    return "; ".join(parts)


def capture_range(images: DataFrame) -> DataFrame:
    """One row: first and last capture date in UTC, null without any."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(timeparts.millis() / timeparts.DAY_MS).cast("int"))
    return images.agg(F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"))
