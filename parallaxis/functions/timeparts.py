"""Capture times: milliseconds since 1970, always read in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}
DAY_MS = 86_400_000


def millis(c="captured_at") -> Column:
    """A whole number of milliseconds, or null where the value is not one."""
    return F.expr(f"try_cast({c} AS BIGINT)") if isinstance(c, str) else c.cast("bigint")


def _days(ms: Column) -> Column:
    """The UTC date, whatever the session's time zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(DAY_MS)).cast("int"))


def year(ms: Column) -> Column:
    return F.year(_days(ms))


def month(ms: Column) -> Column:
    return F.month(_days(ms))


def season_of(month_: Column) -> Column:
    out = F.when(month_.isin(*SEASONS["spring"]), "spring")
    out = out.when(month_.isin(*SEASONS["summer"]), "summer").when(month_.isin(*SEASONS["autumn"]), "autumn")
    return out.when(month_.isNotNull(), "winter")


def season(ms: Column) -> Column:
    return season_of(month(ms))


def daytime(ms: Column, lat: Column, lon: Column) -> Column:
    """Whether the sun is up at that place, between sunrise and sunset of the UTC date.

    Published general solar position equations (zenith 90.833 degrees, position at noon);
    null in polar day and night, where there is no sunrise.
    """
    turn = (F.dayofyear(_days(ms)) - 1) * F.lit(2 * 3.141592653589793 / 365)

    def sun(g: Column) -> Column:
        equation = 229.18 * (
            0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g)
        )
        tilt = (
            0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g)
            - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
        )
        phi = F.radians(lat)
        return F.struct(
            equation.alias("equation"),
            (F.cos(F.radians(F.lit(90.833))) / (F.cos(phi) * F.cos(tilt)) - F.tan(phi) * F.tan(tilt)).alias("cosine"),
        )

    # bound to a name, so that the plan holds each part once
    place = F.get(F.transform(F.array(turn), sun), 0)
    equation, cosine = place["equation"], place["cosine"]
    angle = F.when(F.abs(cosine) <= 1, F.degrees(F.acos(cosine)))
    minute = F.pmod(ms, F.lit(DAY_MS)) / 60000.0
    return minute.between(720 - 4 * (lon + angle) - equation, 720 - 4 * (lon - angle) - equation)
