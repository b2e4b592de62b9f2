"""The engine's functions for SQL: native SQL functions, aggregates over a pair's matches and one table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import geo

_SQL = {
    "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": (
        f"2 * {geo.EARTH_RADIUS_M}D * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"
    ),
    "angle_diff(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "least(abs(a - b) % 360, 360 - abs(a - b) % 360)",
    "circular_distance(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "abs(pmod(a - b + 180, 360D) - 180)",
    "season(month INT) RETURNS STRING": (
        "CASE WHEN month IN (3, 4, 5) THEN 'spring' WHEN month IN (6, 7, 8) THEN 'summer' "
        "WHEN month IN (9, 10, 11) THEN 'autumn' WHEN month IS NOT NULL THEN 'winter' END"
    ),
    "capture_year(ms BIGINT) RETURNS INT": "year(date_add(DATE '1970-01-01', CAST(floor(ms / 86400000) AS INT)))",
}


def register(spark: SparkSession, height: int = 512, width: int = 1024) -> None:
    """Make the functions known to a session: scalar ones, tiles_of(wkt), and the aggregates hull_coverage(x, y),
    hull_iou(lx, ly, rx, ry) and homography_inliers(lx, ly, rx, ry)."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    def coverage(x: pd.Series, y: pd.Series) -> float:
        from ..operators.raster import hull_coverage

        return hull_coverage(pd.concat([x, y], axis=1).to_numpy(float), height, width)

    def overlap(lx: pd.Series, ly: pd.Series, rx: pd.Series, ry: pd.Series) -> float:
        from ..operators.raster import hull_iou

        left, right = (pd.concat(side, axis=1).to_numpy(float) for side in ([lx, ly], [rx, ry]))
        return float(hull_iou(left, right, height, width))

    def inliers(lx: pd.Series, ly: pd.Series, rx: pd.Series, ry: pd.Series) -> int:
        from ..operators.raster import homography_support

        # the sample must not depend on the order of arrival
        rows = pd.concat([lx, ly, rx, ry], axis=1, keys=["lx", "ly", "rx", "ry"]).sort_values(["lx", "ly", "rx", "ry"])
        return homography_support(rows[["lx", "ly"]].to_numpy(float), rows[["rx", "ry"]].to_numpy(float))[0]

    for name, function, kind in (("hull_coverage", coverage, "double"), ("hull_iou", overlap, "double"), ("homography_inliers", inliers, "long")):
        spark.udf.register(name, F.pandas_udf(function, kind))

    class Tiles:
        def eval(self, wkt: str):
            x0, x1, y0, y1 = geo.tile_range(wkt)
            for x in range(x0, x1 + 1):
                for y in range(y0, y1 + 1):
                    yield geo.TILE_ZOOM, x, y

    spark.udtf.register("tiles_of", F.udtf(Tiles, returnType="tile_z int, tile_x int, tile_y int"))
