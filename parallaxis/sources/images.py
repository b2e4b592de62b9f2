"""Image metadata: schema, normalisation, area scan and first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("compass_angle", T.DoubleType()),
        T.StructField("is_pano", T.BooleanType()),
        T.StructField("captured_at", T.LongType()),
        T.StructField("tile_z", T.IntegerType()),
        T.StructField("tile_x", T.IntegerType()),
        T.StructField("tile_y", T.IntegerType()),
    ]
)


def read(spark: SparkSession, path: str, format_: str = "parquet") -> DataFrame:
    """A metadata table, ideally partitioned by tile_z, tile_x, tile_y."""
    reader = spark.read.schema(SCHEMA).option("header", True)
    return normalized(reader.format(format_).load(path))


def normalized(images: DataFrame) -> DataFrame:
    """Ids as text, NaN as null, missing is_pano as false."""
    return images.withColumns(
        {
            "id": F.col("id").cast("string"),
            "compass_angle": F.when(~F.isnan("compass_angle"), F.col("compass_angle")),
            "is_pano": F.coalesce("is_pano", F.lit(False)),
        }
    )


def tiled(images: DataFrame, zoom: int = geo.TILE_ZOOM) -> DataFrame:
    return images.withColumns(
        {"tile_z": F.lit(zoom), "tile_x": geo.tile_x("lon", zoom), "tile_y": geo.tile_y("lat", zoom)}
    )


def of_type(images: DataFrame, image_type: str) -> DataFrame:
    """all, panorama, or flat; a missing flag counts as flat."""
    if image_type == "all":
        return images
    if image_type not in ("panorama", "flat"):
        raise ValueError(f"unknown image type {image_type!r}")
    pano = F.coalesce("is_pano", F.lit(False))
    return images.where(pano if image_type == "panorama" else ~pano)


def first_by_id(images: DataFrame, *order: str) -> DataFrame:
    """One row per id, the first in tile order (then the given columns); blank ids go."""
    named = images.where(F.col("id").isNotNull() & (F.col("id") != ""))
    # partial minima, so that copies of an id do not travel
    first = F.min_by(F.struct(*images.columns), F.struct("tile_z", "tile_x", "tile_y", *order))
    return named.groupBy("id").agg(first.alias("__first")).select("__first.*")


def scan_area(images: DataFrame, wkt: str, image_type: str = "all", zoom: int = geo.TILE_ZOOM) -> DataFrame:
    """Images strictly inside a polygon: tile range (prunes partitions), polygon, type, then deduplication."""
    x0, x1, y0, y1 = geo.tile_range(wkt, zoom)
    inside = images.where(
        (F.col("tile_z") == zoom) & F.col("tile_x").between(x0, x1) & F.col("tile_y").between(y0, y1)
    ).where(geo.within(wkt))
    return first_by_id(of_type(inside, image_type), "lat", "lon")


def tiles(spark: SparkSession, wkt: str, zoom: int = geo.TILE_ZOOM) -> DataFrame:
    """All tiles that a geometry's box touches."""
    x0, x1, y0, y1 = geo.tile_range(wkt, zoom)
    return spark.range(1).select(
        F.lit(zoom).alias("tile_z"), F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias("tile_x")
    ).select("tile_z", "tile_x", F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("tile_y"))
