"""Restartable work: results appended once, new images joined to stored ones as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.pairing import angle_ok, pending


def append_pending(
    pairs: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], done: DataFrame | None = None
):
    """Start a query that works on streamed pairs (id_left, id_right) not done before, and appends to a Parquet table.

    A batch writes a folder of its own number, so a repeated batch replaces itself: a row is
    appended once, although a batch may run twice. Available input only; ends by itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        key = F.struct(F.least("id_left", "id_right"), F.greatest("id_left", "id_right"))
        todo = rows.withColumn("__key", key).dropDuplicates(["__key"]).drop("__key")
        for before in (done, _finished(spark, path, number)):
            if before is not None:
                todo = pending(todo, before)
        work(todo).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _finished(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """Pairs of earlier batches; None before the first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    try:
        table = spark.read.parquet(path)
    except Exception as e:  # a folder without any file yet
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return table.where(F.col("batch") < number).select("id_left", "id_right")


def stream_near_stored(
    arriving: DataFrame, stored: DataFrame, mean_lat: float, most_m: float = 2.5, most_angle: float | None = None
) -> DataFrame:
    """(l, r): arriving images (a stream) with stored ones at most `most_m` metres away, by the same grid as the batch join.

    The projection's latitude is given, because a stream has no mean.
    """
    scale = 3.141592653589793 / 180 * geo.EARTH_RADIUS_M

    def cells(images: DataFrame) -> DataFrame:
        row = F.struct(*images.columns)
        placed = images.select(
            row.alias("row"), (F.col("lon") * scale * F.cos(F.radians(F.lit(mean_lat)))).alias("x"), (F.col("lat") * scale).alias("y")
        )
        return placed.withColumns({"cx": F.floor(F.col("x") / most_m), "cy": F.floor(F.col("y") / most_m)})

    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    new = cells(arriving).withColumnsRenamed({"row": "l", "x": "x1", "y": "y1"})
    old = cells(stored).select(F.col("row").alias("r"), "x", "y", "cx", "cy", F.explode(near).alias("s"))
    old = old.select("r", "x", "y", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    met = new.join(old, ["cx", "cy"]).where((F.sqrt(dx * dx + dy * dy) <= most_m) & (F.col("l.id") != F.col("r.id")))
    return met.select("l", "r").where(angle_ok(most_angle))
