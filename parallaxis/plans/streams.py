"""Queries that run a stream to the end of its input and give what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairing
from ..sources import scratch
from ..streaming import incremental
from . import fixtures as fx
from .area import _DONE, _IDS, _ids, _pairs


def stream_resume(spark, sf):
    """Pairs arrive as files, some were done before; a sink appends each of the others once."""
    source, sink, checkpoint = (scratch.folder(spark, n) for n in ("pairs", "appended", "checkpoint"))
    # every batch reads what was done, and both deliveries are the same pairs: found once
    pairs = scratch.written(_ids(pairing.area_pairs(fx.images(spark, sf), order="k", distinct=True)), "found")
    pairs.repartition(3).write.parquet(source)
    # the second delivery repeats the first one
    pairs.where("cast(id_left as long) % 2 = 0").repartition(3).write.mode("append").parquet(source)
    done = pairs.where("cast(id_left as long) % 3 = 0").select(F.col("id_right").alias("id_left"), F.col("id_left").alias("id_right"))
    arriving = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 2).parquet(source)
    query = incremental.append_pending(arriving, sink, checkpoint, lambda rows: rows, done)
    query.awaitTermination()
    return spark.read.parquet(sink).select("id_left", "id_right")


def stream_near_stored(spark, sf):
    """New images arrive as files and meet the stored ones on the grid."""
    images = fx.images(spark, sf)
    mean = images.agg(F.avg("lat")).first()[0]
    source, sink, checkpoint = (scratch.folder(spark, n) for n in ("arriving", "met", "checkpoint"))
    images.where("k % 10 = 0").repartition(4).write.parquet(source)
    arriving = spark.readStream.schema(images.schema).option("maxFilesPerTrigger", 2).parquet(source)
    met = incremental.stream_near_stored(arriving, images.where("k % 10 <> 0"), mean, 2.5, 30)
    flat = met.select(F.col("l.id").alias("id_new"), F.col("r.id").alias("id_stored"))
    flat.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


_TURN = "least(abs(l.compass_angle - r.compass_angle) % 360, 360 - abs(l.compass_angle - r.compass_angle) % 360)"

QUERIES = {
    "stream_resume": (stream_resume, f"WITH {_pairs(fx.IMAGES)}, ids AS ({_IDS}) SELECT * FROM ids WHERE NOT ({_DONE})"),
    "stream_near_stored": (
        stream_near_stored,
        f"""WITH {_pairs(fx.IMAGES)}, m AS (SELECT * FROM pairs WHERE l.compass_angle IS NULL OR r.compass_angle IS NULL OR {_TURN} <= 30)
        SELECT l.id AS id_new, r.id AS id_stored FROM m WHERE l.k % 10 = 0 AND r.k % 10 <> 0
        UNION ALL SELECT r.id, l.id FROM m WHERE r.k % 10 = 0 AND l.k % 10 <> 0""",
    ),
}
