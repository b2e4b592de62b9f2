"""Connected components of an edge table by alternating stars; nothing passes through the driver but a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, label): label is the smallest node that is reachable.

    Each round links the larger neighbours of every node to its smallest neighbour, then the
    smaller ones, until the table is a set of stars. A node's neighbours are never gathered:
    minima are partial sums, and written before rows meet them, so that Spark can split the joins.
    Nulls and loops are ignored.
    """
    stars = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _checksum(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialize(least, "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        discard(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large, stars, least)
        stars, before = new, mark
        mark = _checksum(stars)
        if mark == before:
            break
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres)


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)
