"""Places for learned models: a matcher gives match rows, a segmenter gives masks.

The engine itself has no neural network. The default implementations read tables that
some other run has computed; any function over batches can stand in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Matcher(Protocol):
    def matches(self, pairs: DataFrame) -> DataFrame:
        """pairs(id_left, id_right) to (id_left, id_right, kp, lx, ly, rx, ry)."""


class Segmenter(Protocol):
    def masks(self, images: DataFrame) -> DataFrame:
        """images(id) to (id, height, width, data: one byte a pixel)."""


class TableMatcher:
    def __init__(self, table: DataFrame):
        self.table = table

    def matches(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("id_left", "id_right").join(self.table, ["id_left", "id_right"])


class TableSegmenter:
    def __init__(self, table: DataFrame):
        self.table = table

    def masks(self, images: DataFrame) -> DataFrame:
        return images.select("id").distinct().join(self.table, "id")


class BatchModel:
    """A model loaded once in a Python worker, applied to batches of rows.

    load() runs on the executor at a worker's first batch; predict(model, rows) gives rows of the schema.
    """

    def __init__(self, load: Callable[[], object], predict: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str):
        self.load, self.predict, self.schema = load, predict, schema

    def apply(self, rows: DataFrame) -> DataFrame:
        load, predict = self.load, self.predict

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for batch in batches:
                model = load() if model is None else model
                yield predict(model, batch)

        return rows.mapInPandas(run, self.schema)


def with_stored(wanted: DataFrame, stored: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored rows for the wanted keys, and computed ones for the keys that the store lacks."""
    keyed = wanted.select(*keys).distinct()
    hits = stored.join(keyed, keys, "left_semi")
    misses = wanted.join(stored.select(*keys).distinct(), keys, "left_anti")
    return hits.unionByName(compute(misses).select(*hits.columns))


def sampler_fields(rows: DataFrame, classes: dict[int, str]) -> DataFrame:
    """Columns prop_NNN_label and no_temp_prop_NNN_label from the maps props and no_temp_props."""
    from ..functions.text import safe_label

    spark = rows.sparkSession
    labels = spark.createDataFrame(sorted(classes.items()), "class int, label string").select("class", safe_label(F.col("label")))
    wide = [
        F.coalesce(F.try_element_at(F.col(source), F.lit(k)), F.lit(0.0)).alias(f"{prefix}_{k:03d}_{label}")
        for k, label in labels.collect()
        for prefix, source in (("prop", "props"), ("no_temp_prop", "no_temp_props"))
    ]
    return rows.select(*[c for c in rows.columns if c not in ("props", "no_temp_props")], *wide)
