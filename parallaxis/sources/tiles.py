"""A data source of image metadata by map tile, one input partition per tile, with a fetcher of choice.

    spark.dataSource.register(TileSource)
    spark.read.format("image_tiles").option("wkt", "POLYGON((...))").option("fetch", "package.module:function").load()

The fetcher gets (z, x, y) and yields dicts with the schema's names, or gives the bytes of a
vector tile, whose points in option "layer" are decoded; networks, files and fixtures are
all the same to the engine. Options delay, retries and wait pace the fetcher.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geo
from .vector_tiles import points

FIELDS = ("id", "lat", "lon", "compass_angle", "is_pano", "captured_at", "tile_z", "tile_x", "tile_y")


def with_backoff(get: Callable[[], object], delay: float = 0.1, retries: int = 5, wait: float = 60.0, sleep=time.sleep):
    """get() after a fixed delay; while its answer has status_code 429, wait and try again, at most `retries` times."""
    for attempt in range(retries + 1):
        sleep(delay)
        answer = get()
        if getattr(answer, "status_code", None) != 429 or attempt == retries:
            return answer
        sleep(wait)


class _Tile(InputPartition):
    def __init__(self, z: int, x: int, y: int):
        super().__init__((z, x, y))
        self.z, self.x, self.y = z, x, y


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.zoom = int(options.get("zoom", geo.TILE_ZOOM))
        self.range = geo.tile_range(options["wkt"], self.zoom)
        self.fetch, self.layer = options["fetch"], options.get("layer", "image")
        self.pace = (float(options.get("delay", 0)), int(options.get("retries", 5)), float(options.get("wait", 60)))

    def partitions(self) -> list[InputPartition]:
        x0, x1, y0, y1 = self.range
        return [_Tile(self.zoom, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]

    def read(self, partition: _Tile) -> Iterator[tuple]:
        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        where = (partition.z, partition.x, partition.y)
        answer = with_backoff(lambda: fetch(*where), *self.pace)
        answer = getattr(answer, "content", answer)
        for row in points(answer, *where, self.layer) if isinstance(answer, bytes) else answer:
            row = {**row, **dict(zip(("tile_z", "tile_x", "tile_y"), where, strict=True))}
            if row.get("id") is not None:
                row["id"] = str(row["id"])
            yield tuple(row.get(f) for f in FIELDS)


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_tiles"

    def schema(self) -> str:
        return (
            "id string, lat double, lon double, compass_angle double, is_pano boolean, captured_at long, "
            "tile_z int, tile_x int, tile_y int"
        )

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)
