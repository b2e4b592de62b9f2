"""Points of vector tiles (the published protocol-buffer format, version 2): attributes and positions."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: memoryview) -> Iterator[tuple[int, object]]:
    """(field number, value) in order: whole numbers, bytes of lengths 4 and 8, or a length-delimited part."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield number, value


def _packed(data: memoryview) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value)
    return out


def _signed(value: int) -> int:
    """Zigzag: even numbers are positive."""
    return (value >> 1) ^ -(value & 1)


def _value(data: memoryview) -> object:
    for number, raw in _fields(data):
        if number == 1:
            return bytes(raw).decode()
        if number in (2, 3):
            return struct.unpack("<f" if number == 2 else "<d", raw)[0]
        if number == 4:
            return raw - (1 << 64) if raw >> 63 else raw
        if number == 5:
            return raw
        if number == 6:
            return _signed(raw)
        if number == 7:
            return bool(raw)
    return None


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """(west, south, east, north) of a map tile."""

    def lat(row: int) -> float:
        return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / 2**z))))

    return x / 2**z * 360 - 180, lat(y + 1), (x + 1) / 2**z * 360 - 180, lat(y)


def points(data: bytes, z: int, x: int, y: int, layer: str) -> Iterator[dict]:
    """Attributes of each point of a layer with lon and lat, straight from the tile's grid; its id where no attribute is named so."""
    west, south, east, north = tile_bounds(z, x, y)
    for number, part in _fields(memoryview(data)):
        if number != 3:
            continue
        name, extent, keys, values, features = "", 4096, [], [], []
        for field, value in _fields(part):
            if field == 1:
                name = bytes(value).decode()
            elif field == 2:
                features.append(value)
            elif field == 3:
                keys.append(bytes(value).decode())
            elif field == 4:
                values.append(_value(value))
            elif field == 5:
                extent = value
        if name != layer:
            continue
        for feature in features:
            row: dict = {}
            kind, steps = 0, []
            for field, value in _fields(feature):
                if field == 1:
                    row["id"] = value
                elif field == 2:
                    tags = _packed(value)
                    row.update({keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)})
                elif field == 3:
                    kind = value
                elif field == 4:
                    steps = _packed(value)
            if kind != 1 or not steps:
                continue
            px = py = 0
            # one command: move to so many points, each from the one before
            for k in range(1, 1 + 2 * (steps[0] >> 3), 2):
                px, py = px + _signed(steps[k]), py + _signed(steps[k + 1])
                yield {**row, "lon": west + px / extent * (east - west), "lat": north - py / extent * (north - south)}
