"""Rasters as tiles: one row holds a square of pixels as bytes, and operators that need neighbours exchange borders.

A tile is (image_id, band, ty, tx, h, w, data): ``data`` are h * w numbers, row by row, as little-endian doubles, of the
pixels from (ty * size, tx * size) on. Tiles at the right and lower border may be smaller. Pixels that are missing are NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = "image_id {key}, band string, ty int, tx int, h int, w int, data binary"
COLUMNS = ["image_id", "band", "ty", "tx", "h", "w", "data"]


def _schema(df: DataFrame) -> str:
    return TILE.format(key=df.schema["image_id"].dataType.simpleString())


def _array(data: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(h, w)


def cut(a: np.ndarray, size: int):
    """(ty, tx, part) of an array."""
    for ty in range(-(-a.shape[0] // size)):
        for tx in range(-(-a.shape[1] // size)):
            yield ty, tx, a[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size]


def tile_pixels(px: DataFrame, bands: list[str], size: int = 64) -> DataFrame:
    """Tiles of pixels (image_id, y, x, bands); of pixels given twice one stays, null values are NaN."""

    def pack(key, pdf):
        image, ty, tx = key
        y, x = pdf["y"].to_numpy() - ty * size, pdf["x"].to_numpy() - tx * size
        rows = []
        for band in bands:
            a = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan)
            a[y, x] = pdf[band].to_numpy(float, na_value=np.nan)
            rows.append((image, band, ty, tx, *a.shape, a.astype("<f8").tobytes()))
        return pd.DataFrame(rows, columns=COLUMNS)

    at = lambda c: F.floor(F.col(c) / size).cast("int")
    own = px.select("image_id", "y", "x", *bands).dropna(subset=["image_id", "y", "x"])
    return own.withColumns({"ty": at("y"), "tx": at("x")}).groupBy("image_id", "ty", "tx").applyInPandas(pack, _schema(px))


def tile_values(tiles: DataFrame, size: int = 64) -> DataFrame:
    """(image_id, band, y, x, value): one row for each pixel of the tiles that is not missing."""

    def unpack(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a = _array(r.data, r.h, r.w)
                y, x = np.nonzero(~np.isnan(a))
                yield pd.DataFrame({"image_id": r.image_id, "band": r.band, "y": (y + r.ty * size).astype("int32"), "x": (x + r.tx * size).astype("int32"), "value": a[y, x]})

    key = tiles.schema["image_id"].dataType.simpleString()
    return tiles.mapInPandas(unpack, f"image_id {key}, band string, y int, x int, value double")


def map_tiles(tiles: DataFrame, fn: Callable[[np.ndarray], np.ndarray], halo: int, height: int, width: int, size: int = 64) -> DataFrame:
    """Tiles of fn(a), where a is a tile with ``halo`` more pixels on every side and fn gives back the inner part.

    Each tile sends its neighbours the strips of it that their halos hold, so what is shuffled is the tiles and their
    borders, and a task holds one tile of fixed size at a time. Beyond the border of the image (``height``, ``width``)
    pixels are mirrored, the edge pixel repeated.
    """
    reach, schema = math.ceil(halo / size), _schema(tiles)

    def send(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a = _array(r.data, r.h, r.w)
                for ty in range(max(0, r.ty - reach), min((height - 1) // size, r.ty + reach) + 1):
                    for tx in range(max(0, r.tx - reach), min((width - 1) // size, r.tx + reach) + 1):
                        top, left = max(ty * size - halo, r.ty * size), max(tx * size - halo, r.tx * size)
                        part = a[top - r.ty * size : max(0, (ty + 1) * size + halo - r.ty * size), left - r.tx * size : max(0, (tx + 1) * size + halo - r.tx * size)]
                        if part.size:
                            rows.append((r.image_id, r.band, ty, tx, top, left, *part.shape, part.tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "band", "ty", "tx", "top", "left", "h", "w", "data"])

    def work(key, pdf):
        image, band, ty, tx = key
        y0, x0, y1, x1 = ty * size, tx * size, min((ty + 1) * size, height), min((tx + 1) * size, width)
        top, left, bottom, right = max(0, y0 - halo), max(0, x0 - halo), min(height, y1 + halo), min(width, x1 + halo)
        a = np.full((bottom - top, right - left), np.nan)
        for r in pdf.itertuples():
            a[r.top - top : r.top - top + r.h, r.left - left : r.left - left + r.w] = _array(r.data, r.h, r.w)
        a = np.pad(a, ((halo - (y0 - top), halo - (bottom - y1)), (halo - (x0 - left), halo - (right - x1))), mode="symmetric")
        out = np.ascontiguousarray(fn(a), "<f8")
        return pd.DataFrame([(image, band, ty, tx, *out.shape, out.tobytes())], columns=COLUMNS)

    key = tiles.schema["image_id"].dataType.simpleString()
    strips = tiles.mapInPandas(send, f"image_id {key}, band string, ty int, tx int, top int, left int, h int, w int, data binary")
    return strips.groupBy("image_id", "band", "ty", "tx").applyInPandas(work, schema)


def gaussian(sigma: float) -> tuple[int, np.ndarray]:
    """(reach, weights) of a kernel that reaches four deviations."""
    r = max(1, round(4 * sigma))
    w = np.array([math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)])
    return r, w / w.sum()


def blur_tiles(tiles: DataFrame, sigma: float, height: int, width: int, size: int = 64) -> DataFrame:
    """Gaussian blur as ``rasters.blur``, on tiles: missing pixels add nothing and stay missing."""
    r, weights = gaussian(sigma)

    def both(a):
        h, w = a.shape[0] - 2 * r, a.shape[1] - 2 * r
        gone, a = np.isnan(a), np.nan_to_num(a)
        rows = sum(k * a[:, i : i + w] for i, k in enumerate(weights))
        rows[gone[:, r : r + w]] = 0
        return np.where(gone[r : r + h, r : r + w], np.nan, sum(k * rows[i : i + h] for i, k in enumerate(weights)))

    return map_tiles(tiles, both, r, height, width, size)


def dilate_tiles(tiles: DataFrame, offsets: list[tuple[int, int]], height: int, width: int, size: int = 64) -> DataFrame:
    """Largest value within the kernel of ``offsets`` (dy, dx): dilation of a mask of 0 and 1. Missing pixels count as the smallest value."""
    r = max(max(abs(dy), abs(dx)) for dy, dx in offsets)

    def spread(a):
        h, w = a.shape[0] - 2 * r, a.shape[1] - 2 * r
        a = np.nan_to_num(a, nan=-np.inf)
        out = np.full((h, w), -np.inf)
        for dy, dx in offsets:
            np.maximum(out, a[r - dy : r - dy + h, r - dx : r - dx + w], out=out)
        return np.where(np.isinf(out), np.nan, out)

    return map_tiles(tiles, spread, r, height, width, size)
