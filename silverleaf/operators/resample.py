"""Perspective resampling and non-local means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def square_to_quad(v: Column) -> dict[str, Column]:
    """Coefficients of the projective map from the unit square to a quad (corners TL, TR, BR, BL), in closed form."""
    x, y = [v[i]["x"] for i in range(4)], [v[i]["y"] for i in range(4)]
    dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
    dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
    den = dx1 * dy2 - dx2 * dy1
    g, h = F.try_divide(sx * dy2 - dx2 * sy, den), F.try_divide(dx1 * sy - sx * dy1, den)
    return {"a": x[1] - x[0] + g * x[1], "b": x[3] - x[0] + h * x[3], "c": x[0], "d": y[1] - y[0] + g * y[1], "e": y[3] - y[0] + h * y[3], "f": y[0], "g": g, "h": h}


def tap_weight(s: Column, kernel: str) -> Column:
    """Weight of a tap at distance ``s``: linear, or cubic with a = -0.75."""
    if kernel == "bilinear":
        return F.greatest(F.lit(0.0), 1.0 - s)
    if kernel == "cubic":
        near, far = (1.25 * s - 2.25) * s * s + 1.0, ((-0.75 * s + 3.75) * s - 6.0) * s + 3.0
        return F.when(s <= 1, near).when(s < 2, far).otherwise(0.0)
    raise ValueError(f"unknown kernel: {kernel}")


def warp(px: DataFrame, quads: DataFrame, channels: list[str], width: int, height: int, kernel: str = "bilinear") -> DataFrame:
    """(image_id, y, x, channels as double, valid): each image's quad (image_id, v) stretched to width x height.

    Every target cell asks for its 2 x 2 (4 x 4) source cells by an equi-join on (image_id, y, x); weighted sums combine
    map-side. Source cells that do not exist count as 0; ``valid``: existing ones carry half of the bilinear weight or more.
    Degenerate quads (null coefficients) give no rows.
    """
    taps = (0, 1) if kernel == "bilinear" else (-1, 0, 1, 2)
    m = quads.select("image_id", *[c.alias(f"m{k}") for k, c in square_to_quad(F.col("v")).items()]).filter("mg is not null and mh is not null")
    grid = m.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    u, w = F.col("tx") / float(width), F.col("ty") / float(height)
    den = F.col("mg") * u + F.col("mh") * w + 1.0
    grid = grid.select("image_id", "ty", "tx", F.try_divide(F.col("ma") * u + F.col("mb") * w + F.col("mc"), den).alias("px"), F.try_divide(F.col("md") * u + F.col("me") * w + F.col("mf"), den).alias("py"))
    grid = grid.withColumn("bx", F.floor("px")).withColumn("by", F.floor("py"))
    list_ = F.array(*map(F.lit, taps))
    grid = grid.withColumn("i", F.explode(list_)).withColumn("j", F.explode(list_))
    off = lambda p, b, k: F.abs(F.col(p) - F.col(b) - F.col(k))
    one = lambda kind: tap_weight(off("py", "by", "i"), kind) * tap_weight(off("px", "bx", "j"), kind)
    ask = grid.select("image_id", "ty", "tx", (F.col("by") + F.col("i")).cast("int").alias("y"), (F.col("bx") + F.col("j")).cast("int").alias("x"), one(kernel).alias("wt"), one("bilinear").alias("cover")).filter("wt <> 0 or cover <> 0")
    hit = ask.join(px.select("image_id", "y", "x", *channels), ["image_id", "y", "x"], "left")
    has = F.col(channels[0]).isNotNull()
    out = hit.groupBy("image_id", "ty", "tx").agg(*[F.sum(F.coalesce(F.col(c) * F.col("wt"), F.lit(0.0))).alias(c) for c in channels], (F.sum(F.when(has, F.col("cover")).otherwise(0.0)) >= 0.5).alias("valid"))
    return out.withColumnsRenamed({"ty": "y", "tx": "x"})


def to_byte(c: Column) -> Column:
    """A channel value to 0..255, halves up."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c)) + 0.5).cast("int")


def non_local_means(px: DataFrame, col: str, h: float, height: int, width: int, template: int = 7, search: int = 21, tile: int = 64) -> DataFrame:
    """(image_id, y, x, ``smooth``): mean of the search window, weighted by exp(-mean squared patch difference / h**2).

    Images are cut into tiles with a halo of (template + search) // 2 cells, mirrored at the image's border (edge cell
    not repeated), so a task holds one tile at a time, of fixed size, and an image of any size spreads over tasks.
    """
    pr, sr = template // 2, search // 2
    halo = pr + sr
    side = tile + 2 * halo

    def spread(c: str, n: int) -> Column:
        at = F.array_distinct(F.array(F.col(c), -F.col(c), F.lit(2 * (n - 1)) - F.col(c)))
        return F.filter(at, lambda t: (t >= -halo) & (t < n + halo))

    def tiles(c: str, n: int) -> Column:
        low = F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0))
        high = F.least(F.floor((F.col(c) + halo) / tile), F.lit((n - 1) // tile))
        return F.sequence(low.cast("int"), high.cast("int"))

    ext = px.select("image_id", F.explode(spread("y", height)).alias("ey"), "x", F.col(col).cast("double").alias("v"))
    ext = ext.select("image_id", "ey", F.explode(spread("x", width)).alias("ex"), "v")
    ext = ext.withColumn("ty", F.explode(tiles("ey", height))).withColumn("tx", F.explode(tiles("ex", width)))

    def smooth(key, pdf):
        image, ty, tx = key
        a = np.zeros((side, side))
        own = np.zeros((side, side), bool)
        y, x = pdf["ey"].to_numpy() - ty * tile + halo, pdf["ex"].to_numpy() - tx * tile + halo
        a[y, x], own[y, x] = pdf["v"].to_numpy(), True
        core = a[sr : side - sr, sr : side - sr]
        total, weight = np.zeros((tile, tile)), np.zeros((tile, tile))
        for dy in range(-sr, sr + 1):
            for dx in range(-sr, sr + 1):
                moved = a[sr + dy : side - sr + dy, sr + dx : side - sr + dx]
                d = np.pad(np.cumsum(np.cumsum((core - moved) ** 2, axis=0), axis=1), ((1, 0), (1, 0)))
                d = (d[template:, template:] - d[:-template, template:] - d[template:, :-template] + d[:-template, :-template]) / template**2
                w = np.exp(-np.maximum(d, 0) / h**2)
                total += w * moved[pr : pr + tile, pr : pr + tile]
                weight += w
        rows, cols = min(tile, height - ty * tile), min(tile, width - tx * tile)
        at = np.argwhere(own[halo : halo + rows, halo : halo + cols])
        return pd.DataFrame({"image_id": image, "y": at[:, 0] + ty * tile, "x": at[:, 1] + tx * tile, "smooth": (total / weight)[at[:, 0], at[:, 1]]})

    return ext.groupBy("image_id", "ty", "tx").applyInPandas(smooth, "image_id long, y int, x int, smooth double")
