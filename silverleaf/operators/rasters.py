"""Rasters as pixel rows (image_id, y, x, channels): blocks, white balance, regions, blur, sharpening."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import apply_gain


def block_stats(px: DataFrame, size: int, stride: int, white: Column, least: float, height: int, width: int) -> DataFrame:
    """Strided blocks whose white share exceeds ``least``: share, channel means and mean variance of white pixels.

    Each pixel is sent to the blocks that cover it, a two-dimensional hopping window; sums combine map-side.
    """

    def starts(c: str, n: int) -> Column:
        low = F.greatest(F.ceil((F.col(c) - (size - 1)) / stride), F.lit(0)).cast("int")
        high = F.least(F.floor(F.col(c) / stride), F.lit((n - size - 1) // stride)).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    hit = px.withColumn("w", white.cast("int")).withColumn("by", F.explode(starts("y", height))).withColumn("bx", F.explode(starts("x", width)))
    on = lambda c: F.when(F.col("w") == 1, F.col(c).cast("double"))
    agg = hit.groupBy("image_id", (F.col("by") * stride).alias("by"), (F.col("bx") * stride).alias("bx")).agg(
        (F.sum("w") / (size * size)).alias("share"), *[F.avg(on(c)).alias(f"mean_{c}") for c in "rgb"], *[F.var_pop(on(c)).alias(f"v{c}") for c in "rgb"])
    return agg.filter(F.col("share") > least).withColumn("var", (F.col("vr") + F.col("vg") + F.col("vb")) / 3.0).drop("vr", "vg", "vb")


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= k)


def white_gains(blocks: DataFrame, images: DataFrame, target: float = 240.0, k: int = 10) -> DataFrame:
    """Per image gains toward ``target`` from its ``k`` calmest blocks, within [0.5, 2]; 1 where there is no block."""
    ref = top_k(blocks, ["image_id"], ["var", "by", "bx"], k).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_blocks"), *[F.avg(f"mean_{c}").alias(f"ref_{c}") for c in "rgb"])
    gain = lambda c: F.coalesce(F.least(F.lit(2.0), F.greatest(F.lit(0.5), target / F.greatest(F.col(f"ref_{c}"), F.lit(1.0)))), F.lit(1.0))
    return images.join(ref, "image_id", "left").select("image_id", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), *[F.coalesce(f"ref_{c}", F.lit(0.0)).alias(f"ref_{c}") for c in "rgb"], *[gain(c).alias(f"gain_{c}") for c in "rgb"])


def balance(px: DataFrame, gains: DataFrame) -> DataFrame:
    """Pixels with gains applied, clipped and truncated. Gains hold one row for each image; the optimiser picks the join."""
    return px.join(gains, "image_id").select("image_id", "y", "x", *[apply_gain(F.col(c), F.col(f"gain_{c}")).alias(c) for c in "rgb"])


def region_stats(px: DataFrame, by: list[str]) -> DataFrame:
    return px.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in "rgb"], *[F.stddev_pop(c).alias(f"std_{c}") for c in "rgb"])


def blur(px: DataFrame, col: str, sigma: float, height: int, width: int) -> DataFrame:
    """Gaussian blur in two passes, borders mirrored with the edge pixel repeated; the kernel reaches four deviations.

    Pixels that are missing from ``px`` add nothing and have no result.
    """
    r = max(1, round(4 * sigma))
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    w = [x / sum(w) for x in w]
    taps = F.array(*[F.struct(F.lit(i - r).alias("d"), F.lit(x).alias("w")) for i, x in enumerate(w)])

    def one(df: DataFrame, axis: str, n: int, value: str) -> DataFrame:
        # a target t takes source mirror(t + d); pixels near a border also reach targets by mirroring
        spread = df.select("*", F.explode(taps).alias("k"))
        at = F.array_distinct(F.array(F.col(axis) - F.col("k.d"), -F.col(axis) - 1 - F.col("k.d"), F.lit(2 * n - 1) - F.col(axis) - F.col("k.d")))
        spread = spread.withColumn("t", F.explode(F.filter(at, lambda t: (t >= 0) & (t < n))))
        src = F.col("t") + F.col("k.d")
        mirrored = F.when(src < 0, -src - 1).when(src > n - 1, 2 * n - 1 - src).otherwise(src)
        spread = spread.filter(mirrored == F.col(axis))
        other = "x" if axis == "y" else "y"
        # a pixel always reaches itself, so targets that no pixel reaches from its own place are missing
        sums = spread.groupBy("image_id", other, F.col("t").alias("at")).agg(F.sum(F.col(value) * F.col("k.w")).alias("v"), F.max(F.col("t") == F.col(axis)).alias("own"))
        return sums.filter("own").select("image_id", other, F.col("at").alias(axis), "v")

    rows = one(px.select("image_id", "y", "x", F.col(col).cast("double").alias("v")), "x", width, "v")
    return one(rows, "y", height, "v").select("image_id", "y", "x", F.col("v").alias("blur"))


def unsharp(px: DataFrame, col: str, height: int, width: int, mode: str = "low", sigma: float = 1.0, amount: float = 0.45, threshold: float = 3.0) -> DataFrame:
    """Adds ``sharp``: the channel plus ``amount`` of its detail where that reaches ``threshold``; mode 'off' leaves the channel as it is."""
    if mode == "off":
        return px.withColumn("sharp", F.col(col))
    if mode != "low":
        raise ValueError(f"unknown mode: {mode}")
    soft = blur(px, col, sigma, height, width)
    detail = F.col(col) - F.col("blur")
    detail = F.when(F.abs(detail) < threshold, 0.0).otherwise(detail)
    return px.join(soft, ["image_id", "y", "x"]).withColumn("sharp", F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(col) + amount * detail))).cast("int"))


def reorient(px: DataFrame, tag: Column, height: int, width: int) -> DataFrame:
    """Undo orientation tags 1 to 8: mirror, turn, transpose."""
    y, x, h, w = F.col("y"), F.col("x"), height - 1, width - 1
    ny = F.when(tag.isin(1, 2), y).when(tag.isin(3, 4), h - y).when(tag.isin(5, 6), x).otherwise(w - x)
    nx = F.when(tag.isin(1, 4), x).when(tag.isin(2, 3), w - x).when(tag.isin(5, 8), y).otherwise(h - y)
    return px.withColumn("ny", ny.cast("int")).withColumn("nx", nx.cast("int")).drop("y", "x").withColumnsRenamed({"ny": "y", "nx": "x"})
