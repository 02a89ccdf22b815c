"""From masks to corners: boundary, rough quad, exterior points, robust refit, and a template where that fails."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.files import written
from .fitting import extremes, quad_fit
from .labelling import largest_component_boundary, mask_runs

#: Errors of ``mask_to_quad`` and ``with_fallback``, in the order in which they are sought.
NO_MASK, FEW_POINTS, DEGENERATE, DEVIATION = "no mask", "not enough contour points", "degenerate contour", "deviation"
POINT = "struct<x:double,y:double>"


def corners_by_angle(v: Column) -> Column:
    """The corners of a quad in order of their angle about their mean, then by x and y."""
    cx, cy = sum(v[i]["x"] for i in range(4)) / 4.0, sum(v[i]["y"] for i in range(4)) / 4.0
    told = F.array_sort(F.array(*[F.struct(F.atan2(v[i]["y"] - cy, v[i]["x"] - cx).alias("angle"), v[i]["x"].alias("x"), v[i]["y"].alias("y")) for i in range(4)]))
    return F.transform(told, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def rough_quads(points: DataFrame) -> DataFrame:
    """(group_id, v, flat): the four extreme points of each group in order of angle; ``flat`` if all points lie on one line."""
    ends = extremes(points)
    cross = lambda k: (F.col("p2.x") - F.col("p1.x")) * (F.col(f"{k}.y") - F.col("p1.y")) - (F.col("p2.y") - F.col("p1.y")) * (F.col(f"{k}.x") - F.col("p1.x"))
    ends = ends.select("group_id", F.array("p1", "p2", "p3", "p4").alias("p"), ((cross("p3") == 0) & (cross("p4") == 0)).alias("flat"))
    return ends.select("group_id", corners_by_angle(F.col("p")).alias("v"), "flat")


def exterior_points(points: DataFrame, quads: DataFrame, shrink: float = 0.03) -> DataFrame:
    """The points (group_id, pid, x, y) that do not lie in their group's quad (group_id, v) shrunken by the share ``shrink``."""
    inner = quads.select("group_id", X.shrink_quad(F.col("v"), shrink).alias("inner"))
    return points.join(inner, "group_id").filter(~X.inside_quad(F.col("x"), F.col("y"), F.col("inner"))).select("group_id", "pid", "x", "y")


def largest_runs(masks: DataFrame) -> DataFrame:
    """(image_id, y, x0, x1): maximal runs of each image's mask of most cells; ties to the smaller mask_id."""
    runs = written(mask_runs(masks, ["mask_id"]), "mask-runs")
    size = runs.groupBy("image_id", "mask_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))
    best = size.groupBy("image_id").agg((-F.max(F.struct("n", (-F.col("mask_id")).alias("minus")))["minus"]).alias("mask_id"))
    return runs.join(best, ["image_id", "mask_id"]).select("image_id", "y", "x0", "x1")


def mask_to_quad(cells: DataFrame, seed: int = 42, shrink: float = 0.03, least: int = 8, **limits) -> DataFrame:
    """(image_id, v, n_exterior, error): the quad of each image's mask (image_id, y, x), or its maximal runs (image_id, y, x0, x1).

    The boundary of the largest component gives four extreme points, the rough quad. The boundary points outside the
    rough quad shrunken by ``shrink`` are fitted by four robust lines that start at its sides (``quad_fit``, to which
    ``limits`` go); with fewer than four of them the rough corners stay. Where a mask cannot be fitted ``v`` is null and
    ``error`` says why: fewer than ``least`` boundary cells, or all of them on one line. Images without cells have no row.
    """
    edge = written(largest_component_boundary(cells, least), "boundary")
    few = edge.filter("not enough").select("image_id").distinct().withColumn("error", F.lit(FEW_POINTS))
    points = edge.filter("enough").select(F.col("image_id").alias("group_id"), (F.col("y").cast("long") * (1 << 32) + F.col("x")).alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rough = written(rough_quads(points), "rough-quads")
    usable = rough.filter("not flat").select("group_id", "v")
    outside = written(exterior_points(points, usable, shrink), "exterior")
    counts = outside.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_exterior"))
    start = usable.join(counts.filter("n_exterior >= 4"), "group_id", "left_semi")
    fitted = quad_fit(outside.join(start.select("group_id"), "group_id", "left_semi"), start, seed, **limits).select("group_id", F.array("tl", "tr", "br", "bl").alias("fit"))
    quad = rough.join(counts, "group_id", "left").join(fitted, "group_id", "left")
    none = F.lit(None).cast(f"array<{POINT}>")
    quad = quad.select(F.col("group_id").alias("image_id"), F.when(F.col("flat"), none).otherwise(F.coalesce(F.col("fit").cast(f"array<{POINT}>"), F.col("v").cast(f"array<{POINT}>"))).alias("v"), F.coalesce("n_exterior", F.lit(0)).cast("long").alias("n_exterior"), F.when(F.col("flat"), DEGENERATE).alias("error"))
    return quad.unionByName(few.select("image_id", none.alias("v"), F.lit(0).cast("long").alias("n_exterior"), "error"))


def with_fallback(fits: DataFrame, images: DataFrame, template: list[tuple[float, float]], limit: float = 150.0) -> DataFrame:
    """(image_id, v, fallback, error, max_dev): each image's fitted quad, or the template where there is none or it is too far off.

    ``fits`` as ``mask_to_quad`` gives them, at most one row for each image; ``images`` lists all images (image_id).
    ``max_dev`` is the largest distance of a fitted corner from its corner of the template, null without a fit.
    """
    dev = X.corner_deviation(F.col("v"), template)[0]
    rows = images.select("image_id").distinct().join(fits.select("image_id", "v", "error", F.lit(True).alias("found")), "image_id", "left").withColumn("max_dev", F.when(F.col("v").isNotNull(), dev))
    error = F.coalesce(F.when(F.col("found").isNull(), NO_MASK), "error", F.when(F.col("max_dev") > limit, DEVIATION))
    fixed = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in template])
    rows = rows.withColumn("error", error)
    return rows.select("image_id", F.when(F.col("error").isNull(), F.col("v")).otherwise(fixed).alias("v"), F.col("error").isNotNull().alias("fallback"), "error", "max_dev")


def image_area(masks: DataFrame, images: DataFrame, template: list[tuple[float, float]], limit: float = 150.0, **options) -> DataFrame:
    """The whole way for masks (image_id, mask_id, y, x): the largest mask of each image, its quad, or the template."""
    return with_fallback(mask_to_quad(largest_runs(masks), **options), images, template, limit)


def points_in_quads(points: DataFrame, quads: DataFrame, cell: float = 64.0) -> DataFrame:
    """The columns of ``points`` (group_id, x, y, ...) with quad_id, once for each convex quad (group_id, quad_id, v) of their group that holds them, edges included.

    A quad goes to every square of a grid of ``cell`` that its bounding box meets, a point to one, so points meet only
    the quads near them; choose ``cell`` about as large as the quads. Points and quads with null coordinates meet none.
    """
    square = lambda c: F.floor(c / cell).cast("long")
    side = lambda fn, z: fn(*[F.col("v")[i][z] for i in range(4)])
    span = lambda z: F.sequence(square(side(F.least, z)), square(side(F.greatest, z)))
    whole = F.forall("v", lambda p: p["x"].isNotNull() & p["y"].isNotNull()) & (F.size("v") == 4)
    near = quads.filter(whole).select("group_id", "quad_id", "v", F.explode(span("x")).alias("gx")).select("*", F.explode(span("y")).alias("gy"))
    own = points.filter("x is not null and y is not null").withColumns({"gx": square(F.col("x")), "gy": square(F.col("y"))})
    return own.join(near, ["group_id", "gx", "gy"]).filter(X.inside_quad(F.col("x"), F.col("y"), F.col("v"))).select(*points.columns, "quad_id")


def _crosses(v: np.ndarray, x: np.ndarray, y: np.ndarray):
    """The four cross products of ``inside_quad``, for quads v (x0, y0, ... y3 along the last axis) and points that broadcast with them."""
    for i in range(0, 8, 2):
        j = (i + 2) % 8
        ex, ey = v[..., j] - v[..., i], v[..., j + 1] - v[..., i + 1]
        yield ex, ey, ex * (y - v[..., i + 1]) - ey * (x - v[..., i])


def _count_block(x: np.ndarray, y: np.ndarray, n: np.ndarray, total: np.ndarray, quads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each convex quad the sums of ``n`` and of ``total`` over the points in it.

    Points are sorted into at most 64 x 64 squares. Squares that lie in a quad by more than rounding could change count as a
    whole, those that lie out of it not at all; only points of the others, along its sides, are compared with it.
    """
    fine = int(min(64, max(1, np.sqrt(len(x)))))
    low, size = np.array([x.min(), y.min()]), np.maximum(np.array([np.ptp(x), np.ptp(y)]) / fine, 1e-9)
    at = [np.minimum(((z - lo) / s).astype(np.int64), fine - 1) for z, lo, s in zip((x, y), low, size)]
    square, own = np.unique(at[0] * fine + at[1], return_inverse=True)
    order = np.argsort(own, kind="stable")
    x, y, n, total, own = x[order], y[order], n[order], total[order], own[order]
    first = np.searchsorted(own, np.arange(len(square) + 1))
    # what a square's points span, not the square itself
    span = [(f.reduceat(z, first[:-1])) for z in (x, y) for f in (np.minimum, np.maximum)]
    cx, hx, cy, hy = (span[0] + span[1]) / 2, (span[1] - span[0]) / 2, (span[2] + span[3]) / 2, (span[3] - span[2]) / 2
    sums = np.stack([np.add.reduceat(n, first[:-1]), np.add.reduceat(total, first[:-1])], 1)
    out = np.zeros((len(quads), 2), np.int64)
    step = max(1, (1 << 20) // len(square))
    for s in range(0, len(quads), step):
        v = quads[s : s + step, None, :]
        least, most, least_in, most_in = np.full((4, v.shape[0], len(square)), np.inf)
        for ex, ey, mid in _crosses(v, cx, cy):
            reach = np.abs(ex) * hy + np.abs(ey) * hx
            slack = 1e-9 * (reach + np.abs(mid) + (np.abs(ex) + np.abs(ey)) * (1 + np.abs(v).max(-1)))
            np.minimum(least_in, mid - reach - slack, out=least_in)  # all points are on the left of all sides if this is positive
            np.minimum(most_in, -mid - reach - slack, out=most_in)
            np.minimum(least, mid + reach + slack, out=least)  # none is in a quad that turns left if this is negative
            np.minimum(most, -mid + reach + slack, out=most)
        whole = (least_in > 0) | (most_in > 0)
        out[s : s + step] += whole.astype(np.int64) @ sums
        some_quad, some_square = np.nonzero(~whole & ((least >= 0) | (most >= 0)))
        counts = first[some_square + 1] - first[some_square]
        ends = np.cumsum(counts)
        for a in range(0, len(counts), 1 << 14):
            b = min(len(counts), a + (1 << 14))
            many = counts[a:b]
            pair = np.repeat(np.arange(a, b), many)
            point = np.arange(len(pair)) - np.repeat(ends[a:b] - many - (ends[a] - many[0]), many) + first[some_square[pair]]
            cross = np.stack([c for _, _, c in _crosses(quads[s + some_quad[pair]], x[point], y[point])])
            hit = (cross.min(0) >= 0) | (cross.max(0) <= 0)
            np.add.at(out, s + some_quad[pair[hit]], np.stack([n[point[hit]], total[point[hit]]], 1))
    return out[:, 0], out[:, 1]


def count_in_quads(points: DataFrame, quads: DataFrame, value: str, cell: float = 64.0, size: int = 1 << 16) -> DataFrame:
    """(group_id, quad_id, n, total): how many points each convex quad holds, as ``points_in_quads`` finds them, and the sum of their whole numbers ``value``; quads that hold none have no row.

    Pairs are not made. Equal points are one with a count. Points and quads of a square of the grid meet in blocks of about
    ``size`` each, and counts of blocks add up, so a task holds one block of either however many share a square.
    Within a block most points are counted by small squares that lie in a quad as a whole (``_count_block``).
    """
    tile, sides = ["group_id", "gx", "gy"], [f"{z}{i}" for i in range(4) for z in "xy"]
    square = lambda c: F.floor(c / cell).cast("long")
    span = lambda z: F.sequence(square(F.least(*[F.col(f"{z}{i}") for i in range(4)])), square(F.greatest(*[F.col(f"{z}{i}") for i in range(4)])))
    whole = quads.filter(F.size("v") == 4).select("group_id", "quad_id", *[F.col("v")[int(c[1])][c[0]].cast("double").alias(c) for c in sides]).dropna()
    near = whole.select("*", F.explode(span("x")).alias("gx")).select("*", F.explode(span("y")).alias("gy"))
    own = points.select("group_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(value).cast("long").alias("value")).dropna(subset=["group_id", "x", "y"])
    own = own.groupBy("group_id", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0)).alias("total")).withColumns({"gx": square(F.col("x")), "gy": square(F.col("y"))})
    share = lambda df, name: df.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    blocks = share(own, "ps").join(share(near, "qs"), tile)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = own.join(blocks, tile).withColumn("p", F.pmod(F.xxhash64("x", "y"), "ps").cast("int")).withColumn("q", every("qs"))
    near = near.join(blocks, tile).withColumn("q", F.pmod(F.xxhash64("quad_id"), "qs").cast("int")).withColumn("p", every("ps"))
    keys = {c: quads.schema[c].dataType.simpleString() for c in ("group_id", "quad_id")}

    def count(pts, qs):
        if not len(pts) or not len(qs):
            return pd.DataFrame({"group_id": [], "quad_id": [], "n": [], "total": []})
        n, total = _count_block(*(pts[c].to_numpy() for c in ("x", "y", "n", "total")), qs[sides].to_numpy())
        some = n > 0
        return pd.DataFrame({"group_id": qs["group_id"][some], "quad_id": qs["quad_id"][some], "n": n[some], "total": total[some]})

    own = own.select(*tile, "p", "q", "x", "y", "n", "total").groupBy(*tile, "p", "q")
    near = near.select(*tile, "p", "q", "quad_id", *sides).groupBy(*tile, "p", "q")
    parts = own.cogroup(near).applyInPandas(count, f"group_id {keys['group_id']}, quad_id {keys['quad_id']}, n long, total long")
    return parts.groupBy("group_id", "quad_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
