"""Masks as half-open runs (image_id, y, x0, x1): set algebra by a sweep over run ends, areas and overlap ratios.

Work and rows follow the number of runs, not of cells. Runs of one mask may overlap, touch or repeat: a place that any of
them covers is set. Runs with x1 <= x0 or a null bound or key cover nothing. Results are maximal runs. Where masks share
an image, ``by`` names the columns that tell them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written

ROW = ["image_id", "y"]


def _sweep(ends: DataFrame, keys: list[str], set_: str) -> DataFrame:
    """Maximal runs of the places where the condition ``set_`` on the depths a and b holds; ``ends`` has keys, x and the steps da, db of both depths."""
    steps = ends.groupBy(*keys, "x").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    along = Window.partitionBy(*keys).orderBy("x")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    state = steps.select(*keys, "x", F.sum("da").over(upto).alias("a"), F.sum("db").over(upto).alias("b")).select(*keys, "x", F.expr(set_).alias("on"))
    edge = state.withColumn("was", F.coalesce(F.lag("on").over(along), F.lit(False))).filter("on <> was")  # from here on and off take turns
    runs = edge.withColumn("x1", F.lead("x").over(along)).filter("on")
    return runs.select(*keys, F.col("x").alias("x0"), "x1")


def _ends(runs: DataFrame, keys: list[str], a: int, b: int) -> DataFrame:
    end = lambda c, s: F.struct(F.col(c).cast("int").alias("x"), F.lit(s * a).alias("da"), F.lit(s * b).alias("db"))
    return runs.filter("x0 < x1").dropna(subset=keys).select(*keys, F.explode(F.array(end("x0", 1), end("x1", -1))).alias("e")).select(*keys, "e.*")


def _dealt(ends: DataFrame, keys: list[str]) -> DataFrame:
    """``ends``, written and counted first, so that the number of tasks of a sweep grows with them and not with their size."""
    ends = written(ends, "ends")
    return ends.repartition(1 + ends.count() // 100_000, *keys)


def _both(a: DataFrame, b: DataFrame, keys: list[str], set_: str) -> DataFrame:
    return _sweep(_dealt(_ends(a, keys, 1, 0).unionByName(_ends(b, keys, 0, 1)), keys), keys, set_)


def normalize_runs(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Maximal runs of each mask."""
    keys = [*(by or []), *ROW]
    return _sweep(_dealt(_ends(runs, keys, 1, 0), keys), keys, "a > 0")


def runs_and(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _both(a, b, [*(by or []), *ROW], "a > 0 AND b > 0")


def runs_or(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _both(a, b, [*(by or []), *ROW], "a > 0 OR b > 0")


def runs_minus(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _both(a, b, [*(by or []), *ROW], "a > 0 AND b <= 0")


def runs_xor(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _both(a, b, [*(by or []), *ROW], "(a > 0) <> (b > 0)")


def runs_not(a: DataFrame, images: DataFrame) -> DataFrame:
    """The rest of each image's grid; ``images`` lists all images (image_id, height, width). Their rows are counted first, so that the number of tasks grows with them."""
    rows_in_all = images.filter("height > 0 and width > 0").agg(F.sum(F.col("height").cast("long"))).first()[0] or 0
    rows = images.filter("height > 0 and width > 0").select("image_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.lit(0).alias("x0"), F.col("width").alias("x1"))
    ends = _ends(rows, ROW, 1, 0).unionByName(_ends(a, ROW, 0, 1))
    return _sweep(ends.repartition(1 + rows_in_all // 100_000, *ROW), ROW, "a > 0 AND b <= 0")


def run_edges(runs: DataFrame) -> DataFrame:
    """Places of one mask for each image that lack one of four neighbours, as runs; ``runs`` are maximal.

    A place has all four if its run goes on to both sides and the rows above and below cover it: three covers.
    ``runs`` are counted first, so that the number of tasks grows with them and not their size; give them as a table.
    """
    step = lambda dy, x, s, a, b: F.struct((F.col("y") + dy).alias("y"), x.cast("int").alias("x"), F.lit(s * a).alias("da"), F.lit(s * b).alias("db"))
    cover = lambda dy, x0, x1, a, b: [step(dy, x0, 1, a, b), step(dy, x1, -1, a, b)]
    x0, x1 = F.col("x0"), F.col("x1")
    inner = cover(0, F.least(x0 + 1, x1), F.greatest(x1 - 1, F.least(x0 + 1, x1)), 0, 1)  # of one place: none
    ends = runs.filter("x0 < x1").dropna(subset=ROW).select("image_id", F.explode(F.array(*cover(0, x0, x1, 1, 0), *inner, *cover(-1, x0, x1, 0, 1), *cover(1, x0, x1, 0, 1))).alias("e"))
    return _sweep(ends.select("image_id", "e.*").repartition(1 + runs.count() // 50_000, *ROW), ROW, "a > 0 AND b < 3")


def run_area(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): places covered."""
    inner = [c for c in by if c not in ROW]
    return normalize_runs(runs, inner).groupBy(*by).agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("n"))


def run_cells(runs: DataFrame) -> DataFrame:
    """One row for each place of maximal runs."""
    keep = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select(*keep, F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))


def run_iou(runs: DataFrame, least: float, tile: int = 64) -> DataFrame:
    """(image_id, a, b, iou) of masks (image_id, mask_id, y, x0, x1) of one image that overlap by a ratio above ``least``.

    Runs are cut at the borders of tiles of ``tile`` places, so runs meet by image, row and tile, and what two masks share
    is summed from pieces. Masks whose sizes alone rule a pair out do not meet.
    """
    own = written(normalize_runs(runs, ["mask_id"]), "runs")
    size = own.groupBy("image_id", "mask_id").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("n"))
    first, last = F.floor(F.col("x0") / tile).cast("int"), F.floor((F.col("x1") - 1) / tile).cast("int")
    cut = own.join(size, ["image_id", "mask_id"]).select("*", F.explode(F.sequence(first, last)).alias("t"))
    cut = cut.select("image_id", "mask_id", "n", "y", "t", F.greatest("x0", F.col("t") * tile).alias("x0"), F.least("x1", (F.col("t") + 1) * tile).alias("x1"))
    a, b = (cut.select("image_id", "y", "t", F.col("mask_id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in ("n", "x0", "x1")]) for k in "ab")
    shared = F.least("x1a", "x1b") - F.greatest("x0a", "x0b")
    meet = a.join(b, ["image_id", "y", "t"]).filter((F.col("a") < F.col("b")) & (F.least("na", "nb") > F.greatest("na", "nb") * least) & (shared > 0))
    both = meet.groupBy("image_id", "a", "b", "na", "nb").agg(F.sum(shared).alias("k"))
    return both.withColumn("iou", F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).filter(F.col("iou") > least).select("image_id", "a", "b", "iou")
