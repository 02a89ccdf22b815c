"""Connected components of masks (8 neighbours) and the boundary of the largest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written
from .runs import run_edges

CELL = ["image_id", "y", "x"]


def mask_runs(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, image_id, y, x0, x1): maximal half-open runs of a row's cells; where masks share an image, ``by`` names the columns that tell them apart.

    Cells first become bits, 32 places in one number, which combine map-side; what is shuffled and sorted grows with runs.
    """
    keys, kind = [*(by or []), "image_id", "y"], cells.schema["x"].dataType
    word = F.floor(F.col("x") / 32).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("x") - word * 32).cast("int"))
    words = cells.select(*keys, "x").dropna().groupBy(*keys, word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    # ones from a place on that has none before it: as many as adding one to them carries over
    rest = F.call_function("shiftright", F.col("bits"), F.col("s"))
    starts = words.select("*", F.explode(F.array(*[F.lit(i) for i in range(32)])).alias("s")).withColumn("rest", rest)
    starts = starts.filter((F.col("rest").bitwiseAND(F.lit(1).cast("long")) == 1) & ((F.col("s") == 0) | (F.call_function("shiftright", F.col("bits"), F.greatest(F.col("s") - 1, F.lit(0))).bitwiseAND(F.lit(1).cast("long")) == 0)))
    x0 = F.col("word") * 32 + F.col("s")
    pieces = starts.select(*keys, x0.alias("x0"), (x0 + F.bit_count(F.col("rest").bitwiseAND(F.bitwise_not(F.col("rest") + 1)))).alias("x1"))
    along = Window.partitionBy(*keys).orderBy("x0")
    edge = pieces.withColumn("new", (F.coalesce(F.lag("x1").over(along) != F.col("x0"), F.lit(True))).cast("int"))
    whole = edge.withColumn("k", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "k").agg(F.min("x0").cast(kind).alias("x0"), F.max("x1").cast(kind).alias("x1"))
    return whole.select(*keys, "x0", "x1")


def label_runs(cells: DataFrame) -> DataFrame:
    """(image_id, y, x0, x1, label): runs with their component's smallest (y, x0), as one number y * 2**32 + x0. ``cells`` may be given as maximal runs.

    Rows are joined as runs, not cells: two runs of neighbouring rows touch if they overlap or meet at a corner. Then
    large-star and small-star steps, of which a logarithmic number suffices, whatever the shapes.
    """
    runs = cells.select("image_id", "y", "x0", "x1") if "x0" in cells.columns else mask_runs(cells)
    runs = written(runs.withColumn("node", F.col("y").cast("long") * (1 << 32) + F.col("x0")), "labels")
    below = runs.select("image_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("node").alias("u"))
    touch = runs.join(below, ["image_id", "y"]).filter((F.col("x0") <= F.col("b1")) & (F.col("b0") <= F.col("x1")))
    e = written(touch.select("image_id", "u", F.col("node").alias("v")), "labels")
    last = None
    while True:
        both = e.unionByName(e.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("image_id", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, ["image_id", "u"]).select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("image_id", "u").agg(F.min("v").alias("m"))
        rest = large.join(low, ["image_id", "u"]).filter("v <> m").select("image_id", F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(low.withColumnRenamed("m", "v").unionByName(rest).filter("u <> v").distinct(), "labels")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last = now
    root = e.groupBy("image_id", F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return runs.join(root, ["image_id", "node"], "left").select("image_id", "y", "x0", "x1", F.coalesce("label", "node").alias("label"))


def largest_component_boundary(cells: DataFrame, least: int = 8) -> DataFrame:
    """(image_id, y, x, enough): cells of the largest component (by cells; ties to the first label) that lack one of four neighbours. ``cells`` may be given as maximal runs.

    ``enough`` is false where the boundary has fewer than ``least`` cells: too few to fit a quad.
    """
    runs = label_runs(cells)
    size = runs.groupBy("image_id", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))
    best = size.groupBy("image_id").agg(F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("b")).select("image_id", (-F.col("b.minus")).alias("label"))
    kind = runs.schema["x0"].dataType
    edge = run_edges(written(runs.join(best, ["image_id", "label"]).select("image_id", "y", "x0", "x1"), "largest")).select("image_id", "y", F.explode(F.sequence(F.col("x0").cast(kind), F.col("x1").cast(kind) - 1)).alias("x"))
    count = edge.groupBy("image_id").agg((F.count(F.lit(1)) >= least).alias("enough"))
    return edge.join(count, "image_id")


def edge_cells(cells: DataFrame) -> DataFrame:
    """(image_id, y, x, own): cells that lack one of four neighbours (own) and the neighbours that are missing (not own)."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    told = cells.select(*CELL).distinct().select("*", F.explode(steps).alias("o"))
    told = told.select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), ((F.col("o.dy") == 0) & (F.col("o.dx") == 0)).alias("self"))
    return told.groupBy(*CELL).agg(F.max("self").alias("own"), F.count(F.lit(1)).alias("n")).filter("not own or n < 5").drop("n")
