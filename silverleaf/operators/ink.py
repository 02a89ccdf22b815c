"""Ink on prints: regions around a quad, outline noise, region statistics of sweep steps, the stopping rule, colours.

Cells are rows (image_id, y, x) with further columns; a cell appears once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import inside_quad
from .masks import dilate, erode

REGIONS = ("border", "image")
CELL = ["image_id", "y", "x"]


def classify_regions(cells: DataFrame, quads: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Adds ``region``: 'image' well inside the image's quad (image_id, v), 'border' well outside, 'exclude' within the band.

    The band is what a round kernel of ``radius`` adds to the quad's cells or takes away. One quad for each image,
    so the join is by key; cells of images without a quad are 'border'. Cells that an image lacks take nothing away.
    """
    inner = cells.select(*CELL).join(quads, "image_id").filter(inside_quad(F.col("x").cast("double"), F.col("y").cast("double"), F.col("v"))).select(*CELL)
    grown = dilate(inner, radius, height, width).withColumn("grown", F.lit(True))
    shrunk = erode(inner, radius, height, width, cells).withColumn("shrunk", F.lit(True))
    out = cells.join(grown, CELL, "left").join(shrunk, CELL, "left")
    return out.withColumn("region", F.when(F.col("shrunk"), "image").when(F.col("grown"), "exclude").otherwise("border")).drop("grown", "shrunk")


def first_step(p: Column, thresholds: list[float]) -> Column:
    """Index of the first of the falling thresholds below ``p``; null if there is none."""
    return F.coalesce(*[F.when(p > t, i) for i, t in enumerate(thresholds)])


def outline_noise(cells: DataFrame, n_steps: int, radius: int) -> DataFrame:
    """Adds ``outline``: the cell is new at its step ``ti`` and nearer than ``radius`` to the edge of the previous set.

    Sets are nested, so a cell lies on the edge of the previous set exactly for the steps after its own and up to the
    latest step of its four neighbours; cells of the region 'exclude' belong to no set here. One bucketed semi-join
    with that interval covers all steps, and a cell leaves it at its first match. Cells outside the grid make no edge.
    """
    step = F.coalesce(F.when(F.col("region") != "exclude", F.col("ti")), F.lit(n_steps))
    known = cells.select(*CELL, step.alias("s"))
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    told = known.select("image_id", "s", "y", "x", F.explode(offsets).alias("o")).select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "s")
    latest = told.groupBy(*CELL).agg(F.max("s").alias("until"))
    edge = known.join(latest, CELL).filter(F.col("s") < F.col("until"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    edge = edge.select(F.col("image_id").alias("i"), F.col("y").alias("ey"), F.col("x").alias("ex"), "s", "until", F.explode(near).alias("a")).select("*", F.explode(near).alias("b"))
    edge = edge.withColumn("gy", F.floor(F.col("ey") / radius) + F.col("a")).withColumn("gx", F.floor(F.col("ex") / radius) + F.col("b"))
    new = cells.filter("ti > 0").select(*CELL, "ti")
    d2 = (F.col("y") - F.col("ey")) * (F.col("y") - F.col("ey")) + (F.col("x") - F.col("ex")) * (F.col("x") - F.col("ex"))
    on = (F.col("image_id") == F.col("i")) & (F.floor(F.col("y") / radius) == F.col("gy")) & (F.floor(F.col("x") / radius) == F.col("gx"))
    hit = new.join(edge, on & (F.col("s") < F.col("ti")) & (F.col("ti") <= F.col("until")) & (d2 < radius * radius), "left_semi").select(*CELL, F.lit(True).alias("outline"))
    return cells.join(hit, CELL, "left").withColumn("outline", F.coalesce("outline", F.lit(False)))


def decide(n_cur: Column, total: Column, ar_border: Column, mr_border: Column, ar_image: Column, mr_image: Column) -> Column:
    """The stopping rule: four tests in order, 'reject' or 'accept'."""
    bold = lambda ar, mr: (ar > 0.15) & ((ar > 0.50) | (mr > 0.50))
    odd = lambda ar, mr: (ar > 0.015) & (mr < 0.80)
    return (F.when((n_cur > 0) & (total < 0.015), "reject").when(bold(ar_border, mr_border) | bold(ar_image, mr_image), "accept")
            .when(odd(ar_border, mr_border) | odd(ar_image, mr_image), "reject").otherwise("accept"))


def region_history(cells: DataFrame, n_steps: int) -> DataFrame:
    """(image_id, region, ti): cells new at the step (raw, and without outline noise), and mean and population deviation of all earlier ones.

    Sums of whole numbers combine map-side; the window then runs over at most ``n_steps`` rows of an image and region.
    """
    sums = [F.sum(F.col(c).cast("long")).alias(f"s{c}") for c in "rgb"] + [F.sum((F.col(c) * F.col(c)).cast("long")).alias(f"q{c}") for c in "rgb"]
    per = cells.filter("ti is not null").groupBy("image_id", "region", "ti").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(~F.col("outline")).alias("n_new"), *sums)
    steps = cells.select("image_id").distinct().select("image_id", F.explode(F.array(*map(F.lit, (*REGIONS, "exclude")))).alias("region")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("ti"))
    out = steps.join(per, ["image_id", "region", "ti"], "left").na.fill(0)
    before = Window.partitionBy("image_id", "region").orderBy("ti").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    out = out.withColumns({"n_prev": past("n_raw"), **{f"p{k}{c}": past(f"{k}{c}") for c in "rgb" for k in "sq"}})
    n = F.col("n_prev")
    mean = {f"mean_{c}": F.try_divide(F.col(f"ps{c}").cast("double"), n) for c in "rgb"}
    std = {f"std_{c}": F.sqrt(F.try_divide((n * F.col(f"pq{c}") - F.col(f"ps{c}") * F.col(f"ps{c}")).cast("double"), n * n)) for c in "rgb"}
    return out.withColumns(mean | std).select("image_id", "region", "ti", "n_raw", "n_new", "n_prev", *mean, *std)


def ink_steps(cells: DataFrame, n_steps: int) -> DataFrame:
    """One row for each image and step, with counts, growth, colour match and decision.

    ``cells``: image_id, y, x, ti (first step, null: never), region, outline, r, g, b. Growth leaves outline noise out;
    the match counts it. A new cell matches if its mean channel z-score against the region's earlier cells is under 2;
    no earlier cells: all match; no new cells: 1. The first step decides nothing ('base').
    """
    past = region_history(cells, n_steps)
    z = sum(F.abs(F.col(c) - F.col(f"mean_{c}")) / (F.col(f"std_{c}") + 1e-6) for c in "rgb") / 3.0
    fits = cells.filter("ti > 0 and region <> 'exclude'").join(past.select("image_id", "region", "ti", *[f"{k}_{c}" for c in "rgb" for k in ("mean", "std")]), ["image_id", "region", "ti"])
    fits = fits.groupBy("image_id", "region", "ti").agg(F.count_if(F.coalesce(z, F.lit(0.0)) < 2.0).alias("n_fit"))
    rows = past.join(fits, ["image_id", "region", "ti"], "left").na.fill(0, ["n_fit"])
    of = lambda c, region: F.sum(F.when(F.col("region") == region, F.col(c)).otherwise(0))
    agg = [F.sum("n_raw").alias("raw"), F.sum("n_new").alias("n_new"), F.sum("n_prev").alias("n_prev")]
    agg += [of(c, region).alias(f"{c}_{region}") for region in REGIONS for c in ("n_raw", "n_new", "n_prev", "n_fit")]
    out = rows.groupBy("image_id", "ti").agg(*agg).withColumn("n_cur", F.col("n_prev") + F.col("raw")).withColumn("n_outline", F.col("raw") - F.col("n_new"))
    share = lambda a, b, none: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(none))
    out = out.withColumn("area_ratio", share(F.col("n_new"), F.col("n_cur"), 0.0))
    for k in REGIONS:
        out = out.withColumn(f"ar_{k}", share(F.col(f"n_new_{k}"), F.col(f"n_prev_{k}") + F.col(f"n_new_{k}"), 0.0)).withColumn(f"mr_{k}", share(F.col(f"n_fit_{k}"), F.col(f"n_raw_{k}"), 1.0))
    rule = decide(*[F.col(c) for c in ("n_cur", "area_ratio", "ar_border", "mr_border", "ar_image", "mr_image")])
    out = out.withColumn("decision", F.when(F.col("ti") == 0, "base").otherwise(rule))
    return out.select("image_id", "ti", "n_cur", "n_prev", "n_new", "n_outline", "area_ratio", "ar_border", "mr_border", "ar_image", "mr_image", "decision")


def chosen_ink(cells: DataFrame, chosen: DataFrame, drop_outline: bool = False) -> DataFrame:
    """Cells of the chosen step's mask (image_id, chosen); without outline noise of any step, outside 'exclude', if asked."""
    out = cells.join(chosen, "image_id").filter(F.col("ti") <= F.col("chosen")).drop("chosen")
    return out.filter(~(F.col("outline") & (F.col("region") != "exclude"))) if drop_outline else out


def remove_white(ink: DataFrame, white: float = 240.0, share: float = 0.6, default: float = 120.0) -> DataFrame:
    """Ink without cells near white: all channels above mean + share * (white - mean), by the image's ink in the border."""
    mean = ink.groupBy("image_id").agg(*[F.coalesce(F.avg(F.when(F.col("region") == "border", F.col(c))), F.lit(default)).alias(f"m{c}") for c in "rgb"])
    near = [F.col(c) > F.col(f"m{c}") + (white - F.col(f"m{c}")) * share for c in "rgb"]
    return ink.join(mean, "image_id").filter(~(near[0] & near[1] & near[2])).drop("mr", "mg", "mb")


def ink_stats(ink: DataFrame, images: DataFrame) -> DataFrame:
    """For each image: ink cells in all, in the border and in the image, background (0 if the mean ink is near white, else 255) and ink colour (60s if the border has none)."""
    border = lambda c: F.when(F.col("region") == "border", F.col(c))
    agg = ink.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("region") == k).alias(f"n_{k}") for k in REGIONS], *[F.avg(c).alias(f"m{c}") for c in "rgb"], *[F.avg(border(c)).alias(f"b{c}") for c in "rgb"])
    out = images.select("image_id").distinct().join(agg, "image_id", "left").na.fill(0, ["n", *[f"n_{k}" for k in REGIONS]])
    light = (F.col("mr") > 200) & (F.col("mg") > 200) & (F.col("mb") > 200)
    return out.select("image_id", "n", *[f"n_{k}" for k in REGIONS], F.when(light, 0).otherwise(255).alias("background"), *[F.coalesce(F.floor(f"b{c}").cast("int"), F.lit(60)).alias(f"ink_{c}") for c in "rgb"])
