"""Fallback cascades, threshold sweeps and the stopping rule over scored detections and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_success(found: DataFrame, trials: DataFrame, images: DataFrame) -> DataFrame:
    """Per image the first trial (ord, prompt, threshold) with a detection of that prompt above it, and how many there are."""
    hit = found.join(trials, "prompt").filter(F.col("score") > F.col("threshold"))
    per = hit.groupBy("image_id", "ord").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("image_id").agg(F.min_by(F.struct("ord", "n"), "ord").alias("b"))
    return images.join(best, "image_id", "left").select("image_id", F.col("b.ord").alias("ord"), F.coalesce(F.col("b.n"), F.lit(0)).alias("n"))


def probe_base(found: DataFrame, probes: list[float], first: float, last: float) -> DataFrame:
    """Base threshold: the probe before the first that fires; ``first`` if the first fires, ``last`` if none does."""
    top = found.groupBy("image_id").agg(F.max("score").alias("top"))
    out = F.lit(last)
    for i in reversed(range(len(probes))):
        out = F.when(F.col("top") > probes[i], first if i == 0 else probes[i - 1]).otherwise(out)
    return top.select("image_id", out.alias("base"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(image_id, ti, n_new, n_cur, n_prev): cells above falling thresholds. A cell is counted once, at its first step."""
    step = F.coalesce(*[F.when(F.col("p") > t, i) for i, t in enumerate(thresholds)])
    new = scored.withColumn("ti", step).filter("ti is not null").groupBy("image_id", "ti").agg(F.count(F.lit(1)).alias("n"))
    grid = scored.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))).alias("ti"))
    w = Window.partitionBy("image_id").orderBy("ti")
    out = grid.join(new, ["image_id", "ti"], "left").select("image_id", "ti", F.coalesce("n", F.lit(0)).alias("n_new"))
    out = out.withColumn("n_cur", F.sum("n_new").over(w))
    return out.withColumn("n_prev", F.coalesce(F.lag("n_cur").over(w), F.lit(0)))


def stopping_rule(steps: DataFrame, most: float) -> DataFrame:
    """Steps with growth = new / (previous + new) and a decision; the first step decides nothing."""
    growth = F.coalesce(F.try_divide(F.col("n_new").cast("double"), F.col("n_prev") + F.col("n_new")), F.lit(0.0))
    return steps.withColumn("growth", growth).withColumn("decision", F.when(F.col("ti") == 0, "base").when(F.col("n_new") == 0, "accept").when(F.col("growth") > most, "reject").otherwise("accept"))


def select_step(steps: DataFrame, n_steps: int, offset: int = 0) -> DataFrame:
    """The step before the first reject (the last if none), moved by ``offset`` within bounds."""
    stop = F.coalesce(F.min(F.when(F.col("decision") == "reject", F.col("ti"))), F.lit(n_steps)) - 1
    return steps.groupBy("image_id").agg(F.least(F.lit(n_steps - 1), F.greatest(F.lit(0), stop + offset)).alias("chosen"))


def step_change(steps: DataFrame, at: int, offset: int) -> DataFrame:
    """Cells of the mask at step ``at`` and ``offset`` steps on (within bounds), and the difference."""
    last = F.max("ti")
    to = F.least(last, F.greatest(F.lit(0), F.lit(at + offset)))
    n = F.map_from_entries(F.collect_list(F.struct("ti", "n_cur")))  # one entry for each step
    out = steps.groupBy("image_id").agg(n.alias("n"), to.alias("to"))
    return out.select("image_id", F.col("n")[at].alias("n_from"), F.element_at("n", F.col("to")).alias("n_to")).withColumn("change", F.col("n_to") - F.col("n_from"))
