"""Connected components of links: contraction inside partitions, then alternating large-star and small-star steps.

Nodes are pairs (low, node), ordered in that order; a component is named by its smallest pair, so the least ``low``
of a component comes out without another join. Links never reach the driver. A partition holds about ``EDGES_A_TASK``
links, whatever the input; links that fit one partition are contracted there at once, others need steps between.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release

EDGES_A_TASK = 500_000
PAIR = np.dtype([("low", "<i8"), ("node", "<i8")])
COLUMNS = ["ul", "un", "vl", "vn"]
EDGE = ", ".join(f"{c} long" for c in COLUMNS)


def _pairs(low, node) -> np.ndarray:
    out = np.empty(len(low), PAIR)
    out["low"], out["node"] = low, node
    return out


def contract(edges: np.ndarray) -> np.ndarray:
    """Edges (ul, un, vl, vn) -> star edges: every node of the edges but roots, with the least node it reaches."""
    u, v = _pairs(edges[:, 0], edges[:, 1]), _pairs(edges[:, 2], edges[:, 3])
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    child, top = nodes[own], nodes[root[own]]
    return np.stack([child["low"], child["node"], top["low"], top["node"]], axis=1)


def _contracted(e: DataFrame) -> DataFrame:
    def run(batches):
        rows = [pdf[COLUMNS].to_numpy(np.int64) for pdf in batches]
        if rows:
            yield pd.DataFrame(contract(np.concatenate(rows)), columns=COLUMNS)

    return e.mapInPandas(run, EDGE)


def _stars(e: DataFrame) -> DataFrame:
    """A large-star and a small-star step."""
    pair = lambda a, b, name: F.struct(F.col(a).alias("l"), F.col(b).alias("n")).alias(name)
    e = e.select(pair("ul", "un", "u"), pair("vl", "vn", "v"))
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    rest = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = low.select("u", F.col("m").alias("v")).unionByName(rest).filter("u <> v").distinct()
    return small.select(F.col("u.l").alias("ul"), F.col("u.n").alias("un"), F.col("v.l").alias("vl"), F.col("v.n").alias("vn"))


def components(links: DataFrame) -> DataFrame:
    """(node, component, low) for every node of ``links(a, la, b, lb)``; component: the least node reachable, by (low, node)."""
    a, b = (F.struct(F.col("l" + c).alias("l"), F.col(c).alias("n")) for c in "ab")
    e = links.filter("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = e.select(F.col("u.l").alias("ul"), F.col("u.n").alias("un"), F.col("v.l").alias("vl"), F.col("v.n").alias("vn"))
    parts = -(-max(1, links.count()) // EDGES_A_TASK)
    e = materialize(_contracted(e.coalesce(parts)), "links")
    stamp = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*COLUMNS).cast("decimal(38,0)"))).first())
    last, step = None, 0
    while parts > 1 and (now := stamp(e)) != last:
        before, last = e, now
        e = materialize(_contracted(_stars(e).coalesce(parts)), "links")
        discard(before)
        step += 1
        if not step % 2:
            release(e.sparkSession)
    child = e.groupBy("un").agg(F.min(F.struct("vl", "vn")).alias("top")).select(F.col("un").alias("node"), F.col("top.vn").alias("component"), F.col("top.vl").alias("low"))
    roots = e.select(F.col("vn").alias("node"), F.col("vn").alias("component"), F.col("vl").alias("low")).distinct()
    return child.unionByName(roots.join(child.select("node"), "node", "left_anti"))
