"""Points and lines: hulls, extremes, nearest edges, least squares and robust consensus lines."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.files import written

#: Points of a group that travel in one row.
BLOCK = 4096
#: Of the sequence of draws, modulo 2**64.
MULTIPLIER = 6364136223846793005


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def convex_hull(points: DataFrame, fan: int = 16) -> DataFrame:
    """Hull corners (group_id, x, y) as a set: hulls of partitions first, then of ``fan`` shares of those, then of what is left, so that no task meets the hulls of all partitions."""
    schema = "group_id long, x double, y double, share int"

    def part(batches):
        from pyspark import TaskContext

        share = TaskContext.get().partitionId() % fan
        for pdf in batches:
            rows = [(g, *p, share) for g, own in pdf.groupby("group_id") for p in _hull(list(zip(own["x"], own["y"])))]
            yield pd.DataFrame(rows, columns=["group_id", "x", "y", "share"])

    def whole(pdf):
        return pd.DataFrame([(pdf["group_id"].iloc[0], *p, 0) for p in _hull(list(zip(pdf["x"], pdf["y"])))], columns=["group_id", "x", "y", "share"])

    shares = points.select("group_id", "x", "y").mapInPandas(part, schema).groupBy("group_id", "share").applyInPandas(whole, schema)
    return shares.groupBy("group_id").applyInPandas(whole, schema).drop("share")


def order_quad(points: DataFrame) -> DataFrame:
    """Corners by smallest and largest x + y and x - y (ties by x, then y): tl, tr, br, bl."""
    s, d, p = F.col("x") + F.col("y"), F.col("x") - F.col("y"), F.struct("x", "y")
    pick = lambda k, first: (F.min if first else F.max)(F.struct(k.alias("k"), p.alias("p")))["p"]
    return points.groupBy("group_id").agg(pick(s, True).alias("tl"), pick(d, False).alias("tr"), pick(s, False).alias("br"), pick(d, True).alias("bl"))


def fit_line(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares y = m x + b per group."""
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("m"), F.regr_intercept("y", "x").alias("b"))


def numbered_blocks(points: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """The points of each group, numbered from 0 and gathered in blocks: (keys, n, first, pid, x, y), the last three arrays.

    A group of n points gets ceil(n / size) blocks, by pid modulo that number, so a large group lies in many rows and no
    window sorts it; ``first`` is the number of a block's first point.
    """
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = points.join(counts, keys).withColumn("block", F.pmod("pid", F.ceil(F.col("n") / size)))
    blocks = rows.groupBy(*keys, "n", "block").agg(F.sort_array(F.collect_list(F.struct("pid", "x", "y"))).alias("p"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*keys, "n", F.coalesce(F.sum(F.size("p")).over(before), F.lit(0)).cast("long").alias("first"), *[F.col(f"p.{c}").alias(c) for c in ("x", "y")])


def _draws(key: str, n: int, seed: int, trials: int, sample: int) -> np.ndarray:
    """[trials, sample] numbers of points, one from each of ``sample`` equal shares of 0..n-1: a multiplicative sequence that starts at a digest of seed and key."""
    edges = np.arange(sample + 1) * n // sample
    start = int(hashlib.sha256(f"{seed}|{key}".encode()).hexdigest()[:12], 16) + 1
    h = (np.uint64(start) + np.arange(min(trials, 10 * n) * sample, dtype=np.uint64)) * np.uint64(MULTIPLIER) >> np.uint64(16)
    return edges[:-1] + h.astype(np.int64).reshape(-1, sample) % np.diff(edges)


def _least_norm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares m and b of each row's points; where all x are equal, the line of least error with the smallest m^2 + b^2."""
    mx, my = x.mean(1), y.mean(1)
    dx = x - mx[:, None]
    sxx, sxy = (dx * dx).sum(1), (dx * (y - my[:, None])).sum(1)
    flat = (x == x[:, :1]).all(1)
    m = np.where(flat, mx * my / (mx * mx + 1), sxy / np.where(flat, 1, sxx))
    return m, np.where(flat, my / (mx * mx + 1), my - m * mx)


def _values(batch: pa.RecordBatch, keys: list[str]) -> list[str]:
    return ["|".join(map(str, k)) for k in zip(*(batch.column(k).to_pylist() for k in keys))]


def _small(batches, rows: int = 256):
    """Pieces of Arrow batches, so that what a piece becomes in Python stays small however long its lists are."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as views of one array."""
    values, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[s:e] for s, e in zip(at[:-1] - at[0], at[1:] - at[0])]


def _votes(x: np.ndarray, y: np.ndarray, m: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """How many points each line y = m x + b is nearer to than ``reach`` along y."""
    step = max(1, (1 << 20) // len(x))
    return np.concatenate([(np.abs(y - (m[s : s + step, None] * x + b[s : s + step, None])) < reach).sum(1) for s in range(0, len(m), step)])


def consensus_lines(points: DataFrame, keys: list[str], seed: int, trials: int = 500, sample: int = 5, reach: float = 5.0) -> DataFrame:
    """(keys, n, trial, votes, m, b): for each group of ``sample`` points or more the line y = m x + b that most points are nearer to than ``reach`` along y.

    Where no line has a vote, the first trial's is given with 0 votes. min(trials, 10 n) lines are tried, each through ``sample`` points addressed by number: one from each of ``sample``
    equal shares of the group's numbers, so at most trials * sample points are ever drawn. Ties go to the first trial.
    Groups travel as blocks (see ``numbered_blocks``): rows follow the points, not points times trials. A group of one
    block is settled where that lies; only of larger ones the drawn points are gathered, and the votes of blocks added.
    Draws depend on seed, keys, trial and n only, not on partitioning.
    """
    drawn = trials * sample
    blocks = written(numbered_blocks(points, keys).filter(F.col("n") >= sample), "blocks")
    schema = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    named = ", ".join(f"{k} {schema[k]}" for k in keys)
    fields = lambda b, names: [b.column(c) for c in names]
    lists = lambda values, kind: pa.array([v.tolist() for v in values], pa.list_(kind))

    def whole(batches):
        """The best line of each group that is one block."""
        for b in _small(batches):
            best = []
            for key, x, y in zip(_values(b, keys), _arrays(b.column("x")), _arrays(b.column("y"))):
                own = _draws(key, len(x), seed, trials, sample)
                m, c = _least_norm(x[own], y[own])
                k = _votes(x, y, m, c, reach)
                t = int(k.argmax())
                best.append((t, int(k[t]), m[t], c[t]))
            kinds = zip(zip(*best), (pa.int32(), pa.int64(), pa.float64(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*fields(b, [*keys, "n"]), *(pa.array(v, kind) for v, kind in kinds)], names=[*keys, "n", "trial", "votes", "m", "b"])

    def pick(batches):
        """Of each block the points that any trial draws."""
        for b in _small(batches):
            at, x, y = [], [], []
            for key, n, first, bx, by in zip(_values(b, keys), b.column("n").to_pylist(), b.column("first").to_pylist(), _arrays(b.column("x")), _arrays(b.column("y"))):
                own = np.arange(first, first + len(bx))
                if n > drawn:
                    own = np.intersect1d(own, _draws(key, n, seed, trials, sample))
                at.append(own)
                x.append(bx[own - first])
                y.append(by[own - first])
            yield pa.RecordBatch.from_arrays([*fields(b, [*keys, "n"]), lists(at, pa.int64()), lists(x, pa.float64()), lists(y, pa.float64())], names=[*keys, "n", "at", "x", "y"])

    def solve(batches):
        """The lines of each group, in order of trial."""
        for b in _small(batches):
            ms, bs = [], []
            for key, n, p in zip(_values(b, keys), b.column("n").to_pylist(), b.column("p").to_pylist()):
                at, x, y = (np.concatenate([np.array(q[c]) for q in p]) for c in ("at", "x", "y"))
                order = np.argsort(at)
                own = order[np.searchsorted(at[order], _draws(key, n, seed, trials, sample))]
                m, c = _least_norm(x[own], y[own])
                ms.append(m)
                bs.append(c)
            yield pa.RecordBatch.from_arrays([*fields(b, keys), lists(ms, pa.float64()), lists(bs, pa.float64())], names=[*keys, "m", "b"])

    def vote(batches):
        """Votes of a block for all trials; those without one are left out, except the first."""
        for b in _small(batches):
            rows, trial, votes, ms, bs = [], [], [], [], []
            for i, (x, y, m, c) in enumerate(zip(*map(_arrays, fields(b, ["x", "y", "m", "b"])))):
                k = _votes(x, y, m, c, reach)
                own = np.arange(len(m))
                own = own[(k > 0) | (own == 0)]
                rows += [i] * len(own)
                trial += own.tolist()
                votes += k[own].tolist()
                ms += m[own].tolist()
                bs += c[own].tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows, pa.int64())) for c in [*keys, "n"]), pa.array(trial, pa.int32()), pa.array(votes, pa.int64()), pa.array(ms, pa.float64()), pa.array(bs, pa.float64())], names=[*keys, "n", "trial", "votes", "m", "b"])

    outcome = [*keys, "n", "trial", "votes", "m", "b"]
    single = blocks.filter(F.size("x") == F.col("n")).mapInArrow(whole, f"{named}, n long, trial int, votes long, m double, b double").select(*outcome)
    blocks = blocks.filter(F.size("x") < F.col("n"))
    if blocks.isEmpty():
        return written(single, "lines")
    picked = blocks.mapInArrow(pick, f"{named}, n long, at array<long>, x array<double>, y array<double>")
    pool = picked.groupBy(*keys, "n").agg(F.collect_list(F.struct("at", "x", "y")).alias("p"))  # at most trials * sample points
    lines = pool.mapInArrow(solve, f"{named}, m array<double>, b array<double>")
    votes = blocks.select(*keys, "n", "x", "y").join(lines, keys).mapInArrow(vote, f"{named}, n long, trial int, votes long, m double, b double")
    total = votes.groupBy(*keys, "n", "trial", "m", "b").agg(F.sum("votes").alias("votes"))
    best = total.groupBy(*keys, "n").agg(F.max(F.struct("votes", (-F.col("trial")).alias("order"), "m", "b")).alias("v")).select(*keys, "n", (-F.col("v.order")).alias("trial"), "v.votes", "v.m", "v.b")
    return written(single.unionByName(best.select(*outcome)), "lines")  # a row for each group, read more than once


def refit_lines(points: DataFrame, lines: DataFrame, keys: list[str], reach: float, least: int = 3) -> DataFrame:
    """``lines`` (keys, m, b, ...) fitted anew to the points nearer than ``reach`` along y, if they are ``least`` or more; ``inliers`` is their number."""
    off = F.abs(F.col("y") - (F.col("m") * F.col("x") + F.col("b")))
    new = _least_norm_line(points.join(lines.select(*keys, "m", "b"), keys).filter(off < reach).select(*keys, "x", "y"), keys)
    out = lines.join(new.select(*keys, F.col("n").alias("inliers"), F.col("m").alias("rm"), F.col("b").alias("rb")), keys, "left")
    enough = F.col("inliers") >= least
    return out.withColumns({"inliers": F.coalesce("inliers", F.lit(0)).cast("long"), "m": F.when(enough, F.col("rm")).otherwise(F.col("m")), "b": F.when(enough, F.col("rb")).otherwise(F.col("b"))}).drop("rm", "rb")


def consensus_line(points: DataFrame, keys: list[str], seed: int, trials: int = 500, sample: int = 5, reach: float = 5.0) -> DataFrame:
    """(keys, inliers, m, b): the robust line of each group of five points or more, fitted again to the points near it; groups where no line has a vote have none."""
    best = consensus_lines(points, keys, seed, trials, sample, reach).filter("votes > 0").select(*keys, "m", "b")
    return refit_lines(points, best, keys, reach).select(*keys, "inliers", "m", "b")


def along_axes(points: DataFrame, orient: str = "orient") -> DataFrame:
    """``points`` with x and y swapped where ``orient`` is 'v', so that the fits give x = m y + b on vertical sides."""
    flat = F.col(orient) == "h"
    return points.withColumns({"x": F.when(flat, F.col("x")).otherwise(F.col("y")), "y": F.when(flat, F.col("y")).otherwise(F.col("x"))})


def start_lines(quads: DataFrame) -> DataFrame:
    """(group_id, edge, orient, m, b): the four sides of each quad (group_id, v) in order top, right, bottom, left."""
    side = lambda i: X.line_from_points(F.col("v")[i]["x"], F.col("v")[i]["y"], F.col("v")[(i + 1) % 4]["x"], F.col("v")[(i + 1) % 4]["y"])
    return quads.select("group_id", F.posexplode(F.array(*[side(i) for i in range(4)])).alias("edge", "line")).select("group_id", "edge", "line.*")


def _least_norm_line(points: DataFrame, keys: list[str]) -> DataFrame:
    """Like ``fit_line``; where all x are equal, of the lines of least error the one with the smallest m^2 + b^2."""
    x, y = F.avg("x"), F.avg("y")
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.regr_slope("y", "x"), x * y / (x * x + 1.0)).alias("m"), F.coalesce(F.regr_intercept("y", "x"), y / (x * x + 1.0)).alias("b"))


def robust_lines(points: DataFrame, starts: DataFrame, seed: int, trials: int = 500, sample: int = 5, near: float = 80.0, reach: float = 5.0) -> DataFrame:
    """(group_id, edge, orient, inliers, m, b): each line of ``starts``, fitted anew to the points nearest to it.

    Points go to the start line nearest along its axis, the first of equals, if nearer than ``near``. With fewer than
    five the start line stays, with no inliers. Else the line of ``consensus_lines`` takes its place if
    it has a vote. It is fitted again to the points within ``reach`` if they are at least three. ``inliers`` is their number.
    """
    keys = ["group_id", "edge"]
    off = lambda m, b: F.abs(F.col("y") - (m * F.col("x") + b))
    sides = starts.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("edge", "orient", "m", "b"))).alias("lines"))
    cross = lambda e: F.when(e["orient"] == "h", off(e["m"], e["b"])).otherwise(F.abs(F.col("x") - (e["m"] * F.col("y") + e["b"])))
    own = points.join(sides, "group_id").withColumn("at", F.array_min(F.transform("lines", lambda e: F.struct(cross(e).alias("d"), e["edge"].alias("edge"), e["orient"].alias("orient")))))
    own = along_axes(own.select("group_id", "pid", "x", "y", "at.*").filter(F.col("d") < near)).select(*keys, "pid", "x", "y")
    own = written(own, "side-points")
    best = consensus_lines(own, keys, seed, trials, sample, reach).select(*keys, F.when(F.col("votes") > 0, F.struct("m", "b")).alias("best"), F.lit(True).alias("tried"))
    model = starts.join(best, keys, "left").select(*keys, "orient", "tried", F.coalesce("best.m", "m").alias("m"), F.coalesce("best.b", "b").alias("b"))
    tried = refit_lines(own, model.filter("tried"), keys, reach)
    return tried.unionByName(model.filter("tried is null").withColumn("inliers", F.lit(0).cast("long"))).select(*keys, "orient", "inliers", "m", "b")


def quad_fit(points: DataFrame, quads: DataFrame, seed: int, **limits) -> DataFrame:
    """(group_id, tl, tr, br, bl): corners where the robust lines of the four sides meet; near parallel ones keep the corner of ``quads``.

    Where a group has several quads, each line of a side meets each of the next, and the outermost corners of all are taken.
    """
    flat = F.col("orient") == "h"
    general = F.struct("edge", F.when(flat, F.col("m")).otherwise(1.0).alias("a"), F.when(flat, -1.0).otherwise(-F.col("m")).alias("b"), F.when(flat, F.col("b")).otherwise(-F.col("b")).alias("c"))
    lines = robust_lines(points, start_lines(quads), seed, **limits).groupBy("group_id").agg(F.collect_set(general).alias("e"))
    side = lambda i: F.filter("e", lambda s: s["edge"] == i)

    def meet(p, q, corner):
        det = p["a"] * q["b"] - q["a"] * p["b"]
        x, y = F.try_divide(p["b"] * q["c"] - q["b"] * p["c"], det), F.try_divide(q["a"] * p["c"] - p["a"] * q["c"], det)
        return F.when(F.abs(det) >= 1e-9, F.struct(x.alias("x"), y.alias("y"))).otherwise(F.col("v")[corner])

    met = lambda i, j, corner: F.flatten(F.transform(side(i), lambda p: F.transform(side(j), lambda q: meet(p, q, corner))))
    corners = F.concat(*[met(i, j, k) for k, (i, j) in enumerate([(0, 3), (0, 1), (2, 1), (2, 3)])])
    return order_quad(quads.join(lines, "group_id").select("group_id", F.explode(corners).alias("p")).select("group_id", "p.x", "p.y"))


def nearest_edge(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Each point with the nearest of its group's lines (group_id, edges array of a, b, c); the first edge wins ties."""
    d = F.transform("edges", lambda e, i: F.struct((F.abs(e["a"] * F.col("x") + e["b"] * F.col("y") + e["c"]) / F.sqrt(e["a"] * e["a"] + e["b"] * e["b"])).alias("d"), i.alias("edge")))
    return points.join(lines, "group_id").withColumn("near", F.array_min(d)).select("group_id", "pid", F.col("near.edge").alias("edge"), F.col("near.d").alias("d"))


def sort_by_angle(points: DataFrame) -> DataFrame:
    """(group_id, v): the few corners of each group in order of their angle about the mean."""
    w = Window.partitionBy("group_id")
    angle = F.atan2(F.col("y") - F.avg("y").over(w), F.col("x") - F.avg("x").over(w))
    out = points.withColumn("angle", angle).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("angle", "x", "y"))).alias("v"))
    return out.select("group_id", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("v"))


def extremes(points: DataFrame) -> DataFrame:
    """(group_id, p1..p4): leftmost point, the point farthest from it, and those farthest to either side of the line through both.

    Ties go to the smaller y for p1, else to the larger x, then y. If p2 is nearer than 1, all four are p1.
    Three aggregates joined back by key; none gathers a group.
    """
    p = F.struct("x", "y")
    first = points.groupBy("group_id").agg(F.min(p).alias("p1"))
    dx, dy = F.col("x") - F.col("p1.x"), F.col("y") - F.col("p1.y")
    pair = points.join(first, "group_id").groupBy("group_id", "p1").agg(F.max(F.struct((dx * dx + dy * dy).alias("d2"), p.alias("p"))).alias("m"))
    pair = pair.select("group_id", "p1", F.col("m.p").alias("p2"), F.col("m.d2").alias("d2"))
    vx, vy = F.col("p2.x") - F.col("p1.x"), F.col("p2.y") - F.col("p1.y")
    side = vx * dy - vy * dx
    out = points.join(pair, "group_id").groupBy("group_id", "p1", "p2", "d2").agg(F.max(F.struct(side.alias("s"), p.alias("p")))["p"].alias("p3"), F.max(F.struct((-side).alias("s"), p.alias("p")))["p"].alias("p4"))
    return out.select("group_id", "p1", *[F.when(F.col("d2") < 1, F.col("p1")).otherwise(F.col(k)).alias(k) for k in ("p2", "p3", "p4")])


def _antipodal(hull: list[tuple[float, float]]):
    """Pairs of corners through which parallel lines can hold the hull between them, by one turn around it; the farthest pairs are among them."""
    n = len(hull)
    if n < 3:
        yield from ((p, q) for p in hull for q in hull)
        return
    height = lambda i, k: (hull[(i + 1) % n][0] - hull[i][0]) * (hull[k % n][1] - hull[i][1]) - (hull[(i + 1) % n][1] - hull[i][1]) * (hull[k % n][0] - hull[i][0])
    j = 1
    for i in range(n):
        j = max(j, i + 1)
        while height(i, j + 1) > height(i, j):
            j += 1
        yield hull[i], hull[j % n]
        yield hull[(i + 1) % n], hull[j % n]
        if height(i, j + 1) == height(i, j):  # the edge at j is parallel
            yield hull[i], hull[(j + 1) % n]
            yield hull[(i + 1) % n], hull[(j + 1) % n]


def _farthest(hull: list[tuple[float, float]]) -> tuple:
    """(d2, p, q) with p before q; of equals the largest coordinates."""
    near = ((min(p, q), max(p, q)) for p, q in _antipodal(hull))
    return max(((q[0] - p[0]) * (q[0] - p[0]) + (q[1] - p[1]) * (q[1] - p[1]), p, q) for p, q in near)


def _smallest_rect(hull: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """(area, corners) of the smallest rectangle with a side along an edge: three corners of the hull follow the edge around it. Ties go to the first edge."""
    n, best = len(hull), (math.inf, [hull[0]] * 4)
    if n < 3:
        return 0.0, [*hull, *hull, *hull][:4] if n == 2 else [hull[0]] * 4
    right = top = left = 0
    for i, a in enumerate(hull):
        b = hull[(i + 1) % n]
        size = math.hypot(b[0] - a[0], b[1] - a[1])
        ux, uy = (b[0] - a[0]) / size, (b[1] - a[1]) / size
        s = lambda k: hull[k % n][0] * ux + hull[k % n][1] * uy
        t = lambda k: hull[k % n][1] * ux - hull[k % n][0] * uy
        right = max(right, i + 1)
        while s(right + 1) > s(right):
            right += 1
        top = max(top, right)
        while t(top + 1) > t(top):
            top += 1
        left = max(left, top)
        while s(left + 1) < s(left):
            left += 1
        s0, s1, t0, t1 = s(left), s(right), min(t(i), t(i + 1)), t(top)
        area = (s1 - s0) * (t1 - t0)
        if area < best[0]:
            best = (area, [(k * ux - m * uy, k * uy + m * ux) for k, m in ((s0, t0), (s1, t0), (s1, t1), (s0, t1))])
    return best


def farthest_pair(points: DataFrame) -> DataFrame:
    """(group_id, d2, p, q): the two points farthest apart, p before q; ties to the largest coordinates. Linear in the corners of the hull."""

    def best(key, pdf):
        d2, p, q = _farthest(_hull(list(zip(pdf["x"], pdf["y"]))))
        return pd.DataFrame([(key[0], d2, *p, *q)], columns=["group_id", "d2", "px", "py", "qx", "qy"])

    return convex_hull(points).groupBy("group_id").applyInPandas(best, "group_id long, d2 double, px double, py double, qx double, qy double")


def min_area_rect(points: DataFrame) -> DataFrame:
    """(group_id, area, v): smallest rectangle around the points, one side along a hull edge; corners in order of angle. Linear in the corners of the hull."""

    def rects(key, pdf):
        area, corners = _smallest_rect(_hull(list(zip(pdf["x"], pdf["y"]))))
        cx, cy = sum(p[0] for p in corners) / 4, sum(p[1] for p in corners) / 4
        v = sorted(corners, key=lambda p: (math.atan2(p[1] - cy, p[0] - cx), p))
        return pd.DataFrame([(key[0], area, [{"x": x, "y": y} for x, y in v])], columns=["group_id", "area", "v"])

    return convex_hull(points).groupBy("group_id").applyInPandas(rects, "group_id long, area double, v array<struct<x:double,y:double>>")
