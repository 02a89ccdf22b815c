"""Operators without SQL against brute force."""

import math

import numpy as np

from silverleaf.operators import fitting, resample


def test_non_local_means_matches_brute_force(spark):
    h, w, rng = 11, 13, np.random.default_rng(1)
    a = rng.integers(0, 30, (h, w)).astype(float)
    px = spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, v double")
    p = np.pad(a, 3, mode="reflect")
    want = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            own = p[y + 2 : y + 5, x + 2 : x + 5]
            near = [(math.exp(-np.mean((own - p[y + dy + 2 : y + dy + 5, x + dx + 2 : x + dx + 5]) ** 2) / 100), p[y + dy + 3, x + dx + 3]) for dy in range(-2, 3) for dx in range(-2, 3)]
            want[y, x] = sum(k * v for k, v in near) / sum(k for k, _ in near)
    got = resample.non_local_means(px, "v", 10.0, h, w, template=3, search=5, tile=4).collect()
    assert len(got) == h * w and all(abs(r.smooth - want[r.y, r.x]) < 1e-6 for r in got)


def test_min_area_rect_of_a_turned_rectangle(spark):
    c, s = math.cos(0.3), math.sin(0.3)
    pts = [(1, x * c - y * s, x * s + y * c) for x in range(5) for y in range(3)]
    r = fitting.min_area_rect(spark.createDataFrame(pts, "group_id long, x double, y double")).first()
    assert abs(r.area - 8) < 1e-9 and len(r.v) == 4


def five(key, trial, n):
    """The numbers of the points that a trial draws, one from each fifth."""
    import hashlib

    start, out = int(hashlib.sha256(key.encode()).hexdigest()[:12], 16) + 1, []
    for j in range(5):
        lo, hi = n * j // 5, n * (j + 1) // 5
        out.append(lo + ((start + 5 * trial + j) * 6364136223846793005 % 2**64 // 2**16) % (hi - lo))
    return out


def quad_by_hand(points, quad, group, seed=42):
    """The fit of four lines with numpy: corners in order top left, right, bottom right, left."""
    lines = []
    for (x1, y1), (x2, y2) in zip(quad, quad[1:] + quad[:1]):
        flat = abs(x2 - x1) > abs(y2 - y1)
        m = (y2 - y1) / (x2 - x1) if flat else (x2 - x1) / (y2 - y1)
        lines.append((flat, m, y1 - m * x1 if flat else x1 - m * y1))
    turn = lambda p, flat: (p[1], p[2]) if flat else (p[2], p[1])
    own, out = [[] for _ in lines], []
    for p in points:
        d = [abs(turn(p, f)[1] - m * turn(p, f)[0] - b) for f, m, b in lines]
        own[int(np.argmin(d))].append((p, min(d)))
    for edge, ((flat, m, b), pts) in enumerate(zip(lines, own)):
        pts = [(p[0], *turn(p, flat)) for p, d in pts if d < 80]
        u, w = np.array([p[1] for p in pts]), np.array([p[2] for p in pts])
        solve = lambda k: np.linalg.lstsq(np.column_stack([u[k], np.ones(len(u[k]))]), w[k], rcond=None)[0]
        if len(pts) >= 5:
            ranked, top = sorted(range(len(pts)), key=lambda i: pts[i][0]), 0
            for t in range(min(500, 10 * len(pts))):
                a, c = solve([ranked[i] for i in five(f"{seed}|{group}|{edge}", t, len(pts))])
                n = int(np.sum(np.abs(w - (a * u + c)) < 5))
                if n > top:
                    top, m, b = n, a, c
            near = np.abs(w - (m * u + b)) < 5
            if near.sum() >= 3:
                m, b = solve(near)
        out.append((m, b))
    corners = []
    for k, (h, v) in enumerate([(0, 3), (0, 1), (2, 1), (2, 3)]):
        (mh, bh), (mv, bv) = out[h], out[v]
        x = (mv * bh + bv) / (1 - mv * mh) if abs(1 - mv * mh) >= 1e-9 else None
        corners.append(quad[k] if x is None else (x, mh * x + bh))
    return out, corners


def test_quad_fit_matches_brute_force(spark):
    """Noisy sides with outliers; a side of four points; a right side whose points lie at one height; parallel lines."""
    rng, pts, quads = np.random.default_rng(8), [], {}
    for g, tilt in enumerate((0.0, 0.04, -0.03, 0.02)):
        quads[g] = [(55.0, 110.0), (750.0, 95.0), (740.0, 1015.0), (60.0, 1030.0)]
        for side in range(4):
            n = 4 if (g, side) == (1, 2) else 24
            for i in range(n):
                t, e = (0.5 if (g, side) == (2, 1) else i / n), rng.normal(0, 1.5) + (float(rng.uniform(-60, 60)) if i % 4 == 0 else 0)
                x, y = [(60 + 680 * t, 100 + e), (745 + e, 100 + 920 * t), (60 + 680 * t, 1022 + e), (58 + e, 100 + 920 * t)][side]
                pts.append((g, len(pts), float(x - tilt * y), float(y + tilt * x)))
    quads[4] = [(0.0, 0.0), (100.0, 99.999), (200.0, 200.0), (150.0, 250.0)]  # no points
    p = spark.createDataFrame(pts, "group_id long, pid long, x double, y double").repartition(5)
    q = spark.createDataFrame([(g, v) for g, v in quads.items()], "group_id long, v array<struct<x:double,y:double>>")
    lines = {(r.group_id, r.edge): (r.m, r.b) for r in fitting.robust_lines(p, fitting.start_lines(q), 42).collect()}
    fit = {r.group_id: [tuple(r[k]) for k in ("tl", "tr", "br", "bl")] for r in fitting.quad_fit(p, q, 42).collect()}
    assert set(fit) == set(quads) and len(lines) == 20
    for g in range(4):
        want, corners = quad_by_hand([r[1:] for r in pts if r[0] == g], quads[g], g)
        assert np.allclose([lines[g, e] for e in range(4)], want, rtol=1e-6, atol=1e-6)
        order = [min(corners, key=lambda c: c[0] + c[1]), max(corners, key=lambda c: c[0] - c[1]), max(corners, key=lambda c: c[0] + c[1]), min(corners, key=lambda c: c[0] - c[1])]
        assert np.allclose(fit[g], order, rtol=1e-6, atol=1e-5)
    assert np.allclose(fit[0], [(60, 100), (745, 100), (745, 1022), (58, 1022)], atol=5)


def test_fit_line_on_vertical_sides(spark):
    p = spark.createDataFrame([(1, "v", 2.0 + 0.5 * y, float(y)) for y in range(6)] + [(2, "h", float(x), 1.0 - x) for x in range(6)], "group_id long, orient string, x double, y double")
    got = {r.group_id: (round(r.m, 9), round(r.b, 9)) for r in fitting.fit_line(fitting.along_axes(p), ["group_id"]).collect()}
    assert got == {1: (0.5, 2.0), 2: (-1.0, 1.0)}


def test_consensus_lines_do_not_depend_on_blocks(spark, monkeypatch):
    """A group of many blocks, one of few points and one under five: equal to all points in one array."""
    rng = np.random.default_rng(4)
    size = {1: 700, 2: 9, 3: 4}
    pts = [(g, 3 * i - 50, float(x), float(0.25 * x + 7 + rng.normal(0, 1) + (rng.uniform(-90, 90) if i % 3 == 0 else 0))) for g, n in size.items() for i, x in enumerate(rng.uniform(0, 500, n))]
    monkeypatch.setattr(fitting, "BLOCK", 64)
    df = spark.createDataFrame(pts, "g long, pid long, x double, y double").repartition(7)
    assert fitting.numbered_blocks(df, ["g"], 64).filter("g = 1").count() == 11
    monkeypatch.setattr(fitting.numbered_blocks, "__defaults__", (64,))
    got = {r["g"]: r for r in fitting.consensus_lines(df, ["g"], 42, trials=40).collect()}
    assert set(got) == {1, 2}
    for g in got:
        blocks = -(-size[g] // 64)
        own = sorted((p[1] % blocks, *p[1:]) for p in pts if p[0] == g)
        x, y = np.array([p[2] for p in own]), np.array([p[3] for p in own])
        best = (0, 0)
        for t in range(min(40, 10 * len(own))):
            at = five(f"42|{g}", t, len(own))
            m, b = np.polyfit(x[at], y[at], 1)
            best = max(best, (int(np.sum(np.abs(y - m * x - b) < 5)), -t))
        assert (got[g]["votes"], -got[g]["trial"]) == best


def test_mask_to_quad_branches(spark):
    from silverleaf.operators import prints
    from silverleaf.plans import registry, views

    sf_dir = "/root/testdata/sf0.001"
    quads = {r["image_id"]: r for r in registry.QUERIES["mask_to_quad"](spark, sf_dir).collect()}
    assert 0 not in quads and quads[1]["error"] == prints.FEW_POINTS and quads[2]["error"] == prints.DEGENERATE
    assert quads[4]["n_exterior"] == 3 and sorted((quads[4][f"x{i}"], quads[4][f"y{i}"]) for i in range(4)) == [(10, 30), (20, 10), (20, 10), (30, 30)]
    final = {r["image_id"]: r for r in registry.QUERIES["with_fallback"](spark, sf_dir).collect()}
    errors = {k: r["error"] for k, r in final.items()}
    assert errors == {1: prints.FEW_POINTS, 2: prints.DEGENERATE, 3: prints.DEVIATION, 4: prints.DEVIATION, 0: prints.NO_MASK} | dict.fromkeys(range(5, 10))
    assert all((r["x0"], r["y2"]) == (2.75, 51.1) for r in final.values() if r["fallback"]) and final[3]["max_dev"] > 7.5
    empty = spark.createDataFrame([], "image_id long, y int, x int")
    assert prints.mask_to_quad(empty).count() == 0
    images = spark.createDataFrame([(1,), (1,), (2,)], "image_id long")
    assert [(r["image_id"], r["error"]) for r in prints.with_fallback(prints.mask_to_quad(empty), images, views.SMALL).orderBy("image_id").collect()] == [(1, prints.NO_MASK), (2, prints.NO_MASK)]


def test_run_algebra_equals_cells(spark):
    """Overlapping, touching, repeated, empty and null runs; several masks an image; runs over many tiles."""
    import operator

    from silverleaf.operators import runs

    rng = np.random.default_rng(3)
    made = [[(int(rng.integers(0, 3)), int(rng.integers(0, 4)), int(rng.integers(0, 5)), x := int(rng.integers(-20, 180)), x + int(rng.integers(-1, 60))) for _ in range(60)] for _ in range(2)]
    schema = "image_id int, mask_id int, y int, x0 int, x1 int"
    extra = [(0, 0, 0, None, 5), (0, 0, 0, 5, None), (None, 0, 0, 1, 5), (1, 1, 1, 9, 9)]
    a, b = (spark.createDataFrame(rows + rows[:5] + extra, schema).repartition(4) for rows in made)
    cells = [{(i, y, x) for i, _, y, x0, x1 in rows for x in range(x0, x1)} for rows in made]
    for fn, op in ((runs.runs_and, operator.and_), (runs.runs_or, operator.or_), (runs.runs_minus, operator.sub), (runs.runs_xor, operator.xor)):
        got = fn(a, b)
        told = [tuple(r) for r in got.collect()]
        assert {(i, y, x) for i, y, x0, x1 in told for x in range(x0, x1)} == op(*cells)
        ends = {(i, y, x1) for i, y, _, x1 in told}
        assert not any((i, y, x0) in ends for i, y, x0, _ in told)  # maximal
        assert got.groupBy().sum().count() == 1 and runs.run_cells(got).count() == len(op(*cells))
    images = spark.createDataFrame([(0, 5, 150), (7, 2, 3), (8, 0, 9)], "image_id int, height int, width int")
    want = {(0, y, x) for y in range(5) for x in range(150)} - cells[0] | {(7, y, x) for y in range(2) for x in range(3)}
    assert {(r["image_id"], r["y"], x) for r in runs.runs_not(a, images).collect() for x in range(r["x0"], r["x1"])} == want
    own = {}
    for i, m, y, x0, x1 in made[0]:
        own.setdefault((i, m), set()).update((y, x) for x in range(x0, x1))
    own = {k: v for k, v in own.items() if v}
    assert {(r["image_id"], r["mask_id"]): r["n"] for r in runs.run_area(a, ["image_id", "mask_id"]).collect()} == {k: len(v) for k, v in own.items()}
    iou = {(i, m, n): len(own[i, m] & own[j, n]) / len(own[i, m] | own[j, n]) for i, m in own for j, n in own if i == j and m < n}
    got = {(r["image_id"], r["a"], r["b"]): r["iou"] for r in runs.run_iou(a, 0.1, tile=16).collect()}
    assert got == {k: v for k, v in iou.items() if v > 0.1} and got
    assert runs.run_iou(a.limit(0), 0.1).count() == 0


def test_calipers_equal_all_pairs():
    """Random, gridded (parallel edges, equal distances), collinear and single points."""
    rng = np.random.default_rng(9)
    clouds = [rng.normal(0, 30, (40, 2)) for _ in range(60)] + [rng.integers(0, k, (60, 2)).astype(float) for k in (2, 3, 5, 9, 30) for _ in range(40)]
    clouds += [np.array([[i, 2 * i] for i in range(5)], float), np.array([[3.0, 4.0]]), np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)]
    for c in clouds:
        pts = [tuple(map(float, p)) for p in c]
        hull = fitting._hull(pts)
        every = [(min(p, q), max(p, q)) for p in pts for q in pts]
        assert fitting._farthest(hull) == max(((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2, p, q) for p, q in every)
        area = 0.0
        if len(hull) > 2:
            areas, h = [], np.array(hull)
            for i in range(len(h)):
                u = (h[(i + 1) % len(h)] - h[i]) / np.linalg.norm(h[(i + 1) % len(h)] - h[i])
                areas.append(np.ptp(h @ u) * np.ptp(h @ np.array([-u[1], u[0]])))
            area = min(areas)
        got, corners = fitting._smallest_rect(hull)
        assert abs(got - area) < 1e-6 * max(1, area) and len(corners) == 4
