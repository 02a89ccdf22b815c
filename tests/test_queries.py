"""Every registered query of the reference's operators against its DuckDB counterpart on the smallest tables."""

import glob
import os

import duckdb
import pytest

from silverleaf.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return round(v, 3) if isinstance(v, float) else v if isinstance(v, (int, type(None))) else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name in ORACLE_SQL:
        rel = con.sql(ORACLE_SQL[name])
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    else:
        assert got


def test_hull_holds_all_points(spark):
    from silverleaf.plans import views

    pts = views.contour(spark, DIR).collect()
    hull = {}
    for r in QUERIES["convex_hull"](spark, DIR).collect():
        hull.setdefault(r.group_id, []).append((r.x, r.y))
    for g, h in hull.items():
        for p in (r for r in pts if r.group_id == g):
            cross = [(h[(i + 1) % len(h)][0] - a) * (p.y - b) - (h[(i + 1) % len(h)][1] - b) * (p.x - a) for i, (a, b) in enumerate(h)]
            assert min(cross) > -1e-6 or max(cross) < 1e-6


ANSWERS = {"null": '{"Date":null}', "none": "no object", "leap": '{"Date":{"bbox":[1,2,3,4],"text":"02.29"}}', "full": '{"Date":{"bbox":[1,2,3,4],"text":"2024.01.05"}}'}
#: (file, time of change, image, answer); c comes twice in one file
ARRIVALS = [("1", 100, [("a", "null")]), ("2", 200, [("a", "leap"), ("b", "none")]), ("3", 300, [("b", "full"), ("c", "none"), (None, "null")]), ("4", 250, [("a", "none"), ("c", "full")]), ("5", 400, [("a", "none")]), ("0", 50, [("d", "full"), ("a", "full")])]
LAST = {"a": "no json", "b": None, "c": "no json", "d": None}
SCHEMA = "image_id string, raw_text string, width int, height int"


def _deliver(folder, files):
    import json
    import os

    for name, at, rows in files:
        path = folder / f"{name}.json"
        path.write_text("\n".join(json.dumps({"image_id": i, "raw_text": ANSWERS[a], "width": 800, "height": 1272}) for i, a in rows))
        os.utime(path, (at + 1_700_000_000, at + 1_700_000_000))


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4, 5], [4, 2, 5, 1, 3, 0]])
def test_ingestion_upserts(spark, tmp_path, order):
    """One row for each image whatever the order of files and batches, with a late old file at the end and a batch that runs again."""
    from silverleaf.streaming import streams

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    assert streams.read_table(spark, out) is None
    for step in (order[:2], order[2:3], order[3:]):
        _deliver(src, [ARRIVALS[i] for i in step])
        streams.stream_responses(spark, str(src), out, str(tmp_path / "ck"), SCHEMA, buckets=4, per_batch=2).awaitTermination()

    def state():
        return [sorted(map(repr, df.collect())) for df in streams.read_table(spark, out)]

    audit, quarantine = streams.read_table(spark, out)
    assert {r["image_id"]: r["reason"] for df in (audit, quarantine) for r in df.collect() if r["image_id"]} == LAST
    assert audit.filter("image_id is not null").count() + quarantine.filter("image_id is not null").count() == 4
    assert {r["image_id"]: r["date"] for r in audit.collect()} == {"b": "2024.01.05", "d": "2024.01.05", None: None}
    before = state()
    last = max(streams._versions(spark, out).values())
    again = spark.createDataFrame([("a", ANSWERS["none"], 800, 1272)], SCHEMA).selectExpr("*", "timestamp_seconds(1700000400) AS order_time", "'5.json' AS order_file", "xxhash64(image_id, raw_text, width, height) AS order_hash")
    streams.merge_batch(streams.validate_responses(again), out, last + 1, "image_id", 4)
    streams.merge_batch(streams.validate_responses(again), out, last + 1, "image_id", 4)
    assert state() == before
    streams.drop_old(spark, out)
    assert state() == before


def test_streams_match_batch(spark, tmp_path):
    from silverleaf.streaming.streams import hopping_stats

    events = spark.read.parquet(f"{DIR}/events.parquet").select("ts", "value")
    events.write.parquet(str(tmp_path / "ev"))
    q = hopping_stats(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))).writeStream.outputMode("update").format("memory").queryName("hops").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("select start, max(n) n from hops group by start")
    assert last.exceptAll(hopping_stats(events).select("start", "n")).count() == 0


def test_hooks_isolate_errors(spark):
    from silverleaf.functions.hooks import isolate, score

    df = spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "id long, v string")
    got = {r.id: (r.value, r.error) for r in isolate(df, int, "v", "long").collect()}
    assert got[1] == (4, None) and got[2][1].startswith("ValueError") and got[3][1].startswith("TypeError")
    assert score(df, lambda: lambda p: p[["id"]], "id long").count() == 3


def test_sources(spark, tmp_path):
    from silverleaf.sources import files

    for n in ("10.png", "2.PNG", "b.jpg", "A.tiff", "x.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.name for r in files.scan_assets(spark, str(tmp_path)).collect()] == ["2.PNG", "10.png", "A.tiff", "b.jpg"]
    with pytest.raises(ValueError):
        files.limit_inputs(spark.range(3), 0)
    assert files.scan_responses(spark, str(tmp_path / "x.txt")).first().image_id == "x"


def test_response_contract(spark):
    from silverleaf.operators.responses import flatten_envelope, plan_resume, validate_responses

    box = '{"Date":{"bbox":[%s],"text":%s}}'
    cases = [
        (box % ("[1],2,3,4", '"02.29"'), "box type"), (box % ('1,2,{"a":1},4', '"02.29"'), "box type"), (box % ("1,2,null,4", '"a"'), "box type"), (box % ("1,2,true,4", '"a"'), "box type"),
        (box % ("1,2,3", '"a"'), "box length"), ('{"Date":{"bbox":7,"text":"a"}}', "box length"), (box % ("5,2,3,4", '"a"'), "box range"), (box % ("1,2,3,4", "5"), "blank text"), (box % ("1,2,3,4", '" \\n"'), "blank text"),
        ('{"reasoning":5,"Date":null}', "reasoning type"), ('{"a":1,"Date":null}', "extra key"), ('{"reasoning":"x"}', "no date key"), ('{"Date":5}', "date keys"), (box % ("1,2,3,4", '"12.31","more":1'), "date keys"),
        ("[1]", "no object"), ("", "no json"), (None, "no json"), ('{"Date":null,"Date":null}', "repeated key"), ('a {"Date":{"bbox":[],"bbox":[],"text":"x"}} b', "repeated key"), ("{]", "no json"), ('{"Date":null}', None), (box % ("1,2,3,4", '"\\t02.29\\u00a0"'), None), ("x " + box % ("1.5,2,3,4", '"2021.02.30"') + " y", None)]
    df = spark.createDataFrame([(i, t, 800, 1272) for i, (t, _) in enumerate(cases)], "i int, raw_text string, width int, height int")
    got = {r.i: r for r in validate_responses(df).collect()}
    assert {i: got[i].reason for i in got} == {i: why for i, (_, why) in enumerate(cases)}
    assert [got[i].outcome for i in (20, 21, 22)] == ["null", "date", "unreadable"] and got[21].date == "02.29" and got[21].box == [0, 2, 3, 6]
    ids = spark.createDataFrame([(1,), (2,)], "image_id long")
    audit = spark.createDataFrame([(1, "x"), (2, None)], "image_id long, raw_result string")
    assert {r.image_id: r.status for r in plan_resume(ids, ids, audit, ids).collect()} == {1: "audited", 2: "recovered"}
    e = spark.createDataFrame([('{"Success":true,"Code":"Success","Data":{"Items":[{"InstanceID":"a"},{"InstanceID":"b"}]}}',)], "text string")
    assert [r.instance_id for r in flatten_envelope(e, "b").collect()] == ["b"]


def test_sources_and_stages(spark, tmp_path):
    """Plain path order, audit lists (malformed records out, last wins), stages and half-even rounding."""
    from pyspark.sql import functions as F

    from silverleaf.functions.expressions import round_half_even
    from silverleaf.sources import files

    for name in ("b.png", "a.PNG", "10.jpg", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in files.path_order(files.scan_assets(spark, str(tmp_path))).collect()] == sorted(["b.png", "a.PNG", "10.jpg"])
    with pytest.raises(ValueError):
        files.scan_assets(spark, str(tmp_path / "notes.txt"))
    (tmp_path / "audit.json").write_text('[{"image_id":"a","status":"old"},{"image_id":"a","status":"new"},{"status":"lost"},5]')
    assert [(r.image_id, r.status) for r in files.scan_audit(spark, str(tmp_path / "audit.json"), "image_id string, status string").collect()] == [("a", "new")]
    df = spark.createDataFrame([(i, i * 2) for i in range(50)], "image_id long, v long")
    files.save_stage(df, str(tmp_path / "stages"), "one")
    assert sorted(map(tuple, files.load_stage(spark, str(tmp_path / "stages"), "one").select("image_id", "v").collect())) == [(i, i * 2) for i in range(50)]
    assert [r[0] for r in spark.sql("select explode(array(0.5d, 1.5d, 2.5d)) x").select(round_half_even(F.col("x"), 0)).collect()] == [0.0, 2.0, 2.0]


def png(rows, channels):
    """A PNG file of 8-bit samples: gray (1), RGB (3) or RGBA (4)."""
    import struct
    import zlib

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", len(rows[0]) // channels, len(rows), 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + part(b"IEND", b"")


def test_rasters_from_files_and_back(spark, tmp_path):
    from silverleaf.sources import files

    folder = tmp_path / "images"
    folder.mkdir()
    (folder / "rgb.png").write_bytes(png([[1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12], [255, 0, 128, 0, 0, 0]], 3))
    (folder / "gray.png").write_bytes(png([[9, 200]], 1))
    (folder / "alpha.png").write_bytes(png([[1, 2, 3, 255]], 4))
    (folder / "broken.png").write_bytes(b"no image")
    got = files.scan_rasters(spark, str(folder)).selectExpr("substring_index(path, '/', -1) as name", "y", "x", "r", "g", "b")
    want = [("rgb.png", y, x, *p) for y, row in enumerate([[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (10, 11, 12)], [(255, 0, 128), (0, 0, 0)]]) for x, p in enumerate(row)]
    want += [("gray.png", 0, 0, 9, 9, 9), ("gray.png", 0, 1, 200, 200, 200), ("alpha.png", 0, 0, 1, 2, 3)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    from silverleaf.operators import tiles

    cut = files.scan_rasters(spark, str(folder), layout="tiles", size=1)
    assert cut.count() == 3 * 9
    files.write_rasters(cut.selectExpr("*", "'raw' AS stage"), str(tmp_path / "tiles"))
    back = tiles.tile_values(spark.read.parquet(str(tmp_path / "tiles")), 1).groupBy("image_id", "y", "x").pivot("band", ["r", "g", "b"]).agg({"value": "first"})
    assert sorted(map(tuple, back.selectExpr("substring_index(image_id, '/', -1)", "y", "x", "int(r)", "int(g)", "int(b)").collect())) == sorted(want)
    out = str(tmp_path / "out")
    files.write_rasters(got.withColumn("stage", got.name), out)
    assert sorted(map(tuple, spark.read.parquet(out).filter("stage = 'gray.png'").select("name", "y", "x", "r", "g", "b").collect())) == sorted(w for w in want if w[0] == "gray.png")
    files.write_rasters(got.filter("name = 'rgb.png'").withColumn("stage", got.name), out)
    assert spark.read.parquet(out).count() == 6


def _greedy(sets, iou):
    kept = []
    for m in sorted(sets, key=lambda m: (-len(sets[m]), m)):
        if all(len(sets[m] & sets[k]) / len(sets[m] | sets[k]) <= iou for k in kept):
            kept.append(m)
    return set(kept)


def test_prefix_pairs_and_rounds_match_brute_force(spark):
    """Masks near the threshold, a chain in which each decision waits for the one before, many copies of one mask, and an empty table."""
    import random

    from silverleaf.operators import masks

    rng, sets = random.Random(2), {}
    for base in range(12):
        cells = rng.sample(range(300), 40)
        for _ in range(6):
            sets[len(sets)] = set(cells[rng.randrange(0, 6) :]) | set(rng.sample(range(300), rng.randrange(0, 5)))
    for i in range(30):  # each overlaps the next one alone
        sets[200 + i] = set(range(1000 + 3 * i, 1000 + 3 * i + 60 - i % 2))
    for i in range(50):
        sets[300 + i] = set(range(5000, 5020))
    rows = [(1, m, c) for m in sets for c in sets[m]]
    df = spark.createDataFrame(rows + rows[:40], "image_id long, mask_id long, cell long").repartition(5)
    own = {m: s for m, s in sets.items() if m < 300}
    for iou in (0.5, 0.85):
        want = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) / len(own[a] | own[b]) > iou}
        got = masks.pairwise_iou(df.filter("mask_id < 300"), iou)
        assert {(r["a"], r["b"]) for r in got.collect()} == want
    for iou in (0.15, 0.5, 0.85):
        assert {r["mask_id"] for r in masks.suppress(df, iou).collect()} == _greedy(sets, iou)
    sizes = masks.mask_area(df, ["image_id", "mask_id"])
    assert masks.overlap_candidates(df.distinct(), sizes, 0.85).count() < 0.5 * 50 * 49 / 2 + 2 * len(want) + 50 * 49 / 2
    assert masks.suppress(df.limit(0), 0.85).count() == 0


def test_reports_round_halves_to_even_and_keep_errors(spark, tmp_path):
    import json

    from silverleaf.operators import responses

    corner = "array<struct<x:double,y:double>>"
    rows = [(1, "a.png", 2, "o2", [(0.25, 0.75)], None, None, None, None), (1, "a.png", 1, None, None, None, None, None, "no \"mask\""), (2, "b.png", 1, "o1", [(1.0, 2.04)], [(0.35, -0.25)], False, (3, [0.5]), None)]
    items = spark.createDataFrame(rows, f"image_id long, input string, idx int, output string, vertices {corner}, area_vertices {corner}, used_area_fallback boolean, white_balance struct<white_blocks:int,gains_rgb:array<double>>, error string")
    out = responses.report_json(items, responses.report_settings(False, False, "light"))
    responses.write_reports(out, str(tmp_path / "r"))
    got = {r["input"]: r for r in map(json.loads, (r.value for r in spark.read.text(str(tmp_path / "r")).collect()))}
    assert got["a.png"]["outputs"] == [{"index": 1, "error": 'no "mask"'}, {"index": 2, "output": "o2", "vertices": [[0.2, 0.8]], "area_vertices": None, "used_area_fallback": None, "white_balance": None}]
    assert got["b.png"]["outputs"][0]["area_vertices"] == [[0.4, -0.2]] and got["b.png"]["outputs"][0]["white_balance"] == {"white_blocks": 3, "gains_rgb": [0.5]}
    assert got["a.png"]["paper_count"] == 2 and got["a.png"]["denoise"] == {"enabled": False, "algorithm": None, "l_h": None, "ab_h": None, "position": None} and got["a.png"]["sharpen"]["mode"] == "light"
    assert responses.report_json(items.limit(0), responses.report_settings(True, True, "off")).count() == 0


def test_last_record_wins(spark, tmp_path):
    import os

    from silverleaf.operators import responses
    from silverleaf.sources import files

    for name, at, text in (("b.json", 100, '[{"image_id":"x","n":1},{"image_id":"x","n":2},5,{"n":9}]'), ("a.json", 200, '[{"image_id":"x","n":3}]'), ("c.json", 50, '[{"image_id":"x","n":4},{"image_id":"y","n":5}]')):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (at, at))
    assert sorted((r["image_id"], r["n"]) for r in files.scan_audit(spark, str(tmp_path), "image_id string, n int").collect()) == [("x", 3), ("y", 5)]
    old = spark.createDataFrame([(1, 0, "old"), (2, 0, "old")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (3, 1, "c")], "k int, at int, v string")
    assert sorted((r["k"], r["v"]) for r in responses.upsert(old, new, "k", ["at"]).collect()) == [(1, "b"), (2, "old"), (3, "c")]
    assert responses.upsert(old, new, "k").count() == 4


@pytest.mark.parametrize("size", [3, 8, 64])
def test_tiles_exchange_borders(spark, size):
    """Halos wider than a tile, images that no tile size divides, several bands; blur and dilation equal those on pixels."""
    import numpy as np

    from silverleaf.operators import masks, rasters, tiles

    rng, height, width = np.random.default_rng(7), 13, 19
    a = rng.integers(0, 256, (2, height, width))
    px = spark.createDataFrame([(i, y, x, int(a[i, y, x]), int(a[i, y, x] > 235)) for i in range(2) for y in range(height) for x in range(width)], "image_id long, y int, x int, v int, m int").repartition(4)
    cut = tiles.tile_pixels(px, ["v", "m"], size)
    back = {(r["image_id"], r["band"], r["y"], r["x"]): r["value"] for r in tiles.tile_values(cut, size).collect()}
    assert len(back) == 4 * height * width and all(back[i, "v", y, x] == a[i, y, x] for i in range(2) for y in range(height) for x in range(width))
    blurred = {(r["image_id"], r["y"], r["x"]): r["value"] for r in tiles.tile_values(tiles.blur_tiles(cut.filter("band = 'v'"), 1.3, height, width, size), size).collect()}
    want = {(r["image_id"], r["y"], r["x"]): r["blur"] for r in rasters.blur(px, "v", 1.3, height, width).collect()}
    assert blurred.keys() == want.keys() and all(abs(blurred[k] - want[k]) < 1e-9 for k in want)
    wide = tiles.tile_values(tiles.dilate_tiles(cut.filter("band = 'm'"), masks.ellipse(2), height, width, size), size).filter("value = 1").select("image_id", "y", "x")
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, masks.dilate(px.filter("m = 1"), 2, height, width).collect()))
    assert tiles.tile_pixels(px.limit(0), ["v"], size).count() == 0
