"""Queries over the given tables and their DuckDB counterparts, side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import fitting, masks, rasters, responses, sweep
from ..sources import files
from ..streaming import streams
from . import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
r4 = lambda c: X.rounded(c, 4)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


@query("response_summary", f"WITH {V.RESPONSES} SELECT coalesce(reason, 'valid') reason, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN m = 0 THEN 'null' WHEN date IS NULL THEN 'unreadable' ELSE 'date' END outcome, count(*) n FROM resp GROUP BY ALL")
def response_summary(spark, d):
    return responses.validate_responses(V.responses(spark, d)).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason"), "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("response_validation", f"WITH {V.RESPONSES} SELECT o_orderkey, CASE WHEN reason IS NULL AND m <> 0 THEN concat_ws(',', CASE WHEN m = 1 THEN 8 ELSE 8 END, 25, CAST(ceil(x / 1000.0e0 * 800) AS INT), CASE WHEN m = 1 THEN CAST(ceil(60 / 1000.0e0 * 1272) AS INT) ELSE 1272 END) END box, CASE WHEN reason IS NULL AND m <> 0 THEN date END date FROM resp WHERE reason IS NULL")
def response_validation(spark, d):
    return responses.split_valid(responses.validate_responses(V.responses(spark, d)))[0].select("o_orderkey", F.array_join("box", ",").alias("box"), "date")


@query("response_quarantine", f"WITH {V.RESPONSES} SELECT o_orderkey, reason FROM resp WHERE reason IS NOT NULL")
def response_quarantine(spark, d):
    return responses.split_valid(responses.validate_responses(V.responses(spark, d)))[1].select("o_orderkey", "reason")


@query("plan_resume", "SELECT page_id image_id, CASE WHEN page_id % 3 <> 0 THEN 'todo' WHEN page_id % 6 = 0 THEN 'audited' WHEN page_id % 5 = 0 THEN 'recovered' ELSE 'skipped_existing' END status FROM pages")
def plan_resume(spark, d):
    p = V.table(spark, d, "pages").select(F.col("page_id").alias("image_id"))
    return responses.plan_resume(p, p.filter("image_id % 3 = 0"), p.filter("image_id % 6 = 0"), p.filter("image_id % 5 = 0"))


@query("audit_upsert", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS amount FROM orders")
def audit_upsert(spark, d):
    old = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    return responses.upsert(old, old.filter("key % 3 = 0").withColumn("amount", F.col("amount") * 2), "key")


@query("audit_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def audit_latest(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return responses.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


ITEMS = "items AS (SELECT l_suppkey image_id, l_partkey mask_id, round(avg(l_quantity), 4) cx, round(avg(l_discount), 4) cy FROM lineitem GROUP BY ALL)"


def _items(spark, d):
    return V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("mask_id")).agg(r4(F.avg("l_quantity")).alias("cx"), r4(F.avg("l_discount")).alias("cy"))


@query("number_items", f"WITH {ITEMS}, t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cx, cy, mask_id) idx FROM items) SELECT image_id, mask_id, CAST(idx AS INT) idx, printf('p%02d', idx) AS name FROM t")
def number_items(spark, d):
    return masks.number_items(_items(spark, d)).select("image_id", "mask_id", "idx", "name")


REPORT = f"WITH {ITEMS}, t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cx, cy, mask_id) idx FROM items), r AS (SELECT image_id, string_agg(printf('p%02d', idx), ',' ORDER BY idx) AS names, CAST(count(*) AS INT) item_count, CAST(count(*) FILTER (WHERE mask_id % 7 = 0) AS INT) error_count FROM t GROUP BY 1)"


def _reports(spark, d):
    items = masks.number_items(_items(spark, d)).withColumn("error", F.when(F.col("mask_id") % 7 == 0, "unreadable"))
    return responses.build_reports(items)


@query("build_reports", REPORT + " SELECT image_id, names, item_count, error_count FROM r")
def build_reports(spark, d):
    return _reports(spark, d).select("image_id", F.array_join("outputs.name", ",").alias("names"), "item_count", "error_count")


ROUNDED = ", ".join(f"[round_even(x{i}, 1), round_even(y{i}, 1)]" for i in range(4))
SHRUNK = ", ".join(f"x{i} + ((x0 + x1 + x2 + x3) / 4 - x{i}) * 0.03e0 x{i}, y{i} + ((y0 + y1 + y2 + y3) / 4 - y{i}) * 0.03e0 y{i}" for i in range(4))


@query("report_json", f"""WITH {V.QUADS}, s AS (SELECT quad_id, {SHRUNK} FROM quads), i AS (SELECT quad_id // 10 image_id, quad_id % 10 idx, CASE WHEN quad_id % 7 = 0 THEN '{{"index":' || (quad_id % 10) || ',"error":"no mask"}}'
 ELSE '{{"index":' || (quad_id % 10) || ',"output":"out/' || (quad_id // 10) || '_p0' || (quad_id % 10) || '.png","vertices":' || replace(CAST([{ROUNDED}] AS VARCHAR), ' ', '') || ',"area_vertices":' || CASE WHEN quad_id % 3 = 0 THEN 'null' ELSE replace(CAST([{ROUNDED}] AS VARCHAR), ' ', '') END
 || ',"used_area_fallback":' || CASE WHEN quad_id % 3 = 0 THEN 'null' ELSE CAST(quad_id % 10 = 0 AS VARCHAR) END || ',"white_balance":' || CASE WHEN quad_id % 3 = 0 THEN 'null' ELSE '{{"white_blocks":' || quad_id || '}}' END || '}}' END t FROM s)
 SELECT image_id, '{{"input":"scan ' || image_id || '.png","white_balance":true,"denoise":{{"enabled":true,"algorithm":"LAB per-channel fastNlMeansDenoising","l_h":3.5,"ab_h":6.0,"position":"after white_balance"}},"sharpen":{{"mode":"off","position":"after denoise","algorithm":null}},"paper_count":' || count(*) || ',"outputs":[' || string_agg(t, ',' ORDER BY idx) || ']}}' report FROM i GROUP BY image_id""")
def report_json(spark, d):
    image, idx = F.floor(F.col("quad_id") / 10), (F.col("quad_id") % 10).cast("int")
    some = lambda c: F.when(F.col("quad_id") % 3 != 0, c)
    v = X.shrink_quad(F.col("v"), 0.03)
    items = V.quads(spark, d).select(image.alias("image_id"), F.concat(F.lit("scan "), image.cast("string"), F.lit(".png")).alias("input"), idx.alias("idx"), F.format_string("out/%d_p%02d.png", image, idx).alias("output"), v.alias("vertices"), some(v).alias("area_vertices"),
        some(F.col("quad_id") % 10 == 0).alias("used_area_fallback"), some(F.struct(F.col("quad_id").alias("white_blocks"))).alias("white_balance"), F.when(F.col("quad_id") % 7 == 0, "no mask").alias("error"))
    return responses.report_json(items, responses.report_settings(True, True, "off"))


@query("run_summary", REPORT + " SELECT count(*) image_count, CAST(sum(item_count) AS BIGINT) item_count, CAST(sum(error_count) AS BIGINT) error_count FROM r")
def run_summary(spark, d):
    return responses.run_summary(_reports(spark, d))


@query("flatten_envelope", "SELECT CAST(s_suppkey AS VARCHAR) instance_id, 'USD' currency, CAST(s_suppkey * 3 AS VARCHAR) remaining_amount, s_name status FROM supplier WHERE s_nationkey % 5 <> 0")
def flatten_envelope(spark, d):
    s = V.table(spark, d, "supplier")
    item = F.struct(F.col("s_suppkey").cast("string").alias("InstanceID"), F.lit("USD").alias("Currency"), (F.col("s_suppkey") * 3).cast("string").alias("RemainingAmount"), F.col("s_name").alias("Status"))
    e = s.groupBy("s_nationkey").agg(F.collect_list(item).alias("Items")).select(F.to_json(F.struct((F.col("s_nationkey") % 5 != 0).alias("Success"), F.lit("Success").alias("Code"), F.struct("Items").alias("Data"))).alias("text"))
    return responses.flatten_envelope(e)


@query("scan_assets", "SELECT page_id, split_part(url, '/', -1) AS name FROM pages WHERE lower(regexp_extract(split_part(url, '/', -1), '\\.([^.]+)$', 1)) IN ('html', 'htm', 'png')")
def scan_assets(spark, d):
    return files.with_names(V.table(spark, d, "pages"), "url").filter(F.col("ext").isin("html", "htm", "png")).select("page_id", "name")


STEMS = "SELECT CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END stem, p_partkey FROM part"
NATURAL = "CASE WHEN regexp_matches(stem, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(stem AS DECIMAL(38, 0)), lower(stem), stem, p_partkey"


def _stems(spark, d):
    return V.table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_name")).alias("stem"), "p_partkey").withColumn("name", F.col("stem"))


@query("natural_order", f"SELECT stem, p_partkey, row_number() OVER (ORDER BY {NATURAL}) AS rank FROM ({STEMS})")
def natural_order(spark, d):
    return files.natural_rank(_stems(spark, d), "p_partkey").select("stem", "p_partkey", "rank")


@query("limit_inputs", f"SELECT * FROM ({STEMS}) ORDER BY {NATURAL} LIMIT 50")
def limit_inputs(spark, d):
    return files.limit_inputs(files.natural_order(_stems(spark, d), "p_partkey"), 50).select("stem", "p_partkey")


@query("sample_rows", "SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500")
def sample_rows(spark, d):
    return files.sample_rows(V.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, 42)


@query("data_url", "SELECT page_id, md5('data:text/html;base64,' || base64(encode(html))) AS url_md5 FROM pages")
def data_url(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.md5(X.data_url(F.col("html").cast("binary"), "text/html")).alias("url_md5"))


@query("canonical_query", "SELECT page_id, coalesce(array_to_string(list_sort(list_transform(list_filter(string_split(CASE WHEN contains(url, '?') THEN split_part(url, '?', -1) ELSE '' END, '&'), lambda p: p <> ''), lambda p: url_encode(split_part(p, '=', 1)) || '=' || url_encode(CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE '' END))), '&'), '') AS q FROM pages")
def canonical_query(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.canonical_query(F.col("url")).alias("q"))


# masks
@query("mask_area", f"WITH {V.SETS} SELECT image_id, mask_id, count(*) n FROM sets GROUP BY ALL")
def mask_area(spark, d):
    return masks.mask_area(V.sets(spark, d), ["image_id", "mask_id"])


@query("min_area", f"WITH {V.SETS}, i AS (SELECT image_id, count(DISTINCT cell) cells FROM sets GROUP BY 1), a AS (SELECT image_id, mask_id, count(*) n FROM sets GROUP BY ALL) SELECT image_id, mask_id, n FROM a JOIN i USING (image_id) WHERE n >= cells * 0.25e0")
def min_area(spark, d):
    s = V.sets(spark, d)
    return masks.min_area(s, s.groupBy("image_id").agg(F.countDistinct("cell").alias("cells")), 0.25)


@query("largest_mask", f"WITH {V.SETS}, a AS (SELECT image_id, mask_id, count(*) n FROM sets GROUP BY ALL) SELECT image_id, mask_id, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, mask_id) rn FROM a) WHERE rn = 1")
def largest_mask(spark, d):
    return masks.largest_mask(V.sets(spark, d))


def iou_sql(sets: str) -> str:
    return f"""WITH RECURSIVE {sets}, a AS (SELECT image_id, mask_id, count(*) n FROM sets GROUP BY ALL), k AS (SELECT s.image_id, s.mask_id a, t.mask_id b, count(*) k FROM sets s JOIN sets t ON s.image_id = t.image_id AND s.cell = t.cell AND s.mask_id < t.mask_id GROUP BY ALL),
 iou AS (SELECT k.image_id, k.a, k.b, k / (p.n + q.n - k)::DOUBLE iou FROM k JOIN a p ON p.image_id = k.image_id AND p.mask_id = k.a JOIN a q ON q.image_id = k.image_id AND q.mask_id = k.b)"""


IOU = iou_sql(V.SETS)


@query("pairwise_iou", IOU + " SELECT image_id, a, b, round(iou, 4) iou FROM iou WHERE iou > 0.15")
def pairwise_iou(spark, d):
    return masks.pairwise_iou(V.sets(spark, d), 0.15).withColumn("iou", r4("iou"))


@query("suppress", IOU + """, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, mask_id) rn FROM a), step AS (SELECT image_id, 0::BIGINT rn, []::BIGINT[] kept FROM (SELECT DISTINCT image_id FROM a)
 UNION ALL SELECT s.image_id, o.rn, CASE WHEN EXISTS (SELECT 1 FROM iou i WHERE i.image_id = s.image_id AND i.iou > 0.15 AND ((i.a = o.mask_id AND list_contains(s.kept, i.b)) OR (i.b = o.mask_id AND list_contains(s.kept, i.a)))) THEN s.kept ELSE list_append(s.kept, o.mask_id) END
 FROM step s JOIN o ON o.image_id = s.image_id AND o.rn = s.rn + 1), f AS (SELECT image_id, unnest(arg_max(kept, rn)) mask_id FROM step GROUP BY 1) SELECT f.image_id, f.mask_id, a.n FROM f JOIN a USING (image_id, mask_id)""")
def suppress(spark, d):
    return masks.suppress(V.sets(spark, d), 0.15)


@query("suppress_documents", iou_sql(V.SHINGLES) + """, e AS (SELECT * FROM iou WHERE iou > 0.85), o AS (SELECT mask_id, row_number() OVER (ORDER BY n DESC, mask_id) rn FROM a WHERE mask_id IN (SELECT a FROM e UNION SELECT b FROM e)),
 near AS (SELECT x.rn, list(y.rn) earlier FROM (SELECT a p, b q FROM e UNION ALL SELECT b, a FROM e) JOIN o x ON x.mask_id = p JOIN o y ON y.mask_id = q WHERE y.rn < x.rn GROUP BY 1), step AS (SELECT 0::BIGINT rn, []::BIGINT[] kept
 UNION ALL SELECT o.rn, CASE WHEN list_has_any(coalesce(earlier, []), s.kept) THEN s.kept ELSE list_append(s.kept, o.rn) END FROM step s JOIN o ON o.rn = s.rn + 1 LEFT JOIN near ON near.rn = o.rn), f AS (SELECT unnest(arg_max(kept, rn)) rn FROM step)
 SELECT a.mask_id, a.n FROM a LEFT JOIN o USING (mask_id) WHERE o.rn IS NULL OR o.rn IN (SELECT rn FROM f)""")
def suppress_documents(spark, d):
    return masks.suppress_sets(V.shingle_sets(spark, d), 0.85).select("mask_id", "n")


MASKS = f"WITH {V.RASTER}, m AS (SELECT DISTINCT image_id, y, x FROM raster WHERE p > 0.9), k AS (SELECT DISTINCT image_id, y, x FROM raster WHERE v > 215)"


def _cells(spark, d):
    r = V.raster(spark, d)
    return r.filter("p > 0.9").select("image_id", "y", "x").distinct(), r.filter("v > 215").select("image_id", "y", "x").distinct()


for _name, _sql in (("and", "SELECT * FROM m INTERSECT SELECT * FROM k"), ("or", "SELECT * FROM m UNION SELECT * FROM k"), ("minus", "SELECT * FROM m EXCEPT SELECT * FROM k"), ("xor", "(SELECT * FROM m EXCEPT SELECT * FROM k) UNION ALL (SELECT * FROM k EXCEPT SELECT * FROM m)")):
    query(f"mask_{_name}", f"{MASKS} {_sql}")(lambda spark, d, f=getattr(masks, f"mask_{_name}"): f(*_cells(spark, d)))

OFFSETS = "o AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) dy) CROSS JOIN (SELECT unnest(range(-3, 4)) dx) WHERE abs(dx) <= round(sqrt(9 - dy * dy)))"


@query("dilate", f"{MASKS}, {OFFSETS} SELECT DISTINCT image_id, CAST(y + dy AS INT) y, CAST(x + dx AS INT) x FROM m CROSS JOIN o WHERE y + dy BETWEEN 0 AND 79 AND x + dx BETWEEN 0 AND 79")
def dilate(spark, d):
    return masks.dilate(_cells(spark, d)[0], 3, V.HEIGHT, V.WIDTH)


@query("erode", f"WITH {V.RASTER}, m AS (SELECT DISTINCT image_id, y, x FROM raster WHERE p > 0.02), {OFFSETS.replace('-3, 4', '-1, 2').replace('9 -', '1 -')}, g AS (SELECT image_id, y, x FROM (SELECT DISTINCT image_id FROM m), (SELECT unnest(range(0, 80)) y), (SELECT unnest(range(0, 80)) x)), n AS (SELECT g.* FROM g ANTI JOIN m USING (image_id, y, x)) SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM n JOIN o ON true WHERE n.image_id = m.image_id AND n.y = m.y + dy AND n.x = m.x + dx)")
def erode(spark, d):
    return masks.erode(V.raster(spark, d).filter("p > 0.02").select("image_id", "y", "x"), 1, V.HEIGHT, V.WIDTH)


@query("within_distance", f"{MASKS} SELECT DISTINCT m.image_id, m.y, m.x FROM m JOIN k ON m.image_id = k.image_id WHERE (m.y - k.y) * (m.y - k.y) + (m.x - k.x) * (m.x - k.x) < 16")
def within_distance(spark, d):
    return masks.within_distance(*_cells(spark, d), 4)


# rasters
BLOCKS = f"""WITH {V.RGB}, w AS (SELECT *, (r > 170 AND g > 170 AND b > 170 AND sqrt(((r - (r+g+b)/3.0e0)^2 + (g - (r+g+b)/3.0e0)^2 + (b - (r+g+b)/3.0e0)^2) / 3.0e0) < 8) white FROM rgb),
 s AS (SELECT unnest(range(0, 72, 4)) s), blk AS (SELECT image_id, CAST(a.s AS INT) AS "by", CAST(c.s AS INT) AS bx, count(*) FILTER (WHERE white) / 64.0e0 share, avg(r) FILTER (WHERE white) mean_r, avg(g) FILTER (WHERE white) mean_g, avg(b) FILTER (WHERE white) mean_b,
 (var_pop(r) FILTER (WHERE white) + var_pop(g) FILTER (WHERE white) + var_pop(b) FILTER (WHERE white)) / 3.0e0 AS var FROM w JOIN s a ON y >= a.s AND y < a.s + 8 JOIN s c ON x >= c.s AND x < c.s + 8 GROUP BY ALL HAVING count(*) FILTER (WHERE white) > 32)"""


def _blocks(spark, d):
    return rasters.block_stats(V.raster_rgb(spark, d), 8, 4, X.is_white(F.col("r"), F.col("g"), F.col("b"), spread=8.0), 0.5, V.HEIGHT, V.WIDTH)


@query("block_stats", BLOCKS + ' SELECT image_id, "by", bx, round(share, 4) share, round(mean_r, 4) mean_r, round(mean_g, 4) mean_g, round(mean_b, 4) mean_b, round(var, 3) var FROM blk')
def block_stats(spark, d):
    return _blocks(spark, d).select("image_id", "by", "bx", *[r4(c).alias(c) for c in ("share", "mean_r", "mean_g", "mean_b")], X.rounded("var", 3).alias("var"))


@query("top_k_blocks", BLOCKS + ', t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(var, 4), "by", bx) rn FROM blk) SELECT image_id, "by", bx, CAST(rn AS INT) rn FROM t WHERE rn <= 10')
def top_k_blocks(spark, d):
    return rasters.top_k(_blocks(spark, d), ["image_id"], [r4("var"), "by", "bx"], 10).select("image_id", "by", "bx", "rn")


GAINS = BLOCKS + """, t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY var, "by", bx) rn FROM blk), ref AS (SELECT image_id, avg(mean_r) r, avg(mean_g) g, avg(mean_b) b FROM t WHERE rn <= 10 GROUP BY 1),
 gain AS (SELECT i.image_id, coalesce(least(2.0e0, greatest(0.5e0, 240.0e0 / greatest(r, 1.0e0))), 1.0e0) gain_r, coalesce(least(2.0e0, greatest(0.5e0, 240.0e0 / greatest(g, 1.0e0))), 1.0e0) gain_g, coalesce(least(2.0e0, greatest(0.5e0, 240.0e0 / greatest(b, 1.0e0))), 1.0e0) gain_b FROM (SELECT DISTINCT image_id FROM rgb) i LEFT JOIN ref USING (image_id))"""


def _gains(spark, d):
    return rasters.white_gains(_blocks(spark, d), V.raster_rgb(spark, d).select("image_id").distinct())


@query("white_gains", GAINS + " SELECT image_id, round(gain_r, 4) gain_r, round(gain_g, 4) gain_g, round(gain_b, 4) gain_b FROM gain")
def white_gains(spark, d):
    return _gains(spark, d).select("image_id", *[r4(f"gain_{c}").alias(f"gain_{c}") for c in "rgb"])


@query("white_balance", GAINS + " SELECT image_id, avg(least(255, floor(r * round(gain_r, 4)))) r, avg(least(255, floor(g * round(gain_g, 4)))) g, avg(least(255, floor(b * round(gain_b, 4)))) b FROM rgb JOIN gain USING (image_id) GROUP BY 1")
def white_balance(spark, d):
    gains = _gains(spark, d).select("image_id", *[r4(f"gain_{c}").alias(f"gain_{c}") for c in "rgb"])
    return rasters.balance(V.raster_rgb(spark, d), gains).groupBy("image_id").agg(*[F.avg(c).alias(c) for c in "rgb"])


@query("region_stats", f"WITH {V.RGB} SELECT image_id, y // 20 AS region, count(*) n, round(avg(r), 4) mean_r, round(stddev_pop(r), 4) std_r, round(avg(g), 4) mean_g, round(stddev_pop(g), 4) std_g FROM rgb GROUP BY ALL")
def region_stats(spark, d):
    px = V.raster_rgb(spark, d).withColumn("region", F.floor(F.col("y") / 20).cast("int"))
    return rasters.region_stats(px, ["image_id", "region"]).select("image_id", "region", "n", *[r4(f"{k}_{c}").alias(f"{k}_{c}") for c in "rg" for k in ("mean", "std")])


@query("reorient", f"WITH {V.RASTER} SELECT image_id, CAST(CASE image_id % 8 + 1 WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 79 - y WHEN 4 THEN 79 - y WHEN 5 THEN x WHEN 6 THEN x ELSE 79 - x END AS INT) y, CAST(CASE image_id % 8 + 1 WHEN 1 THEN x WHEN 4 THEN x WHEN 2 THEN 79 - x WHEN 3 THEN 79 - x WHEN 5 THEN y WHEN 8 THEN y ELSE 79 - y END AS INT) x, v FROM raster")
def reorient(spark, d):
    return rasters.reorient(V.raster(spark, d).select("image_id", "y", "x", "v"), F.col("image_id") % 8 + 1, V.HEIGHT, V.WIDTH).select("image_id", "y", "x", "v")


GAUSS = "k AS (SELECT d, exp(-(d * d) / 2.0e0) / (SELECT sum(exp(-(t.e * t.e) / 2.0e0)) FROM (SELECT unnest(range(-4, 5)) e) t) wt FROM (SELECT unnest(range(-4, 5)) d))"
MIRROR = lambda c: f"CASE WHEN {c} < 0 THEN -({c}) - 1 WHEN {c} > 79 THEN 159 - ({c}) ELSE {c} END"
BLUR = f"WITH {V.RASTER}, {GAUSS}, h AS (SELECT t.image_id, t.y, t.x, sum(s.v * wt) v FROM raster t CROSS JOIN k JOIN raster s ON s.image_id = t.image_id AND s.y = t.y AND s.x = {MIRROR('t.x + d')} GROUP BY ALL), b AS (SELECT t.image_id, t.y, t.x, sum(s.v * wt) v FROM h t CROSS JOIN k JOIN h s ON s.image_id = t.image_id AND s.x = t.x AND s.y = {MIRROR('t.y + d')} GROUP BY ALL)"


@query("blur", BLUR + " SELECT image_id, y, x, round(v, 3) blur FROM b")
def blur(spark, d):
    return rasters.blur(V.raster(spark, d), "v", 1.0, V.HEIGHT, V.WIDTH).withColumn("blur", X.rounded("blur", 3))


# sweep
TH = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]
SWEEP = f"""WITH {V.RASTER}, s AS (SELECT image_id, CASE {' '.join(f'WHEN p > {t}e0 THEN {i}' for i, t in enumerate(TH))} END ti FROM raster), g AS (SELECT image_id, ti FROM (SELECT DISTINCT image_id FROM raster), (SELECT unnest(range(0, 8)) ti)),
 n AS (SELECT g.image_id, g.ti, count(s.ti) n_new FROM g LEFT JOIN s ON s.image_id = g.image_id AND s.ti = g.ti GROUP BY ALL), c AS (SELECT *, CAST(sum(n_new) OVER (PARTITION BY image_id ORDER BY ti) AS BIGINT) n_cur FROM n), w AS (SELECT *, coalesce(lag(n_cur) OVER (PARTITION BY image_id ORDER BY ti), 0) n_prev FROM c),
 r AS (SELECT *, coalesce(n_new / nullif(n_prev + n_new, 0)::DOUBLE, 0.0e0) growth FROM w), q AS (SELECT *, CASE WHEN ti = 0 THEN 'base' WHEN n_new = 0 THEN 'accept' WHEN growth > 0.18 THEN 'reject' ELSE 'accept' END decision FROM r)"""


def _steps(spark, d):
    return sweep.stopping_rule(sweep.threshold_sweep(V.raster(spark, d), TH), 0.18)


@query("threshold_sweep", SWEEP + " SELECT image_id, CAST(ti AS INT) ti, n_new, n_cur, n_prev, round(growth, 4) growth, decision FROM q")
def threshold_sweep(spark, d):
    return _steps(spark, d).withColumn("growth", r4("growth"))


@query("select_step", SWEEP + " SELECT image_id, CAST(least(7, greatest(0, coalesce(min(ti) FILTER (WHERE decision = 'reject'), 8) - 1 + 1)) AS INT) chosen FROM q GROUP BY 1")
def select_step(spark, d):
    return sweep.select_step(_steps(spark, d), 8, 1)


DET = "det AS (SELECT user_id image_id, event_type prompt, value / 330.0e0 score FROM events)"


def _det(spark, d):
    return V.table(spark, d, "events").select(F.col("user_id").alias("image_id"), F.col("event_type").alias("prompt"), (F.col("value") / 330.0).alias("score"))


TRIALS = [(0, "purchase", 0.5), (1, "view", 0.5), (2, "click", 0.4), (3, "signup", 0.4)]


@query("first_success", f"WITH {DET}, t(ord, prompt, threshold) AS (VALUES {', '.join(str(t) for t in TRIALS)}), h AS (SELECT image_id, ord, count(*) n FROM det JOIN t USING (prompt) WHERE score > threshold GROUP BY ALL), b AS (SELECT image_id, min(ord) AS ord, arg_min(n, ord) n FROM h GROUP BY 1) SELECT i.image_id, CAST(b.ord AS INT) AS ord, coalesce(b.n, 0) n FROM (SELECT DISTINCT user_id image_id FROM events) i LEFT JOIN b USING (image_id)")
def first_success(spark, d):
    det = _det(spark, d)
    return sweep.first_success(det, spark.createDataFrame(TRIALS, "ord int, prompt string, threshold double"), det.select("image_id").distinct())


@query("probe_base", f"WITH {DET} SELECT image_id, CASE WHEN max(score) > 0.5 THEN 0.6338e0 WHEN max(score) > 0.4 THEN 0.5e0 WHEN max(score) > 0.3 THEN 0.4e0 WHEN max(score) > 0.2 THEN 0.3e0 WHEN max(score) > 0.1 THEN 0.2e0 ELSE 0.1e0 END AS base FROM det GROUP BY 1")
def probe_base(spark, d):
    return sweep.probe_base(_det(spark, d), [0.5, 0.4, 0.3, 0.2, 0.1], 0.6338, 0.1)


# points and quads
@query("order_quad", f"WITH {V.CONTOUR}, p AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY x + y, x, y) a, row_number() OVER (PARTITION BY group_id ORDER BY x - y DESC, x DESC, y DESC) b, row_number() OVER (PARTITION BY group_id ORDER BY x + y DESC, x DESC, y DESC) c, row_number() OVER (PARTITION BY group_id ORDER BY x - y, x, y) e FROM contour) SELECT group_id, max(x) FILTER (WHERE a = 1) tlx, max(y) FILTER (WHERE a = 1) tly, max(x) FILTER (WHERE b = 1) trx, max(y) FILTER (WHERE c = 1) bry, max(x) FILTER (WHERE e = 1) blx FROM p GROUP BY 1")
def order_quad(spark, d):
    return fitting.order_quad(V.contour(spark, d)).select("group_id", F.col("tl.x").alias("tlx"), F.col("tl.y").alias("tly"), F.col("tr.x").alias("trx"), F.col("br.y").alias("bry"), F.col("bl.x").alias("blx"))


NORM = "coalesce(regr_slope(w, u), avg(w) * avg(u) / (avg(u) * avg(u) + 1)) m, coalesce(regr_intercept(w, u), avg(w) / (avg(u) * avg(u) + 1)) b"


def consensus_sql(keys: str, reach: float, block: int = fitting.BLOCK) -> str:
    """CTEs from ``own`` (keys, pid, u, w) to ``best`` (keys, trial, k, m, b): five numbered points a trial, most votes, first trial."""
    text = " || '|' || ".join(keys.split(", "))
    draw = " UNION ALL ".join(f"SELECT {keys}, n, trial, n * {j} // 5 + CAST((start + 5 * trial + {j}) * {fitting.MULTIPLIER}::HUGEINT % 18446744073709551616::HUGEINT // 65536 AS BIGINT) % (n * {j + 1} // 5 - n * {j} // 5) AS spot FROM tr" for j in range(5))
    return f""" sized AS (SELECT *, count(*) OVER (PARTITION BY {keys}) n FROM own QUALIFY n >= 5),
 num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pid % CAST(ceil(n / {block}.0e0) AS BIGINT), pid) - 1 AS spot FROM sized),
 tr AS (SELECT *, unnest(range(least(500, 10 * n))) trial FROM (SELECT DISTINCT {keys}, n, CAST('0x' || substr(sha256('42|' || {text}), 1, 12) AS HUGEINT) + 1 AS start FROM sized)),
 dr AS ({draw}), l AS (SELECT {keys}, trial, {NORM} FROM dr JOIN num USING ({keys}, spot) GROUP BY ALL),
 v AS (SELECT {keys}, trial, m, b, count(*) k FROM sized JOIN l USING ({keys}) WHERE abs(w - (m * u + b)) < {reach} GROUP BY ALL),
 best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY k DESC, trial) = 1)"""


@query("fit_line", f"WITH {V.CONTOUR} SELECT group_id, side, count(*) n, round(CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) END, 4) m, round(CASE WHEN var_pop(x) > 0 THEN regr_intercept(y, x) END, 4) b FROM contour GROUP BY ALL")
def fit_line(spark, d):
    return fitting.fit_line(V.contour(spark, d), ["group_id", "side"]).select("group_id", "side", "n", r4("m").alias("m"), r4("b").alias("b"))


@query("consensus_line", f"""WITH {V.OUTLINE}, own AS (SELECT group_id, side, pid, CASE WHEN side % 2 = 0 THEN x ELSE y END u, CASE WHEN side % 2 = 0 THEN y ELSE x END w FROM outline),{consensus_sql("group_id, side", 5)},
 near AS (SELECT group_id, side, u, w, best.m bm, best.b bb FROM own JOIN best USING (group_id, side) WHERE abs(w - (best.m * u + best.b)) < 5),
 r AS (SELECT group_id, side, any_value(bm) bm, any_value(bb) bb, count(*) n, {NORM} FROM near GROUP BY ALL) SELECT group_id, side, n inliers, round(CASE WHEN n >= 3 THEN m ELSE bm END, 4) + 0 m, round(CASE WHEN n >= 3 THEN b ELSE bb END, 3) + 0 b FROM r""")
def consensus_line(spark, d):
    c = V.outline(spark, d).withColumn("orient", F.when(F.col("side") % 2 == 0, "h").otherwise("v"))
    out = fitting.consensus_line(fitting.along_axes(c).drop("orient"), ["group_id", "side"], 42)
    return out.select("group_id", "side", "inliers", r4("m").alias("m"), X.rounded("b", 3).alias("b"))


@query("fit_line_sides", f"WITH {V.CONTOUR}, c AS (SELECT group_id, side, CASE WHEN side % 2 = 0 THEN x ELSE y END u, CASE WHEN side % 2 = 0 THEN y ELSE x END w FROM contour) SELECT group_id, side, count(*) n, round(regr_slope(w, u), 4) m, round(regr_intercept(w, u), 4) b FROM c GROUP BY ALL")
def fit_line_sides(spark, d):
    c = V.contour(spark, d).withColumn("orient", F.when(F.col("side") % 2 == 0, "h").otherwise("v"))
    return fitting.fit_line(fitting.along_axes(c), ["group_id", "side"]).select("group_id", "side", "n", r4("m").alias("m"), r4("b").alias("b"))


def quad_lines_sql(points: str, quads: str, near: float, reach: float) -> str:
    """CTEs from ``points`` (group_id, pid, x, y) and ``quads`` (group_id, x0, y0, ... x3, y3) to ``lines``, as ``robust_lines`` gives them."""
    side = " UNION ALL ".join(f"SELECT group_id, {i} edge, x{i} xa, y{i} ya, x{(i + 1) % 4} xb, y{(i + 1) % 4} yb FROM {quads}" for i in range(4))
    return f"""init AS ({side}),
 sl AS (SELECT *, abs(xb - xa) > abs(yb - ya) flat, CASE WHEN abs(xb - xa) > abs(yb - ya) THEN (yb - ya) / (xb - xa) ELSE coalesce((xb - xa) / nullif(yb - ya, 0), 0) END m FROM init),
 st AS (SELECT group_id, edge, flat, m, CASE WHEN flat THEN ya - m * xa ELSE xa - m * ya END b FROM sl),
 axes AS (SELECT c.group_id, edge, pid, m, b, CASE WHEN flat THEN x ELSE y END u, CASE WHEN flat THEN y ELSE x END w FROM {points} c JOIN st USING (group_id)),
 own AS (SELECT group_id, edge, pid, u, w FROM (SELECT *, abs(w - (m * u + b)) d FROM axes QUALIFY row_number() OVER (PARTITION BY group_id, pid ORDER BY d, edge) = 1) WHERE d < {near}),
 {consensus_sql("group_id, edge", reach)},
 model AS (SELECT st.group_id, st.edge, flat, coalesce(best.m, st.m) sm, coalesce(best.b, st.b) sb FROM st LEFT JOIN best USING (group_id, edge)),
 refit AS (SELECT group_id, edge, count(*) n, {NORM} FROM sized JOIN model USING (group_id, edge) WHERE abs(w - (sm * u + sb)) < {reach} GROUP BY ALL),
 lines AS (SELECT group_id, edge, flat, coalesce(refit.n, 0) inliers, CASE WHEN refit.n >= 3 THEN m ELSE sm END m, CASE WHEN refit.n >= 3 THEN b ELSE sb END b FROM model LEFT JOIN refit USING (group_id, edge))"""


START = f"{V.OUTLINE}, {V.QUADS}, start AS (SELECT quad_id - 1 group_id, * FROM quads)"
QUAD_LINES = f"{START}, {quad_lines_sql('outline', 'start', 80, 5)}"


def _start_quads(spark, d):
    return V.quads(spark, d).select((F.col("quad_id") - 1).alias("group_id"), "v")


@query("robust_lines", f"WITH {QUAD_LINES} SELECT group_id, edge, CASE WHEN flat THEN 'h' ELSE 'v' END orient, inliers, round(m, 4) + 0 m, round(b, 3) + 0 b FROM lines")
def robust_lines(spark, d):
    out = fitting.robust_lines(V.outline(spark, d), fitting.start_lines(_start_quads(spark, d)), 42)
    return out.select("group_id", "edge", "orient", "inliers", r4("m").alias("m"), X.rounded("b", 3).alias("b"))


def meet_sql(quads: str) -> str:
    """CTEs from ``lines`` and the quads they started at to ``corner`` (group_id, tlx, tly, ... bly)."""
    meet = " UNION ALL ".join(f"SELECT group_id, CASE WHEN abs(det) >= 1e-9 THEN px ELSE x{k} END x, CASE WHEN abs(det) >= 1e-9 THEN py ELSE y{k} END y FROM (SELECT p.group_id, p.a * q.b - q.a * p.b det, (p.b * q.c - q.b * p.c) / nullif(p.a * q.b - q.a * p.b, 0) px, (q.a * p.c - p.a * q.c) / nullif(p.a * q.b - q.a * p.b, 0) py FROM side_line p JOIN side_line q USING (group_id) WHERE p.edge = {i} AND q.edge = {j}) JOIN {quads} USING (group_id)" for k, (i, j) in enumerate([(0, 3), (0, 1), (2, 1), (2, 3)]))
    place = {"a": "x + y, x, y", "b": "x - y DESC, x DESC, y DESC", "c": "x + y DESC, x DESC, y DESC", "e": "x - y, x, y"}
    return f"""side_line AS (SELECT group_id, edge, CASE WHEN flat THEN m ELSE 1 END a, CASE WHEN flat THEN -1 ELSE -m END b, CASE WHEN flat THEN b ELSE -b END c FROM lines), met AS ({meet}),
 placed AS (SELECT *, {", ".join(f"row_number() OVER (PARTITION BY group_id ORDER BY {o}) {k}" for k, o in place.items())} FROM met),
 corner AS (SELECT group_id, {", ".join(f"max({z}) FILTER (WHERE {k} = 1) {n}{z}" for k, n in zip("abce", ("tl", "tr", "br", "bl")) for z in "xy")} FROM placed GROUP BY 1)"""


@query("quad_fit", f"WITH {QUAD_LINES}, {meet_sql('start')} SELECT group_id, " + ", ".join(f"round({n}{z}, 3) + 0 {n}{z}" for n in ("tl", "tr", "br", "bl") for z in "xy") + " FROM corner")
def quad_fit(spark, d):
    out = fitting.quad_fit(V.outline(spark, d), _start_quads(spark, d), 42)
    return out.select("group_id", *[X.rounded(F.col(f"{n}.{z}"), 3).alias(f"{n}{z}") for n in ("tl", "tr", "br", "bl") for z in "xy"])


SIDE = lambda a, b: f"sqrt((x{a} - x{b}) * (x{a} - x{b}) + (y{a} - y{b}) * (y{a} - y{b}))"


@query("rectify_quality", f"WITH {V.QUADS}, s AS (SELECT quad_id, {SIDE(0, 1)} t, {SIDE(1, 2)} r, {SIDE(2, 3)} b, {SIDE(3, 0)} l FROM quads), q AS (SELECT *, ((l + r) / 2) / ((t + b) / 2) a FROM s) SELECT quad_id, round(least(t, b) / greatest(t, b) * least(l, r) / greatest(l, r) * least(a, 1.35e0) / greatest(a, 1.35e0), 4) quality FROM q")
def rectify_quality(spark, d):
    return V.quads(spark, d).select("quad_id", r4(X.rectify_quality(F.col("v"))).alias("quality"))


DEV = [f"sqrt((x{i} - {x}e0) * (x{i} - {x}e0) + (y{i} - {y}e0) * (y{i} - {y}e0))" for i, (x, y) in enumerate(V.TEMPLATE)]


@query("template_fallback", f"WITH {V.QUADS}, q AS (SELECT *, greatest({', '.join(DEV)}) top, ({' + '.join(DEV)}) / 4 mean FROM quads) SELECT quad_id, round(top, 4) max_dev, round(mean, 4) mean_dev, top > 150 fallback, CASE WHEN top > 150 THEN 55.0e0 ELSE x0 END x0 FROM q")
def template_fallback(spark, d):
    q = V.quads(spark, d)
    top, mean = X.corner_deviation(F.col("v"), V.TEMPLATE)
    return q.select("quad_id", r4(top).alias("max_dev"), r4(mean).alias("mean_dev"), (top > 150).alias("fallback"), F.when(top > 150, 55.0).otherwise(F.col("v")[0]["x"]).alias("x0"))


@query("shrink_quad", f"WITH {V.QUADS} SELECT quad_id, round(x0 + ((x0 + x1 + x2 + x3) / 4 - x0) * 0.03e0, 4) x0, round(y2 + ((y0 + y1 + y2 + y3) / 4 - y2) * 0.03e0, 4) y2 FROM quads")
def shrink_quad(spark, d):
    s = V.quads(spark, d).select("quad_id", X.shrink_quad(F.col("v"), 0.03).alias("v"))
    return s.select("quad_id", r4(F.col("v")[0]["x"]).alias("x0"), r4(F.col("v")[2]["y"]).alias("y2"))


CROSS = [f"(x{(i + 1) % 4} - x{i}) * (y - y{i}) - (y{(i + 1) % 4} - y{i}) * (x - x{i})" for i in range(4)]


CROSS_Q = [f"(q.x{(i + 1) % 4} - q.x{i}) * (p.y - q.y{i}) - (q.y{(i + 1) % 4} - q.y{i}) * (p.x - q.x{i})" for i in range(4)]


@query("points_inside_quad", f"WITH {V.CONTOUR}, {V.QUADS} SELECT group_id, count(*) FILTER (WHERE least({', '.join(CROSS)}) >= 0 OR greatest({', '.join(CROSS)}) <= 0) n FROM contour JOIN quads ON quad_id = group_id + 1 GROUP BY 1")
def points_inside_quad(spark, d):
    j = V.contour(spark, d).join(V.quads(spark, d), F.col("quad_id") == F.col("group_id") + 1)
    return j.groupBy("group_id").agg(F.count_if(X.inside_quad(F.col("x"), F.col("y"), F.col("v"))).alias("n"))


@query("line_intersection", f"WITH {V.QUADS}, l AS (SELECT quad_id, (y1 - y0) / (x1 - x0) mh, y0 - (y1 - y0) / (x1 - x0) * x0 bh, (x3 - x0) / (y3 - y0) mv, x0 - (x3 - x0) / (y3 - y0) * y0 bv FROM quads) SELECT quad_id, round((mv * bh + bv) / (1.0e0 - mv * mh), 3) x, round(mh * ((mv * bh + bv) / (1.0e0 - mv * mh)) + bh, 3) y FROM l")
def line_intersection(spark, d):
    v = F.col("v")
    q = V.quads(spark, d).select("quad_id", X.line_from_points(v[0]["x"], v[0]["y"], v[1]["x"], v[1]["y"]).alias("h"), X.line_from_points(v[0]["x"], v[0]["y"], v[3]["x"], v[3]["y"]).alias("w"))
    return q.withColumn("p", X.intersect_lines(F.col("h.m"), F.col("h.b"), F.col("w.m"), F.col("w.b"))).select("quad_id", X.rounded("p.x", 3).alias("x"), X.rounded("p.y", 3).alias("y"))


@query("nearest_edge", f"WITH {V.CONTOUR}, e AS (SELECT *, [abs(y - 100.0e0), abs(x - 745.0e0), abs(y - 1022.0e0), abs(x - 55.0e0)] d FROM contour) SELECT group_id, CAST(list_position(d, list_min(d)) - 1 AS INT) edge, count(*) n, round(avg(list_min(d)), 4) d FROM e GROUP BY ALL")
def nearest_edge(spark, d):
    lines = spark.sql("SELECT id AS group_id, array(named_struct('a', 0D, 'b', 1D, 'c', -100D), named_struct('a', 1D, 'b', 0D, 'c', -745D), named_struct('a', 0D, 'b', 1D, 'c', -1022D), named_struct('a', 1D, 'b', 0D, 'c', -55D)) AS edges FROM range(10)")
    return fitting.nearest_edge(V.contour(spark, d), lines).groupBy("group_id", "edge").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("d")).alias("d"))


@query("hopping_stats", "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) n, round(avg(value) * count(*), 2) total, round(var_pop(value), 1) AS var FROM (SELECT value, unnest([time_bucket(INTERVAL 16 MINUTE, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 16 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 16 MINUTE]) s FROM events) GROUP BY 1")
def hopping_stats(spark, d):
    out = streams.hopping_stats(V.table(spark, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", X.rounded(F.col("mean") * F.col("n"), 2).alias("total"), X.rounded("var", 1).alias("var"))


from . import print_queries  # noqa: E402, F401  (adds its queries to the two dictionaries)
