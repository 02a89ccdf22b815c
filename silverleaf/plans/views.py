"""Raster-, mask-, point- and response-shaped views over the given tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEIGHT = WIDTH = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark, sf_dir) -> DataFrame:
    """image_id, y, x, v, p: 100 vectors make one 80 x 80 mosaic."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).withColumn("e", F.col("e").cast("double")).withColumn("q", F.col("vec_id") % 100)
    return e.select(F.floor(F.col("vec_id") / 100).alias("image_id"), (F.floor(F.col("q") / 10) * 8 + F.floor(F.col("i") / 8)).cast("int").alias("y"), ((F.col("q") % 10) * 8 + F.col("i") % 8).cast("int").alias("x"),
                    F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 205.0 + 60.0 * F.col("e")))).cast("int").alias("v"), F.least(F.lit(1.0), 4.0 * F.abs("e")).alias("p"))


RASTER = """raster AS (SELECT CAST(vec_id // 100 AS BIGINT) image_id, CAST(((vec_id % 100) // 10) * 8 + i // 8 AS INT) y, CAST(((vec_id % 100) % 10) * 8 + i % 8 AS INT) x,
 CAST(floor(least(255.0e0, greatest(0.0e0, 205.0e0 + 60.0e0 * e))) AS INT) v, least(1.0e0, 4.0e0 * abs(e)) p
 FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) e, generate_subscripts(embedding, 1) - 1 i FROM embeddings))"""


def raster_rgb(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("q", F.col("vec_id") % 100)
    v = lambda k: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 205.0 + 60.0 * F.element_at("embedding", (F.col("i") + k) % 64 + 1).cast("double")))).cast("int")
    return e.select(F.floor(F.col("vec_id") / 100).alias("image_id"), (F.floor(F.col("q") / 10) * 8 + F.floor(F.col("i") / 8)).cast("int").alias("y"), ((F.col("q") % 10) * 8 + F.col("i") % 8).cast("int").alias("x"), v(0).alias("r"), v(21).alias("g"), v(42).alias("b"))


RGB = """rgb AS (SELECT CAST(vec_id // 100 AS BIGINT) image_id, CAST(((vec_id % 100) // 10) * 8 + i // 8 AS INT) y, CAST(((vec_id % 100) % 10) * 8 + i % 8 AS INT) x,
 CAST(floor(least(255.0e0, greatest(0.0e0, 205.0e0 + 60.0e0 * CAST(embedding[CAST(i % 64 + 1 AS INT)] AS DOUBLE)))) AS INT) r,
 CAST(floor(least(255.0e0, greatest(0.0e0, 205.0e0 + 60.0e0 * CAST(embedding[CAST((i + 21) % 64 + 1 AS INT)] AS DOUBLE)))) AS INT) g,
 CAST(floor(least(255.0e0, greatest(0.0e0, 205.0e0 + 60.0e0 * CAST(embedding[CAST((i + 42) % 64 + 1 AS INT)] AS DOUBLE)))) AS INT) b
 FROM (SELECT vec_id, embedding, unnest(range(0, 64)) i FROM embeddings))"""


def sets(spark, sf_dir) -> DataFrame:
    """image_id, mask_id, cell: suppliers as masks over the parts they ship."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("image_id"), F.col("l_suppkey").alias("mask_id"), F.col("l_partkey").alias("cell")).distinct()


SETS = "sets AS (SELECT DISTINCT l_suppkey % 10 image_id, l_suppkey mask_id, l_partkey cell FROM lineitem)"


def shingles(spark, sf_dir) -> DataFrame:
    """image_id, mask_id, cell: documents as masks over the hashes of their three-word shingles, all in one image."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.lower("text"), "[ \\t\\r\\n]+"), lambda w: w != "").alias("w")).filter(F.size("w") >= 3)
    three = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 3), " ")))
    return words.select(F.lit(0).cast("long").alias("image_id"), F.col("doc_id").alias("mask_id"), F.explode(F.array_distinct(three)).alias("cell"))


def shingle_sets(spark, sf_dir) -> DataFrame:
    """image_id, mask_id, cells: ``shingles`` with one row for each document; cells are sorted 64-bit hashes, other than those of ``shingles``."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc

    mix = lambda h: (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def hashed(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                text = pc.fill_null(b.column("text"), "")
                for blank in "\t\r\n":
                    text = pc.replace_substring(text, blank, " ")
                words = pc.split_pattern(text, " ")
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
                told = words.flatten().dictionary_encode()
                at, known = told.indices.to_numpy(zero_copy_only=False), told.dictionary
                full = pc.not_equal(known, "").to_numpy(zero_copy_only=False)[at]  # between two blanks lies an empty word
                h, row = pd.util.hash_array(known.to_pandas().to_numpy(dtype=object), categorize=False)[at[full]], row[full]
                inner = row[2:] == row[:-2]
                three, row = (mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) + h[:-2])[inner].view(np.int64), row[2:][inner]
                ends = np.cumsum(np.bincount(row, minlength=b.num_rows))
                for i, end in zip([0, *ends], ends):
                    three[i:end].sort()
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (three[1:] != three[:-1])
                ends = np.cumsum(np.bincount(row[new], minlength=b.num_rows))
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(three[new], pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("mask_id"), cells], names=["mask_id", "cells"])

    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("mask_id"), F.lower("text").alias("text"))
    return texts.mapInArrow(hashed, "mask_id long, cells array<long>").filter(F.size("cells") > 0).select(F.lit(0).cast("long").alias("image_id"), "mask_id", "cells")


SHINGLES = """sets AS (SELECT DISTINCT 0 image_id, doc_id mask_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) cell
 FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') w FROM documents) WHERE len(w) >= 3)"""


def contour(spark, sf_dir, group=None) -> DataFrame:
    group = F.col("o_custkey") % 10 if group is None else group
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), group.alias("group_id"), (F.col("o_orderkey") % 4).alias("side"),
        ((F.col("o_orderkey") * 7919) % 101 / 101.0 * 6.0 - 3.0).alias("z"), F.when(F.col("o_orderkey") % 17 == 0, 60.0).otherwise(0.0).alias("o"), (F.floor(F.col("o_orderkey") / 4) % 200 / 200.0).alias("t"))
    z, out, t, s = F.col("z"), F.col("o"), F.col("t"), F.col("side")
    x = F.when(s == 0, 55.0 + 690.0 * t).when(s == 1, 745.0 + z - out).when(s == 2, 745.0 - 690.0 * t).otherwise(55.0 + z + out)
    y = F.when(s == 0, 100.0 + z + out).when(s == 1, 100.0 + 922.0 * t).when(s == 2, 1022.0 + z - out).otherwise(1022.0 - 922.0 * t)
    return o.select("group_id", "pid", "side", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


CONTOUR = """contour AS (SELECT group_id, pid, side,
 round(CASE side WHEN 0 THEN 55.0e0 + 690.0e0 * t WHEN 1 THEN 745.0e0 + z - o WHEN 2 THEN 745.0e0 - 690.0e0 * t ELSE 55.0e0 + z + o END, 6) x,
 round(CASE side WHEN 0 THEN 100.0e0 + z + o WHEN 1 THEN 100.0e0 + 922.0e0 * t WHEN 2 THEN 1022.0e0 + z - o ELSE 1022.0e0 - 922.0e0 * t END, 6) y
 FROM (SELECT o_custkey % 10 group_id, o_orderkey pid, o_orderkey % 4 side, (o_orderkey * 7919) % 101 / 101.0e0 * 6.0e0 - 3.0e0 z,
 CASE WHEN o_orderkey % 17 = 0 THEN 60.0e0 ELSE 0.0e0 END o, ((o_orderkey // 4) % 200) / 200.0e0 t FROM orders))"""

def outline(spark, sf_dir) -> DataFrame:
    """``contour`` with a group for each ten customers, so that groups grow in number and not in size."""
    return contour(spark, sf_dir, F.floor(F.col("o_custkey") / 10))


OUTLINE = CONTOUR.replace("contour AS", "outline AS").replace("o_custkey % 10 group_id", "o_custkey // 10 group_id")

TEMPLATE = [(55.0, 100.0), (745.0, 100.0), (745.0, 1022.0), (55.0, 1022.0)]


def quads(spark, sf_dir) -> DataFrame:
    """quad_id, v: template corners moved by whole numbers that depend on the customer."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("quad_id"))
    move = lambda k: ((F.col("quad_id") * k) % 41 - 20).cast("double")
    far = F.when(F.col("quad_id") % 10 == 0, 400.0).otherwise(0.0)
    return c.select("quad_id", F.array(*[F.struct((F.lit(x) + move(7 + 2 * i) + (far if i == 0 else 0.0)).alias("x"), (F.lit(y) + move(8 + 3 * i)).alias("y")) for i, (x, y) in enumerate(TEMPLATE)]).alias("v"))


QUADS = "quads AS (SELECT c_custkey quad_id, " + ", ".join(f"{x}e0 + (c_custkey * {7 + 2 * i}) % 41 - 20" + (" + CASE WHEN c_custkey % 10 = 0 THEN 400.0e0 ELSE 0.0e0 END" if i == 0 else "") + f" x{i}, {y}e0 + (c_custkey * {8 + 3 * i}) % 41 - 20 y{i}" for i, (x, y) in enumerate(TEMPLATE)) + " FROM customer)"


def patches(spark, sf_dir) -> DataFrame:
    """group_id, quad_id, v: a tenth of each quad, scattered over its image; ten images, so each has many that overlap."""
    q = quads(spark, sf_dir)
    move = lambda p: F.struct((p["x"] * 0.1 + (F.col("quad_id") * 37) % 700).alias("x"), (p["y"] * 0.1 + (F.col("quad_id") * 53) % 950).alias("y"))
    return q.select((F.col("quad_id") % 10).alias("group_id"), "quad_id", F.transform("v", move).alias("v"))


PATCHES = QUADS + ", patches AS (SELECT quad_id % 10 group_id, quad_id, " + ", ".join(f"x{i} * 0.1e0 + (quad_id * 37) % 700 x{i}, y{i} * 0.1e0 + (quad_id * 53) % 950 y{i}" for i in range(4)) + " FROM quads)"


#: The template and its limits on the small grid of ``prints``.
SMALL = [(x / 20, y / 20) for x, y in TEMPLATE]
_PRINT = {
    "slope": "((k % 7) - 3) * 0.03{d}",
    "tiny": "k % 10 = 1 AND y BETWEEN 10 AND 11 AND x BETWEEN 10 AND 12",
    "line": "k % 10 = 2 AND y = 20 AND x BETWEEN 5 AND 24",
    "far": "k % 10 = 3 AND y BETWEEN 5 AND 51 AND x BETWEEN 25 AND 60",
    "star": "k % 10 = 4 AND ((x = 20 AND y BETWEEN 10 AND 20) OR (abs(x - 20) = y - 20 AND y BETWEEN 20 AND 30))",
    "print": "k % 10 >= 5 AND y BETWEEN 5 + k % 3 AND 51 - k % 2 AND x >= 3 + k % 4 + {slope} * (y - 5) AND x <= 37 - k % 5 + {slope} * (y - 5)",
    "blob": "k % 10 >= 3 AND y BETWEEN 58 AND 59 AND x BETWEEN 1 AND 2",
    "second": "(k % 10 = 3 OR k % 10 >= 5) AND y BETWEEN 55 AND 62 AND x BETWEEN 40 AND 44",
}


def _print_rule(d: str) -> tuple[str, str]:
    """Conditions of mask 1 and mask 2 for image k; ``d`` marks double literals."""
    rule = {k: v.replace("{slope}", f"({_PRINT['slope']})").replace("{d}", d) for k, v in _PRINT.items()}
    return " OR ".join(f"({rule[k]})" for k in ("tiny", "line", "far", "star", "print", "blob")), rule["second"]


def prints(spark, sf_dir) -> DataFrame:
    """image_id, mask_id, y, x: one 64 x 64 grid for each supplier, with no mask, a tiny one, a line, one far off, a star of thin arms, or a tilted print; with a loose blob and a smaller second mask."""
    one, two = _print_rule("D")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    rows = rows.repartition(1 + rows.count() // 500, "k")  # keys only; a row becomes 4096, so a partition two millions of cells
    grid = rows.selectExpr("k", "explode(sequence(0, 63)) AS y").selectExpr("*", "explode(sequence(0, 63)) AS x")
    mask = lambda rule, number: grid.filter(rule).select(F.col("k").alias("image_id"), F.lit(number).cast("long").alias("mask_id"), "y", "x")
    return mask(one, 1).unionByName(mask(two, 2))


def _prints_sql() -> str:
    one, two = _print_rule("e0")
    grid = "SELECT s_suppkey k, y, unnest(range(64)) x FROM (SELECT s_suppkey, unnest(range(64)) y FROM supplier)"
    return f"grid AS ({grid}), prints AS (SELECT k image_id, 1 mask_id, y, x FROM grid WHERE {one} UNION ALL SELECT k, 2, y, x FROM grid WHERE {two})"


PRINTS = _prints_sql()


def responses(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    d = F.date_format("o_orderdate", "yyyy.MM.dd")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 1, F.date_format("o_orderdate", "MM.dd")).when(k == 2, "2023.02.30").when(k == 3, F.concat(d, F.lit("x"))).otherwise(d)
    x = (100 + F.col("o_custkey") % 800).cast("string")
    box = lambda b, t: F.concat(F.lit('{"Date":{"bbox":['), b, F.lit('],"text":"'), t, F.lit('"}}'))
    m = F.col("o_orderkey") % 15
    raw = (F.when(m == 0, '{"reasoning":"none","Date":null}').when(m == 1, F.concat(F.lit("note: "), box(F.concat(F.lit("10,20,"), x, F.lit(",60")), text), F.lit(" end"))).when(m == 2, "   ").when(m == 3, "no object here").when(m == 4, "[1,2]")
        .when(m == 5, box(F.lit("10,20,5,60"), F.lit("01.02"))).when(m == 6, box(F.lit("10,20,true,60"), F.lit("01.02"))).when(m == 7, '{"Date":null,"extra":1}').when(m == 8, box(F.lit("10,20,30"), F.lit("01.02")))
        .when(m == 10, '{"Date":null,"Date":null}').when(m == 11, box(F.lit("[10],20,30,60"), F.lit("01.02"))).when(m == 12, '{"reasoning":5,"Date":null}').when(m == 13, '{"Date":{"bbox":[10,20,30,60],"text":5}}')
        .when(m == 14, box(F.concat(F.lit("10.5,20,"), x, F.lit(",1000")), F.concat(F.lit("\\t"), text, F.lit("\\n\\u00a0"))))
        .otherwise(box(F.concat(F.lit("10.5,20,"), x, F.lit(",1000")), F.concat(F.lit(" "), text, F.lit(" ")))))
    return o.select("o_orderkey", raw.alias("raw_text"), F.lit(800).alias("width"), F.lit(1272).alias("height"))


RESPONSES = """resp AS (SELECT o_orderkey, m, x, CASE m WHEN 2 THEN 'no json' WHEN 3 THEN 'no json' WHEN 4 THEN 'no object' WHEN 5 THEN 'box range' WHEN 6 THEN 'box type' WHEN 7 THEN 'extra key' WHEN 8 THEN 'box length' WHEN 10 THEN 'repeated key' WHEN 11 THEN 'box type' WHEN 12 THEN 'reasoning type' WHEN 13 THEN 'blank text' END reason,
 CASE k WHEN 0 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 1 THEN strftime(o_orderdate, '%m.%d') END date
 FROM (SELECT *, o_orderkey % 15 m, o_orderkey % 4 k, 100 + o_custkey % 800 x FROM orders))"""
