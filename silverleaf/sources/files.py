"""File sources and sinks: asset listings, rasters, raw responses, audit lists, stage tables."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Image file endings.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")


def with_names(df: DataFrame, path: str = "path") -> DataFrame:
    name = F.substring_index(F.col(path), "/", -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return df.withColumn("name", name).withColumn("ext", ext).withColumn("stem", F.regexp_replace(F.col("name"), r"\.[^.]*$", ""))


def scan_assets(spark: SparkSession, path: str, exts: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Image files of a folder, in natural order; contents are never read. A path that names a single file of another kind is an error."""
    ending = path.rstrip("/").rpartition("/")[2].rpartition(".")
    if ending[1] and ending[2].lower() not in exts and _is_file(spark, path):
        raise ValueError(f"not an image file: {path}")
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("mtime"))
    return natural_order(with_names(files).filter(F.col("ext").isin(*exts)))


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def path_order(df: DataFrame) -> DataFrame:
    return df.orderBy("path")


def natural_rank(df: DataFrame, *ties: str) -> DataFrame:
    """``df`` with ``rank``, the place of a row in natural order (from 1): the rows sorted, then counted by partition."""
    placed = natural_order(df, *ties).withColumn("at", F.monotonically_increasing_id())
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    placed = written(placed.withColumn("part", part).withColumn("place", place).drop("at"), "natural-order")
    before, total = [], 0
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row for each sorted partition
        before += [F.lit(r["part"]), F.lit(total)]
        total += r["n"]
    if not before:
        return df.withColumn("rank", F.lit(1).cast("long"))
    return placed.withColumn("rank", F.create_map(*before)[F.col("part")].cast("long") + F.col("place") + 1).drop("part", "place")


def natural_order(df: DataFrame, *ties: str) -> DataFrame:
    """Stems of digits first, by number; the others by lower-case name."""
    digits = F.col("stem").rlike("^[0-9]+$")
    return df.orderBy(F.when(digits, 0).otherwise(1), F.when(digits, F.col("stem").try_cast("decimal(38,0)")), F.lower("name"), "name", *ties)


def limit_inputs(df: DataFrame, n: int) -> DataFrame:
    if n <= 0:
        raise ValueError("the limit must be positive")
    return df.limit(n)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def output_names(df: DataFrame, index: Column) -> DataFrame:
    """Adds the names of what is written for an input: annotated image, item of an index, report."""
    return df.withColumn("annotated", F.concat("stem", F.lit("_annotated"))).withColumn("item", F.concat("stem", F.format_string("_p%02d", index))).withColumn("report", F.concat("stem", F.lit("_report")))


def scan_rasters(spark: SparkSession, path: str, layout: str = "pixels", size: int = 64) -> DataFrame:
    """The readable images as pixels (path, y, x, r, g, b), or with ``layout`` 'tiles' as tiles of bands r, g, b (see ``operators/tiles``; image_id is the path)."""

    def unpack(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                raw = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)
                y, x = [a.ravel() for a in np.indices((r.height, r.width))]
                b, g, red = (raw[..., min(i, r.nChannels - 1)].ravel().astype("int32") for i in range(3))
                yield pd.DataFrame({"path": r.origin, "y": y.astype("int32"), "x": x.astype("int32"), "r": red, "g": g, "b": b})

    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    if layout == "pixels":
        return image.mapInPandas(unpack, "path string, y int, x int, r int, g int, b int")
    from ..operators.tiles import TILE, cut

    def pack(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                raw = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)
                for name, i in (("b", 0), ("g", 1), ("r", 2)):
                    rows = [(r.origin, name, ty, tx, *a.shape, np.ascontiguousarray(a, "<f8").tobytes()) for ty, tx, a in cut(raw[..., min(i, r.nChannels - 1)], size)]
                    yield pd.DataFrame(rows, columns=["image_id", "band", "ty", "tx", "h", "w", "data"])

    return image.mapInPandas(pack, TILE.format(key="string"))


def scan_responses(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw_text"), F.col("_metadata.file_name").alias("path"))
    return with_names(files).select(F.col("stem").alias("image_id"), "raw_text")


def scan_audit(spark: SparkSession, path: str, schema: str, key: str = "image_id") -> DataFrame:
    """Records of audit lists (JSON arrays): those that are objects with a key; of each key the last of its list; among files the one that was changed last, then by name."""
    file = F.struct("_metadata.file_modification_time", "_metadata.file_name")
    lists = spark.read.text(path, wholetext=True).select(file.alias("file"), F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("pos", "r"))
    records = lists.filter(F.schema_of_variant("r").startswith("OBJECT")).select(F.struct("file", "pos").alias("pos"), F.try_variant_get("r", "$", f"struct<{schema}>").alias("r"))
    records = records.filter(F.col(f"r.{key}").isNotNull())
    return records.groupBy(F.col(f"r.{key}").alias("k")).agg(F.max_by("r", "pos").alias("r")).select("r.*")


def write_rasters(df: DataFrame, path: str, by: str = "stage") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table in the folder that all executors share: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(df: DataFrame) -> str | None:
    """The folder of a table that ``written`` made; None if it has no file."""
    return next((f.rpartition("/")[0] for f in df.inputFiles()[:1]), None)


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    path = folder(df)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def save_stage(df: DataFrame, root: str, stage: str, key: str = "image_id", buckets: int = 64) -> None:
    """A stage's table under ``root``, in folders by a bucket of its key, so that a later stage can read a part."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{stage}")


def load_stage(spark: SparkSession, root: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{stage}").drop("bucket")
