"""Streaming forms: incremental ingestion of responses into a keyed table, and hopping-window statistics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.responses import split_valid, validate_responses
from ..sources.files import discard, written

#: How a record came in; added to what the source gives.
ORIGIN = ["order_time", "order_file", "order_hash"]


def stream_responses(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, key: str = "image_id", buckets: int = 64, time: str | None = None, per_batch: int = 1000) -> StreamingQuery:
    """New JSON files of responses go through the contract into two keyed tables: ``audit`` (valid) and ``quarantine`` (with their reason).

    One row is left for each key, in one of the two: the record with the greatest ``time`` (a column; else the time at
    which its file was last changed), then by file name and content. So the result depends neither on the order in which
    files come in nor on the batches they fall into, and a batch that runs twice changes nothing. Read the tables with
    ``read_table``. Records without a key are kept in ``quarantine`` too, one for each content.
    """
    when = F.col(time) if time else F.col("_metadata.file_modification_time")
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(source)
    new = new.select("*", when.alias("order_time"), F.col("_metadata.file_name").alias("order_file"))

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(validate_responses(batch.withColumn("order_hash", F.xxhash64(*[c for c in batch.columns if c not in ORIGIN]))), target, batch_id, key, buckets)

    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(rows: DataFrame, target: str, batch_id: int, key: str, buckets: int) -> None:
    """Validated ``rows`` merged into the table at ``target``, as its version ``batch_id``.

    Keys lie in ``buckets`` buckets by hash. A batch rewrites the buckets that it touches, next to the ones before, and
    then names for every bucket the version that holds (at most ``buckets`` rows), which is what makes the batch visible.
    It starts from the newest version below its own, so running it again, whole or from the middle, gives the same.
    """
    spark = rows.sparkSession
    identity = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.col("order_hash").cast("string")))
    rows = rows.withColumn("row_key", identity).withColumn("bucket", F.pmod(F.xxhash64("row_key"), F.lit(buckets)).cast("int"))
    rows = fresh = written(last_of(rows), "batch")
    before = _versions(spark, target, batch_id - 1)
    touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most ``buckets``
    old = [_bucket(target, v, b) for b, v in before.items() if b in touched]
    if old:
        rows = last_of(rows.unionByName(spark.read.schema(rows.drop("bucket").schema).parquet(*old).withColumn("bucket", F.pmod(F.xxhash64("row_key"), F.lit(buckets)).cast("int"))))
    rows.repartition("bucket", F.pmod(F.xxhash64("row_key", F.lit(1)), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/version={batch_id}")
    held = [(b, batch_id) for b in sorted(touched)] + [(b, v) for b, v in before.items() if b not in touched]
    spark.createDataFrame(held, "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{target}/held/version={batch_id}")
    discard(fresh)


def drop_old(spark: SparkSession, target: str) -> None:
    """Delete the buckets that neither the newest state nor the one before it holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    now = _versions(spark, target)
    top = max(now.values(), default=0)
    keep = {_bucket(target, v, b) for state in (now, _versions(spark, target, top - 1)) for b, v in state.items()}
    for status in fs.globStatus(path(f"{target}/data/version=*/bucket=*")):
        version, bucket = (int(part.rpartition("=")[2]) for part in status.getPath().toString().split("/")[-2:])
        if _bucket(target, version, bucket) not in keep:
            fs.delete(status.getPath(), True)


def last_of(rows: DataFrame) -> DataFrame:
    """Of each row_key the record that came last (see ``stream_responses``)."""
    rest = [c for c in rows.columns if c not in ("row_key", "bucket")]
    best = F.max_by(F.struct(*rest), F.struct(*ORIGIN)).alias("r")
    return rows.groupBy("bucket", "row_key").agg(best).select("r.*", "row_key", "bucket")


def _bucket(target: str, version: int, bucket: int) -> str:
    return f"{target}/data/version={version}/bucket={bucket}"


def _versions(spark: SparkSession, target: str, upto: int | None = None) -> dict[int, int]:
    """bucket -> version of the newest state, or of the newest not above ``upto``."""
    try:
        held = spark.read.schema("bucket int, held long, version long").parquet(f"{target}/held")
    except AnalysisException:  # no batch yet
        return {}
    held = held if upto is None else held.filter(F.col("version") <= upto)
    top = held.agg(F.max("version")).first()[0]
    return {} if top is None else {r["bucket"]: r["held"] for r in held.filter(F.col("version") == top).collect()}


def read_table(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame] | None:
    """(audit, quarantine) as the last finished batch left them; None before the first."""
    held = _versions(spark, target)
    if not held:
        return None
    rows = spark.read.parquet(*[_bucket(target, v, b) for b, v in sorted(held.items())]).drop("row_key", *ORIGIN)
    return split_valid(rows)


def hopping_stats(events: DataFrame, size: str = "32 minutes", stride: str = "16 minutes", late: str = "1 hour") -> DataFrame:
    """Count, mean and population variance of value per hopping window; works on batch and streaming frames."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", size, stride).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")).select(F.col("w.start").alias("start"), "n", "mean", "var")
