"""Corpus pipeline: toxicity, near duplicates, decontamination, secrets, packing. One DataFrame in, one out, per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverleaf.llm.common import materialize, table
from silverleaf.llm.decontaminate import mark
from silverleaf.llm.jaccard_join import link_documents
from silverleaf.llm.packing import pack
from silverleaf.llm.secret_scan import redact
from silverleaf.llm.toxicity import score_toxicity, training_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go."""
    train = training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 5, 0)
    return score_toxicity(docs.select(*COLUMNS), train).filter("toxicity < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id stays (null last, then by a hash of the text), once.

    Rows, not ids, are linked: texts that share an id are judged each, and rows without an id are linked too. Texts
    without words are linked to none; of those, one row for each doc_id and text stays.
    """
    docs = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    links = link_documents(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"), "row")
    rows = docs.select("row", order.alias("order")).join(links, "row")
    some = rows.filter("n_shingles > 0")
    first = some.groupBy("group").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = some.join(first, "group").filter(F.col("row") != F.col("first.row")).select("row")
    blank = docs.filter(F.coalesce("text", F.lit("")).rlike(r"\A[\x20\t-\r]*\z")).select("row", "doc_id", "text")
    one = blank.groupBy("doc_id", "text").agg(F.min("row").alias("first"))
    gone = gone.unionByName(blank.select("row").join(one.select(F.col("first").alias("row")), "row", "left_anti"))
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return mark(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs, f"pipeline-{name}") if name != STAGES[-1][0] else docs
    return docs
