"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Peeling starts at the greatest depth: nodes that survived from below and
conversations that end here are merged, their last turn is stripped, and what is left is grouped again, so that every
node is found and all its sums are made in the same pass upwards.

* A turn is a 16-byte digest of its role and text. A sequence travels as one binary ``path`` of 24 bytes a turn: the
  digest of the whole sequence up to it (16 bytes) and the code points of all texts up to it (8 bytes). Stripping turns
  is a ``substring``; no text moves after the first step.
* Equal conversations are merged first, into one row for each distinct end (``ended_sequences``).
* Levels at which no node has two continuations only strip, so they are stripped together with the next level that has
  one: their nodes follow in closed form from the node below. One Spark job runs for each depth at which any two
  sequences part; how many turns a single conversation has does not matter.

Results rest on 128-bit digests.

Defined cases: null role or text -> empty; turns without a number come first, equal numbers are ordered by the digest
of role and text; repeated rows are repeated turns; rows without conv_id belong to no conversation and are left out;
conversations without turns end at the root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path

STEP = 24
#: Members of one piece of an ends list.
PIECE = 1000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def digest_turns(turns: DataFrame) -> DataFrame:
    """conv_id, t: each conversation's turns in order, as (turn, k: 16-byte digest, n: code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    k = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)), 1, 16)
    t = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", k.alias("k"), F.length(text).cast("long").alias("n")).alias("t"))
    return t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))


def borrow_heads(own: DataFrame, group: int, heads: int) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % ``group`` (none if absent), then the own turns after the first h; h = crc32(c) % ``heads``."""
    first = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("t", 1, max(heads - 1, 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    rows = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % group).join(first, "first", "left").withColumn("h", h)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(own.schema["t"].dataType))
    return rows.select("conv_id", F.concat(head, F.slice("t", F.col("h") + 1, F.greatest(F.size("t"), F.lit(1)))).alias("t"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path of conversations (conv_id, t as by ``digest_turns``)."""

    def chain(batches):
        for b in batches:
            t = b.column("t")
            turns, sizes = t.flatten(), np.diff(t.offsets.to_numpy())
            keys, chars = turns.field("k").to_pylist(), turns.field("n").to_pylist()
            out, at = [], 0
            for size in sizes.tolist():
                last, total, path = b"", 0, bytearray()
                for k, n in zip(keys[at : at + size], chars[at : at + size]):
                    last, total = hashlib.sha256(last + k).digest()[:16], total + n
                    path += last + total.to_bytes(8, "big")
                out.append(bytes(path))
                at += size
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(out, pa.binary())], names=["conv_id", "path"])

    return conversations.select("conv_id", F.transform("t", lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n"))).alias("t")).mapInArrow(chain, "conv_id long, path binary")


def ended_sequences(rows: DataFrame) -> DataFrame:
    """path, conv_id (the smallest), n, ends_sha256: one row for each distinct whole sequence.

    Rows are sorted by range, so members of a frequent sequence lie in several tasks; each task joins its members' ids
    in pieces, and only those pieces meet, as a stream, where the digest is made.
    """

    def pack(batches):
        for b in batches:
            path, ids, out, s = b.column("path").to_pylist(), b.column("conv_id").to_pylist(), [], 0
            for i in range(1, len(path) + 1):
                if i == len(path) or path[i] != path[s] or i - s == PIECE:
                    out.append((path[s], ids[s], i - s, ",".join(map(str, ids[s:i]))))
                    s = i
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["path", "conv_id", "n", "ids"])

    def digest(batches):
        now = None
        for b in batches:
            out = []
            for path, first, n, ids in zip(*(b.column(c).to_pylist() for c in ("path", "conv_id", "n", "ids"))):
                if now is None or path != now[0]:
                    if now is not None:
                        out.append((*now[:3], now[3].hexdigest()))
                    now = [path, first, n, hashlib.sha256(ids.encode())]
                else:
                    now[2] += n
                    now[3].update(b"," + ids.encode())
            yield rows_of(out)
        if now is not None:
            yield rows_of([(*now[:3], now[3].hexdigest())])

    def rows_of(out):
        columns = zip(*out) if out else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["path", "conv_id", "n", "ends_sha256"])

    pieces = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(pack, "path binary, conv_id long, n long, ids string")
    return pieces.repartition("path").sortWithinPartitions("path", "conv_id").mapInArrow(digest, "path binary, conv_id long, n long, ends_sha256 string")


def _key(path: Column, depth: Column) -> Column:
    """Digest of the first ``depth`` turns; empty for the root."""
    return F.when(depth > 0, F.substring(path, (depth - 1) * STEP + 1, F.lit(16))).otherwise(F.lit(b""))


def _chars(path: Column, depth: Column) -> Column:
    """Code points of the first ``depth`` texts."""
    return F.when(depth > 0, F.conv(F.hex(F.substring(path, (depth - 1) * STEP + 17, F.lit(8))), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def parting_depths(ends: DataFrame) -> list[int]:
    """Depths, greatest first, at which a node has two continuations, or one and an end; with 0. At most one number for each depth."""
    depth = F.col("depth")
    steps = ends.select("path", "depth", F.explode(F.sequence(F.lit(0), depth)).alias("at"))
    following = F.when(F.col("at") < depth, _key(F.col("path"), F.col("at") + 1)).otherwise(F.lit(b""))
    half = lambda s: F.coalesce(F.conv(F.hex(F.substring(following, s, 8)), 16, 10).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    spread = lambda c: F.min(c) != F.max(c)
    nodes = steps.select("at", _key(F.col("path"), F.col("at")).alias("key"), half(1).alias("a"), half(9).alias("b")).groupBy("at", "key").agg((spread("a") | spread("b")).alias("parts"))
    return sorted({r["at"] for r in nodes.filter("parts").select("at").distinct().collect()} | {0}, reverse=True)


def peel(ends: DataFrame) -> DataFrame:
    """All nodes of the sequences ``ends`` (path, conv_id, n, ends_sha256; each path once)."""
    spark = ends.sparkSession
    ends = ends.withColumn("depth", (F.octet_length("path") / STEP).cast("int"))
    levels = parting_depths(ends)
    path, depth, n = F.col("path"), F.col("depth"), F.col("n")
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    last = _chars(path, depth) - _chars(path, depth - 1)
    alone = ends.select("path", "depth", "conv_id", "n", none.alias("n_children"), one.alias("n_leaves"), ((n - 1) * last).alias("saved"), "ends_sha256")
    root, level, below, done = scratch_path(spark, "trie-levels"), None, None, []
    for d in levels:
        open_ = alone.filter((depth > d) & (depth < below) if below is not None else depth > d)
        open_ = open_.unionByName(level) if level is not None else open_
        done.append((open_, d))
        stripped = open_.select(
            F.substring(path, 1, d * STEP).alias("path"), "conv_id", "n", one.alias("child"), "n_leaves",
            (F.col("saved") + (n - 1) * (_chars(path, depth - 1) - _chars(path, F.lit(d)))).alias("saved"), F.lit(None).cast("string").alias("ends_sha256"))
        ended = ends.filter(depth == d).select("path", "conv_id", "n", none.alias("child"), none.alias("n_leaves"), none.alias("saved"), "ends_sha256")
        nodes = stripped.unionByName(ended).groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("child").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends_sha256").alias("ends_sha256"))
        own = _chars(path, F.lit(d)) - _chars(path, F.lit(d - 1))
        nodes = nodes.select("path", F.lit(d).alias("depth"), "conv_id", "n", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("saved") + (n - 1) * own).alias("saved"), "ends_sha256")
        nodes.write.option("compression", "zstd").parquet(f"{root}/{d}")
        level, below = spark.read.schema(nodes.schema).parquet(f"{root}/{d}"), d
    top = level.first()
    if top is None:
        return _nodes(level.withColumn("floor", F.lit(-1)).withColumn("parent", F.lit(None).cast("long")))
    tables = spark.read.schema(level.schema).parquet(*[f"{root}/{d}" for d in levels])
    floor = F.array_max(F.filter(F.array(*[F.lit(x) for x in [*levels, -1]]), lambda x: x < depth))
    runs = tables.unionByName(alone.filter(~depth.isin(levels))).withColumn("floor", floor)
    parents = tables.filter(depth > 0).select(F.col("depth").alias("floor"), _key(path, depth).alias("key"), F.col("conv_id").alias("parent"))
    low = runs.filter("floor <= 0").withColumn("parent", F.when(F.col("floor") == 0, F.lit(top["conv_id"])).cast("long"))
    high = runs.filter("floor > 0").withColumn("key", _key(path, F.col("floor"))).join(parents, ["floor", "key"], "left").drop("key")
    return _nodes(low.unionByName(high))


def _nodes(runs: DataFrame) -> DataFrame:
    """The nodes from depth down to floor + 1; all but the deepest have one child and no ends."""
    path, n, at, depth = F.col("path"), F.col("n"), F.col("at"), F.col("depth")
    rows = runs.select("*", F.explode(F.sequence(F.col("floor") + 1, depth)).alias("at"))
    deepest = at == depth
    return rows.select(
        "conv_id", at.cast("long").alias("depth"), F.when(at > F.col("floor") + 1, F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), n.alias("n_convs"),
        F.when(deepest, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        F.when(deepest, F.col("saved")).otherwise(F.col("saved") + (n - 1) * (_chars(path, depth - 1) - _chars(path, at - 1))).alias("saved_tokens"),
        F.when(deepest, F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"), _key(path, at).alias("key"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of conversations (conv_id, t as by ``digest_turns``), one row each, as ``op11_prefix_trie`` returns them, and ``key``, the digest of the sequence."""
    return peel(materialize(ended_sequences(materialize(paths(conversations), "trie-paths")), "trie-ends"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    own = materialize(digest_turns(table(spark, sf_dir, "conversations")), "trie-turns")
    return prefix_trie(borrow_heads(own, 100, 6)).drop("key")
