"""Shared pieces of the training-data operators: table access, shared scratch space, vectorised hashing."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MULT = 6364136223846793005
_POWERS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once a later one has taken its place."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        delete_path(spark, file.rpartition("/")[0])


def delete_path(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files of finished jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_bytes(docs: DataFrame, col: str = "text") -> tuple[int, int]:
    """(rows, bytes of text): the two numbers that size partitions."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(col)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def crc_mod(col: str, m: int) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(m)


def byte_list(arr) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return [b"" if x is None else x for x in arr.cast(pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, schema: str, **columns) -> pa.RecordBatch:
    """A record batch of the columns that ``schema`` (name type, ...) lists: those given here, else those of ``batch`` as they are, so nulls and large ids stay."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) if n in columns else batch.column(n).cast(kinds[k]) for n, k in names], names=[n for n, _ in names])


def text_slices(arr, limit: int):
    """Lists of UTF-8 texts of an Arrow column, each of about ``limit`` bytes."""
    arr = arr.cast(pa.binary())
    for s, e in blocks([n or 0 for n in pc.binary_length(arr).to_pylist()], limit):
        yield byte_list(arr.slice(s, e - s))


def blocks(sizes, limit: int):
    """Consecutive index ranges whose sizes add up to about ``limit``; one large item stands alone."""
    start = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n (grown on demand, kept per worker)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS[base] = have = tuple(out)
    return have


def byte_values() -> np.ndarray:
    """One fixed odd 64-bit number for each byte value."""
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_VALUES = byte_values()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hash(values: np.ndarray, base: int = MULT) -> np.ndarray:
    """Prefix sums from which the hash of any slice follows (see ``slice_hash``)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = MULT) -> np.ndarray:
    inv = powers(base, len(prefix) + 1)[1]
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


#: Byte classes. Words of letters, digits and non-ASCII bytes; words of anything but blanks.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True
NONBLANK = np.ones(256, bool)
NONBLANK[[32, 9, 10, 11, 12, 13]] = False


class Words:
    """Words of a block of documents: byte ranges, 64-bit hashes and the index of their document."""

    def __init__(self, texts: list[bytes], word_class: np.ndarray):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.buf = LOWER[raw]
        self.raw = raw
        inside = word_class[self.buf]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.bounds = np.searchsorted(self.start, self.doc_start)  # words of document i: bounds[i]..bounds[i+1]
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.hash = slice_hash(prefix_hash(BYTE_VALUES[self.buf]), self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of every run of ``n`` words that stays inside its document."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.arange(len(self.hash) - n + 1)
        first = first[self.doc[: len(first)] == self.doc[n - 1 :]]
        return first, slice_hash(prefix_hash(self.hash, 0x9E3779B97F4A7C15), first, first + n, 0x9E3779B97F4A7C15)

    def whole(self, i: int) -> np.ndarray:
        """Hash of all words of document ``i`` as one n-gram."""
        s, e = int(self.bounds[i]), int(self.bounds[i + 1])
        p = prefix_hash(self.hash[s:e], 0x9E3779B97F4A7C15)
        return slice_hash(p, np.array([0]), np.array([e - s]), 0x9E3779B97F4A7C15)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as fixed-width differences; the first byte holds the width."""
    if not len(values):
        return b"\x01"
    d = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + d.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    blob = memoryview(blob)
    width = blob[0] if blob.format == "B" else blob.cast("B")[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def counts_by_slot(df: DataFrame, fn, slots: int, cols: int, slice_slots: int = 1 << 16) -> np.ndarray:
    """Sum of the sparse (slot, count...) arrays that ``fn(record_batch)`` yields, over all partitions.

    ``fn`` returns an array ``[slots, cols]`` to add for its batch. Each task adds up its own batches, sends
    only slots that are not zero, cut into slices; slices are summed in parallel. The result has a fixed
    size, ``slots * cols`` numbers, whatever the input.
    """

    def partial(batches):
        total = None
        for b in batches:
            x = fn(b)
            total = x if total is None else total + x
        if total is None:
            return
        out = {"slice": [], "at": [], "n": []}
        for s in range(0, slots, slice_slots):
            part = total[s : s + slice_slots]
            at = np.flatnonzero(part.any(axis=1))
            if len(at):
                out["slice"].append(s // slice_slots)
                out["at"].append(at.astype("<u4").tobytes())
                out["n"].append(part[at].astype("<i8" if part.max() > 2**31 - 1 else "<i4").tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("slice", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

    def add(pdf):
        total = np.zeros((slice_slots, cols), np.int64)
        for at, n in zip(pdf["at"], pdf["n"]):
            at = np.frombuffer(at, "<u4")
            total[at] += np.frombuffer(n, "<i4" if len(n) == 4 * cols * len(at) else "<i8").reshape(-1, cols)
        return pdf.head(1)[["slice"]].assign(n=[total.astype("<i8").tobytes()])

    sums = df.mapInArrow(partial, "slice int, at binary, n binary").groupBy("slice").applyInPandas(add, "slice int, n binary")
    out = np.zeros((-(-slots // slice_slots) * slice_slots, cols), np.int64)
    for row in sums.collect():  # bounded: one row for each slice of a fixed-size table
        out[row["slice"] * slice_slots : (row["slice"] + 1) * slice_slots] = np.frombuffer(row["n"], "<i8").reshape(-1, cols)
    return out[:slots]
