"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Windows are 13 consecutive words of a benchmark item (an item of fewer words is one window). Tasks make and hash them,
and they are counted. If they are at most ``block_windows`` they are one broadcast; else window and item together are
dealt by hash into blocks of about that size, however often one window recurs. Documents are scanned once per block, with
one broadcast alive at a time, and carry a bit mask of hit words and the items hit through a table in the shared
folder from block to block. Every hash hit is verified on the words themselves. A document is contaminated if it has hits on at least a twentieth
of its words.

Defined cases: null text or text without words -> no words, no hits, no items, clean; null item texts have no window;
repeated rows are judged each; equal items are all reported; an item without item_id is named null; an empty table or benchmark gives clean documents
or no rows; other columns stay (columns named like the results are replaced).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, blocks, byte_list, discard, materialize

WINDOW = 13
#: Windows in one broadcast block, about.
BLOCK_WINDOWS = 200_000
SLICE = 10_000


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(n, hash, words, item): the windows of all items."""

    def windows(batches):
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), byte_list(b.column("text"))):
                w = Words([text], ALNUM)
                n = min(width, len(w.start))
                first, h = w.ngrams(n) if n else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                for s in range(0, len(first), SLICE):
                    own = first[s : s + SLICE].tolist()
                    yield pa.RecordBatch.from_pydict({"n": [n] * len(own), "hash": h[s : s + SLICE].view(np.int64), "words": [_words(w, f, n) for f in own], "item": [item] * len(own)}, schema=schema)

    schema = pa.schema([("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("item", pa.string())])
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(windows, "n int, hash long, words binary, item string")


def hash_set(windows: DataFrame) -> dict:
    """{n: (sorted hashes, {hash: {words: items}})} of one block of windows, gathered on the driver; its size is bounded by the caller."""
    block = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for b in windows.toArrow().to_batches():
        for n, h, words, item in zip(*(b.column(c).to_pylist() for c in ("n", "hash", "words", "item"))):
            block[n][h % 2**64][words].add("null" if item is None else item)
    return {n: (np.array(sorted(h), np.uint64), {k: dict(v) for k, v in h.items()}) for n, h in block.items()}


def _words(w: Words, first: int, n: int) -> bytes:
    return b" ".join(w.buf[w.start[i] : w.end[i]].tobytes() for i in range(first, first + n))


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted array) and contaminated."""
    keep = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "contaminated", "_mask")]
    rows = docs.select(*keep).withColumn("n_words", F.lit(0).cast("long")).withColumn("_mask", F.lit(None).cast("binary")).withColumn("items", F.array().cast("array<string>"))

    def scanner(table):
        def scan(batches):
            lens = table.value
            for b in batches:
                texts = byte_list(b.column("text"))
                masks, names_of = b.column("_mask").to_pylist(), [set(x or []) for x in b.column("items").to_pylist()]
                n_words = np.zeros(len(texts), np.int64)
                for s, e in blocks([len(t) for t in texts], 1 << 21):
                    w = Words(texts[s:e], ALNUM)
                    n_words[s:e] = w.counts
                    hit = np.zeros(len(w.hash) + 1, np.int32)
                    for n, (known, names) in lens.items():
                        first, h = w.ngrams(n)
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        for f, x in zip(first[known[at] == h].tolist(), h[known[at] == h].tolist()):
                            found = names[x].get(_words(w, f, n))
                            if found:
                                hit[f] += 1
                                hit[f + n] -= 1
                                names_of[s + int(w.doc[f])].update(found)
                    inside = np.cumsum(hit[:-1]) > 0
                    for d in np.unique(w.doc[inside]):
                        own = np.packbits(inside[w.bounds[d] : w.bounds[d + 1]])
                        old = masks[s + d]
                        masks[s + d] = (own if old is None else own | np.frombuffer(old, np.uint8)).tobytes()
                new = {"n_words": pa.array(n_words), "_mask": pa.array(masks, pa.binary()), "items": pa.array([sorted(x) for x in names_of], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in b.schema.names], names=b.schema.names)

        return scan

    windows = benchmark_windows(benchmark, width)
    parts = max(1, -(-windows.count() // block_windows))
    if parts > 1:
        windows = materialize(windows.distinct(), "benchmark-windows")
    for k in range(parts):
        own = windows.filter(F.pmod(F.xxhash64("hash", "words", "item"), F.lit(parts)) == k) if parts > 1 else windows
        table = docs.sparkSession.sparkContext.broadcast(hash_set(own))
        scanned = rows.mapInArrow(scanner(table), rows.schema)
        if parts > 1:
            scanned = materialize(scanned, "decontaminate-scan")
            table.destroy()
            if k:
                discard(rows)
        rows = scanned
    if parts > 1:
        discard(windows)
    ones = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length("_mask"), F.lit(1))), lambda i: F.bit_count(F.conv(F.hex(F.substring(F.col("_mask"), i, F.lit(1))), 16, 10).cast("int"))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return rows.withColumn("n_hit", F.when(F.col("_mask").isNull(), 0).otherwise(ones).cast("long")).withColumn("items", F.array_sort("items")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("_mask")


def op6_decontamination(spark, sf_dir) -> DataFrame:
    from .common import table

    out = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
