"""Exact substring dedup by difference-cover blockwise suffix sorting.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. What is needed
of the suffix order is which suffixes agree on their first 50 bytes, so suffixes are sorted by a 64-bit
fingerprint of those bytes, never by the bytes themselves.

* Documents are range-partitioned by id into chunks of a few MB and stored once, bucketed by chunk, so that
  later passes read text without a shuffle. Exact copies of a whole document are found by digest first.
* Cover sample: positions p with p mod 31 in a perfect difference cover. Two equal 50-byte strings always
  share a sampled position within their first 31 bytes, at which 20 equal bytes follow. The ranks (classes) of
  the 20-byte strings at sampled positions are computed first. A suffix none of whose sampled positions has a
  rank that occurs in a second document is unique and is never sorted.
* The suffixes left (long ties) are sorted one block of the suffix space at a time; inside a block, buckets
  are Spark partitions. Per chunk only sorted distinct fingerprints travel, as differences, and one bit per
  fingerprint comes back: "also in an earlier chunk". No pairs are made, so groups of copies cost a line each.

Results are decided by 64-bit fingerprints: for n sorted suffixes the chance that any byte is removed wrongly
is below n*n / 2**65.

Defined cases: rows without doc_id come before none and after none, so they keep everything; null or empty text -> nothing removed, digest of zero bytes; texts under 50 bytes are kept;
rows repeating a doc_id never remove each other (only a smaller id removes), and each of their texts is judged for itself; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, input_bytes, materialize, mix, pack_sorted, powers, prefix_hash, release, scratch_path, unpack_sorted, MULT

LENGTH = 50
PERIOD = 31
#: Perfect difference cover modulo 31: every difference occurs.
COVER = np.array([1, 5, 11, 24, 25, 27])
SAMPLE_BYTES = LENGTH - PERIOD + 1


#: doc_id and first 16 bytes of the text's digest.
COPY = np.dtype([("id", "<i8"), ("key", "V16")])


def _text_key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


class _Sorted:
    """Values in order: the distinct ones, and of each the first and last document of the chunk that has it."""

    def __init__(self, values: np.ndarray, doc: np.ndarray):
        self.order = np.argsort(values)
        ordered = values[self.order]
        start = _runs(ordered)
        self.count = np.diff(start, append=len(values))
        self.keys = ordered[start]
        self.doc = doc[self.order]
        self.low = np.minimum.reduceat(self.doc, start) if len(start) else self.doc
        self.high = np.maximum.reduceat(self.doc, start) if len(start) else self.doc

    def spread(self, of_keys: np.ndarray) -> np.ndarray:
        """What belongs to keys, for every value in order."""
        return np.repeat(of_keys, self.count)


class _Chunk:
    """Text of the documents of a chunk that are not copies, end to end, and what is derived from it.

    Hashes are taken only at sampled positions and at candidates, so a pass costs little more than one prefix sum a byte.
    """

    def __init__(self, pdf: pd.DataFrame, copies: dict):
        pdf = pdf.sort_values("doc_id", kind="stable")
        self.ids = pdf["doc_id"].to_numpy()
        self.texts = [b"" if t is None else t.encode() for t in pdf["text"]]
        self.copy = np.array([i in copies and _text_key(t) in copies[i] for i, t in zip(self.ids, self.texts)], bool)
        live = [b"" if c else t for t, c in zip(self.texts, self.copy)]
        self.size = np.fromiter(map(len, live), np.int64, len(live))
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        buf = np.frombuffer(b"".join(live), np.uint8)
        self.n = len(buf)
        self.row = np.repeat(np.arange(len(live), dtype=np.int32), self.size)  # of each byte
        self.rank = np.unique(self.ids, return_inverse=True)[1].astype(np.int32)  # of each row: its document
        self.prefix = prefix_hash(BYTE_VALUES[buf])

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix((self.prefix[at + length] - self.prefix[at]) * powers(MULT, self.n + 1)[1][at])

    def samples(self) -> tuple[np.ndarray, _Sorted]:
        """Sampled positions, and the ranks of their strings in order."""
        last = self.size - SAMPLE_BYTES  # last start in each row
        k = np.maximum(last + PERIOD, 0) // PERIOD * len(COVER)
        j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        own = j // len(COVER) * PERIOD + COVER[j % len(COVER)]
        fine = own <= np.repeat(last, k)
        at = (own + np.repeat(self.start[:-1], k))[fine]
        return at, _Sorted(self.hashes(at, SAMPLE_BYTES) >> np.uint64(24), self.rank[self.row[at]])

    def candidates(self, shared: np.ndarray, at: np.ndarray, ranks: _Sorted) -> np.ndarray:
        """Starts of 50-byte strings with a sampled rank that occurs in a second document."""
        hit = np.sort(at[ranks.order[ranks.spread(shared | (ranks.low < ranks.high))]])
        if not len(hit):
            return hit
        new = np.flatnonzero(np.concatenate([[True], hit[1:] - hit[:-1] > PERIOD]))  # each hit covers the PERIOD starts up to it
        lo = np.maximum(hit[new] - PERIOD + 1, 0)
        n = hit[np.append(new[1:], len(hit)) - 1] + 1 - lo
        out = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return out[self.start[self.row[out] + 1] - out >= LENGTH]

    def suffixes(self, shared_bits: list, buckets: int) -> tuple[np.ndarray, _Sorted]:
        at, ranks = self.samples()
        shared = _bits(shared_bits, [len(v) for _, v in _split(ranks.keys, 40, buckets)])
        at = self.candidates(shared, at, ranks)
        return at, _Sorted(self.hashes(at, LENGTH), self.rank[self.row[at]])


def _split(values: np.ndarray, bits: int, buckets: int, lo: int = 0, hi: int | None = None):
    """(bucket, slice) of sorted values, where bucket is the part of the value range [0, 2**bits)."""
    edges = np.array([(b << bits) // buckets for b in range(buckets)], dtype=np.uint64)
    cut = np.append(np.searchsorted(values, edges), len(values))
    for b in range(lo, buckets if hi is None else hi):
        if cut[b] < cut[b + 1]:
            yield b, values[cut[b] : cut[b + 1]]


def _side(pdf: pd.DataFrame, kind: str) -> list:
    return [] if pdf.empty else pdf[pdf["kind"] == kind].sort_values("bucket")["data"].tolist()


def _copies(side: pd.DataFrame) -> dict:
    """doc_id -> text keys of its rows that are copies; other texts of the id are none."""
    out: dict = {}
    for blob in _side(side, "copy"):
        for i, key in np.frombuffer(blob, COPY).tolist():
            out.setdefault(i, set()).add(key)
    return out


def _bits(blobs: list, bucket_sizes: list) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(blobs, bucket_sizes)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _seen(pdf: pd.DataFrame, kind: str, earlier: bool) -> pd.DataFrame:
    """Per chunk a bit for each value of this bucket: in another chunk (or only: in an earlier one)."""
    pdf = pdf.sort_values("chunk")
    values = [unpack_sorted(b) for b in pdf["data"]]
    size = np.array([len(v) for v in values])
    everything = np.concatenate(values)
    order = np.argsort(everything, kind="stable")  # equal values stay in order of their chunks
    ordered = everything[order]
    same = ordered[1:] == ordered[:-1]
    flag = np.zeros(len(ordered), bool)
    flag[1:] = same
    if not earlier:
        flag[:-1] |= same
    back = np.empty(len(ordered), bool)
    back[order] = flag
    cut = np.cumsum(size)[:-1]
    return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "kind": kind, "bucket": pdf["bucket"].to_numpy(), "data": [np.packbits(x).tobytes() for x in np.split(back, cut)]})


SIDE = "chunk int, kind string, bucket int, data binary"
SENT = "chunk int, bucket int, data binary"


def remove_repeats(docs: DataFrame, chunk_bytes: int = 4 << 20, blocks: int = 2) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes' ranges of every document.

    ``chunk_bytes`` bounds the text (and about 50 times as many bytes of arrays) in a Python worker;
    ``blocks`` is the number of parts of the suffix space that are sorted one after the other.
    """
    spark = docs.sparkSession
    docs, no_id = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    n_docs, n_bytes = input_bytes(docs)
    chunks = max(1, min(n_docs, -(-n_bytes // chunk_bytes)))
    buckets = max(blocks, 12, chunks // 3) // blocks * blocks
    name = f"suffix_text_{uuid.uuid4().hex}"
    (docs.select("doc_id", "text").repartitionByRange(chunks, "doc_id").withColumn("chunk", F.spark_partition_id())
        .write.bucketBy(chunks, "chunk").option("compression", "zstd").option("path", scratch_path(spark, "suffix-text")).saveAsTable(name))
    text = spark.table(name)
    release(spark)

    digest = text.select("chunk", "doc_id", F.sha2("text", 256).alias("digest"))
    first = digest.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = (digest.join(first, "digest").filter("doc_id > first_id").groupBy("chunk").agg(F.collect_list("doc_id").alias("ids"), F.collect_list("digest").alias("keys"))
        .mapInPandas(lambda it: (pd.DataFrame({"chunk": p["chunk"], "kind": "copy", "bucket": 0, "data": [b"".join(int(i).to_bytes(8, "little", signed=True) + bytes.fromhex(k[:32]) for i, k in zip(*x)) for x in zip(p["ids"], p["keys"])]}) for p in it), SIDE))
    copies = materialize(copies, "suffix-copies")

    def send_ranks(key, pdf, side):
        c = _Chunk(pdf, _copies(side))
        rows = [(key[0], b, pack_sorted(v)) for b, v in _split(c.samples()[1].keys, 40, buckets)]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "data"])

    by_chunk = text.groupBy("chunk")
    ranks = by_chunk.cogroup(copies.groupBy("chunk")).applyInPandas(send_ranks, SENT).groupBy("bucket").applyInPandas(lambda p: _seen(p, "rank", False), SIDE)
    side = copies.unionByName(materialize(ranks, "suffix-ranks"))
    release(spark)

    per = buckets // blocks
    found = side

    def sender(lo, hi):
        def send(key, pdf, own):
            c = _Chunk(pdf, _copies(own))
            keys = c.suffixes(_side(own, "rank"), buckets)[1].keys
            rows = [(key[0], b, pack_sorted(v)) for b, v in _split(keys, 64, buckets, lo, hi)]
            return pd.DataFrame(rows, columns=["chunk", "bucket", "data"])

        return send

    for block in range(blocks):
        part = by_chunk.cogroup(side.groupBy("chunk")).applyInPandas(sender(block * per, (block + 1) * per), SENT).groupBy("bucket").applyInPandas(lambda p: _seen(p, "suffix", True), SIDE)
        found = found.unionByName(materialize(part, "suffix-block"))
        release(spark)

    def finish(key, pdf, own):
        c = _Chunk(pdf, _copies(own))
        at, suffixes = c.suffixes(_side(own, "rank"), buckets)
        earlier = _bits(_side(own, "suffix"), [len(v) for _, v in _split(suffixes.keys, 64, buckets)])
        hit = np.sort(at[suffixes.order[suffixes.spread(earlier) | (suffixes.doc > suffixes.spread(suffixes.low))]])
        row = c.row[hit]
        new = np.flatnonzero(np.concatenate([[True], (hit[1:] > hit[:-1] + LENGTH) | (row[1:] != row[:-1])])) if len(hit) else hit
        lo, hi, row = hit[new], hit[np.append(new[1:], len(hit)) - 1] + LENGTH if len(hit) else hit, row[new]
        cut = np.searchsorted(row, np.arange(len(c.texts) + 1))
        rows = []
        for i, t in enumerate(c.texts):
            if c.copy[i]:
                spans = [(0, len(t))] if len(t) >= LENGTH else []
            else:
                spans = [(x - int(c.start[i]), y - int(c.start[i])) for x, y in zip(lo[cut[i] : cut[i + 1]].tolist(), hi[cut[i] : cut[i + 1]].tolist())]
            digest, last = hashlib.sha256(), 0
            for s, e in spans:
                digest.update(t[last:s])
                last = e
            digest.update(t[last:])
            rows.append((int(c.ids[i]), len(t), sum(e - s for s, e in spans), len(spans), digest.hexdigest(), ",".join(f"{s}:{e}" for s, e in spans)))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    out = by_chunk.cogroup(found.groupBy("chunk")).applyInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string")
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    return out.unionByName(no_id.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), F.lit("").alias("removed")))


def op1_suffix_dedup(spark, sf_dir) -> DataFrame:
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents"))
