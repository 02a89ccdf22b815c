"""Quality classifier: a factorisation machine on hashed words and structure statistics.

The score of features x is sigmoid(w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions, low rank, in linear time. Features are the relative frequencies of words hashed into ``HASHED`` slots
and ``STATS`` structure statistics of the text (shares of character kinds, repetition, lengths). It is fitted by
Adam on a bounded sample of labelled rows, those with the smallest hashes of their id (``sample_rows``, in one task).

Defined cases: null or empty text -> all features zero but the bias, still scored; repeated rows are scored each;
rows without a label do not train; without training rows every score is 0.5; an empty table gives no rows;
other columns stay, but an input column ``quality`` is replaced by the score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONBLANK, Words, blocks, byte_list, crc_mod

HASHED = 1024
STATS = 20
RANK = 8
SAMPLE_ROWS = 12_000

UPPER, LOWERC, DIGIT, OTHER = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = LOWERC[97:123] = DIGIT[48:58] = OTHER[128:] = True
MARKS = [np.isin(np.arange(256), list(x)) for x in (b"!", b"#$%&*", b"|", b".,", b"\n", b"{}[]()<>=;", b"@/_\\")]
KINDS = np.stack([UPPER, LOWERC, DIGIT, OTHER, *MARKS]).astype(np.float32)


def features(texts: list[bytes]) -> np.ndarray:
    """[rows, HASHED + STATS] float32."""
    out = np.zeros((len(texts), HASHED + STATS), np.float32)
    for s, e in blocks([len(t) for t in texts], 1 << 21):
        w = Words(texts[s:e], NONBLANK)
        slot = (w.hash >> np.uint64(54)).astype(np.int64)
        x = out[s:e]
        np.add.at(x, (w.doc, slot), 1.0)
        n = np.maximum(w.counts, 1)[:, None]
        x[:, :HASHED] = np.sqrt(x[:, :HASHED] / n)
        pair_first, pair = w.ngrams(2)
        for d in range(e - s):
            t, a, b = texts[s + d], int(w.bounds[d]), int(w.bounds[d + 1])
            if not t or a == b:
                continue
            hist = np.bincount(np.frombuffer(t, np.uint8), minlength=256).astype(np.float32) / len(t)
            h = w.hash[a:b]
            size = w.end[a:b] - w.start[a:b]
            p = pair[np.searchsorted(pair_first, a) : np.searchsorted(pair_first, b)]
            lines = t.split(b"\n")
            x[d, HASHED:] = [
                *(KINDS @ hist),
                np.log1p(b - a) / 10,
                len(np.unique(h)) / (b - a),
                len(np.unique(p)) / max(len(p), 1),
                float(np.mean(h[1:] == h[:-1])) if b - a > 1 else 0.0,
                float(size.mean()) / 10,
                float(size.std()) / 10,
                len(set(lines)) / len(lines),
                len(zlib.compress(t, 1)) / len(t),
                np.log1p(len(t) / len(lines)) / 10,
            ]
    return out


def _raw(x, model):
    w0, w, v, mean, scale = model
    z = x.copy()
    z[:, HASHED:] = (z[:, HASHED:] - mean) / scale
    s = z @ v
    return w0 + z @ w + 0.5 * ((s * s).sum(1) - ((z * z) @ (v * v)).sum(1))


def train_machine(x: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 0.02, decay: float = 1e-5):
    rng = np.random.default_rng(5)
    mean, scale = x[:, HASHED:].mean(0), x[:, HASHED:].std(0) + 1e-3
    z = x.copy()
    z[:, HASHED:] = (z[:, HASHED:] - mean) / scale
    par = [np.zeros(1, np.float32), np.zeros(z.shape[1], np.float32), rng.normal(0, 0.01, (z.shape[1], RANK)).astype(np.float32)]
    m, u, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(z), 128):
            b = z[order[i : i + 128]]
            s = b @ par[2]
            raw = par[0] + b @ par[1] + 0.5 * ((s * s).sum(1) - ((b * b) @ (par[2] ** 2)).sum(1))
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[order[i : i + 128]]) / len(b)
            grad = [np.array([g.sum()]), b.T @ g + decay * par[1], b.T @ (g[:, None] * s) - ((b * b).T @ g)[:, None] * par[2] + decay * par[2]]
            step += 1
            for k in range(3):
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                u[k] = 0.999 * u[k] + 0.001 * grad[k] ** 2
                par[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(u[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return float(par[0][0]), par[1], par[2], mean, scale


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """Model from at most ``sample_rows`` rows of (doc_id, text, label); features are made in parallel, then one task fits."""

    def make(batches):
        for b in batches:
            x = features(byte_list(b.column("text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    def solve(pdf):
        pdf = pdf.sort_values(["doc_id", "x"])
        x = np.frombuffer(b"".join(pdf["x"]), np.float16).reshape(len(pdf), -1).astype(np.float32)
        w0, w, v, mean, scale = train_machine(x, pdf["label"].to_numpy().astype(np.float32))
        return pd.DataFrame({"w0": [w0], "w": [w.tobytes()], "v": [v.astype(np.float32).tobytes()], "mean": [mean.tobytes()], "scale": [scale.tobytes()]})

    sample = train.select("doc_id", "text", "label").mapInArrow(make, "doc_id long, label int, x binary")
    rows = sample.groupBy(F.lit(0).alias("one")).applyInPandas(solve, "w0 double, w binary, v binary, mean binary, scale binary").collect()
    if not rows:
        return 0.0, np.zeros(HASHED + STATS, np.float32), np.zeros((HASHED + STATS, RANK), np.float32), np.zeros(STATS, np.float32), np.ones(STATS, np.float32)
    r = rows[0]
    f = lambda k: np.frombuffer(r[k], np.float32)
    return r["w0"], f("w"), f("v").reshape(-1, RANK), f("mean"), f("scale")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, left_out: int, sample_rows: int) -> DataFrame:
    """doc_id, text, label: the bounded sample. Labels are chosen first, so that few texts move."""
    known = labels.filter(F.col(label).isNotNull() & (crc_mod("doc_id", fold) != left_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows


def score_quality(docs: DataFrame, model) -> DataFrame:
    """``docs`` with quality, 0 to 1."""
    docs = docs.drop("quality")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts, q = byte_list(b.column("text")), []
            for s in range(0, len(texts), 1024):
                raw = _raw(features(texts[s : s + 1024]), shared.value)
                q.append(1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -500, 500))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(q) if q else np.zeros(0))], names=[*b.schema.names, "quality"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, quality double")


def op4_quality(spark, sf_dir) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 3, 1, SAMPLE_ROWS))
    return score_quality(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"))
