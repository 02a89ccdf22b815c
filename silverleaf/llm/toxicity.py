"""Toxicity by maximum-scoring segments of token log-odds.

* Words are hashed into 2**18 slots. Log-odds of toxic against clean use a Dirichlet prior in proportion to the
  overall counts (of a bounded sample of labelled rows, ``SAMPLE_ROWS``, summed on Spark); log-odds within ``Z_MIN`` standard errors of zero count as zero.
* A word's score is its log-odds less a drift, so that long clean stretches score below zero. A linear scan
  yields every maximal scoring segment of a text; segments above the significance level are reported.
* Extreme-value calibration: the best segment of n clean words follows a Gumbel law with parameter lambda, the
  positive root of sum p_i exp(lambda s_i) = 1 over clean words. lambda * S - log(n), and the number
  of significant segments, are turned into a probability from the counts of training rows per bin.

Defined cases: null or empty text, or text without words, has no segment and gets the training rate of texts without
segments; repeated rows are scored each; rows without a label, or with both labels null, do not train; an empty table gives no
rows, and without training rows every score is 0; other columns stay (columns
named toxicity or toxic_spans are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, blocks, byte_list, counts_by_slot, crc_mod

SLOTS = 1 << 18
#: Weight of the prior as a share of all training words; log-odds nearer to zero than Z_MIN standard errors are dropped.
PRIOR_SHARE = 0.05
Z_MIN = 3.0
DRIFT = 1.0
BINS = 64
#: Expected number of segments as good in clean text of that length, below which a segment is significant.
SIGNIFICANT = 0.05


#: Labelled rows used for fitting, those with the smallest hashes of their id: a bound, so that they can be broadcast and no text moves.
SAMPLE_ROWS = 60_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: int, held_out: int, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, label of at most ``sample_rows`` labelled documents outside the held-out fold."""
    known = labels.filter(F.col(label).isNotNull() & (crc_mod("doc_id", fold) != held_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def _slots(w: Words) -> np.ndarray:
    return (w.hash >> np.uint64(64 - 18)).astype(np.int64)


def _class_counts(batch) -> np.ndarray:
    total = np.zeros(2 * SLOTS, np.int64)
    texts, label = byte_list(batch.column("text")), np.array(batch.column("label").to_pylist(), np.int64)
    for s, e in blocks([len(t) for t in texts], 1 << 21):
        w = Words(texts[s:e], ALNUM)
        total += np.bincount(_slots(w) * 2 + label[s:e][w.doc], minlength=2 * SLOTS)
    return total.reshape(SLOTS, 2)


def log_odds(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Score per slot, and lambda."""
    n = counts.sum(0)
    if not n.all():
        return np.full(len(counts), -DRIFT), 1.0
    prior = PRIOR_SHARE * counts.sum(1)
    all_prior = PRIOR_SHARE * n.sum()
    c, t = counts[:, 0] + prior, counts[:, 1] + prior
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(t / (n[1] + all_prior - t)) - np.log(c / (n[0] + all_prior - c))
        odds = np.where(np.abs(odds) > Z_MIN * np.sqrt(1 / t + 1 / c), odds, 0.0)
    score = np.nan_to_num(odds, posinf=0.0, neginf=0.0) - DRIFT
    p = counts[:, 0] / n[0]
    low, high = 1e-3, 50.0
    if score.max() <= 0:
        return score, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.sum(p * np.exp(np.clip(mid * score, -700, 700))) < 1 else (low, mid)
    return score, (low + high) / 2


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), in linear time; only positive runs are visited."""
    at = np.flatnonzero(score > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    before, after = total[at].tolist(), total[at + 1].tolist()
    held: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest earlier one with a smaller sum before
    for i, left, right in zip(at.tolist(), before, after):
        s, e, j = i, i + 1, len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                break
            s, left = held[j][0], held[j][2]
            del held[j:]
            j -= 1
        held.append((s, e, left, right, j))
    return [(s, e, r - left) for s, e, left, r, _ in held]


def _statistics(texts: list[bytes], score: np.ndarray, lam: float):
    """Per text: bin of the calibrated statistic, and its significant segments as byte ranges."""
    for s, e in blocks([len(t) for t in texts], 1 << 21):
        w = Words(texts[s:e], ALNUM)
        own = score[_slots(w)]
        for d in range(e - s):
            a, b = int(w.bounds[d]), int(w.bounds[d + 1])
            found = maximal_segments(own[a:b])
            if not found:
                yield 0, []
                continue
            e_value = [(b - a) * np.exp(-lam * x) for _, _, x in found]
            good = [(int(w.start[a + p] - w.doc_start[d]), int(w.end[a + q - 1] - w.doc_start[d])) for (p, q, _), v in zip(found, e_value) if v < SIGNIFICANT]
            best = -np.log(max(min(e_value), 1e-300)) + 2.0 * max(0, len(good) - 1)
            yield int(np.clip(1 + round(8 + 1.5 * best), 1, BINS - 1)), good


def calibrate(counts: np.ndarray) -> np.ndarray:
    """Probability per bin, rising with the bin (pool-adjacent-violators on the counts)."""
    rate = (counts.sum(0)[1] / counts.sum()) if counts.sum() else 0.0
    stack: list[list[float]] = []
    for clean, toxic in counts[1:]:
        stack.append([toxic + 0.05 * rate, clean + toxic + 0.05, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            t, n, k = stack.pop()
            stack[-1] = [stack[-1][0] + t, stack[-1][1] + n, stack[-1][2] + k]
    rising = [t / n for t, n, k in stack for _ in range(int(k))]
    return np.clip([(counts[0, 1] + 0.05 * rate) / (counts[0].sum() + 0.05), *rising], 0.001, 0.999) if counts.sum() else np.zeros(BINS)


def fit(train: DataFrame):
    score, lam = log_odds(counts_by_slot(train, _class_counts, SLOTS, 2))
    shared = train.sparkSession.sparkContext.broadcast((score.astype(np.float32), lam))  # fixed size: 2**18 scores

    def bins(batch):
        out = np.zeros((BINS, 2), np.int64)
        at = [b for b, _ in _statistics(byte_list(batch.column("text")), *shared.value)]
        np.add.at(out, (at, batch.column("label").to_pylist()), 1)
        return out

    return shared, calibrate(counts_by_slot(train, bins, BINS, 2))


def score_toxicity(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and toxic_spans (byte ranges of significant segments)."""
    docs = docs.drop("toxicity", "toxic_spans")
    model, chance = fit(train)

    def run(batches):
        for b in batches:
            got = list(_statistics(byte_list(b.column("text")), *model.value))
            extra = [pa.array([float(chance[k]) for k, _ in got], pa.float64()), pa.array([",".join(f"{x}:{y}" for x, y in spans) for _, spans in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "toxicity", "toxic_spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, toxicity double, toxic_spans string")


def op9_toxicity(spark, sf_dir) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = training_rows(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0)
    out = score_toxicity(docs, train)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
