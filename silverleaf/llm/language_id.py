"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are the relative frequencies (square roots, unit length) of runs of one to four bytes of the lower-cased
letters of the whole text, hashed into ``SLOTS`` slots; other characters part words. The learned languages are joined
into families by the likeness of their mean features (average linkage, about the root of their number). A softmax
regression over the same features predicts the family. For each two languages of a family a linear support vector
machine is fitted, each in a task of its own, and the language with most votes wins, then the larger sum of margins.

Fitted on a bounded sample: about ``per_language`` labelled texts for each of the ``languages`` most frequent languages,
those with the smallest hashes of their doc_id, one text for each doc_id and language. All texts are scored.

Defined cases: null text or no letter -> ``und`` with score 0; rows without lang or doc_id teach nothing; without any
labelled row every text is ``und``; with one language every text with a letter is that language; repeated rows are
scored each; an empty table gives no rows; other columns stay (``lang_pred`` and ``lang_score`` are replaced).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_mod, materialize

SLOTS = 2048
PER_LANGUAGE = 1000
LANGUAGES = 250
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def features(texts: list[str | None]) -> np.ndarray:
    """[rows, SLOTS] float32, rows of unit length or zero."""
    raw = [(t or "").lower().encode("utf-8", "ignore") for t in texts]
    out = np.zeros((len(raw), SLOTS), np.float32)
    for s, e in ((a, b) for lo, hi in blocks([len(t) for t in raw], 1 << 20) for a, b in ((i, min(i + 256, hi)) for i in range(lo, hi, 256))):
        buf = np.frombuffer(b" " + b" ".join(raw[s:e]) + b" ", np.uint8)
        doc = np.repeat(np.arange(e - s), [len(t) + 1 for t in raw[s:e]])
        doc = np.append(doc, e - s - 1)
        letter = LETTER[buf]
        keep = letter | np.concatenate([[True], letter[:-1]])  # one blank stands for any run of other bytes
        buf, doc = np.where(letter, buf, 32)[keep].astype(np.uint64), doc[keep]
        run, total = np.zeros(len(buf), np.uint64), np.zeros((e - s) * SLOTS)
        for n in range(1, 5):
            run = run[: len(buf) - n + 1] | (buf[n - 1 :] << np.uint64(8 * (n - 1)))
            own = (doc[: len(run)] == doc[n - 1 :]) & (run != 32)
            slot = ((run + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)
            total += np.bincount(doc[: len(run)][own] * SLOTS + slot[own].astype(np.int64), minlength=len(total))
        x = np.sqrt(total.reshape(e - s, SLOTS))
        out[s:e] = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    return out


def families(centroids: np.ndarray, count: int) -> list[int]:
    """Family number of each language: average linkage by cosine until ``count`` families are left."""
    unit = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    near, groups = unit @ unit.T, [[i] for i in range(len(unit))]
    while len(groups) > count:
        _, a, b = max((float(near[np.ix_(g, h)].mean()), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        groups[-a] += groups.pop(-b)
    return [next(k for k, g in enumerate(groups) if i in g) for i in range(len(unit))]


def _adam(par: list[np.ndarray], gradient, steps: int, rate: float) -> None:
    """Minimise in place, in single precision."""
    m, u = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    for t in range(1, steps + 1):
        for k, g in enumerate(gradient(*par)):
            m[k] = 0.9 * m[k] + 0.1 * g
            u[k] = 0.999 * u[k] + 0.001 * g * g
            par[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(u[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 120, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights [SLOTS, classes], bias) of a softmax regression; classes weigh the same."""
    weight = ((1.0 / np.maximum(np.bincount(y, minlength=classes), 1))[y][:, None] / classes).astype(np.float32)
    goal = np.eye(classes, dtype=np.float32)[y]

    def gradient(w, b):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - goal) * weight
        return x.T @ g + decay * w, g.sum(0)

    par = [np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)]
    _adam(par, gradient, steps, rate)
    return par[0], par[1]


def fit_margin(x: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear support vector machine with squared hinge loss; y is 1 or -1, both sides weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)

    def gradient(w, b):
        g = -2 * y * np.maximum(1 - y * (x @ w + b[0]), 0) * weight
        return x.T @ g + decay * w, np.array([g.sum()])

    par = [np.zeros(x.shape[1], np.float32), np.zeros(1, np.float32)]
    _adam(par, gradient, steps, rate)
    return par[0], float(par[1][0])


def labelled_sample(docs: DataFrame, fold: int, left_out: int, per_language: int, languages: int = LANGUAGES) -> DataFrame:
    """doc_id, lang, text: about ``per_language`` texts of each language, chosen by a hash of doc_id alone; no other text moves."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", fold) != left_out))
    ids = known.groupBy("lang", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = ids.orderBy(F.desc("n"), "lang").limit(languages).select("lang", (per_language / F.col("n")).alias("share"))
    chosen = known.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    return chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fit(sample: DataFrame) -> dict:
    """The model of a bounded sample (doc_id, lang, text); features are made in parallel, one task fits the families, one task each pair."""

    def make(batches):
        for b in batches:
            x = features(b.column("text").to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    def matrix(pdf):
        return np.frombuffer(b"".join(pdf["x"]), np.float16).reshape(len(pdf), -1).astype(np.float32)

    def top(pdf):
        pdf = pdf.sort_values(["lang", "doc_id"])
        x, names = matrix(pdf), sorted(pdf["lang"].unique())
        lang = np.searchsorted(names, pdf["lang"].to_numpy())
        family = families(np.stack([x[lang == i].mean(0) for i in range(len(names))]), int(np.ceil(np.sqrt(len(names)))))
        w, b = fit_softmax(x, np.array(family)[lang], max(family) + 1)
        return pd.DataFrame({"lang": names, "family": family, "w": [w[:, f].astype(np.float32).tobytes() for f in family], "b": [float(b[f]) for f in family]})

    def pair(key, pdf):
        pdf = pdf.sort_values(["lang", "doc_id"])
        w, b = fit_margin(matrix(pdf), np.where(pdf["lang"] == key[0], 1.0, -1.0).astype(np.float32))
        return pd.DataFrame({"one": [key[0]], "other": [key[1]], "w": [w.astype(np.float32).tobytes()], "b": [b]})

    rows = materialize(sample.select("doc_id", "lang", "text").mapInArrow(make, "doc_id long, lang string, x binary"), "language-sample")
    found = sorted(rows.groupBy(F.lit(0).alias("whole")).applyInPandas(top, "lang string, family int, w binary, b double").collect())
    names, family = [r["lang"] for r in found], [r["family"] for r in found]
    pairs = [(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and family[i] == family[j]]
    machines = []
    if pairs:
        sides = rows.sparkSession.createDataFrame([(x, a, b) for a, b in pairs for x in (a, b)], "lang string, one string, other string")
        machines = rows.join(F.broadcast(sides), "lang").groupBy("one", "other").applyInPandas(pair, "one string, other string, w binary, b double").collect()  # a row for each pair of the learned languages
    array = lambda r: np.frombuffer(r["w"], np.float32)
    at = {n: i for i, n in enumerate(names)}
    by_family = {f: r for f, r in zip(family, found)}
    return {
        "names": names, "family": np.array(family, int), "w": np.stack([array(by_family[f]) for f in sorted(by_family)]) if found else None, "b": np.array([by_family[f]["b"] for f in sorted(by_family)]),
        "one": np.array([at[r["one"]] for r in machines], int), "other": np.array([at[r["other"]] for r in machines], int),
        "v": np.stack([array(r) for r in machines]) if machines else np.zeros((0, SLOTS), np.float32), "c": np.array([r["b"] for r in machines]),
    }


def decide(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(language number, score) of each row: probability of the family times the mean of the winner's squashed margins in it."""
    z = x @ model["w"].T + model["b"]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    margin = x @ model["v"].T + model["c"]
    k, rows = len(model["names"]), np.arange(len(x))
    votes, sure, met = np.zeros((len(x), k)), np.zeros((len(x), k)), np.zeros(k)
    for side, sign in ((model["one"], 1), (model["other"], -1)):
        for j, lang in enumerate(side):
            m = sign * margin[:, j]
            votes[:, lang] += (m > 0) + np.clip(m, -50, 50) * 1e-6  # the margin decides between equal votes
            sure[:, lang] += 1 / (1 + np.exp(-2 * np.clip(m, -50, 50)))
            met[lang] += 1
    votes[model["family"][None, :] != best[:, None]] = -np.inf
    lang = votes.argmax(1)
    return lang, p[rows, best] * np.where(met[lang] > 0, sure[rows, lang] / np.maximum(met[lang], 1), 1.0)


def predict_language(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred and lang_score."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            names, langs, scores = shared.value["names"], [], []
            for s in range(0, b.num_rows if names else 0, 512):
                lang, score = decide(features(b.column("text").slice(s, 512).to_pylist()), shared.value)
                langs.append(lang)
                scores.append(score)
            pred = pa.array([names[i] for i in np.concatenate(langs)] if langs else ["und"] * b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pred, pa.array(np.concatenate(scores) if scores else np.zeros(b.num_rows))], names=[*b.schema.names, "lang_pred", "lang_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = docs.withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, f"{fields}, `_letter` boolean, lang_pred string, lang_score double")
    und = ~F.col("_letter")
    return rows.withColumns({"lang_score": F.when(und | (F.col("lang_pred") == "und"), 0.0).otherwise(F.col("lang_score")), "lang_pred": F.when(und, "und").otherwise(F.col("lang_pred"))}).drop("_letter")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs.select("doc_id", "lang", "text"), 3, 1, PER_LANGUAGE))
    return predict_language(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
