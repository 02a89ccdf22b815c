"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

* Codebooks are fitted on a bounded sample, rows with the smallest hashes of their id (``sample_rows``). There are
  ``lists_per_root`` * sqrt(n) centroids, as far as the sample holds ``SAMPLE_A_LIST`` rows for each.
* Of equal vectors only the k + 1 smallest ids can be among any query's k nearest, so a window keeps those:
  a group of copies of any size costs no more than that.
* Every vector goes to its nearest centroid's list as the codes of its residual. Lists, or parts of a long list, are packed into
  parts of about ``PART`` vectors, which are the unit of work. A query is sent once to every part that holds a list it
  probes, with the numbers of those lists; more than ``QUERIES`` queries meet a part in several tasks.
* A query probes the lists with the largest inner products with their centroids. Asymmetric distance tables (query against
  code words) give each probed vector's approximate score; the best ``rerank`` of a part, and everything that ties
  with the last of them, are scored exactly in double precision. A query's best of each part are merged by a window.
* The exact way: ``probe_share=1.0, rerank=None`` scores every vector of every list.

The embeddings of the test tables are nearly isotropic, so nearest neighbours are spread over many lists whatever the
index: a recall of 0.9 takes about half of them. On clustered vectors a smaller ``probe_share`` holds it.

Defined cases: vectors that are null, zero, of another length, or hold null or non-finite components take no part;
ties go to the smaller vec_id; rows that repeat an id and its vector count once, as query and as candidate; an id with several
vectors has a result for each, and none of them is its own candidate; fewer candidates than k give fewer rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors in a part, the most of one list in a part, queries that meet a part at a time, and queries scored at once.
PART, BLOCK, QUERIES, BATCH = 1 << 15, 4096, 1 << 14, 256
SAMPLE_A_LIST = 16


def _kmeans(x: np.ndarray, k: int, rng, steps: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[s : s + 8192] @ c.T - half, axis=1) for s in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def _fit(x: np.ndarray, lists: int, parts: int, codes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    coarse = _kmeans(np.unique(x, axis=0), lists, rng)
    rest = (x - coarse[_nearest(x, coarse)]).reshape(len(x), parts, -1)
    books = []
    for p in range(parts):
        own = np.unique(rest[:, p], axis=0)
        b = _kmeans(own, codes, rng)
        books.append(np.concatenate([b, np.repeat(b[:1], codes - len(b), axis=0)]))
    return coarse, np.stack(books)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, probe_share: float = 0.5, rerank: int | None = 96, sample_rows: int = 20_000, lists_per_root: float = 4.0, parts: int = 16, codes: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score for each distinct row of ``queries`` (both have vec_id, embedding)."""
    spark = vectors.sparkSession
    v = _sound(vectors)
    dims = v.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, n = dims["d"], dims["n"]
    parts = next(p for p in range(min(parts, dim), 0, -1) if dim % p == 0)
    v, q = (_sound(d).filter(F.size("embedding") == dim).dropDuplicates(["vec_id", "embedding"]) for d in (vectors, queries))
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()["embedding"]  # bounded by sample_rows
    lists = max(1, min(len(sample) // SAMPLE_A_LIST, round(lists_per_root * math.sqrt(n))))
    coarse, books = _fit(np.stack(sample.to_list()).astype(np.float64), lists, parts, codes)
    model = spark.sparkContext.broadcast((coarse, books))
    probes = max(1, min(len(coarse), max(24, math.ceil(probe_share * len(coarse)))))

    def assign(batches):
        c, b = model.value
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["embedding"].to_list()).astype(np.float64)
                at = _nearest(x, c)
                rest = (x - c[at]).reshape(len(x), parts, -1)
                code = np.stack([_nearest(rest[:, p], b[p]) for p in range(parts)], axis=1).astype(np.uint8)
                yield pdf[["vec_id", "embedding"]].assign(list=at.astype(np.int32), code=[r.tobytes() for r in code])

    alike = Window.partitionBy("embedding").orderBy("vec_id")
    single = v.withColumn("copy", F.row_number().over(alike)).filter(F.col("copy") <= k + 1).select("vec_id", "embedding")
    indexed = materialize(single.mapInPandas(assign, "vec_id long, embedding array<double>, list int, code binary"), "ann-index")
    sizes = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each centroid
    cuts = np.array([-(-sizes.get(c, 0) // BLOCK) for c in range(len(coarse))])
    first = np.concatenate([[0], np.cumsum(cuts)])  # of each list, its first piece
    piece_size = np.repeat([sizes.get(c, 0) / max(1, cuts[c]) for c in range(len(coarse))], cuts)
    n_parts = max(12, -(-sum(sizes.values()) // PART))
    part_of = np.minimum((np.cumsum(piece_size) - piece_size) * n_parts // max(1, piece_size.sum()), n_parts - 1).astype(np.int32)
    n_queries = q.count()
    salts = max(1, -(-n_queries // QUERIES))
    place = spark.sparkContext.broadcast((cuts, first, part_of))  # a few numbers for each list and each BLOCK vectors of a long one

    def to_part(batches):
        cut, start, of = place.value
        for pdf in batches:
            at = pdf["list"].to_numpy()
            piece = start[at] + pdf["vec_id"].to_numpy() % cut[at]
            yield pdf.assign(list=piece.astype(np.int32), part=of[piece])

    placed = indexed.mapInPandas(to_part, "vec_id long, embedding array<double>, list int, code binary, part int")
    placed = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probe(batches):
        (c, _), (cut, start, of) = model.value, place.value
        for pdf in batches:
            for s in range(0, len(pdf), 1024):
                own = pdf.iloc[s : s + 1024]
                x = np.stack(own["embedding"].to_list()).astype(np.float64)
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
                rows = []
                for i, e, key, lists_ in zip(own["vec_id"], own["embedding"], own["key"], near):
                    pieces = np.concatenate([np.arange(start[t], start[t] + cut[t]) for t in lists_])
                    where = of[pieces]
                    rows += [(i, e, key, int(w), pieces[where == w].astype("<i4").tobytes()) for w in np.unique(where)]
                yield pd.DataFrame(rows, columns=["query_id", "query", "key", "part", "pieces"])

    probed = q.withColumn("key", F.xxhash64("vec_id", "embedding")).mapInPandas(probe, "query_id long, query array<double>, key long, part int, pieces binary")
    probed = probed.withColumn("salt", F.pmod("key", F.lit(salts)).cast("int"))

    def score(own, asked):
        out = []
        if len(own) and len(asked):
            _, b = model.value
            c = model.value[0].astype(np.float32)
            start = place.value[1]
            own = own.sort_values(["list", "vec_id"])
            ids, x, piece = own["vec_id"].to_numpy(), np.stack(own["embedding"].to_list()), own["list"].to_numpy()
            code = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), parts).astype(np.int64)
            edge = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
            at = {int(piece[s]): (s, e) for s, e in zip(edge, edge[1:])}
            for s in range(0, len(asked), BATCH):
                some = asked.iloc[s : s + BATCH]
                y = np.stack(some["query"].to_list())
                tables = np.einsum("pkd,npd->pnk", b, y.reshape(len(y), parts, -1), optimize=True).astype(np.float32)
                near = np.full((len(y), len(own)), -np.inf, np.float32)
                pieces = [np.frombuffer(t, "<i4") for t in some["pieces"]]
                who, what = np.repeat(np.arange(len(y)), [len(t) for t in pieces]), np.concatenate(pieces)
                order = np.argsort(what, kind="stable")
                who, what = who[order], what[order]
                cut = np.flatnonzero(np.diff(what, prepend=-1, append=-1))
                for f, e in zip(cut, cut[1:]):
                    if int(what[f]) in at:
                        lo, hi = at[int(what[f])]
                        asks = who[f:e]
                        total = np.repeat((y[asks].astype(np.float32) @ c[np.searchsorted(start, what[f], side="right") - 1])[:, None], hi - lo, axis=1)
                        for p in range(parts):
                            total += tables[p][asks][:, code[lo:hi, p]]
                        near[asks, lo:hi] = total
                if rerank is None or rerank >= near.shape[1]:
                    take = near > -np.inf
                else:
                    take = (near >= np.partition(near, near.shape[1] - rerank, axis=1)[:, [near.shape[1] - rerank]]) & (near > -np.inf)
                qi, vi = np.nonzero(take)
                other = ids[vi] != some["query_id"].to_numpy()[qi]
                qi, vi = qi[other], vi[other]
                exact = np.concatenate([np.einsum("nd,nd->n", x[vi[a : a + 65536]], y[qi[a : a + 65536]]) for a in range(0, len(vi), 65536)] or [np.zeros(0)])
                order = np.lexsort((ids[vi], -exact, qi))
                qi, vi, exact = qi[order], vi[order], exact[order]
                top = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
                out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[qi[top]], "key": some["key"].to_numpy()[qi[top]], "vec_id": ids[vi[top]], "score": exact[top]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "key", "vec_id", "score"])

    found = placed.groupBy("part", "salt").cogroup(probed.groupBy("part", "salt")).applyInPandas(score, "query_id long, key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sound(df: DataFrame) -> DataFrame:
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return df.select("vec_id", e.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & e.isNotNull() & fine)


def op7_ann_search(spark, sf_dir) -> DataFrame:
    from .common import table

    v = table(spark, sf_dir, "embeddings")
    return search(v, v.filter("vec_id % 20 = 0"))
