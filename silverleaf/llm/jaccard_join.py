"""N-gram Jaccard self-join with rare-first prefix filtering, and the groups of linked documents.

* A document's set is its distinct 5-word shingles as 64-bit hashes; its node is the 64-bit signature of the
  set, so copies of any number are one node from the start.
* Shingles are ordered rare first, by a fixed-size count sketch over all documents, then by hash. Two sets
  that link share a shingle within their prefixes of n - ceil(0.75 n) + 1 shingles. Prefix entries are packed by
  hash range (bucket) and each bucket keeps the shingles that two nodes share.
* Count filter: of the shingles up to the end of both prefixes, two sets share only those found here, so nodes that
  meet in shingles of few holders only (``FEW``) need enough of them; others cannot link and go. Full sets are
  stored once, by node, for the nodes left.
* Merge rounds: a node is paired, per shingle, with one pivot (of the largest component there, the node whose shared
  shingle comes first) and with its next neighbour by size, so pairs are linear in the entries. The most
  frequent pair of each node that passes the length and positional filters and was not tried is verified, and
  links join nodes into components. Rounds only make the last step smaller.
* Last step, exact: whatever still shares a prefix shingle across components and passes the filters gives one row
  (node, other component) - not one for each member. The component's members are cut into blocks of bounded size. A
  node is compared with a block's union first: if it shares too little with that, no member can link. Else it is
  compared with the members, and stops at the first that links. Pairs inside a component need no test, as they
  change no component. So groups of near copies never expand into all pairs, and no link between components is lost.
* Each comparison runs a length filter, a suffix filter (what two sets can share in each of 64 hash ranges), then
  the full sets.

Defined cases: null, empty or blank text -> empty set, linked with nothing; under 5 words the whole sequence is one
shingle; rows that repeat a doc_id are judged each by its own text; rows without doc_id link too, and get the least
doc_id of their component, null if it has none; an empty table gives no rows; other columns are ignored. 64-bit
hashes decide: the chance of a wrong result is about n*n / 2**65 for n distinct shingles of two compared sets, or n nodes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NONBLANK, Words, blocks, byte_list, delete_path, discard, input_bytes, materialize, mix, pack_sorted, release, scratch_path, text_slices, unpack_sorted
from .components import components

SKETCH_BITS = 21
FILTER_BITS = 23
RANGES = 64
MERGE_ROUNDS = 3
#: Pairs of a node that are verified in a merge round.
TRIES = 1
#: In merge rounds a pair shares one prefix shingle for so many of its node's shingles at least; the last step has no such bound.
MERGE_SHARE = 50
#: A block of a component's members holds about so many shingles (8 bytes each); a block meets about so many nodes at a time.
BLOCK_SHINGLES = 1 << 15
BLOCK_NODES = 128
#: (node, component) rows in one group of the comparison.
ROWS_A_GROUP = 64
#: Up to so many nodes of a shingle the count filter looks at pairs; nodes of a shingle with more stay.
FEW = 16
#: Stands for a missing doc_id in the order of nodes.
NO_ID = 2**63 - 1


def shingle_sets(texts: list[bytes], words: int):
    """(index, sorted distinct shingle hashes) of each text that has a word."""
    for s, e in blocks([len(t) for t in texts], 1 << 20):
        w = Words(texts[s:e], NONBLANK)
        first, h = w.ngrams(words)
        cut = np.searchsorted(w.doc[first], np.arange(e - s + 1))
        for i in range(e - s):
            if w.counts[i] >= words:
                yield s + i, np.unique(h[cut[i] : cut[i + 1]])
            elif w.counts[i]:
                yield s + i, w.whole(i)


def signature(u: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(u), dtype=np.uint64) + np.uint64(len(u))]))[0].astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """One scan: doc rows (doc_id, size, sig) and slices of the count sketch, told apart by ``slice``."""
    slots, step = 1 << SKETCH_BITS, 1 << 16

    def scan(batches):
        total = np.zeros(slots, np.int64)
        for b in batches:
            texts, ids = byte_list(b.column("text")), b.column("doc_id").to_pylist()
            size, sig = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for i, u in shingle_sets(texts, words):
                size[i], sig[i] = len(u), signature(u)
                np.add.at(total, (u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_pydict({"slice": pa.nulls(len(ids), pa.int32()), "n": pa.nulls(len(ids), pa.binary()), "doc_id": pa.array(ids, pa.int64()), "size": size, "sig": sig})
        out = [(k, total[k * step : (k + 1) * step].astype("<u4").tobytes()) for k in range(slots // step)] if total.any() else []
        none = pa.nulls(len(out), pa.int64())
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k for k, _ in out], pa.int32()), "n": pa.array([x for _, x in out], pa.binary()), "doc_id": none, "size": none, "sig": none})

    return docs.select("doc_id", "text").mapInArrow(scan, "slice int, n binary, doc_id long, size long, sig long")


def _sketch(scanned: DataFrame) -> np.ndarray:
    def add(pdf):
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in pdf["n"])
        return pdf.head(1)[["slice"]].assign(n=[np.minimum(total, 2**31 - 1).astype("<i4").tobytes()])

    rows = scanned.filter("slice is not null").select("slice", "n").groupBy("slice").applyInPandas(add, "slice int, n binary").collect()  # 2**21 counts
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    for r in rows:
        out[r["slice"] << 16 : (r["slice"] + 1) << 16] = np.frombuffer(r["n"], "<i4")
    return out


def _pack(h, sig, n, pos):
    """Entries sorted by hash: hashes, index into the nodes, position; then the nodes."""
    order = np.argsort(h, kind="stable")
    nodes, first, index = np.unique(sig[order], return_index=True, return_inverse=True)
    return pack_sorted(h[order]), index.astype("<u4" if len(nodes) > 65535 else "<u2").tobytes(), pos[order].astype("<u4" if len(pos) and pos.max() > 65535 else "<u2").tobytes(), nodes.tobytes(), n[order][first].astype("<u4").tobytes()


def _unpack(row):
    h, nodes, size = unpack_sorted(row.h), np.frombuffer(row.nodes, np.int64), np.frombuffer(row.size_, "<u4").astype(np.int64)
    wide = lambda b: np.frombuffer(b, "<u4" if len(b) == 4 * len(h) else "<u2").astype(np.int64)
    i = wide(row.index_)
    return h, nodes[i], size[i], wide(row.pos)


ENTRIES = "bucket int, h binary, index_ binary, pos binary, nodes binary, size_ binary"


def _entries(docs: DataFrame, words: int, percent: int, sketch, buckets: int) -> DataFrame:
    def send(batches):
        counts = sketch.value
        for texts in (t for b in batches for t in text_slices(b.column("text"), 16 << 20)):
            seen, out = set(), []
            for _, u in shingle_sets(texts, words):
                sig = signature(u)
                if sig in seen:
                    continue
                seen.add(sig)
                order = np.argsort(counts[(u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[: prefix_length(len(u), percent)]
                out.append((u[order], sig, len(u)))
            if not out:
                continue
            k = np.array([len(x[0]) for x in out])
            h = np.concatenate([x[0] for x in out])
            sig, n = np.repeat(np.array([x[1] for x in out], np.int64), k), np.repeat(np.array([x[2] for x in out]), k)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(k) - k, k)
            where = ((mix(h) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(buckets + 1))
            rows = [(j, *_pack(h[o], sig[o], n[o], pos[o])) for j in range(buckets) if len(o := order[cut[j] : cut[j + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if not c else pa.binary()) for c in range(6)], names=["bucket", "h", "index_", "pos", "nodes", "size_"])

    return docs.select("text").mapInArrow(send, ENTRIES)


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entries of the bucket's shingles that two nodes or more share."""
    parts = [_unpack(r) for r in pdf.itertuples()]
    h, sig, n, pos = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((sig, h))
    h, sig, n, pos = h[order], sig[order], n[order], pos[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
    h, sig, n, pos = h[keep], sig[keep], n[keep], pos[keep]
    same = h[1:] == h[:-1]
    keep = np.zeros(len(h), bool)
    keep[1:] = same
    keep[:-1] |= same
    if not keep.any():
        return pd.DataFrame(columns=["bucket", "h", "index_", "pos", "nodes", "size_"])
    row = _pack(h[keep], sig[keep], n[keep], pos[keep])
    return pd.DataFrame([(int(pdf["bucket"].iloc[0]), *row)], columns=["bucket", "h", "index_", "pos", "nodes", "size_"])


PAIRS = "x long, c long, size long, n long"


def _passes(pi, pj, ni, nj, percent: int, each: bool = False):
    """Length and positional filters of pairs that share a shingle at positions pi, pj of sets of ni, nj shingles.

    Linked sets pass at their first common shingle or, with ``each``, at every one.
    """
    swap = ni > nj
    pi, pj, ni, nj = np.where(swap, pj, pi), np.where(swap, pi, pj), np.where(swap, nj, ni), np.where(swap, ni, nj)
    at_most = np.minimum(pi, pj) + np.minimum(ni - pi, nj - pj)
    fine = (100 * ni >= percent * nj) & (at_most * (100 + percent) >= percent * (ni + nj))
    return fine if each else fine & (pi < ni + (-2 * percent * ni) // (100 + percent) + 1)  # the smaller set shares in its shorter prefix


def _few(row, percent: int) -> pd.DataFrame:
    """Pairs (a, b) of nodes in shingles with ``FEW`` nodes at most and how many they share; (a, a) for nodes of other shingles."""
    h, sig, n, pos = _unpack(row)
    order = np.lexsort((sig, n, h))
    sig, n, pos = sig[order], n[order], pos[order]
    size = np.diff(_runs(h[order]))
    group, held = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
    out = []
    for k in range(1, min(FEW, len(group))):
        i = np.flatnonzero((group[: len(group) - k] == group[k:]) & (held[: len(group) - k] <= FEW))
        j = i + k
        t = _passes(pos[i], pos[j], n[i], n[j], percent, each=True)
        out.append(np.stack([sig[i[t]], sig[j[t]], n[i[t]], n[j[t]]], axis=1))
    many, at = np.unique(sig[held > FEW], return_index=True)
    own = n[held > FEW][at]
    t = np.concatenate([*out, np.stack([many, many, own, own], axis=1)])
    swap = t[:, 0] > t[:, 1]
    t[swap] = t[swap][:, [1, 0, 3, 2]]
    t = t[np.lexsort((t[:, 1], t[:, 0]))]
    edge = _runs(t[:, 0], t[:, 1]) if len(t) else np.zeros(1, np.int64)
    first = t[edge[:-1]]
    return pd.DataFrame({"a": first[:, 0], "b": first[:, 1], "na": first[:, 2], "nb": first[:, 3], "c": np.diff(edge)})


def _enough(shared: str, na: str, nb: str, percent: int):
    """Count filter: what two sets share up to the end of both prefixes, and all that follows, can make them link."""
    after = F.ceil(F.greatest(na, nb) * percent / 100) - 1
    return (F.col(shared) + after) * (100 + percent) >= percent * (F.col(na) + F.col(nb))


def _wanted(groups: DataFrame, percent: int) -> DataFrame:
    """Nodes (sig) that the count filter leaves."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                yield _few(r, percent)

    pairs = groups.mapInPandas(run, "a long, b long, na long, nb long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return pairs.filter((F.col("a") == F.col("b")) | _enough("c", "na", "nb", percent)).select(F.explode(F.array("a", "b")).alias("sig")).distinct()


def _only(groups: DataFrame, held: DataFrame) -> DataFrame:
    """``groups`` with the nodes in ``held`` (bucket, sig) only."""

    def keep(entries, own):
        if own.empty or entries.empty:
            return pd.DataFrame(columns=["bucket", "h", "index_", "pos", "nodes", "size_"])
        nodes, out = np.unique(own["sig"].to_numpy()), []
        for r in entries.itertuples():
            h, sig, n, pos = _unpack(r)
            t = np.isin(sig, nodes)
            out.append((r.bucket, *_pack(h[t], sig[t], n[t], pos[t])))
        return _shared(pd.DataFrame(out, columns=["bucket", "h", "index_", "pos", "nodes", "size_"]))

    return groups.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(keep, ENTRIES)


def _runs(*keys) -> np.ndarray:
    """Start of each run of equal keys, and the end."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), len(new))


class _Groups:
    """Entries of a bucket in shingles whose nodes are of several components: shingle, node, size, position, component."""

    def __init__(self, row, label: pd.DataFrame):
        h, sig, n, pos = _unpack(row)
        own = sig.copy()
        if len(label):
            label = label.drop_duplicates("sig").sort_values("sig")
            keys = label["sig"].to_numpy()
            at = np.minimum(np.searchsorted(keys, sig), len(keys) - 1)
            own = np.where(keys[at] == sig, label["component"].to_numpy()[at], sig)
        _, which = np.unique(own, return_inverse=True)
        nodes_of = np.bincount(which[np.unique(sig, return_index=True)[1]], minlength=which.max() + 1 if len(which) else 0)
        order = np.lexsort((pos, own, -nodes_of[which], h))  # the bucket's largest component first
        self.sig, self.n, self.pos, self.own = sig[order], n[order], pos[order], own[order]
        edge = _runs(h[order])
        size = np.diff(edge)
        group = np.repeat(np.arange(len(size)), size)
        several = self.own[edge[:-1]] != self.own[edge[1:] - 1]
        keep = several[group]
        self.sig, self.n, self.pos, self.own, group = (x[keep] for x in (self.sig, self.n, self.pos, self.own, group))
        edge = _runs(group) if len(group) else np.zeros(1, np.int64)
        self.first = np.repeat(edge[:-1], np.diff(edge))  # of each entry, the first of its shingle
        self.group = group

    def merge_pairs(self, percent: int) -> pd.DataFrame:
        """Each node with the pivot of its shingle and with its next neighbour by size."""
        out = []
        i = np.arange(len(self.sig))
        by_size = np.lexsort((self.sig, self.n, self.group))
        for x, c in ((i, self.first), (by_size[1:], by_size[:-1]), (by_size[:-1], by_size[1:])):
            t = (self.group[x] == self.group[c]) & (self.own[x] != self.own[c])
            x, c = x[t], c[t]
            t = _passes(self.pos[x], self.pos[c], self.n[x], self.n[c], percent)
            out.append(np.stack([self.sig[x[t]], self.sig[c[t]], self.n[x[t]], np.ones(t.sum(), np.int64)], axis=1))
        return _summed(out)

    def across(self, percent: int, step: int = 1 << 20) -> pd.DataFrame:
        """(node, component) for every two entries of a shingle in different components that pass the filters; the component is that which comes first."""
        edge = _runs(self.group, self.own) if len(self.sig) else np.zeros(1, np.int64)
        before = np.repeat(edge[:-1], np.diff(edge)) - self.first  # entries of components that come before
        out, x = [], np.flatnonzero(before)
        for s, e in blocks(before[x].tolist(), step):
            part = x[s:e]
            k = before[part]
            left = np.repeat(part, k)
            right = np.repeat(self.first[part], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            t = _passes(self.pos[left], self.pos[right], self.n[left], self.n[right], percent)
            left, right = left[t], right[t]
            rows = np.stack([self.sig[left], self.own[right], self.n[left], np.ones(len(left), np.int64)], axis=1)
            out.append(_summed([rows]).to_numpy())
        return _summed(out)


def _summed(rows: list) -> pd.DataFrame:
    """One row for each (x, c), with the sum of ``n``."""
    t = np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)
    t = t[np.lexsort((t[:, 1], t[:, 0]))]
    at = _runs(t[:, 0], t[:, 1])[:-1] if len(t) else np.zeros(0, np.int64)
    out = t[at].copy()
    if len(at):
        out[:, 3] = np.add.reduceat(t[:, 3], at)
    return pd.DataFrame(out, columns=["x", "c", "size", "n"])


_EDGES = np.arange(1, RANGES, dtype=np.uint64) << np.uint64(58)


class _Set:
    def __init__(self, data):
        self.u = unpack_sorted(data)
        self.ranges = np.diff(np.searchsorted(self.u, _EDGES), prepend=0, append=len(self.u))

    def links(self, other: _Set, percent: int) -> bool:
        need = percent * (len(self.u) + len(other.u))
        if 100 * min(len(self.u), len(other.u)) < percent * max(len(self.u), len(other.u)):
            return False
        if np.minimum(self.ranges, other.ranges).sum() * (100 + percent) < need:
            return False
        return len(np.intersect1d(self.u, other.u, assume_unique=True)) * (100 + percent) >= need


def _first_links(nodes: pd.DataFrame, members: pd.DataFrame, percent: int) -> list:
    """(x, y) for each node x of a unit and the first member y of its block that it links with."""
    ys = [_Set(d) for d in members["data_y"]]
    union, least = None, min(len(y.u) for y in ys)
    if len(ys) > 4:
        union = np.unique(np.concatenate([y.u for y in ys]))
    out = []
    for x, low, data in zip(nodes["x"], nodes["low"], nodes["data_x"]):
        s = _Set(data)
        if union is not None:
            need = percent * (len(s.u) + max(least, -(-percent * len(s.u) // 100)))
            at = np.minimum(np.searchsorted(union, s.u), len(union) - 1)
            if np.count_nonzero(union[at] == s.u) * (100 + percent) < need:
                continue
        for y, low_y, other in zip(members["y"], members["low_y"], ys):
            if s.links(other, percent):
                out.append((x, low, y, low_y))
                break
    return out


def _linked(pairs: DataFrame, label: DataFrame | None, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, la, b, lb) of rows (x, c): node x with members of component c, or with node c itself if there are no labels.

    Units (component, block, part of the nodes) are bounded in size and dealt by hash to groups of a few.
    """
    groups = max(1, pairs.count() // ROWS_A_GROUP)
    own = nodes.select(F.col("sig").alias("y"), F.col("sig").alias("c"), "size", F.col("low").alias("low_y"))
    if label is not None:
        of = label.select(F.col("node").alias("y"), "component")
        own = own.join(of, "y", "left").select("y", F.coalesce("component", "y").alias("c"), "size", "low_y")
    asked = pairs.groupBy("c").agg(F.count(F.lit(1)).alias("nx"))
    cuts = own.groupBy("c").agg(F.sum("size").alias("ny")).join(asked, "c").select(
        "c", F.ceil(F.col("ny") / BLOCK_SHINGLES).cast("int").alias("nb"), F.ceil(F.col("nx") / BLOCK_NODES).cast("int").alias("nxs"))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    dealt = lambda df: df.withColumn("unit", F.pmod(F.xxhash64("c", "block", "part"), F.lit(groups)).cast("int"))
    left = own.join(cuts, "c").select("c", "y", "low_y", F.pmod(F.xxhash64("y"), "nb").cast("int").alias("block"), spread("nxs", "part"))
    left = dealt(left).join(sets.select(F.col("sig").alias("y"), F.col("data").alias("data_y")), "y")
    right = pairs.join(cuts, "c").join(nodes.select(F.col("sig").alias("x"), "low"), "x")
    right = right.select("c", "x", "low", F.pmod(F.xxhash64("x"), "nxs").cast("int").alias("part"), spread("nb", "block"))
    right = dealt(right).join(sets.select(F.col("sig").alias("x"), F.col("data").alias("data_x")), "x")

    def compare(members, nodes):
        held = dict(list(members.groupby(["c", "block", "part"])))
        found = [link for key, own in nodes.groupby(["c", "block", "part"]) if key in held for link in _first_links(own, held[key], percent)]
        return pd.DataFrame(found, columns=["a", "la", "b", "lb"]).astype("int64")

    return left.groupBy("unit").cogroup(right.groupBy("unit")).applyInPandas(compare, "a long, la long, b long, lb long")


def link_documents(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, one row for each row of ``docs``."""
    spark = docs.sparkSession
    n_docs, n_bytes = input_bytes(docs)
    buckets = int(max(12, n_bytes // (24 << 20)))
    scanned = materialize(_summaries(docs, words), "jaccard-scan")
    sketch = spark.sparkContext.broadcast(_sketch(scanned))  # fixed size: 2**21 counts
    info = materialize(scanned.filter("size is not null").select("doc_id", F.col("size").alias("n_shingles"), "sig"), "jaccard-docs")
    discard(scanned)  # with the tasks' slices of the sketch
    groups = materialize(_entries(docs, words, percent, sketch, buckets).groupBy("bucket").applyInPandas(_shared, ENTRIES), "jaccard-groups")
    release(spark)

    def nodes(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame({"bucket": r.bucket, "sig": np.frombuffer(r.nodes, np.int64)})

    holders = lambda g: g.select("bucket", "nodes").mapInPandas(nodes, "bucket int, sig long")
    known = info.filter("n_shingles > 0").groupBy("sig").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("low"), F.first("n_shingles").alias("size"))
    live = materialize(_wanted(groups, percent).join(known, "sig"), "jaccard-nodes")
    every, groups = groups, materialize(_only(groups, holders(groups).join(live.select("sig"), "sig")), "jaccard-groups")
    discard(every)
    held = holders(groups)
    sets, drop_sets = _stored_sets(docs, words, live, int(max(12, n_bytes // (32 << 20))))

    def crossing(label, how):
        """Pairs (x, c) of nodes, or nodes and components, by bucket, from shingles that several components share."""
        if label is None:
            def alone(batches):
                for pdf in batches:
                    for r in pdf.itertuples():
                        yield how(_Groups(r, pd.DataFrame()))

            return groups.mapInPandas(alone, PAIRS)

        def cross(entries, own):
            return pd.concat([how(_Groups(r, own)) for r in entries.itertuples()] or [_summed([])])

        at = held.join(label.select(F.col("node").alias("sig"), "component"), "sig")
        return groups.groupBy("bucket").cogroup(at.groupBy("bucket")).applyInPandas(cross, PAIRS)

    label = tried = links = None
    for _ in range(MERGE_ROUNDS):
        pairs = crossing(label, lambda g: g.merge_pairs(percent)).groupBy("x", "c").agg(F.sum("n").alias("n"), F.first("size").alias("size")).filter(F.col("n") * MERGE_SHARE >= F.col("size"))
        if tried is not None:
            pairs = pairs.join(tried, ["x", "c"], "left_anti")
        best = Window.partitionBy("x").orderBy(F.desc("n"), "c")
        pairs = materialize(pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= TRIES).select("x", "c"), "jaccard-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = materialize(_linked(pairs, None, live, sets, percent), "jaccard-links")
        links = found if links is None else links.unionByName(found)
        if found.isEmpty():
            break
        label = components(links)
        release(spark)

    rest = materialize(crossing(label, lambda g: g.across(percent)).select("x", "c").distinct(), "jaccard-rest")
    links = links.unionByName(materialize(_linked(rest, label, live, sets, percent), "jaccard-links"))
    label = components(links)
    drop_sets()
    for done in (groups, rest, live):
        discard(done)
    release(spark)

    least = known.join(label.select(F.col("node").alias("sig"), F.col("low").alias("least")), "sig", "left").select("sig", F.nullif(F.coalesce("least", "low"), F.lit(NO_ID)).alias("component_id"))
    some = info.filter("n_shingles > 0").join(least, "sig").select("doc_id", "n_shingles", "component_id")
    return some.unionByName(info.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _stored_sets(docs: DataFrame, words: int, wanted: DataFrame, parts: int):
    """Table (sig, data) of the sets of the nodes in ``wanted``, bucketed by node, and how to drop it. One scan of the texts."""
    spark = docs.sparkSession
    may = spark.sparkContext.broadcast(_bitmap(wanted.select("sig")))  # fixed size: 2**23 bits

    def gather(batches):
        bits = may.value
        for b in batches:
            seen = set()
            for texts in text_slices(b.column("text"), 4 << 20):
                out = []
                for _, u in shingle_sets(texts, words):
                    s = signature(u)
                    at = s & ((1 << FILTER_BITS) - 1)
                    if s not in seen and bits[at >> 3] >> (7 - (at & 7)) & 1:
                        seen.add(s)
                        out.append((s, pack_sorted(u)))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.int64(), pa.binary()))], names=["sig", "data"])

    name, path = f"jaccard_sets_{uuid.uuid4().hex}", scratch_path(spark, "jaccard-sets")
    found = docs.select("text").mapInArrow(gather, "sig long, data binary").repartition(parts, "sig").dropDuplicates(["sig"])
    found.write.bucketBy(parts, "sig").option("compression", "zstd").option("path", path).saveAsTable(name)
    release(spark)

    def drop():
        spark.sql(f"drop table {name}")
        delete_path(spark, path)

    return spark.table(name), drop


def _bitmap(held: DataFrame) -> np.ndarray:
    def partial(batches):
        bits, any_ = np.zeros(1 << FILTER_BITS, bool), False
        for pdf in batches:
            bits[pdf["sig"].to_numpy() & ((1 << FILTER_BITS) - 1)] = any_ = True
        if any_:
            packed = np.packbits(bits)
            yield pd.DataFrame({"part": range(16), "bits": [x.tobytes() for x in np.split(packed, 16)]})

    def join(pdf):
        return pdf.head(1)[["part"]].assign(bits=[np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]]).tobytes()])

    rows = held.mapInPandas(partial, "part int, bits binary").groupBy("part").applyInPandas(join, "part int, bits binary").collect()  # 1 MB
    out = np.zeros((16, (1 << FILTER_BITS) // 128), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def op8_jaccard_join(spark, sf_dir) -> DataFrame:
    from .common import table

    return link_documents(table(spark, sf_dir, "documents"))
