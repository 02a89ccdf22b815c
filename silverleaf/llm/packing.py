"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction.

A document is its token ids and an end token; one longer than a sequence is cut into full pieces, its first
piece takes the remainder. Lengths are whole numbers up to the capacity, so an instance is a histogram of at
most ``capacity`` counts, whatever the corpus: the plan is made on that histogram and dealt out to the rows.

* Reduction: for the longest piece left, a set that provably dominates every other set holding that piece is
  fixed for good, as many times as the counts allow: the piece alone if nothing fits; with the longest
  fitting piece k if the two fill the sequence, if no two others fit together, or if no three others
  fit and k is at least as long as the best pair.
* What is left is packed best-fit decreasing: each piece goes to the fullest open sequence it fits.
* Pieces of a length are numbered in salted parts (a hot length is never one group) and take the places of
  that length in order.

Defined cases: null or empty text -> the end token alone; repeated rows are packed each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_columns
from .token_counts import FragmentIds, in_worker, tokenizer_path

END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Salted parts of a length follow the corpus, one for about PART_PIECES pieces, so a hot length is never one task. At most
#: MOST_PARTS, as the driver reads a count for each length and part; a part grows beyond that, and Spark's window spills it.
PART_PIECES, MOST_PARTS = 100_000, 2048


def _dominant(counts: dict, sizes: list, a: int, room: int) -> tuple[int, ...] | None:
    """What provably may stand beside ``a``: () for nothing, a length, or None if no rule applies."""
    i = bisect.bisect_right(sizes, room)
    if not i:
        return ()
    k = sizes[i - 1]
    if k == room:
        return (k,)
    small = []
    for s in sizes[:3]:
        small += [s] * min(3 - len(small), counts[s] - (s == a and len(sizes) == 1))
        if len(small) >= 3:
            break
    if len(small) < 2 or small[0] + small[1] > room:
        return (k,)
    if len(small) < 3 or sum(small[:3]) > room:
        j, best = i - 1, 0
        for q in range(i):
            s = sizes[q]
            while j >= 0 and sizes[j] + s > room:
                j -= 1
            if j < q:
                break
            t = sizes[j] if j > q or counts[s] > 1 else (sizes[j - 1] if j else 0)
            if t:
                best = max(best, s + t)
        if k >= best:
            return (k,)
    return None


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """[(number of sequences, {length: pieces in each})] and how many sequences the reduction fixed."""
    counts = {s: n for s, n in histogram.items() if n}
    sizes = sorted(counts)
    fixed: list[tuple[int, dict[int, int]]] = []
    held: list[int] = []  # longest pieces for which no rule applied; each ends its share of the reduction

    def take(s, n):
        counts[s] -= n
        if not counts[s]:
            del counts[s]
            sizes.pop(bisect.bisect_left(sizes, s))

    for a in sorted(counts, reverse=True):
        while counts.get(a):
            beside = _dominant(counts, sizes, a, capacity - a)
            if beside is None:
                held.append(a)
                break
            if not beside:
                n, sets = counts[a], {a: 1}
            elif beside[0] == a:
                n = counts[a] // 2
                if not n:  # a single piece of this length is left: others decide
                    held.append(a)
                    break
                sets = {a: 2}
            else:
                n, sets = min(counts[a], counts[beside[0]]), {a: 1, beside[0]: 1}
            for s, c in sets.items():
                take(s, n * c)
            fixed.append((n, sets))
    done = sum(n for n, _ in fixed)
    open_bins: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms: list[int] = []

    def put(room, n, sets):
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append((n, sets))

    for s in reversed(sizes):
        n = counts[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                if n // each:
                    put(capacity - each * s, n // each, {s: each})
                if n % each:
                    put(capacity - n % each * s, 1, {s: n % each})
                break
            room = rooms[i]
            m, sets = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
            each = room // s
            full = min(m, n // each)
            if full:
                put(room - each * s, full, sets | {s: each})
            n -= full * each
            m -= full
            if m and n:  # the last pieces fill one sequence partly
                put(room - n * s, 1, sets | {s: n})
                n, m = 0, m - 1
            if m:
                put(room, m, sets)
    return fixed + [x for group in open_bins.values() for x in group], done


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches):
        t, end = in_worker(FragmentIds, path), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = t.ids(text or "") + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                out += [(i, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(edges, edges[1:]))]
            yield with_columns(b, PIECES, **{c: [x[k] for x in out] for k, c in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))})

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    pieces = materialize(token_pieces(docs, path or tokenizer_path(), capacity, end_id), "packing-pieces")
    salts = min(MOST_PARTS, max(16, -(-pieces.count() // PART_PIECES)))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sums = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity * MOST_PARTS rows
    parts: dict[int, dict[int, int]] = {}
    for r in sums:
        parts.setdefault(r["length"], {})[r["salt"]] = r["n"]
    plan, fixed = plan_packing({s: sum(p.values()) for s, p in parts.items()}, capacity)
    before = {s: np.cumsum([0, *[p.get(k, 0) for k in range(salts)]]) for s, p in parts.items()}
    places: dict[int, list] = {}
    base = 0
    for n, sets in plan:
        at = 0
        for s, c in sets.items():
            got = places.setdefault(s, [])
            first = got[-1][0] + got[-1][1] * got[-1][3] if got else 0
            got.append((first, n, base, c, at))
            at += s * c
        base += n
    places = {s: np.asarray(v, np.int64) for s, v in places.items()}

    def deal(batches):
        for b in batches:
            seq, off = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            length, salt, number = (b.column(c).to_numpy() for c in ("length", "salt", "number"))
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                rank = before[s][salt[at]] + number[at] - 1
                row = places[s][np.searchsorted(places[s][:, 0], rank, side="right") - 1]
                slot = rank - row[:, 0]
                seq[at] = row[:, 2] + slot // row[:, 3]
                off[at] = row[:, 4] + slot % row[:, 3] * s
            yield with_columns(b, PIECES + ", sequence_id long, offset long", sequence_id=seq, offset=off)

    window = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return pieces.withColumn("number", F.row_number().over(window)).mapInArrow(deal, PIECES + ", sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
