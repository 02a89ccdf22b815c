"""Prefix trie, fill-in-middle and language identification against brute force, round trips and held-out labels."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from silverleaf.llm import fill_in_middle, language_id, prefix_trie
from silverleaf.llm.registry import QUERIES

TURNS = "conv_id long, turn long, role string, text string, path string, depth int, n long"


def turn_rows():
    rng = np.random.default_rng(11)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 215), 2**60 + 1]:  # conversation 200 is absent
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ("user", "assistant")[t % 2], f"text {rng.integers(0, 3)} é" if c % 3 else f"own {c} {t}"))
    rows += [(300, 7, None, None), (300, None, "user", "first"), (300, 7, "a", ""), (300, 7, "a", "b"), (301, 0, "user", "x"), (301, 0, "user", "x")]
    rows += [(c, t, "user", f"long {t}") for c in (400, 401, 402) for t in range(60 if c < 402 else 55)]
    rows += [(c, 0, "user", "same") for c in range(500, 600)]
    return rows + [(None, 1, "user", "no conversation")]


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), digest, role, text))
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        told = [(r, t) for _, _, r, t in sorted(own[c])]
        first = [(r, t) for _, _, r, t in sorted(own.get(c - c % 100, []))]
        full[c] = tuple(first[:h] + told[h:])
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if full[c] == p).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()), key=str)


def test_prefix_trie(spark):
    rows = turn_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).repartition(6)
    got = prefix_trie.prefix_trie(prefix_trie.borrow_heads(prefix_trie.digest_turns(df), 100, 6)).drop("key")
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie_by_hand(rows)
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(prefix_trie.borrow_heads(prefix_trie.digest_turns(none), 100, 6)).count() == 0


def test_prefix_trie_query(spark, tmp_path):
    rows = turn_rows()
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(r) for r in QUERIES["op11_prefix_trie"](spark, str(tmp_path)).collect()), key=str) == trie_by_hand(rows)


def test_long_conversations_take_one_job_for_each_parting_depth(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(3) for t in range(300 - 50 * c)]
    ends = prefix_trie.ended_sequences(prefix_trie.paths(prefix_trie.digest_turns(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS))))
    assert prefix_trie.parting_depths(ends.withColumn("depth", (prefix_trie.F.octet_length("path") / prefix_trie.STEP).cast("int"))) == [250, 200, 0]
    nodes = prefix_trie.peel(ends)
    assert nodes.count() == 301 and nodes.filter("n_children = 1").count() == 300


def test_ended_sequences_of_many_members(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = spark.range(500).selectExpr("cast(case when id % 5 < 3 then 'hot' else cast(id as string) end as binary) as path", "id as conv_id").repartition(9)
    got = {bytes(r["path"]): (r["n"], r["conv_id"], r["ends_sha256"]) for r in prefix_trie.ended_sequences(rows).collect()}
    hot = [i for i in range(500) if i % 5 < 3]
    assert got[b"hot"] == (300, 0, hashlib.sha256(",".join(map(str, hot)).encode()).hexdigest()) and len(got) == 201


TEXTS = [None, "", "a", "\n", "\n\n\n", "a\nb", "a\nb\n", "\nx", "é\n\U0001f600\nz" * 5, "with <P> inside", "x\n<M>", "<", "S>\n<", "P>\n<S\n>", "\r\n\r\n", "line\n" * 5000, "x" * 100_000, "".join(f"{'w' * (i % 7)}\n" for i in range(70_000))]


def by_hand(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate", [100, 40])
def test_fill_in_middle(spark, rate):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(None, "a\nb\nc"), (5, "a\nb"), (5, "a\nb")]
    schema = "doc_id long, text string, n int, form string, output string, source string"
    df = spark.createDataFrame([(i, t, 1, "x", "y", "kept") for i, t in rows], schema).repartition(4)
    out = fill_in_middle.fill_in_middle(df, rate=rate).withColumn("back", fill_in_middle.restore(fill_in_middle.F.col("output"), fill_in_middle.F.col("form")))
    got = out.collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in got), key=repr) == sorted((by_hand(*r, rate) for r in rows), key=repr)
    assert all(r["back"] == (r["text"] or "") and r["source"] == "kept" for r in got)
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], schema)).count() == 0


def test_every_rank_of_the_skip_list(spark):
    """Cuts at each rank of a text with more lines than one express link spans."""
    lines = ["x" * (i % 5) + "\n" for i in range(300)]
    lanes = [f"l{i}" for i in range(fill_in_middle.LANES)]
    df = spark.range(301).withColumn("parts", fill_in_middle.F.split(fill_in_middle.F.lit("".join(lines)), "\n", -1)).withColumn(lanes[0], fill_in_middle.line_links("parts"))
    for below, lane in zip(lanes, lanes[1:]):
        df = df.withColumn(lane, fill_in_middle.express_lane(below))
    got = {r["id"]: r["at"] for r in df.select("id", fill_in_middle.descend(lanes[::-1], fill_in_middle.F.col("id")).alias("at")).collect()}
    assert got == {k: sum(map(len, lines[:k])) for k in range(301)}


WORDS = {"aa": "the and of with that ing", "ab": "der die und mit dass ung", "ba": "le la et avec que tion", "bb": "el los y con que cion", "cc": "это не на что как был"}


def language_rows():
    rng = np.random.default_rng(6)
    out = []
    for lang, words in WORDS.items():
        for _ in range(80):
            out.append((len(out), " ".join(rng.choice(words.split(), int(rng.integers(4, 60)))), lang))
    return out


def test_language_id(spark, tmp_path):
    rows = language_rows()
    hard = [(9001, None, "aa"), (9002, "", "ab"), (9003, "12 34 !?", "ba"), (9004, "the and of " * 60_000, None), (None, "der die und", "ab"), (9005, "der die und", None), (9005, "der die und", None)]
    schema = "doc_id long, text string, lang string, lang_pred int, score string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + hard], schema).repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_language_id"](spark, str(tmp_path)).collect()
    assert len(got) == len(df.collect()) and all(0 <= r["score"] <= 1 and r["lang_pred"] in {*WORDS, "und"} for r in got)
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert pred[9001] == pred[9002] == pred[9003] == "und" and pred[9004] == "aa" and pred[9005] == pred[None] == "ab"
    held = [(pred[i], lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.98 * len(held)


def test_language_id_without_or_with_one_language(spark):
    schema = "doc_id long, text string, lang string, extra int"
    none = spark.createDataFrame([], schema)
    model = language_id.fit(language_id.labelled_sample(none, 3, 1, 10))
    some = spark.createDataFrame([(1, "abc", None, 3), (3, "!!", None, 4)], schema)
    assert [tuple(r) for r in language_id.predict_language(some, model).orderBy("doc_id").collect()] == [(1, "abc", None, 3, "und", 0.0), (3, "!!", None, 4, "und", 0.0)]
    one = spark.createDataFrame([(i, "hello there", "en", 1) for i in range(9)], schema)
    model = language_id.fit(language_id.labelled_sample(one, 3, 1, 10))
    assert [(r["lang_pred"], r["lang_score"]) for r in language_id.predict_language(some, model).orderBy("doc_id").collect()] == [("en", 1.0), ("und", 0.0)]
    assert language_id.predict_language(none, model).count() == 0


def test_families_join_the_closest_languages():
    c = np.array([[1, 0, 0], [0.9, 0.1, 0], [0, 1, 0.1], [0, 0.9, 0.2]])
    f = language_id.families(c, 2)
    assert f[0] == f[1] != f[2] == f[3]


def test_language_id_held_out_on_given_documents(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    held = [(rows[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs if rows[r["doc_id"]]["held_out"] and r["lang"] is not None]
    assert np.mean([a == b for a, b in held]) >= 0.97
