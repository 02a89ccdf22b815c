"""Training-data operators against brute force on small fixtures with nulls, empties, ties, copies and clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from silverleaf.llm import ann, chat_format, decontaminate, jaccard_join, packing, quality, secret_scan, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, score double, chunk int, salt int, sig long, block int"
WORDS = [f"w{i}" for i in range(300)]


def texts():
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(WORDS, int(rng.integers(1, 120)))) for _ in range(40)]
    near = [re.sub(r"w7\b", "x", b) + " tail" for b in base[:15]]
    long = " ".join(rng.choice(WORDS, 9000))
    return base + near + base[:10] + [None, "", "   ", "é à\n\n  ü", "a b", "a b", base[0] * 3, long, "Straße " * 40]


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(texts()))
    return [*out, out[5], (None, "no id " * 20)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, 2, 3, 4) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup(docs, rows, none):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        want.append((i, len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    got = suffix_dedup.remove_repeats(docs, chunk_bytes=4000).drop("removed").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_chat_round_trip(spark):
    hard = "a</turn>\n<next/>&lt;<user>\\"
    turns = [(1, 0, "user", hard), (1, 1, "user", None), (1, 2, "assistant", hard), (1, 2, "assistant", hard), (2, 0, None, "x"), (None, 0, "assistant", "y"), (3, 0, "<odd>", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    f = chat_format.format_conversations(df)
    got = {r[0]: r for r in f.select("conv_id", chat_format.read_turns(f.formatted), chat_format.loss_text(f.formatted, f.loss_mask)).collect()}
    assert [tuple(t) for t in got[1][1]] == [("user", hard), ("user", ""), ("assistant", hard), ("assistant", hard)]
    assert got[1][2] == hard * 2 and got[2][2] == "" and got[None][2] == "y"
    assert [tuple(t) for t in got[3][1]] == [("<odd>", "")]


def test_token_counts(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path())
    want = sorted(str((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids))) for i, x in rows)
    for size in (1 << 20, 50):
        assert sorted(str(tuple(r)[:3]) for r in token_counts.count_tokens(docs, chunk_chars=size).collect()) == want
    assert token_counts.count_tokens(none).count() == 0


@pytest.fixture(scope="module")
def automaton():
    from silverleaf.llm.token_automaton import Automaton

    return Automaton(token_counts.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.tokenizer_path())


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "  x\n\n y  \t z", "it's 's 't", "   ", "a\x1f b", "\n 'll ''t", "x　 y", "", "'", "'r", "he'rt 'l' 'v", "aaaaaaaaaaaaaaaaaaaa"])
def test_chunk_maps_compose(automaton, library, text):
    want = len(library.encode(text, add_special_tokens=False).ids)
    for n in range(1, len(text) + 1):
        assert automaton.scan(text, n) == want
    part = text.replace("<|endoftext|>", "")
    maps = [automaton.chunk_map(part[i : i + 2]) for i in range(0, len(part), 2)]
    left, right = maps[:], maps[:]
    while len(left) > 1:  # associative: from the left and from the right
        left = [automaton.compose(*left[:2]), *left[2:]]
        right = [*right[:-2], automaton.compose(*right[-2:])]
    assert not maps or automaton.apply(left[0]) == automaton.apply(right[0]) == len(library.encode(part, add_special_tokens=False).ids)


def test_automaton_is_the_library(automaton, library, monkeypatch):
    from silverleaf.llm import token_automaton

    rng = np.random.default_rng(5)
    signs = ["a", "e", "s", "t", "r", "l", "v", "re", "'", "'s", " ", "  ", "\n", "\t", "1", "22", "!", "..", "é", "ü", "Straße", "日", "本", "\u3000", "\xa0", "\x1f", "\u200b", "🙂", "the", "ing", "<|endoftext|>", "ZQ", "xxxxx", "==", "-", "\u0301", "٣", "Ⅷ", "\x85"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 30)))) for _ in range(4000)] + ["".join(map(chr, rng.integers(32, 127, 200))) for _ in range(200)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [automaton.scan(x, 7) for x in texts] == want
    monkeypatch.setattr(token_automaton, "MAX_STATES", 50)  # compiled afresh over and over
    monkeypatch.setattr(token_automaton, "MAX_VIEWS", 50)
    assert [automaton.scan(x, 1 << 14) for x in texts[:300]] == want[:300]


def test_automaton_keeps_tokens_apart_as_bpe_does(automaton):
    rng = np.random.default_rng(6)
    ids = list(automaton.byte_ids.values()) + list(range(256, 50256))
    for x, y in rng.choice(ids, (3000, 2)).tolist():
        assert automaton.apart(x, y) == (automaton.merge([automaton.byte_ids[c] for i in (x, y) for c in automaton.bytes_of[i]]) == [x, y])


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path())
    known = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows}
    bins, total = defaultdict(list), 0
    for r in packing.pack(docs, capacity=64).collect():
        ids = known[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes()) and len(ids) == r.length and (r.piece == 0 or r.length == 64)
        bins[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(len(known[i]) for i, _ in rows)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(none).count() == 0


def test_packing_plan_is_best_on_small_instances():
    plan, _ = packing.plan_packing({6: 2, 5: 1, 4: 3, 3: 1, 2: 2}, 10)
    assert sum(n for n, _ in plan) == 4  # 12+5+12+3+4 = 36 tokens
    plan, fixed = packing.plan_packing({9: 3, 8: 2, 2: 2, 1: 3}, 10)
    assert fixed == 5 and sum(n for n, _ in plan) == 5


def test_decontamination(spark, docs, rows, none):
    passage = next(t for _, t in rows if t and len(t.split()) > 40)
    bench = spark.createDataFrame([(1, " ".join(passage.split()[3:25]).upper()), (2, "A, b!"), (3, None), (4, "")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda x: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = defaultdict(set)
    for r in bench.collect():
        w = low(r.text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(r.item_id))
    want = []
    for i, t in rows:
        w, hit, items = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        want.append(str((i, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w))))
    for size in (1_000_000, 5):
        got = decontaminate.mark(docs, bench, block_windows=size).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
        assert sorted(str(tuple(r)) for r in got) == sorted(want)
    assert decontaminate.mark(none, bench).count() == 0
    assert decontaminate.mark(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_ann_is_exact_on_few_vectors(spark):
    rng = np.random.default_rng(1)
    v = [(i, rng.normal(size=8).tolist()) for i in range(120)] + [(200 + i, [1.0] * 8) for i in range(30)]
    odd = [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [None] + [1.0] * 7), (480, [1.0])]
    df = spark.createDataFrame(v + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), probe_share=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q, x in v:
        if q % 20 == 0:
            order = sorted((-float(np.dot(x, y)), i) for i, y in v if i != q)
            assert got[q] == [i for _, i in order[:20]] or np.allclose([np.dot(x, dict(v)[i]) for i in got[q]], [-s for s, _ in order[:20]])
    assert set(got) == {q for q, _ in v if q % 20 == 0}


def test_ann_recall_at_the_registered_defaults(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:700] = x[100]  # a hot vector
    v = [(i, a.tolist()) for i, a in enumerate(x)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 20 = 0").unionByName(spark.createDataFrame([v[40], v[40], (40, v[41][1])], df.schema))
    got = defaultdict(list)
    for r in ann.search(df, queries).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert len(got.pop(40)) == 40  # an id with two vectors has two results, its repeated row none of its own
    hit = []
    for q, rows in got.items():
        s = np.round(x @ x[q], 12)
        best = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        assert [r for r, _, _ in rows] == list(range(1, 21)) and all(abs(x[i] @ x[q] - sc) < 1e-12 for _, i, sc in rows)
        hit.append(len({i for _, i, _ in rows} & set(best)) / 20)
    assert np.mean(hit) >= 0.9 and all(h == 1 for q, h in zip(got, hit) if 100 <= q < 700)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    exact = defaultdict(set)
    for r in ann.search(df, df.filter("vec_id % 200 = 0"), probe_share=1.0, rerank=None).collect():
        exact[r.query_id].add(r.vec_id)
    for q, found in exact.items():
        s = np.round(x @ x[q], 12)
        assert found == set([i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20])


def test_jaccard_join(docs, rows, none):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(k for k in sets if k is not None)
    for a in keys:
        for b in keys:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert jaccard_join.link_documents(none).count() == 0


def test_scores(spark, none):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(WORDS, 60)) for _ in range(300)]
    text = [t + " vile scum vile" * 2 if i % 5 == 0 else t.upper() + "!!" if i % 7 == 0 else t for i, t in enumerate(good)]
    docs = spark.createDataFrame([*enumerate(text), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 != 0 or i % 5 == 0), int(i % 5 == 0)) for i in range(300)] + [(900, None, None)], "doc_id long, quality int, toxic int")
    tox = toxicity.score_toxicity(docs, toxicity.training_rows(docs, labels, "toxic", 5, 0)).join(labels, "doc_id", "left").collect()
    assert len(tox) == 302 and np.mean([(r.toxicity >= 0.5) == bool(r.toxic) for r in tox if r.toxic is not None]) > 0.98
    model = quality.fit(quality.labelled_sample(docs, labels, "quality", 3, 1, 500))
    q = quality.score_quality(docs, model).join(labels, "doc_id", "left").collect()
    assert np.mean([(r.quality_x if hasattr(r, "quality_x") else r[2]) >= 0.5 for r in q if r[3] == 1]) > 0.95
    empty = none.select("doc_id", "text")
    assert toxicity.score_toxicity(docs, empty.selectExpr("text", "1 as label")).filter("toxicity > 0").count() == 0
    assert toxicity.score_toxicity(empty, toxicity.training_rows(docs, labels, "toxic", 5, 0)).count() == 0


def brute_segments(score):
    """All maximal scoring segments by the recursive definition."""
    best, where = 0.0, None
    for i in range(len(score)):
        for j in range(i + 1, len(score) + 1):
            s = float(np.sum(score[i:j]))
            if s > best + 1e-9:
                best, where = s, (i, j)
    if not where:
        return []
    i, j = where
    return [*brute_segments(score[:i]), (i, j), *[(a + j, b + j) for a, b in brute_segments(score[j:])]]


def test_maximal_segments():
    rng = np.random.default_rng(4)
    for _ in range(60):
        s = rng.normal(-0.3, 1, 25)
        assert [x[:2] for x in toxicity.maximal_segments(s)] == brute_segments(s)


def test_secrets(spark):
    text = "é password = \"abcdefghijkl12\" AKIA" + "Z9" * 8 + " x token=short 0123456789abcdef0 api_key token: q7Gx9Lw2Zt8Rb4Vn6Kc1"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "clean text"), (4, "clean text")], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (2, 1, 1)
    assert "access:" in got[1].spans and got[2].spans == "" and got[4].spans == ""
    red = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert "abcdefghijkl12" not in red[1] and "0123456789abcdef0" not in red[1] and red[4] == "clean text" and red[2] is None


def test_repeated_secrets_are_reported_each(spark):
    """Copies close by, within another string, across the end of the surrounding text and next to a base span."""
    rng = np.random.default_rng(7)
    chars = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    rows, copies = [], []
    for n in (20, 32, 40):
        for _ in range(10):
            t = "a1" + "".join(rng.choice(chars, n - 2))
            curl = f"curl -H 'Authorization: Bearer {t}' https://host/x\n"
            for text in (curl, curl * 2, curl * 3, f"bearer {t} bearer {t}", f"bearer x/{t} then\nbearer {t} end", *[curl + "." * k + curl for k in (310, 322, 334, 346)], f"token={t}\n{curl}"):
                rows.append((len(rows), text))
                copies.append(text.count(t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_assign + r.n_novel for r in secret_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == copies
    red = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert all(red[i].count("[SECRET]") == n for i, n in enumerate(copies))
    plain = [(0, "bearer abcdefghijklmnopqrstuvwxyz0123456789 " * 3)]
    assert secret_scan.scan(spark.createDataFrame(plain, "doc_id long, text string")).first().n_novel == 0


def test_secrets_of_letters_or_digits_and_words_after(spark):
    texts = ["Bearer qWeRtYuIoPaSdFgHjKlZxCvB", "token 8392-0174-6510-9827-3645", "q7Gx9Lw2Zt8Rb4Vn6Kc1 is the password", "bearer " + "=" * 40, "q7Gx9Lw2Zt8Rb4Vn6Kc1 " + "." * 40 + "password", "bearer abcdefghijklmnopqrstuvwxyz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_novel for r in secret_scan.scan(docs).collect()} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_suffix_dedup_judges_each_text_of_an_id(spark):
    rng = np.random.default_rng(9)
    a, b, c = (" ".join(rng.choice(WORDS, 40)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, a), (7, c), (7, b), (9, a)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    gone = [0, len(a), 0, len(a), 0, len(b), len(a)]
    assert got == sorted((i, len(t), n) for (i, t), n in zip(rows, gone))


def test_near_duplicates_judges_rows(spark):
    """Repeated and missing ids against all pairs compared: one row of each group, one of each blank (doc_id, text)."""
    import corpus_pipeline

    rng = np.random.default_rng(10)
    base = [" ".join(f"u{k}x{i}" for i in rng.permutation(90)) for k in range(7)]
    near = [t + " tail" for t in base]
    rows = [(1, base[0]), (4, base[0]), (4, base[1]), (4, near[0]), (2, near[1]), (6, base[2]), (6, base[2]), (6, base[3]), (None, base[4]), (None, base[4]), (None, near[4]),
            (None, base[5]), (8, near[5]), (9, base[6]), (9, near[6]), (3, ""), (3, ""), (3, None), (10, " "), (None, ""), (None, "")]
    got = sorted(map(str, ((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3), "").collect())))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in ((t or "").split() for _, t in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i] == rows[j] if not sets[i] else 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
            if same:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    kept = [[rows[i] for i in range(len(rows)) if group[i] == g] for g in set(group)]
    least = [[r for r in own if (r[0] is None, r[0] or 0) == min((x[0] is None, x[0] or 0) for x in own)] for own in kept]
    assert len(got) == len(least)
    assert all(sum(str(r) in got for r in {*own}) == 1 for own in least)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count() <= n
        n = docs.count()
    assert n == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, d).select("doc_id").distinct().count() == n


def test_jaccard_links_between_fragments_of_a_family(spark):
    """Families just above and below the threshold: components equal those of all pairs compared."""
    import random

    from silverleaf.llm.jaccard_join import link_documents

    rng, rows = random.Random(5), []
    for family in range(3):
        base = [f"w{family}x{i}" for i in range(100)]
        for k in range(40):
            words = list(base)
            for at in rng.sample(range(100), rng.choice((1, 2, 2, 3))):
                words[at] = f"v{rng.randrange(10**9)}"
            rows.append((family * 100 + k, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(96)} for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}


def test_large_ids_stay_beside_missing_ones(spark):
    """An id above 2**53 in a batch with a null id comes out as it went in."""
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "token=abcdefghijklmnop"), (None, "some words"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    for out in (token_counts.count_tokens(docs), packing.pack(docs), secret_scan.scan(docs), secret_scan.redact(docs), jaccard_join.link_documents(docs), suffix_dedup.remove_repeats(docs)):
        assert {r.doc_id for r in out.collect()} == {big, None, big + 2}


def test_segments_are_found_in_linear_time():
    import time

    def seconds(n):
        score = np.tile([1.0, -0.9], n)  # rising sums: every run reaches back
        score[::2] += np.linspace(0, 1e-6, n)
        down = np.tile([1.0, -1.5], n)  # falling sums
        start = time.perf_counter()
        for s in (score, down, np.concatenate([down, score])):
            toxicity.maximal_segments(s)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 30 * max(seconds(10_000), 0.01)


def test_every_registered_query_has_its_contract_columns(spark):
    """The registered opN_ queries on the smallest tables: columns, one row for each document, and digests against plain code."""
    from silverleaf.llm.registry import QUERIES

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    want = {
        "op1_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op2_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op4_quality": "doc_id held_out score predicted", "op5_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op6_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op7_ann_search": "query_id rank vec_id score", "op8_jaccard_join": "doc_id n_shingles component_id", "op9_toxicity": "doc_id held_out score predicted", "op10_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans"}
    got = {}
    for name, columns in want.items():
        out = QUERIES[name](spark, d)
        assert set(columns.split()) <= set(out.columns), name
        got[name] = out.collect()
        if columns.startswith("doc_id") and name != "op5_best_fit_packing":
            assert sorted(r.doc_id for r in got[name]) == sorted(docs), name
    for r in got["op10_secret_scan"]:
        base = secret_scan.base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secret_scan.joined(base).encode()).hexdigest() and r.n_hex == sum(k == 2 for _, k, _ in base)
    for r in got["op9_toxicity"]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got["op2_chat_format"]:
        own = sorted(turns[r.conv_id])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own)), len(loss), sha(loss))
