"""Every pipeline stage on null and repeated ids, null, empty and long texts, extra columns with clashing names, and an empty table."""

import corpus_pipeline
import pytest

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [(1, "plain words of one text that nobody else has written here", "en", "a", 5), (2**60 + 1, "plain words of one text that nobody else has written here", "en", "a", 5), (3, None, None, None, None), (4, "", "", "", 0), (5, LONG, "en", "b", 1),
        (5, "the same id with other words in it than the long one", "en", "b", 1), (6, "twice the same row of words for this test", "en", "b", 1), (6, "twice the same row of words for this test", "en", "b", 1),
        (None, "no id at all but some words to keep for later", "en", "c", 1), (7, 'x = 1\npassword = "Zk3vQ9xW2mNp7Lr5"\n', "en", "c", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame([(*r, 1.0, 2, "z") for r in ROWS], SCHEMA + ", toxicity double, row int, items string")
    return extra.repartition(3)


def told(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, (r["text"] or "")[:30]) for r in df.collect())


WHOLE = sorted((i if i is not None else -1, (t or "")[:30]) for i, t, *_ in ROWS)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([], SCHEMA), DIR)
    assert out.count() == 0 and (name == "packing" or out.columns == corpus_pipeline.COLUMNS)


def test_stages_that_keep_clean_documents(spark, docs):
    for name in ("toxicity", "decontamination"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, DIR)
        assert out.columns == corpus_pipeline.COLUMNS and told(out) == WHOLE


def test_near_duplicates(spark, docs):
    out = corpus_pipeline.near_duplicates(spark, docs, DIR)
    want = list(WHOLE)
    want.remove((2**60 + 1, "plain words of one text that n"))
    want.remove((6, "twice the same row of words fo"))
    assert out.columns == corpus_pipeline.COLUMNS and told(out) == want


def test_secrets_are_masked(spark, docs):
    rows = {r["doc_id"]: r for r in corpus_pipeline.secrets(spark, docs, DIR).collect() if r["doc_id"] in (3, 4, 7)}
    assert "Zk3vQ9xW2mNp7Lr5" not in rows[7]["text"] and "x = 1" in rows[7]["text"] and rows[7]["n_chars"] == len(rows[7]["text"])
    assert rows[3]["text"] is None and rows[3]["n_chars"] is None and rows[4]["text"] == ""


def test_packing_keeps_every_row(spark, docs):
    rows = corpus_pipeline.packing(spark, docs, DIR).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS) and all(r["length"] >= 1 for r in rows)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for a, b in zip(places, places[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
