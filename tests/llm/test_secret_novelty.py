"""Marginal compressed bytes of every reported span against separate compressions, and the scan's edge cases."""

from __future__ import annotations

import zstandard

from silverleaf.llm import secret_scan
from silverleaf.llm.secret_scan import AROUND, CONTEXT, IDENTIFIERS, KINDS


def marginal(text: str, start: int, end: int) -> int:
    """By whole slices, for texts in which no span repeats."""
    around = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b" " + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    lead = text[max(0, start - CONTEXT) : start]
    size = [len(zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False).compress(t.encode())) for t in (lead, lead + text[start:end])]
    return size[1] - size[0]


def test_marginal_bytes_of_each_span(spark):
    texts = [
        "é auth header q7Gx9Lw2Zt8Rb4Vn6Kc1 end", "password = Xk29fQpL77zR and hex 0123456789abcdef00", "plain words only", "AKIAZZ81KQ0PLM3XWT bearer T5rXw9PqL2mZ7vKc1Bd8", "token: aaaaaaaaaaaaaaaaaaaa",
        "word " * 5000 + "signature Jd83kfLq02mXcvB7tYpW " + "word " * 5000]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = set()
    for i, text in enumerate(texts):
        spans = [x.split(":") for x in filter(None, got[i].spans.split(","))]
        kinds |= {k for k, _, _ in spans}
        assert [int(x) for x in filter(None, got[i].novel_bytes.split(","))] == [marginal(text, int(s), int(e)) for _, s, e in spans]
    assert kinds == set(KINDS) and got[2].spans == "" and got[5].spans.startswith("novel:25010:")
    assert got[4].spans == "assign:0:27,hex:7:27" and all(int(n) < 0.45 * k for n, k in zip(got[4].novel_bytes.split(","), (27, 20)))  # base spans that compress well stay


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, spans int, n_hex string, base_spans double, novel_bytes string"
    assert secret_scan.scan(spark.createDataFrame([], schema)).count() == 0
    assert secret_scan.redact(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, "hex 0123456789abcdef00", 7, "x", 0.5, None), (None, None, None, None, None, None)], schema)
    assert {(r.doc_id, r.n_hex, r.spans) for r in secret_scan.scan(docs).collect()} == {(1, 1, "hex:4:22"), (None, 0, "")}
    assert [tuple(r) for r in secret_scan.redact(docs).filter("doc_id = 1").collect()] == [(1, "hex [SECRET]", 7, "x", 0.5, None)]
