"""Registered queries against their DuckDB SQL, on the given tables and on a small table of hard rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from silverleaf.llm.registry import ORACLE_SQL, QUERIES

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (2**60 + 1, LONG), (3, LONG + " end"), (4, "x " + LONG), (5, LONG), (6, None), (7, ""), (8, " \t\n"), (9, "one two"), (10, "ONE Two"),
    (11, "<next/> &amp; </turn>"), (12, "é" * 60), (13, "é" * 61), (14, "a" * 300), (15, "a" * 49), (16, LONG.upper()), (17, "w0 w1 w2 w3 w4 w5"),
]


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard"))
    write = lambda name, **columns: pq.write_table(pa.table(columns), f"{path}/{name}.parquet")
    ids, texts = pa.array([i for i, _ in ROWS], pa.int64()), pa.array([t for _, t in ROWS], pa.string())
    write("documents", doc_id=ids, text=texts, lang=pa.nulls(len(ROWS), pa.string()), n_words=pa.nulls(len(ROWS), pa.int32()))
    write("benchmark", item_id=pa.array([1, 2, 3, 4, 10], pa.int64()), text=pa.array([" ".join(LONG.split()[5:25]), "one TWO", None, "", "w3 w4 w5 w6"]))
    write("conversations", conv_id=pa.array([1] * len(ROWS), pa.int64()), turn=pa.array([i // 2 for i in range(len(ROWS))], pa.int64()), role=pa.array([("assistant", "user", None)[i % 3] for i in range(len(ROWS))]), text=texts)
    return path


def rows(df) -> list:
    names = sorted(df.columns)
    return sorted(map(repr, (tuple(r[n] for n in names) for r in df.select(*names).collect())))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("given", [True, False])
def test_query_equals_sql(spark, hard, name, given):
    sf_dir = "/root/testdata/sf0.001" if given else hard
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    told = con.sql(ORACLE_SQL[name])
    order = sorted(range(len(told.columns)), key=lambda i: told.columns[i])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(told.columns)
    assert rows(got) == sorted(map(repr, (tuple(r[i] for i in order) for r in told.fetchall())))
