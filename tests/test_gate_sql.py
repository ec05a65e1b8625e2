"""The gate of rewritten messages against its SQL, with messages over the budget of cells."""

import random

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")


def _same(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = sorted((tuple(r) for r in __spark_entry__.queries()[name](spark, folder).select(columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    return got


def test_gate_against_its_sql(spark, tmp_path):
    rng = random.Random(5)
    long = "".join("th" if rng.random() < 0.02 else rng.choice("abcdfgij") for _ in range(4_000))
    rows = [(k, turn, "user", text) for k, text in enumerate(["th" + long + "th", "", None, "the thin one", "e" * 3_000]) for turn in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[:2]: r[2:4] for r in _same(spark, tmp_path, "e3_preserve_gate", "conversations")}
    assert got[0, 1] == (True, True) and got[4, 2] == (False, False)
