"""Distances of whole texts against SQL: all lines count, and pairs over the budget of cells, too."""

import random

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("cer")), random.Random(7)
    long = lambda every: "tion" + "".join("tion\n" if rng.random() < 1 / every else rng.choice("abcdé hun") for _ in range(9_000)) + "tion"
    texts = ["no change\nnation\nstation", "tion", "ti\non", "", None, "é\n", long(200), long(8), "shun tion" * 3, "first line only"]
    rows = [(k, "en" if k % 2 else "fr", text) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def _same(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = sorted((tuple(r) for r in __spark_entry__.queries()[name](spark, folder).select(columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    return got


def test_corpus_of_whole_texts(spark, tables):
    got = {r[0]: r[1:] for r in _same(spark, tables, "e1_corpus_cer")}
    con = duckdb.connect()
    plain = con.execute(f"""select lang, count(*), cast(sum(levenshtein(replace(t, ' ', ''), replace(replace(t, 'tion', 'shun'), ' ', ''))) as bigint), cast(sum(length(replace(t, ' ', ''))) as bigint)
      from (select lang, regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g') as t from read_parquet('{tables}/documents.parquet/*.parquet')) where replace(t, ' ', '') <> '' group by 1""").fetchall()
    assert got == {r[0]: r[1:] for r in plain}


def test_whole_texts_within(spark, tables):
    got = {r[0]: r[1:] for r in _same(spark, tables, "e2_cer_within")}
    assert got == {0: (False, False), 1: (False, False), 2: (False, False), 6: (True, True), 7: (True, False), 8: (False, False), 9: (False, True)}
