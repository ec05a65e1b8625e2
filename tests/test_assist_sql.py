"""What an agent is given against its SQL, with a customer whose words no document has: bigrams answer."""

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")

DOCS = ["the cat sat on the mat. It slept", "Thea theory. More\nof it", "xyzzy plugh", None, "zzz", "the mat"]
# the third says nothing that a document has, the fourth no letter, the fifth nothing at all
SAID = ["the cat", "a mat. please", "Theor yz", "…!", "", "qqq www"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("assist"))
    spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    rows = [(k, turn, role, text) for k, said in enumerate(SAID) for turn, role, text in ((0, "assistant", "hello"), (1, "user", said))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def _same(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = sorted((tuple(r) for r in __spark_entry__.queries()[name](spark, folder).select(columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    return got


def test_assist_docs(spark, tables):
    rows = _same(spark, tables, "r20_assist_docs")
    assert any(r[0] == 2 and r[2] is not None for r in rows) and [r[2] for r in rows if r[0] == 5] == [None]


def test_assist_cards(spark, tables):
    rows = _same(spark, tables, "r20_assist_cards")
    assert len(rows) == len(SAID) and any(r[0] == 2 and r[3] != "" for r in rows)
