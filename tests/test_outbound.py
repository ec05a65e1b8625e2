"""Masked texts against their SQL: digits behind a card that count as its last ones."""

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")

# 18 digits with a right check sum: the blank lies among the last four; a card by itself; two that share a blank; one too many digits
TEXTS = ("so 4495589438270767 42.73.240.87 it is", "4495589438270767", "4111 1111 1111 1111 4111-1111-1111-1111", "a 4111111111111111 4.", None, "mail ab.c@d.ef 4495-5894-3827-0767 4-2")


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("outbound"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def _same(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    got = sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect())
    assert len(got) == len(TEXTS) and got == sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_outbound_text(spark, documents):
    _same(spark, documents, "p8_outbound_text")


def test_mask_stream(spark, documents):
    _same(spark, documents, "x6_mask_stream")
