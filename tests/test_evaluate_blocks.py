from callspark.plans import registry


def test_more_questions_than_a_block(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "delta")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.range(10_001).selectExpr("id as item_id", "case id % 3 when 0 then 'alpha' when 1 then 'gamma' else 'zeta' end as text")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    row = registry.queries()["r17_evaluate_ranker"](spark, str(tmp_path)).first()
    assert (row.total, row.answerable) == (10_001, 6_668)


def test_blocks_give_each_question_its_first_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "d")], "doc_id long, text string")
    asked = spark.createDataFrame([(k, "acdx"[k % 4]) for k in range(20)], "query_id long, q string")
    got = {r.query_id: r.expected for r in registry._first_holding(docs, asked, 3).collect()}
    assert got == {k: (1, 2, 3)[k % 4] for k in range(20) if k % 4 < 3}
