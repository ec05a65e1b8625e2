"""Two-character pieces of any text, and an index that is written and read back."""

from pyspark.sql import functions as F

from callspark.functions.text import pairs_of
from callspark.operators import search


def test_pairs(spark):
    rows = [("abca", ["ab", "bc", "ca"]), ("x", []), ("", []), ("a😀b😀", ["a😀", "😀b", "b😀"]), ("a\nb", ["a\n", "\nb"])]
    df = spark.createDataFrame(rows, "t string, want array<string>")
    assert all(r.got == r.want for r in df.withColumn("got", pairs_of(F.col("t"))).collect())


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two", "two three"), (2, "", None), (3, "four", "one one")], "doc_id long, title string, body string")
    made, saved = search.build_index(docs), search.save_index(docs, str(tmp_path / "index"))
    for name in made:
        assert sorted(made[name].collect()) == sorted(saved[name].select(*made[name].columns).collect())
