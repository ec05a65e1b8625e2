"""Run folders of two jobs of one driver."""

import os
import threading

from callspark.llm.staging import Stage, passing


def test_runs_at_once_keep_their_tables(spark):
    """A run that ends in another thread leaves this one's tables alone, and each clears its own."""
    other = {}

    def run():
        with passing():
            stage = Stage(spark, "other")
            other["rows"] = stage.write(spark.range(3), "t").count()
            other["root"] = stage.root

    with passing():
        mine = Stage(spark, "mine")
        table = mine.write(spark.range(5), "t")
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
        assert other["rows"] == 3 and not os.path.exists(other["root"])
        assert table.count() == 5 and os.path.exists(mine.root)
        with passing():
            inner = Stage(spark, "inner")
            inner.write(spark.range(1), "t")
        assert not os.path.exists(inner.root) and table.count() == 5
    assert not os.path.exists(mine.root)
