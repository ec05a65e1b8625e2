"""Tables of one row group are worked on by many tasks where a row takes far longer to work on than to move."""

import pytest

from callspark.plans import defaults, registry, workflows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [registry._cer_pairs, workflows._bare, defaults.r1_default_tokens])
def test_one_row_group_is_many_tasks(spark, rows):
    assert rows(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
