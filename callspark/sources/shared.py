"""The folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that driver and executors share; on a local master without it, the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")
