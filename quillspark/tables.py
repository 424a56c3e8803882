"""The given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir``; scans stay lazy and prune their columns."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it is so small that its splits would not fill them; larger tables stay as they are.

    A file of one row group is one task's work however long that takes, so this
    pays before expensive functions of each row.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * split
    return df.repartition(cores) if small else df
