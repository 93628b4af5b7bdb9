"""Small inputs on all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows of a scan, dealt by a key where the scan has fewer partitions than the session has cores.

    A file of one row group is one partition, whatever is done with its rows. What moves is less than a partition for each
    core; larger inputs have more partitions than that and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
