"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(frame: DataFrame) -> DataFrame:
    """`frame`, dealt over the cluster's cores if it has fewer partitions than
    there are cores, as one small file has; else as it is.  For the input of
    costly steps: a large input is never shuffled by this."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
