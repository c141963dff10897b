"""Scans of few row groups spread over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def wanted_partitions(df: DataFrame) -> int | None:
    """The number of cores if the scan has fewer partitions, else ``None``."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return cores if parts < cores else None


def spread(df: DataFrame) -> DataFrame:
    """The frame over at least as many partitions as there are cores.

    Text labelling is bound by the processor, not by reading, so a file of few row groups is
    worth one shuffle. A scan that already has a partition per core stays as it is, which is
    always so for large tables.
    """
    wanted = wanted_partitions(df)
    return df.repartition(wanted) if wanted else df
