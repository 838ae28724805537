"""Spreading small inputs over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, key: str) -> DataFrame:
    """``scan`` with at least as many partitions as the session has cores.

    A scan of few files has fewer partitions than cores, and work that follows it would run on those few.  Large
    scans, which have more, stay as they are and aren't shuffled.  ``scan`` must be a scan with filters and
    projections only: its partitions are then known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if 0 < scan.rdd.getNumPartitions() < cores else scan
