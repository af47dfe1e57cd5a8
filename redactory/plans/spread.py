"""Parallelism after a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Spread rows over the cores when the scan has fewer splits than there are cores.

    A large table has more splits than cores and is returned as it is, so at scale
    this adds no shuffle.  A small file with one row group would
    otherwise keep all regex work in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores * per_core) if splits < cores else df


# Rows of costly work that one task takes.
TASK_ROWS = 50_000


def spread_rows(df: DataFrame, *by: str, per_core: int = 2) -> DataFrame:
    """Narrow rows that each cost much work later, dealt evenly by ``by``, at most about ``TASK_ROWS`` to a task.

    The splits of a scan do not show where the rows are: a row group lies in one split whole, so a file of few row
    groups would leave all work to as many tasks however many splits it has.  The count reads footers only.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism * per_core, -(-df.count() // TASK_ROWS))
    return df.repartition(parts, *by)
