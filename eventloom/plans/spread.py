"""Using all cores, and tasks of a bounded size, where the input is a few files."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Events that one task parses or decodes, whatever the size of the files they come in.
ROWS_PER_TASK = 20_000


def spread(scan: DataFrame, rows: int = 0) -> DataFrame:
    """Redistribute a scan that offers fewer tasks than the cluster has cores, or than its rows need.

    Parsing costs far more than moving such a small input.  `rows` are those of
    the scan, if known: a split of 128 MB may hold millions of events, and a file
    is cut at its row groups only.  A scan with enough tasks is left as it is.
    """
    tasks = tasks_for(scan, rows)
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan


def tasks_for(scan: DataFrame, rows: int) -> int:
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
