"""Boundaries between stages of long pipelines."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, and read from there.

    What several later steps need is then made once, and their plans start from it.  The
    folder is the session's spark.checkpoint.dir; a local session without one takes a
    temporary folder, a cluster stops with an error, since its executors could not read it.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


#: Rows of a partition where spread is told how many there are.
ROWS = 1 << 17


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """The rows dealt out by keys to a partition for each shuffle partition of the session, two a core at least.

    For steps that make much of each row: a small file is read by one task, and what a shuffle writes of few bytes is read by few,
    however much work is to be done.  If the number of rows is given, partitions grow with it, so that what a task holds does not.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))
    return df.repartition(n, *keys)
