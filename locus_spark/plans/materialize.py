"""Cut lineage through the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and all of it runs on this machine.
LOCAL_FOLDER = "/tmp/checkpoints"

#: A table is broadcast only up to so many estimated bytes; beyond that Spark shuffles.
BROADCAST_BYTES = 8 << 20

#: Rows of a partition that ``dealt`` makes, and the least for which it makes more than one.
PART_ROWS, LEAST_ROWS = 3 << 19, 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a local one, on local masters alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or LOCAL_FOLDER).rstrip("/")


_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs only its running tasks. The
    files stay until the ``scratch`` around them ends or ``drop_materialized`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_to"] = path
    return out


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` read from files, for several uses: those it has been written to, else new ones."""
    return df if "_written_to" in df.__dict__ else materialize(df, name)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end what was materialized inside, but for tables given to the yielded ``keep``.

    What leaves the block must read kept tables alone.
    """
    first, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.__dict__["_written_to"])
        return df

    try:
        yield keep
    finally:
        _delete(spark, [p for p in _written[first:] if p not in kept])


def drop_materialized(spark: SparkSession) -> None:
    """Delete what this process has materialized; call it once the results are written."""
    _delete(spark, list(_written))


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if ``df`` holds at most BROADCAST_BYTES; else leave the choice to Spark."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def dealt(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, hashed by ``by`` into partitions of about PART_ROWS.

    Spark merges the partitions of other shuffles by their bytes, so that what a task holds
    grows with the input until they reach the advisory size; a given number stays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(rows // PART_ROWS, min(rows // LEAST_ROWS, cores)) + 1, *by)


def rows_of_scan(df: DataFrame) -> int | None:
    """The number of rows of a table that is only read and projected, which files know; None for any other plan."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    return df.count() if plan.nodeName() == "LogicalRelation" else None
