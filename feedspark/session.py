"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_BYTES = 64 << 20
BROADCAST_ROWS = 50_000
"""A side is broadcast only when it is known to hold at most this many rows."""


PYTHON_ROWS = 4096
PYTHON_BYTES = 1 << 20
"""Rows and bytes that a Python worker is given at once."""


def utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: zoneless date-times and calendar floors are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a session that names none (tests, local runs) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not hasattr(shared_dir, "_local"):
        shared_dir._local = tempfile.mkdtemp(prefix="feedspark-")
    return shared_dir._local


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor cannot change the rows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them back, for loops that join a table with itself.

    A checkpoint keeps what the planner derived about its columns, and in a loop that grows with
    every round until planning takes minutes. Files start afresh.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most ``PYTHON_ROWS`` and ``PYTHON_BYTES``.

    A batch of the usual 10,000 documents, with what is read from them, takes gigabytes. The
    bound is one of bytes: steps over short texts, as the content hash, lose their pace in
    batches of few rows.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= PYTHON_ROWS:
        spark.conf.set(name, str(PYTHON_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PYTHON_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Give Python work all cores when the input is too small to be split by itself.

    Only an input whose size cannot fill the cores is shuffled; a large one keeps the
    partitions of its scan. Batches are small ones.
    """
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a join side for broadcast after checking its row count; a larger one is left alone.

    The check reads at most ``max_rows + 1`` rows. Beyond the bound the join stays a
    shuffle join, where adaptive execution splits skewed keys.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
