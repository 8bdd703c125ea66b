"""Rules and helpers that the operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.functions.binding import let  # noqa: F401
from feedspark.session import shared_dir

SPACE = r"[\x20\x09-\x0D]+"
"""What separates words: ASCII white space only."""
UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def row_key() -> Column:
    """A 64-bit hash of a row's id and text, for joins that must not trust the id alone."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of("text"))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    spelled = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(spelled.cast("binary")), F.lit(divisor))


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the folder that all executors share and read it back.

    The lineage ends there, so a lost executor costs nothing that was computed before, and
    later steps see the same rows however often they are run.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove a table that ``stored`` wrote, once nothing needs it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shipped(spark: SparkSession, value) -> Broadcast:
    """Broadcast a value of one of the library's classes; tasks need not have the library installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def column(table: pa.Table, name: str) -> np.ndarray:
    """A numeric column of a collected table of bounded size."""
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
