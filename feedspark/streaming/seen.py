"""The keys a watch has seen: parts of hash buckets, each bucket behind a Bloom filter.

A tick adds a part. Parts of one level are merged into one of the next when there are
``FAN`` of them, so few parts are live and a key is rewritten a logarithmic number of times.
A part has as many buckets as its keys need at ``BUCKET_KEYS`` each. Keys of a tick are
tested against the filters of their buckets; only the buckets in which one may lie are read.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 4
BUCKET_KEYS = 250_000
LEAST_BUCKETS = 16
BITS_PER_KEY = 16
PROBES = 7
SEEN = "key string, batch_id bigint"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Part:
    name: str
    level: int
    buckets: int
    keys: int


def _bits(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The bits that each hash sets in a filter of ``size`` bits."""
    low = hashes.view(np.uint64)
    high = (low ^ (low >> np.uint64(32))) * _GOLDEN
    return [(low + np.uint64(k) * high >> np.uint64(7)) % np.uint64(size) for k in range(PROBES)]


def _filter(table: pa.Table) -> pa.Table:
    hashes = table.column("hash").to_numpy()
    size = max(64, len(hashes) * BITS_PER_KEY)
    mask = np.zeros(size, bool)
    for bit in _bits(hashes, size):
        mask[bit] = True
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"bucket": [bucket], "size": [size], "mask": [np.packbits(mask).tobytes()]}, schema=_FILTER)


_FILTER = pa.schema([("bucket", pa.int64()), ("size", pa.int64()), ("mask", pa.binary())])


def _admitted(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The keys of a bucket that its filter does not rule out."""
    if not keys.num_rows or not filters.num_rows:
        return keys.slice(0, 0).select(["part", "bucket", "key"])
    size = filters.column("size")[0].as_py()
    mask = np.unpackbits(np.frombuffer(filters.column("mask")[0].as_py(), np.uint8)).astype(bool)
    inside = np.ones(keys.num_rows, bool)
    for bit in _bits(keys.column("hash").to_numpy(), size):
        inside &= mask[bit]
    return keys.filter(pa.array(inside)).select(["part", "bucket", "key"])


class SeenKeys:
    """The state at one commit: live parts in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, parts: list[Part]):
        self.spark, self.folder, self.parts = spark, folder, parts
        self.read_buckets: list[tuple[str, int]] = []

    def rows(self) -> DataFrame:
        """``key, batch_id`` of every key, with the tick that first saw it."""
        return self._read(self.parts)

    def _read(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SEEN)
        paths = [f"{self.folder}/keys/part={p.name}" for p in parts]
        return self.spark.read.schema(SEEN + ", bucket int").option("basePath", f"{self.folder}/keys").parquet(*paths).select("key", "batch_id")

    def _written(self, rows: DataFrame, name: str, level: int, keys: int) -> Part:
        buckets = LEAST_BUCKETS
        while buckets * BUCKET_KEYS < keys:
            buckets *= 2
        place = f"{self.folder}/keys/part={name}"
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
        dealt = rows.select("key", "batch_id", bucket).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(place)
        back = self.spark.read.schema(SEEN + ", bucket bigint").parquet(place)
        hashed = back.select("bucket", F.xxhash64("key").alias("hash"))
        filters = hashed.groupBy("bucket").applyInArrow(_filter, "bucket bigint, size bigint, mask binary")
        filters.write.mode("overwrite").parquet(f"{self.folder}/filters/part={name}")
        return Part(name, level, buckets, keys)

    def added(self, keys: DataFrame, count: int, batch_id: int) -> "SeenKeys":
        """The state with the keys of one tick, which it must not hold yet."""
        rows = keys.select("key", F.lit(batch_id).cast("long").alias("batch_id"))
        part = self._written(rows, f"t{batch_id}", 0, count)
        return SeenKeys(self.spark, self.folder, [*self.parts, part])

    def compacted(self, batch_id: int) -> "SeenKeys":
        """Merge ``FAN`` parts of a level into one of the next, until no level has so many."""
        parts = list(self.parts)
        level = 0
        while level <= max((p.level for p in parts), default=-1):
            own = [p for p in parts if p.level == level]
            if len(own) >= FAN:
                merged = self._written(self._read(own), f"c{batch_id}-{level + 1}", level + 1, sum(p.keys for p in own))
                parts = [p for p in parts if p.level != level] + [merged]
            level += 1
        return SeenKeys(self.spark, self.folder, parts)

    def hits(self, keys: DataFrame, count: int) -> DataFrame:
        """Those of ``keys`` (distinct, ``count`` of them) that were seen before."""
        none = self.spark.createDataFrame([], "key string")
        if not self.parts or not count:
            return none
        # A small part has few buckets: the keys of a large tick are dealt to shares of them.
        shares = max(1, -(-count // (LEAST_BUCKETS * BUCKET_KEYS)))
        live = F.explode(F.array(*[F.struct(F.lit(p.name).alias("part"), F.lit(p.buckets).alias("buckets")) for p in self.parts]))
        hashed = keys.select("key", F.xxhash64("key").alias("hash"), live.alias("p"))
        asked = hashed.select(
            F.col("p.part").alias("part"),
            F.pmod("hash", F.col("p.buckets")).cast("long").alias("bucket"),
            F.pmod(F.shiftright("hash", 32), F.lit(shares)).alias("share"),
            "key",
            "hash",
        )
        stored = self.spark.read.schema("bucket bigint, size bigint, mask binary, part string").parquet(f"{self.folder}/filters")
        filters = stored.filter(F.col("part").isin([p.name for p in self.parts]))
        filters = filters.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
        by = ["part", "bucket", "share"]
        admitted = asked.groupBy(*by).cogroup(filters.groupBy(*by)).applyInArrow(_admitted, "part string, bucket bigint, key string")
        places = admitted.select("part", "bucket").distinct().collect()
        self.read_buckets = sorted((r["part"], r["bucket"]) for r in places)
        if not places:
            return none
        paths = [f"{self.folder}/keys/part={part}/bucket={bucket}" for part, bucket in self.read_buckets]
        found = self.spark.read.schema(SEEN).parquet(*paths)
        return found.select("key").join(keys, "key", "left_semi")

    def described(self) -> list[dict]:
        return [asdict(p) for p in self.parts]
