"""Definition files: meshes, constructs and templates kept as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.model import MESH, TEMPLATE

_STEM = r"([^/]+?)(?:\.mesh|\.construct)?\.json[^/]*$"
_CONSTRUCT = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("meshes", T.ArrayType(T.StringType()))]
)


def _read(spark: SparkSession, path: str, schema: T.StructType, lines: bool) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    return reader.json(path, multiLine=not lines).select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.monotonically_increasing_id().alias("row_ord"),
    )


def read_meshes(spark: SparkSession, locations: list[str], lines: bool = False) -> DataFrame:
    """Named meshes of several folders in search order; ``x.mesh.json`` goes before ``x.json``.

    With ``lines`` each file holds one definition per line, named by its ``name`` field.
    """
    read = [
        _read(spark, path, MESH, lines).withColumn("_place", F.lit(i))
        for i, path in enumerate(locations)
    ]
    rows = reduce(DataFrame.unionByName, read)
    plain = (~F.col("file_path").rlike(r"\.mesh\.json$")).cast("int")
    name = F.col("name") if lines else F.regexp_extract("file_path", _STEM, 1)
    return rows.select(
        name.alias("name"),
        (F.col("_place") * 2 + plain).alias("location_rank"),
        F.struct("name", "sources").alias("mesh"),
    )


def read_constructs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per construct member; a member is a mesh name, a reference or an inline mesh."""
    rows = _read(spark, path, _CONSTRUCT, lines)
    member = F.col("_member")
    is_object = member.startswith("{")
    parsed = F.from_json(
        member, T.StructType([T.StructField("ref", T.StringType()), *MESH.fields])
    )
    return (
        rows.select("name", F.posexplode("meshes").alias("mesh_ord", "_member"))
        .withColumn("_parsed", F.when(is_object, parsed))
        .select(
            F.col("name").alias("construct"),
            "mesh_ord",
            F.when(is_object, F.col("_parsed.ref")).otherwise(member).alias("ref"),
            F.when(
                F.col("_parsed.sources").isNotNull(),
                F.struct(F.col("_parsed.name").alias("name"), F.col("_parsed.sources").alias("sources")),
            ).alias("mesh"),
        )
    )


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates of a file or folder; a file holds one object or an array of them.

    Load order is file-name order, then order in the file.
    """
    rows = _read(spark, path, TEMPLATE, lines=False)
    return rows.withColumn("load_ord", F.struct("file_path", "row_ord")).drop("file_path", "row_ord")
