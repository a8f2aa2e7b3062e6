"""Archives: a table with its version and schema, as Parquet or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "json")


def save(df: DataFrame, path: str, version: int, fmt: str = "parquet") -> None:
    """Writes a table and its version and schema beside it; what was there goes."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} is none of {FORMATS}")
    df.write.mode("overwrite").format(fmt).save(f"{path}/data")
    head = df.sparkSession.createDataFrame([(version, fmt, df.schema.json())], "version int, fmt string, schema string")
    head.coalesce(1).write.mode("overwrite").json(f"{path}/head")


def version(spark: SparkSession, path: str) -> int:
    return spark.read.schema("version int").json(f"{path}/head").first()[0]


def load(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """The table, with the schema that it was saved with; a version beyond `newest` raises."""
    import json

    from pyspark.sql import types as T

    head = spark.read.schema("version int, fmt string, schema string").json(f"{path}/head").first()
    if newest is not None and head["version"] > newest:
        raise ValueError(f"version {head['version']} is newer than {newest}")
    return spark.read.format(head["fmt"]).schema(T.StructType.fromJson(json.loads(head["schema"]))).load(f"{path}/data")
