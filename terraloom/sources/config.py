"""Configuration files: [section] lines, key=value lines and # comments, as rows of section.key and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value). A file is read whole, since its sections hold for the lines after them; the files go side by side."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    lines = files.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line <> ''")
    section = F.when(F.col("line").rlike(r"^\[.*\]$"), F.trim(F.regexp_extract("line", r"^\[(.*)\]$", 1)))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("section", F.last(section, ignorenulls=True).over(w)).where(F.col("line").contains("="))
    key, value = F.trim(F.regexp_extract("line", r"^([^=]*)=", 1)), F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1))
    return held.select("file", F.concat_ws(".", F.when(F.col("section") != "", F.col("section")), key).alias("key"), value.alias("value"))
