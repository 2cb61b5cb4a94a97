"""File inventory (SURVEY src_file_inventory).

``binaryFile`` lists files recursively in parallel.  Only path, length and
modification time are selected; the ``content`` column is pruned from the
scan, so no file body is read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_inventory(spark: SparkSession, roots: Iterable[str], glob: str | None = None) -> DataFrame:
    """(path, length, modification_time) of every file under ``roots``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(list(roots))
    return df.select(
        F.regexp_replace(F.col("path"), "^file:", "").alias("path"),
        F.col("length").cast("long").alias("length"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modification_time"),
    )
