"""Package digests (SURVEY snk_checksums, verify_checksums).

File digests use ``binaryFile`` + ``sha2``: one task per file, whole file in
one row, so they suit package files up to ~2 GB.  Large tables get an
order-free digest instead: a sum of 64-bit row hashes plus the row count,
computed with partial aggregation and independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def package_checksums(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, sha256) for each file under ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    return df.select(F.regexp_replace("path", "^file:", "").alias("file"), F.sha2(F.col("content"), 256).alias("sha256"))


def text_checksums(df: DataFrame, key: str, text: str, out: str = "sha256") -> DataFrame:
    """SHA-256 of a text column per key (UTF-8 bytes)."""
    return df.select(key, F.sha2(F.col(text), 256).alias(out))


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: (row_count, sum of xxhash64 of each row)."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(h).cast("string").alias("digest"))


def verify_checksums(actual: DataFrame, expected: DataFrame, key: str = "file", digest: str = "sha256") -> DataFrame:
    """Compare digests: match, mismatch, missing (expected, not present) or
    extra (present, not expected).  A full outer join on the key."""
    a = actual.select(F.col(key).alias("_ka"), F.col(digest).alias("_a"))
    e = expected.select(F.col(key).alias("_ke"), F.col(digest).alias("_e"))
    j = e.join(a, F.col("_ke") == F.col("_ka"), "full_outer")
    status = (F.when(F.col("_ka").isNull(), "missing").when(F.col("_ke").isNull(), "extra")
              .when(F.col("_a") == F.col("_e"), "match").otherwise("mismatch"))
    return j.select(F.coalesce(F.col("_ke"), F.col("_ka")).alias(key), status.alias("status"))
