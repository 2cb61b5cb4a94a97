"""Read a named operational table (SURVEY src_table).

Tables come from Parquet folders, the session catalog, or a JDBC source read
in parallel slices of a numeric key.  Columns are pruned later by the
optimizer; nothing is read eagerly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..session import path_exists


def read_table(spark: SparkSession, name: str, source: str | Mapping = "parquet", root: str | None = None,
               schema: str | None = None) -> DataFrame:
    """Read table ``name``.

    ``source``: ``"parquet"`` reads ``{root}/{name}`` (or ``{root}/{name}.parquet``
    if that exists); ``"catalog"`` reads a catalog table; a mapping describes a
    JDBC read: url, user/password properties, and optionally
    ``partition_column``, ``lower_bound``, ``upper_bound``, ``num_partitions``
    to split the read into parallel range queries.
    """
    if source == "catalog":
        return spark.table(name)
    if source == "parquet":
        if root is None:
            raise ValueError("root is required for parquet tables")
        path = f"{root.rstrip('/')}/{name}"
        reader = spark.read.schema(schema) if schema else spark.read
        single = path + ".parquet"
        return reader.parquet(single if path_exists(spark, single) else path)
    if isinstance(source, Mapping):
        opts = {"url": source["url"], "dbtable": source.get("dbtable", name)}
        for k in ("user", "password", "driver", "fetchsize"):
            if k in source:
                opts[k] = str(source[k])
        if "partition_column" in source:
            opts.update(partitionColumn=source["partition_column"], lowerBound=str(source["lower_bound"]),
                        upperBound=str(source["upper_bound"]), numPartitions=str(source.get("num_partitions", 64)))
        return spark.read.format("jdbc").options(**opts).load()
    raise ValueError(f"unknown source {source!r}")
