"""Set operations: UNION ALL by column name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*dfs: DataFrame, allow_missing: bool = False) -> DataFrame:
    """UNION ALL by name; no shuffle, partitions are simply concatenated."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def append_rows(df: DataFrame, new: DataFrame) -> DataFrame:
    """INSERT ... SELECT as dataflow: the table with the derived rows appended."""
    return df.unionByName(new, allowMissingColumns=True)
