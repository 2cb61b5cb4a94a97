"""Small tables from parameters.

Only literal tables are hinted for broadcast: they are bounded by
construction.  Every other join is left to adaptive execution, which switches
to a broadcast on the measured bytes, so plans start no job to probe a size.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def literal_table(
    spark: SparkSession, rows: Iterable[Sequence], schema: str, broadcast: bool = True
) -> DataFrame:
    """A small table from Python literals (rules, labels, policies)."""
    df = spark.createDataFrame(list(rows), schema=schema)
    return F.broadcast(df) if broadcast else df
