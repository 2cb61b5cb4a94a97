"""Sorts, limits and top-k.

``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
its own top n and only those rows meet, so skew never concentrates data.
Every ordering carries a tie-break column, so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import filters


def top_idle(agents: DataFrame, as_of: str, lookback: str = "10 minutes", n: int = 15,
             warn_seconds: int = 60, fail_seconds: int = 120) -> DataFrame:
    """READY agents by idle seconds (longest first), flagged by thresholds."""
    ready = filters.recent(agents, "last_update_time", as_of, lookback).where(F.col("status") == "READY")
    idle = X.seconds_between("last_update_time", X.ts_literal(as_of))
    cols = [c for c in ("agent", "campaign_id", "closer_campaigns", "conf_exten") if c in agents.columns]
    rows = ready.select(*cols, idle.alias("idle_seconds"))
    flag = (F.when(F.col("idle_seconds") > fail_seconds, "IDLE TOO LONG")
            .when(F.col("idle_seconds") > warn_seconds, "elevated wait").otherwise(""))
    return rows.orderBy(F.col("idle_seconds").desc(), F.col("agent")).limit(n).withColumn("flag", flag)


def top_statuses(log: DataFrame, as_of: str, lookback: str = "1 hour", n: int = 15) -> DataFrame:
    """The ``n`` most frequent statuses in the look-back window."""
    recent = filters.recent(log, "call_date", as_of, lookback)
    return (recent.groupBy("status").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("status")).limit(n))


def sort_by(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    """A total ORDER BY (range-partitioned sort)."""
    return df.orderBy(*cols)


def tail_matches(lines: DataFrame, include: str, exclude: str, n1: int = 50, n2: int = 20,
                 order: Sequence[str] = ("ts", "line_no")) -> DataFrame:
    """Last ``n1`` lines matching ``include``, drop ``exclude``, keep the last ``n2``."""
    desc = [F.col(c).desc() for c in order]
    last = filters.grep_lines(lines, include=include).orderBy(*desc).limit(n1)
    return last.where(~F.col("line").rlike(exclude)).orderBy(*desc).limit(n2)


def head_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows in ``order`` (e.g. the lowest free slots)."""
    return df.orderBy(*order).limit(n)
