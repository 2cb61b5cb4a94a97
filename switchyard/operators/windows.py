"""Window-style operators and skew-safe ranking.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sends a whole group to one
task.  When a group may hold a large share of all rows (a few servers, one
hot list), ``ranked`` numbers rows without that: Spark's range partitioner
cuts the (g, k) order into partitions (per-task bounded sampling, any number
of partitions), so a hot group spans many tasks; the sorted partitions are
fixed once with a reliable ``checkpoint()`` into the shared checkpoint
folder; every row's rank is then its position inside its partition plus the
rows of its group in earlier partitions, taken from a table with at most one
row per (partition, group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import ensure_checkpoint_dir


def _cols(cs: Sequence[str | Column]) -> list[Column]:
    return [X.col(c) for c in cs]


def ranked(df: DataFrame, part: Sequence[str], order: Sequence[str | Column], out: str = "rn",
           num_partitions: int | None = None) -> DataFrame:
    """``row_number()`` per ``part`` in ``order``, skew-safe.

    ``order`` must make the order total inside each group (add a unique
    tie-break column); the result is then deterministic.  ``order`` entries
    may be column names or sort expressions such as ``F.col("x").desc()``.
    The input is computed by the range partitioner's sampling pass and its
    shuffle, written once by ``checkpoint()``, and then only read.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pcols = list(part)
    keys = [*_cols(pcols), *_cols(order)]
    fixed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    # on the checkpointed data partition ids and in-partition positions are
    # stable: every read of it sees the same rows in the same order
    pos = fixed.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    runs = pos.groupBy("_pid", *pcols).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*pcols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = offsets.select(F.col("_pid").alias("_opid"), *[F.col(c).alias(f"_o_{c}") for c in pcols],
                             "_first", "_offset")
    cond = [F.col("_pid") == F.col("_opid")] + [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in pcols]
    joined = pos.join(offsets, cond, "inner")
    rn = (F.col("_offset") + F.col("_mid") - F.col("_first") + 1).cast("long")
    return joined.select(*[F.col(c) for c in df.columns], rn.alias(out))


def share_of_total(df: DataFrame, key: str = "status", n: int | None = 20, count_col: str = "count",
                   pct_col: str = "pct") -> DataFrame:
    """Count per key with ROUND(count*100/total, 1), top ``n`` by count.

    The total is the sum of the groups as a scalar subquery, so no
    single-partition window runs over the data and it is read once.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(count_col))
    total = counts.select(F.coalesce(F.sum(count_col), F.lit(0))).scalar()
    out = counts.select(key, count_col, X.round_half_up_ratio(F.col(count_col) * 100, total).alias(pct_col))
    out = out.orderBy(F.col(count_col).desc(), F.col(key).asc())
    return out.limit(n) if n is not None else out


def topn_per_key(df: DataFrame, key: str, order: Sequence[str | Column], n: int, rn_col: str | None = "rn") -> DataFrame:
    """At most ``n`` rows per key in a deterministic order.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before
    the shuffle (n within ``spark.sql.optimizer.windowGroupLimitThreshold``),
    so a hot key ships at most n rows per map task.  Above the threshold the
    rows are numbered with the skew-safe ``ranked``.
    """
    tmp = rn_col or "_rn"
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        out = ranked(df, [key], list(order), out=tmp).where(F.col(tmp) <= n)
        return out if rn_col else out.drop(tmp)
    w = Window.partitionBy(key).orderBy(*_cols(order))
    out = df.withColumn(tmp, F.row_number().over(w)).where(F.col(tmp) <= n)
    out = out.withColumn(tmp, F.col(tmp).cast("long"))
    return out if rn_col else out.drop(tmp)


def assign_new_ids(collisions: DataFrame, key: str, base: Column, out: str = "new_id") -> DataFrame:
    """New ids for colliding keys: ``base + rank`` in key order (global rank)."""
    r = ranked(collisions, [], [key], out="_seq")
    return r.withColumn(out, (base + F.col("_seq")).cast("long")).drop("_seq")


def latest_per_key(df: DataFrame, key: str | Sequence[str], ts: str, tie: str, cols: Sequence[str]) -> DataFrame:
    """Latest row per key by (ts, tie): an aggregate with partial combine."""
    keys = [key] if isinstance(key, str) else list(key)
    packed = F.struct(F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), *[F.col(c).alias(c) for c in cols])
    agg = df.groupBy(*keys).agg(F.max(packed).alias("_latest"))
    return agg.select(*keys, *[F.col("_latest")[c].alias(c) for c in cols],
                      F.col("_latest")["_ts"].alias(ts))
