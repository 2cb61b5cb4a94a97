"""Rules as data.

A rule is a row ``(metric, lo, hi, severity, side, message)`` that matches a
value when ``(lo is null or value > lo) and (hi is null or value < hi)``.
Callers add thresholds as rows, not code; the worst matching severity wins
and no match is PASS.  One-sided rules plus worst-wins express every
threshold ladder of the reference (``> 150`` FAIL, ``> 80`` WARN).

The rules of a metric may overlap and there may be thousands of them.  A
sweep over their bounds turns them into disjoint segments, each with its worst
rule (``segments``); a sample finds its segment by binary search in the sorted
bounds, so grading costs it the logarithm of the rules and adds no shuffle
over the samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sizing import literal_table

RULE_SCHEMA = "metric string, lo double, hi double, severity string, side string, message string"
SEVERITY_RANK = {"PASS": 0, "INFO": 1, "WARN": 2, "FAIL": 3}

# Fixed values that must equal the reference: host and network thresholds.
HOST_RULES = (
    ("iowait", 10.0, None, "FAIL", "SERVER", "High iowait: disk I/O is stalling the kernel"),
    ("mem_avail_mb", None, 256.0, "FAIL", "SERVER", "Less than 256MB RAM available"),
    ("mem_avail_mb", None, 512.0, "WARN", "SERVER", "Under 512MB RAM available"),
    ("nice", 0.0, None, "WARN", "SERVER", "Telephony server process has a positive nice value"),
    ("timing_pct", None, 99.95, "FAIL", "SERVER", "Timing accuracy below 99.95%"),
    ("timing_pct", None, 99.98, "WARN", "SERVER", "Timing accuracy slightly degraded"),
    ("rtt_ms", 150.0, None, "FAIL", "CLIENT", "SIP RTT too high"),
    ("rtt_ms", 80.0, None, "WARN", "CLIENT", "SIP RTT borderline"),
)
NETWORK_RULES = (
    ("pkt_loss", 2.0, None, "FAIL", "CLIENT", "Packet loss: network path is severely degraded"),
    ("pkt_loss", 0.0, None, "WARN", "CLIENT", "Minor packet loss"),
    ("jitter_ms", 30.0, None, "FAIL", "CLIENT", "High jitter: network path is unstable"),
    ("jitter_ms", 15.0, None, "WARN", "CLIENT", "Moderate jitter"),
)


def rules_table(spark: SparkSession, rows) -> DataFrame:
    return literal_table(spark, rows, RULE_SCHEMA, broadcast=False)


def _rank(sev):
    r = F.lit(0)
    for name, v in sorted(SEVERITY_RANK.items(), key=lambda kv: kv[1]):
        r = F.when(sev == name, F.lit(v)).otherwise(r)
    return r


def segments(rules: DataFrame) -> DataFrame:
    """``(_metric, _bounds, _worst)``: each metric's disjoint segments with their worst rule.

    ``m`` sorted distinct bounds cut the values into segments 0 to 2m: even
    ones lie between two bounds, odd ones are a bound itself, as rules exclude
    their bounds.  Segment -1 stands for null values, which only rules without
    bounds match.  ``_worst[i + 1]`` is the worst rule of segment i, null where
    none matches.  A rule covers at most two aligned blocks of segments at each
    power of two; the worst rule of a block is handed to the block's segments.
    So n rules take n log n rows, however much they overlap, all behind one
    shuffle by metric.  Rules without a metric match nothing.
    """
    rule = F.struct(_rank(F.col("severity")).alias("rank"), "severity", "side", "message", "lo", "hi")
    ends = rules.where("metric is not null").select(
        F.col("metric").alias("_metric"), F.monotonically_increasing_id().alias("_id"), rule.alias("_r")) \
        .selectExpr("*", "inline(array(struct(0 as _end, _r.lo + 0D as _b), struct(1 as _end, _r.hi + 0D as _b)))")
    # the shuffle: a bound's place among the metric's bounds, and how many there are; the rest keeps to that partitioning
    by_metric = Window.partitionBy("_metric")
    placed = ends.withColumn("_at", F.when(F.col("_b").isNotNull(), F.dense_rank().over(by_metric.orderBy(F.asc_nulls_last("_b"))))) \
        .withColumn("_m", F.coalesce(F.max("_at").over(by_metric), F.lit(0)))
    spans = placed.groupBy("_metric", "_id").agg(
        F.max("_r").alias("_r"), F.max("_m").alias("_m"),
        *[F.max(F.when(F.col("_end") == i, F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c in ("_at", "_b")])
    spans = spans.selectExpr("*", "coalesce(_at0 * 2, 0) as _from", "coalesce(_at1 * 2 - 2, _m * 2) as _to")
    # blocks of level k are numbered from 2^32 / 2^k, so that halving leads to the block around; covered are [left, right)
    own = spans.selectExpr("*", "inline(if(_from <= _to, transform(sequence(0, int(log2(_to - _from + 1))), k -> struct(k as _k, "
                           "shiftright(_from + 4294967296 + shiftleft(1L, k) - 1, k) as _left, shiftright(_to + 4294967297, k) as _right)), array()))")
    own = own.where("_left < _right").selectExpr(
        "_metric", "_k", "_r", "explode(filter(array(if(_left % 2 = 1, _left, null), if(_right % 2 = 1, _right - 1, null)), b -> b is not null)) as _block")
    blocks = own.groupBy("_metric", "_k", "_block").agg(F.max("_r").alias("_r"))
    # every segment is there, covered or not: each bound, the gap behind it, the first gap and the null values
    bare = spans.selectExpr("_metric", "if(_r.lo is null and _r.hi is null, _r, null) as _always", """inline(array(
        struct(-1L as _seg, double(null) as _b), struct(0L as _seg, double(null) as _b),
        struct(_at0 * 2L - 1 as _seg, _b0 as _b), struct(_at0 * 2L as _seg, double(null) as _b),
        struct(_at1 * 2L - 1 as _seg, _b1 as _b), struct(_at1 * 2L as _seg, double(null) as _b)))""")
    bare = bare.where("_seg is not null").selectExpr("_metric", "_seg", "_b", "if(_seg = -1, _always, null) as _r")
    inside = blocks.selectExpr("_metric", "explode(sequence(shiftleft(_block, _k) - 4294967296, shiftleft(_block + 1, _k) - 4294967297)) as _seg",
                               "double(null) as _b", "_r")
    worst = bare.unionByName(inside).groupBy("_metric", "_seg").agg(F.max("_b").alias("_b"), F.max("_r").alias("_r"))
    worst = worst.groupBy("_metric").agg(F.sort_array(F.collect_list(F.struct("_seg", "_b", "_r"))).alias("_segs"))
    return worst.selectExpr("_metric", "filter(transform(_segs, s -> s._b), b -> b is not null) as _bounds", "transform(_segs, s -> s._r) as _worst")


def grade(samples: DataFrame, rules: DataFrame, value_col: str = "value", metric_col: str = "metric") -> DataFrame:
    """Each sample with the worst matching rule's severity, side and message."""
    j = samples.join(segments(rules), F.col(metric_col) == F.col("_metric"), "left").withColumn("_v", F.col(value_col).cast("double"))
    # how many bounds are below the value: a column a power of two, each over the one before (an array has under 2^31 entries)
    steps = [f"_below{k + 1} + if(get(_bounds, _below{k + 1} + {(1 << k) - 1}) < _v, {1 << k}, 0) as _below{k}" for k in range(30, -1, -1)]
    j = j.selectExpr("*", "0 as _below31", *steps)
    found = j.select(*samples.columns, F.expr(
        "get(_worst, if(_v is null, 0, 1 + _below0 * 2 + if(get(_bounds, _below0) = _v, 1, 0)))").alias("_w"))
    return found.select(*samples.columns, F.coalesce(F.col("_w.severity"), F.lit("PASS")).alias("severity"),
                        F.col("_w.side").alias("side"), F.col("_w.message").alias("message"))


def grade_verdict(grades: DataFrame, severity_col: str = "severity") -> DataFrame:
    """PASS / WARN / FAIL tallies and the overall result (FAIL, WARN or CLEAN)."""
    s = F.col(severity_col)
    t = grades.agg(F.count_if(s == "PASS").alias("pass_count"), F.count_if(s == "WARN").alias("warn_count"),
                   F.count_if(s == "FAIL").alias("fail_count"))
    return t.withColumn("result", F.when(F.col("fail_count") > 0, "FAIL").when(F.col("warn_count") > 0, "WARN")
                        .otherwise("CLEAN"))
