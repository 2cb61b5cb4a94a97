"""Rule segments against brute force, pairing in one order, shares inside the stream."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from switchyard.operators import joins as J
from switchyard.operators import rules as R
from switchyard.session import scratch_path
from switchyard.streaming import streams as S
from test_streaming import _write

SAMPLE_SCHEMA = "id long, metric string, value double"


def _key(v):
    """Doubles in Spark's order: NaN last, both zeros the same."""
    return (1, 0.0) if math.isnan(v) else (0, v + 0.0)


def _brute(rules, metric, v):
    best = None
    for m, lo, hi, sev, side, msg in rules:
        if m is None or m != metric:
            continue
        if v is None:
            hit = lo is None and hi is None
        else:
            hit = (lo is None or _key(v) > _key(lo)) and (hi is None or _key(v) < _key(hi))
        if hit:
            nulls_first = [(x is not None, x if x is not None else "") for x in (sev, side, msg)]
            k = (R.SEVERITY_RANK.get(sev, 0), *nulls_first)
            if best is None or k > best[0]:
                best = (k, sev, side, msg)
    return ("PASS", None, None) if best is None else (best[1] if best[1] is not None else "PASS", best[2], best[3])


def _check(spark, rules, samples):
    got = R.grade(spark.createDataFrame(samples, SAMPLE_SCHEMA), R.rules_table(spark, rules)).collect()
    assert len(got) == len(samples)
    assert {r.id: (r.severity, r.side, r.message) for r in got} == {i: _brute(rules, m, v) for i, m, v in samples}


def test_overlapping_rules_equal_a_scan_of_all_rules(spark):
    rnd = random.Random(5)
    for _ in range(3):
        values = [None, math.nan, 0.0, -0.0, math.inf, -math.inf, 1.0, 1.5, 2.0, -3.0, 1e-300]
        rules = [(rnd.choice(["a", "b", None]), rnd.choice(values), rnd.choice(values), rnd.choice([*R.SEVERITY_RANK, None]),
                  rnd.choice(["SERVER", "CLIENT", None]), rnd.choice(["m1", "m2", None])) for _ in range(14)]
        rules += [("c", None, None, "INFO", "INFO", "seen"), ("d", 2.0, 1.0, "FAIL", "SERVER", "empty"), ("d", 1.0, 1.0, "FAIL", "SERVER", "empty")]
        points = [*values, 1.2, 1.7, 5.0, -4.0]
        _check(spark, rules, [(i, m, v) for i, (m, v) in enumerate((m, v) for m in ("a", "b", "c", "d", "none", None) for v in points)])


def test_ten_thousand_rules_of_one_metric(spark):
    rnd = random.Random(9)
    rules = []
    for i in range(10_000):
        lo = rnd.randrange(20_000) / 2
        rules.append(("m", lo, lo + rnd.choice([0.5, 3.0, 200.0]), rnd.choice(["INFO", "WARN", "FAIL"]), "SERVER", f"r{i:05d}"))
    _check(spark, rules, [(i, "m", rnd.randrange(-40, 41_000) / 4) for i in range(400)])


def test_no_rules_and_no_samples(spark):
    _check(spark, [], [(1, "a", 1.0), (2, None, None)])
    empty = spark.createDataFrame([], SAMPLE_SCHEMA)
    assert R.grade(empty, R.rules_table(spark, R.HOST_RULES)).count() == 0


def test_the_search_needs_no_higher_order_function(spark):
    plan = R.grade(spark.range(10).select(F.lit("rtt_ms").alias("metric"), F.col("id").cast("double").alias("value")),
                   R.rules_table(spark, R.HOST_RULES).hint("broadcast"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.split("Join LeftOuter")[0]  # the search is plain column steps above the join


def test_pairing_in_one_order(spark):
    needs = spark.createDataFrame([("s1", "u2", 1), ("s1", "u1", 2), ("s1", "u3", 3), ("s2", "u9", 4), (None, "u0", 5)], "ip string, name string, x int")
    free = spark.createDataFrame([("s1", 12), ("s1", 11), ("s3", 1), (None, 7)], "ip string, conf int")
    got = J.zip_assign(needs, free, "ip", ["name"], ["conf"])
    assert got.columns == ["ip", "rn", "name", "x", "slot_conf"]
    assert sorted((r.name, r.rn, r.x, r.slot_conf) for r in got.collect()) == [
        ("u0", 1, 5, None), ("u1", 1, 2, 11), ("u2", 2, 1, 12), ("u3", 3, 3, None), ("u9", 1, 4, None)]
    assert J.zip_assign(needs.limit(0), free, "ip", ["name"], ["conf"]).count() == 0
    assert J.zip_assign(needs, free.limit(0), "ip", ["name"], ["conf"]).where("slot_conf is null").count() == 5


def test_pairing_of_a_hot_part(spark):
    needs = spark.range(3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 7).alias("k"), F.format_string("n%05d", "id").alias("n"))
    free = spark.range(2600).select(F.when(F.col("id") < 2400, 0).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 3).alias("c"))
    got = J.zip_assign(needs, free, "k", ["n"], ["c"]).collect()
    slots = {}
    for r in sorted(free.collect()):
        slots.setdefault(r.k, []).append(r.c)
    want, seen = [], {}
    for r in sorted(needs.collect()):
        i = seen[r.k] = seen.get(r.k, 0) + 1
        of = slots.get(r.k, [])
        want.append((r.k, r.n, i, of[i - 1] if i <= len(of) else None))
    assert sorted((r.k, r.n, r.rn, r.slot_c) for r in got) == want


def test_shares_come_out_of_the_stream_once(spark):
    """Over several micro-batches and a restart: a window's shares come together, when it closes, and only once."""
    src, sink, ckpt = (scratch_path(spark, f"share-{n}") for n in ("src", "out", "ckpt"))
    t, m = dt.datetime(2024, 1, 30, 10, 0), dt.timedelta(minutes=1)

    def run():
        calls = spark.readStream.schema(S.CALL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        return S.run_available_now(S.stream_disposition_shares(calls, "10 minutes", "30 minutes", "30 minutes"), sink, ckpt)

    _write(spark, src, [(1, t, 1, "a", "SALE"), (2, t + m, 1, "a", "NA"), (3, t + 2 * m, 1, "a", None)], S.CALL_SCHEMA)
    assert run().count() == 0  # still open
    _write(spark, src, [(4, t + 29 * m, 2, "a", "NA"), (5, t + 31 * m, 2, "b", "DROP")], S.CALL_SCHEMA)
    _write(spark, src, [(6, t + 45 * m, 2, "b", "SALE")], S.CALL_SCHEMA)  # the watermark passes 10:30
    first = {(r.window_start, r.status): (r["count"], float(r.pct)) for r in run().collect()}
    assert first == {(t, "SALE"): (1, 25.0), (t, "NA"): (2, 50.0), (t, None): (1, 25.0)}
    _write(spark, src, [(7, t + 3 * m, 2, "b", "SALE"), (8, t + 90 * m, 2, "b", "SALE")], S.CALL_SCHEMA)  # too late; closes 11:00
    rows = run().collect()
    assert len(rows) == len({(r.window_start, r.status) for r in rows}) == 5
    assert {(r.status, r["count"], float(r.pct)) for r in rows if r.window_start == t + 30 * m} == {("DROP", 1, 50.0), ("SALE", 1, 50.0)}
