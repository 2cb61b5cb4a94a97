"""Compare a Spark result with its DuckDB oracle: columns, types, rows.

Mirrors the driver's check: columns sorted by name, row count, and an
order-insensitive comparison of the values.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))

from switchyard.plans.fixtures import BASE_TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def type_family(t: pa.DataType) -> str:
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_large_string(t) or pa.types.is_string(t) or pa.types.is_string_view(t):
        return "string"
    if pa.types.is_decimal(t):
        return "decimal"
    return str(t)


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(tbl: pa.Table, cols: list[str]):
    data = [tbl.column(c).to_pylist() for c in cols]
    rows = [tuple(norm(col[i]) for col in data) for i in range(tbl.num_rows)]
    return sorted(rows, key=repr)


def compare(spark_tbl: pa.Table, oracle_tbl: pa.Table) -> tuple[bool, str]:
    sc = sorted(spark_tbl.column_names)
    oc = sorted(oracle_tbl.column_names)
    if sc != oc:
        return False, f"columns differ: spark={sc} oracle={oc}"
    st = {c: type_family(spark_tbl.schema.field(c).type) for c in sc}
    ot = {c: type_family(oracle_tbl.schema.field(c).type) for c in oc}
    bad = {c: (st[c], ot[c]) for c in sc if st[c] != ot[c] and ot[c] != "null"}
    if bad:
        return False, f"types differ: {bad}"
    if spark_tbl.num_rows != oracle_tbl.num_rows:
        return False, f"row counts differ: spark={spark_tbl.num_rows} oracle={oracle_tbl.num_rows}"
    a, b = rows_of(spark_tbl, sc), rows_of(oracle_tbl, sc)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ (first): {diff}"
    return True, f"{spark_tbl.num_rows} rows"


def check_key(spark, key: str, sf_dir: str, con=None) -> tuple[bool, str, float]:
    from switchyard.plans.catalog import ORACLES, QUERIES

    t0 = time.time()
    df = QUERIES[key](spark, sf_dir)
    stbl = df.toArrow()
    el = time.time() - t0
    if key not in ORACLES:
        return True, f"rows-only: {stbl.num_rows} rows", el
    con = con or duck(sf_dir)
    otbl = con.sql(ORACLES[key]).to_arrow_table()
    ok, msg = compare(stbl, otbl)
    return ok, msg, el


def main(argv: list[str]) -> int:
    from switchyard.plans.catalog import QUERIES
    from switchyard.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    keys = [a for a in argv if not a.startswith("/")] or list(QUERIES)
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
    spark = local_session()
    con = duck(sf_dir)
    fails = 0
    for k in keys:
        try:
            ok, msg, el = check_key(spark, k, sf_dir, con)
        except Exception as e:  # noqa: BLE001
            ok, msg, el = False, f"ERROR {type(e).__name__}: {str(e)[:400]}", 0.0
        fails += not ok
        print(f"{'OK ' if ok else 'BAD'} {k:28s} {el:6.2f}s {msg}", flush=True)
    print(f"{len(keys) - fails}/{len(keys)} ok")
    return 1 if fails else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
