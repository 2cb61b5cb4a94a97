"""Column expressions shared by the operators.

Everything here is a built-in Spark expression, so it stays inside
whole-stage codegen.  Number formatting follows the reference: SQL
ROUND(x, 1) rounds half away from zero; ``bc`` with ``scale=1`` truncates.
Both are computed on integers, so Spark and the SQL oracle agree exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_literal(value: str) -> Column:
    """A zone-free timestamp literal (``as_of`` and friends)."""
    return F.lit(value).cast("timestamp_ntz")


def ago(as_of: str, interval: str) -> Column:
    """``as_of - INTERVAL interval`` as a literal the optimizer folds."""
    return ts_literal(as_of) - F.expr(f"INTERVAL {interval}")


def within(c: str | Column, as_of: str, interval: str) -> Column:
    """``as_of - interval < c <= as_of``: a run for an earlier time does not see later rows."""
    return (col(c) > ago(as_of, interval)) & (col(c) <= ts_literal(as_of))


def ntz_micros(c: str | Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock (TIMESTAMP_NTZ) value.

    Pure arithmetic on the date and time parts: no session time zone, so no
    DST hour is added or lost (``timestamp_diff`` on NTZ values goes through
    the session zone).
    """
    c = col(c).cast("timestamp_ntz")
    secs = F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return secs * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Whole seconds from ``start`` to ``end`` (TIMESTAMPDIFF(SECOND, ...) on
    DATETIME values: wall-clock difference, truncated toward zero)."""
    d = ntz_micros(end) - ntz_micros(start)
    return ((d - d % 1_000_000) / 1_000_000).cast("long")


def day_start(c: str | Column) -> Column:
    """Midnight of the wall-clock day of ``c`` (zone-free)."""
    return F.to_date(col(c).cast("timestamp_ntz")).cast("timestamp_ntz")


def blank(c: str | Column, extra: Iterable[str] = ("0",)) -> Column:
    """NULL, '' or one of ``extra`` (untrimmed); agents treat '0' as blank."""
    c = col(c)
    return c.isNull() | c.isin("", *extra)


def digits_only(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def _int_div(a: Column, b: Column) -> Column:
    """Exact integer division of non-negative decimal(38,0) values."""
    return ((a - a % b) / b).cast("decimal(38,0)")


def _exact_operands(num, den):
    n = col(num).cast("decimal(38,0)")
    d = col(den).cast("decimal(38,0)")
    return n, F.when(d != 0, d)  # a zero denominator gives NULL, as in SQL engines


def round_half_up_ratio(num: str | Column, den: str | Column, scale: int = 1) -> Column:
    """ROUND(num / den, scale) half away from zero, exact on integers (decimal(38,0))."""
    n, d = _exact_operands(num, den)
    m = 10**scale
    q = _int_div(F.abs(n) * (2 * m) + F.abs(d), F.abs(d) * 2)
    return (F.signum(n) * F.signum(d) * q.cast("double")) / m


def truncate_ratio(num: str | Column, den: str | Column, scale: int = 1) -> Column:
    """``bc`` scale=N division: truncated toward zero, exact on integers (decimal(38,0))."""
    n, d = _exact_operands(num, den)
    m = 10**scale
    q = _int_div(F.abs(n) * m, F.abs(d))
    return (F.signum(n) * F.signum(d) * q.cast("double")) / m


def xargs_trim(c: str | Column) -> Column:
    """Trim and collapse whitespace runs, as ``| xargs`` does."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def basename(c: str | Column) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def glob_to_regex(globs: str | Iterable[str]) -> str:
    """Anchored regex for a set of shell globs (``*``, ``?``, ``[...]``).

    The result uses only syntax shared by Java regex and RE2, so the same
    pattern text serves Spark and the SQL oracle.
    """
    if isinstance(globs, str):
        globs = [globs]
    parts = []
    for g in globs:
        out = []
        i = 0
        while i < len(g):
            ch = g[i]
            if ch == "*":
                out.append(".*")
            elif ch == "?":
                out.append(".")
            elif ch == "[":
                j = g.find("]", i + 1)
                if j == -1:
                    out.append(r"\[")
                else:
                    body = g[i + 1 : j]
                    if body.startswith("!"):
                        body = "^" + body[1:]
                    out.append("[" + body.replace("\\", "\\\\") + "]")
                    i = j
            else:
                out.append(re.escape(ch))
            i += 1
        parts.append("".join(out))
    return "^(?:" + "|".join(parts) + ")$"


def sql_str(value: str) -> str:
    """Quote a Python string as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_values(rows: Iterable[tuple], names: Iterable[str], alias: str = "t") -> str:
    """``(values ...) t(names)`` text for a small literal table."""

    def lit(v):
        if v is None:
            return "null"
        if isinstance(v, str):
            return sql_str(v)
        return repr(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(values {body}) as {alias}({', '.join(names)})"


# SQL-text twins for the oracle (DuckDB dialect) ---------------------------------


def sql_round_half_up_ratio(num: str, den: str, scale: int = 1) -> str:
    m = 10**scale
    n, d = f"cast({num} as hugeint)", f"cast({den} as hugeint)"
    d = f"nullif({d}, 0)"
    return (
        f"cast(sign({n}) * sign({d}) * ((abs({n}) * {2 * m} + abs({d})) // (abs({d}) * 2))"
        f" as double) / {m}"
    )


def sql_truncate_ratio(num: str, den: str, scale: int = 1) -> str:
    m = 10**scale
    n, d = f"cast({num} as hugeint)", f"nullif(cast({den} as hugeint), 0)"
    return f"cast(sign({n}) * sign({d}) * ((abs({n}) * {m}) // abs({d})) as double) / {m}"


def sql_ts(value: str) -> str:
    return f"TIMESTAMP '{value}'"


def sql_ago(as_of: str, interval: str) -> str:
    return f"(TIMESTAMP '{as_of}' - INTERVAL {interval})"


def sql_within(c: str, as_of: str, interval: str) -> str:
    return f"({c} > {sql_ago(as_of, interval)} and {c} <= {sql_ts(as_of)})"


def sql_blank(c: str, extra: Iterable[str] = ("0",)) -> str:
    vals = ", ".join(sql_str(v) for v in ("", *extra))
    return f"({c} is null or {c} in ({vals}))"


def sql_xargs_trim(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
