"""Projections, filters and predicates.

All filters are plain column predicates with literal bounds, so Catalyst
pushes them into the Parquet scan (or a JDBC WHERE clause).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from .sizing import literal_table

# Fixed values that must equal the reference: the 13 exported lead columns
# in their export order, and which of them default to 0 instead of ''.
LEAD_EXPORT_COLUMNS = (
    "list_id", "phone_number", "first_name", "last_name", "email", "address1", "city",
    "state", "postal_code", "status", "entry_date", "last_local_call_time", "called_count",
)
LEAD_EXPORT_UNWRAPPED = ("list_id", "phone_number")
LEAD_EXPORT_ZERO_DEFAULT = ("called_count",)

DATETIME_TEXT = "yyyy-MM-dd HH:mm:ss"


def _as_text(df: DataFrame, c: str) -> Column:
    dtype = dict(df.dtypes).get(c)
    if dtype is None:
        return F.lit(None).cast("string")
    if dtype.startswith("timestamp") or dtype == "date":
        return F.date_format(F.col(c), DATETIME_TEXT)
    return F.col(c).cast("string")


def project_leads(leads: DataFrame) -> DataFrame:
    """The 13 export columns: IFNULL(col, '') and IFNULL(called_count, 0)."""
    out = []
    for c in LEAD_EXPORT_COLUMNS:
        if c in LEAD_EXPORT_UNWRAPPED:
            out.append(F.col(c) if c in leads.columns else F.lit(None).cast("string").alias(c))
        elif c in LEAD_EXPORT_ZERO_DEFAULT:
            src = F.col(c) if c in leads.columns else F.lit(None).cast("int")
            out.append(F.coalesce(src, F.lit(0)).alias(c))
        else:
            out.append(F.coalesce(_as_text(leads, c), F.lit("")).alias(c))
    return leads.select(*out)


# Fixed values that must equal the reference: status code -> label per kind,
# with the display colour turned into a severity word.
STATUS_LABELS = (
    # agent states
    ("agent", "READY", "waiting for call", "ok"),
    ("agent", "INCALL", "on a live call", "active"),
    ("agent", "PAUSED", "paused/break", "warn"),
    ("agent", "DEAD", "session dead", "bad"),
    ("agent", "CLOSER", "closer agent", "info"),
    ("agent", "QUEUE", "in queue", "info"),
    # channel states
    ("channel", "Up", "bridged/active", "ok"),
    ("channel", "Ring", "ringing at agent/carrier", "warn"),
    ("channel", "Ringing", "outbound ringing", "warn"),
    ("channel", "Down", "hanging up", "bad"),
    ("channel", "Rsrvd", "reserved", "info"),
    # call dispositions (30-minute mix)
    ("disposition", "SALE", "", "ok"),
    ("disposition", "CALLBK", "", "ok"),
    ("disposition", "DNC", "", "ok"),
    ("disposition", "DROP", "dropped/abandoned", "bad"),
    ("disposition", "ABAND", "dropped/abandoned", "bad"),
    ("disposition", "AFTHRS", "dropped/abandoned", "bad"),
    ("disposition", "AM", "answering machine detected", "warn"),
    ("disposition", "AA", "answering machine detected", "warn"),
    ("disposition", "AMD", "answering machine detected", "warn"),
    ("disposition", "DNCL", "", "info"),
    ("disposition", "DCBK", "", "info"),
    ("disposition", "N", "no answer", "info"),
    ("disposition", "NA", "no answer", "info"),
    ("disposition", "INCALL", "", "active"),
    # call outcomes (1-hour pattern)
    ("outcome", "N", "no answer — normal if dialing mobile/cell", "warn"),
    ("outcome", "NA", "no answer — normal if dialing mobile/cell", "warn"),
    ("outcome", "NOAN", "no answer — normal if dialing mobile/cell", "warn"),
    ("outcome", "BUSY", "busy signal", "warn"),
    ("outcome", "AM", "answering machine", "warn"),
    ("outcome", "MACHINE", "answering machine", "warn"),
    ("outcome", "DROP", "answered but dropped — no agent", "bad"),
    ("outcome", "ABAND", "answered but dropped — no agent", "bad"),
    ("outcome", "INCALL", "currently active", "active"),
    ("outcome", "SALE", "converted", "ok"),
    ("outcome", "CALLBK", "converted", "ok"),
    ("outcome", "DNCL", "do not call list", "info"),
)
STATUS_LABEL_SCHEMA = "kind string, status string, label string, severity string"


def status_dimension(spark: SparkSession, rows=STATUS_LABELS) -> DataFrame:
    return literal_table(spark, rows, STATUS_LABEL_SCHEMA)


def label_status(df: DataFrame, kind: str, status_col: str = "status", labels: DataFrame | None = None) -> DataFrame:
    """Attach label and severity for ``kind`` codes; unknown codes are 'other'."""
    dim = labels if labels is not None else status_dimension(df.sparkSession)
    dim = dim.where(F.col("kind") == kind).select(
        F.col("status").alias("_code"), F.col("label").alias("_label"), F.col("severity").alias("_sev")
    )
    if labels is None:
        dim = F.broadcast(dim)  # a literal table
    else:
        # a caller's table may repeat a code: the smallest (label, severity) counts, so no row is multiplied
        dim = dim.groupBy("_code").agg(F.min(F.struct("_label", "_sev")).alias("_l")).select("_code", "_l.*")
    joined = df.join(dim, F.col(status_col) == F.col("_code"), "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.coalesce(F.col("_label"), F.lit("other")).alias("label"),
        F.coalesce(F.col("_sev"), F.lit("info")).alias("severity"),
    )


def recent(df: DataFrame, ts_col: str, as_of: str, lookback: str) -> DataFrame:
    """Rows with ``as_of - lookback < ts_col <= as_of``."""
    return df.where(X.within(ts_col, as_of, lookback))


def since_midnight(df: DataFrame, ts_col: str, as_of: str, exclude: Iterable[str] = ("DROP", "ABAND"),
                   status_col: str = "status") -> DataFrame:
    """Rows strictly after the start of the as-of day and not after ``as_of``, status not in ``exclude``."""
    start = X.day_start(X.ts_literal(as_of))
    return df.where((F.col(ts_col) > start) & (F.col(ts_col) <= X.ts_literal(as_of)) & ~F.col(status_col).isin(*exclude))


def in_set(df: DataFrame, c: str, values: Iterable, negate: bool = False) -> DataFrame:
    """IN / NOT IN a literal set with SQL three-valued logic (NULL dropped)."""
    values = list(values)
    pred = F.col(c).isin(*values)
    return df.where(~pred if negate else pred)


def shadow_rows(df: DataFrame, c: str, suffix: str = "_B", wildcard: bool = False) -> DataFrame:
    """Rows whose ``c`` carries the shadow suffix.

    Strict mode is a literal suffix test.  ``wildcard`` keeps the legacy
    ``LIKE '%_B'`` form, where ``_`` matches any one character.
    """
    return df.where(F.col(c).like("%" + suffix) if wildcard else F.col(c).endswith(suffix))


def is_shadow(c: Column, suffix: str = "_B", wildcard: bool = False) -> Column:
    return c.like("%" + suffix) if wildcard else c.endswith(suffix)


def eligible_agents(users: DataFrame, suffix: str = "_B", max_bytes: int = 18, wildcard: bool = False) -> DataFrame:
    """Active users, level 1..4, not shadows, name at most ``max_bytes`` bytes."""
    u = F.col("user_name")
    return users.where(
        (F.col("active") == "Y")
        & F.col("user_level").between(1, 4)
        & ~is_shadow(u, suffix, wildcard)
        & (F.octet_length(u) <= max_bytes)
    )


def grep_lines(lines: DataFrame, include: str | None = None, exclude: str | None = None,
               ignore_case: bool = False, line_col: str = "line") -> DataFrame:
    """Keep lines matching ``include`` and not matching ``exclude`` (regex)."""
    flag = "(?i)" if ignore_case else ""
    out = lines
    if include:
        out = out.where(F.col(line_col).rlike(flag + include))
    if exclude:
        out = out.where(~F.col(line_col).rlike(flag + exclude))
    return out


def invalid_phone(c: str | Column, min_digits: int = 10) -> Column:
    """Fewer than ``min_digits`` digits once non-digits are removed."""
    return F.length(X.digits_only(c)) < min_digits


def campaign_flags(campaigns: DataFrame, aggressive_level: float = 3.0) -> DataFrame:
    """Active campaigns' settings plus the two warning flags, by campaign id."""
    keep = [c for c in (
        "campaign_id", "campaign_name", "active", "dial_status_a", "auto_dial_level", "hopper_level",
        "available_only_ratio_tally", "dial_timeout", "answering_machine_detection",
        "am_message_exten", "drop_call_seconds", "safe_harbor_exten") if c in campaigns.columns]
    am = F.coalesce(F.col("am_message_exten"), F.lit(""))
    return (
        campaigns.where(F.col("active") == "Y")
        .select(
            *[F.col(c).cast("double").alias(c) if c == "auto_dial_level" else F.col(c) for c in keep],
            (F.col("auto_dial_level") > F.lit(aggressive_level)).alias("aggressive_dial"),
            ((F.col("answering_machine_detection") == "N") & (am != "") & (am != "none")).alias("amd_off_message_set"),
        )
    )


# Fixed values that must equal the reference: junk-file name globs.
JUNK_GLOBS = ("*.log", "*.old", "*.gz", "screenlog.*", "agiout.*", "safe_*", "go_*")


def junk_files(files: DataFrame, globs: Iterable[str] = JUNK_GLOBS, path_col: str = "path") -> DataFrame:
    """Files whose base name matches one of the shell globs."""
    return files.where(X.basename(path_col).rlike(X.glob_to_regex(globs)))


# Fixed values that must equal the reference: age-based retention policy
# (root, name glob, days); a file qualifies when its whole-day age exceeds days.
AGE_POLICY = (
    ("/var/log/asterisk", "*.txt", 14),
    ("/var/log/asterisk", "*.gz", 14),
    ("/var/log/astguiclient", "*", 14),
    ("/var/log/apache2", "*.log.*", 14),
    ("/var/lib/php/sessions", "*", 2),
    ("/tmp", "*", 5),
)


def expired_files(files: DataFrame, as_of: str, policy=AGE_POLICY, path_col: str = "path",
                  mtime_col: str = "modification_time") -> DataFrame:
    """Files older than the policy's whole days, one row per matching policy.

    The policy is a short literal list, so it is matched inside each row
    (``filter`` over a literal array, then ``explode``): no join at all.
    """
    pol = F.array(*[F.struct(F.lit(r).alias("root"), F.lit(X.glob_to_regex(g)).alias("name_regex"),
                             F.lit(g).alias("name_glob"), F.lit(d).alias("days")) for r, g, d in policy])
    age_days = F.floor(X.seconds_between(mtime_col, X.ts_literal(as_of)) / 86400).cast("long")
    base = files.select(F.col(path_col).alias("_path"), X.basename(path_col).alias("_name"), age_days.alias("age_days"))
    hits = F.filter(pol, lambda p: F.col("_path").startswith(F.concat(p["root"], F.lit("/")))
                    & F.regexp_like(F.col("_name"), p["name_regex"]))
    cand = base.select("_path", "age_days", F.explode(hits).alias("p"))
    return cand.where(F.col("age_days") > F.col("p.days")).select(
        F.col("_path").alias("path"), F.col("p.root").alias("root"), F.col("p.name_glob").alias("name_glob"), F.col("p.days").alias("days"),
        "age_days")
