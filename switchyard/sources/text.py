"""Line-oriented text sources (SURVEY src_log_lines, src_kv_text, src_column_text).

Text is read with ``spark.read.text`` (or ``readStream.text``) and split
with built-in regex expressions; each line is independent, so the work is
spread over the file splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

# Service log lines: "[2024-01-30 10:00:00] LEVEL[thread]: message" (ISO) or
# "[Jan 30 10:00:00] LEVEL[thread][call]: message" (syslog style).
LOG_RX = r"^\[([^\]]+)\]\s+([A-Z]+)\[([^\]]*)\](?:\[[^\]]*\])*:?\s*(.*)$"


# Month abbreviations of syslog-style stamps.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ISO_STAMP = r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2}(?:\.\d+)?)$"
SYSLOG_STAMP = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})$"


def _wall_clock(y, mo, d, h, mi, s):
    """A TIMESTAMP_NTZ from parts, NULL when they do not form a valid time.

    Built from the parts directly, so no session time zone (and no DST gap)
    is involved: the log's wall-clock time is kept as written.
    """
    return F.try_make_timestamp_ntz(y.try_cast("int"), mo.try_cast("int"), d.try_cast("int"), h.try_cast("int"),
                                    mi.try_cast("int"), s.try_cast("decimal(10,6)"))


def parse_stamp(stamp, year: int | None = None):
    """ISO ``yyyy-MM-dd HH:mm:ss[.f]`` or, given ``year``, syslog ``Mon d HH:mm:ss``."""
    def g(rx, i):
        return F.regexp_extract(stamp, rx, i)

    iso = F.when(stamp.rlike(ISO_STAMP), _wall_clock(*[g(ISO_STAMP, i) for i in range(1, 7)]))
    if year is None:
        return iso
    month = F.lit(None).cast("string")
    for i, m in reversed(list(enumerate(MONTHS, start=1))):
        month = F.when(g(SYSLOG_STAMP, 1) == m, F.lit(str(i))).otherwise(month)
    sys = F.when(stamp.rlike(SYSLOG_STAMP),
                 _wall_clock(F.lit(str(year)), month, g(SYSLOG_STAMP, 2), g(SYSLOG_STAMP, 3), g(SYSLOG_STAMP, 4),
                             g(SYSLOG_STAMP, 5)))
    return F.coalesce(iso, sys)


def parse_log_lines(lines: DataFrame, line_col: str = "line", year: int | None = None) -> DataFrame:
    """``lines`` plus ts, level, component and message parsed from each line.

    ISO timestamps parse directly; syslog-style ``Mon dd HH:MM:SS`` stamps
    take ``year`` (they carry none).  Unparseable stamps give NULL.
    """
    line = F.col(line_col)
    stamp = F.regexp_extract(line, LOG_RX, 1)
    ts = parse_stamp(stamp, year)
    cols = [c for c in lines.columns if c != "ts"]
    return lines.select(
        *cols, ts.alias("ts"),
        F.nullif(F.regexp_extract(line, LOG_RX, 2), F.lit("")).alias("level"),
        F.nullif(F.regexp_extract(line, LOG_RX, 3), F.lit("")).alias("component"),
        F.regexp_extract(line, LOG_RX, 4).alias("message"),
    )


def read_log_lines(spark: SparkSession, path: str | list[str], host: str | None = None, year: int | None = None) -> DataFrame:
    """Log files as (line_no, host, line, ts, level, component, message, line_key).

    ``line_key`` = (file, split start, position) orders lines as they stand in
    their files, across files and splits; use it where "first line" matters
    (e.g. ``extract_kv(..., order_col="line_key")``).  ``line_no`` is a unique
    id, increasing within a split only.
    """
    raw = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("line_no"), F.lit(host).cast("string").alias("host"),
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"))
    keyed = raw.withColumn("line_key", F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"),
                                                 F.col("line_no").alias("pos"))).drop("_file", "_block")
    return parse_log_lines(keyed, "line", year)


# Fixed values that must equal the reference: which line answers each
# setting (case-insensitive substring for the peer listing, anchored
# case-sensitive keys for the config files) and the field separator.
PEER_KEYS = (
    ("status", "(?i)Status", ":"),
    ("codecs", "(?i)Codecs|Codec", ":"),
    ("qualify", "(?i)Qualify", ":"),
    ("direct_media", "(?i)Direct|CanReinvite|DirectMedia", ":"),
    ("transport", "(?i)Transport", ":"),
)
CONFIG_KEYS = (
    ("jbenable", "^jbenable", "="),
    ("jbforce", "^jbforce", "="),
    ("jbimpl", "^jbimpl", "="),
    ("jbmaxsize", "^jbmaxsize", "="),
    ("rtpstart", "^rtpstart", "="),
    ("rtpend", "^rtpend", "="),
)


def extract_kv(lines: DataFrame, keys: Sequence[tuple[str, str, str]], host_col: str = "host",
               order_col: str = "line_no") -> DataFrame:
    """First matching line per (host, key); value = second field, xargs-trimmed.

    One scan: each line yields the (key, value) pairs it answers, then
    ``min_by(value, line_no)`` per (host, key) keeps the first, combined
    partially per task.
    """
    line = F.col("line")
    pairs = F.array(*[
        F.when(line.rlike(rx), F.struct(F.lit(name).alias("key"),
                                         X.xargs_trim(F.coalesce(F.get(F.split(line, sep, -1), 1), F.lit(""))).alias("value")))
        for name, rx, sep in keys])
    exploded = lines.select(host_col, order_col, F.explode(F.array_compact(pairs)).alias("kv"))
    return exploded.groupBy(host_col, F.col("kv.key").alias("key")).agg(
        F.min_by(F.col("kv.value"), F.col(order_col)).alias("value"))


# Fixed values that must equal the reference: header / footer lines of the
# channel listing.
CHANNEL_DROP = r"^\s*$|Channel|active call|active channel"
CHANNEL_COLUMNS = ("channel", "location", "state", "application")


def parse_columns(lines: DataFrame, names: Sequence[str] = CHANNEL_COLUMNS, drop_regex: str = CHANNEL_DROP,
                  keep: Sequence[str] = ("line_no",)) -> DataFrame:
    """Whitespace-separated columns; header, blank and footer lines dropped."""
    body = lines.where(~F.col("line").rlike(drop_regex))
    parts = F.split(F.trim(F.col("line")), r"\s+")
    return body.select(*keep, *[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def read_log_stream(spark: SparkSession, path: str, host: str | None = None, year: int | None = None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Log files arriving in ``path`` as a stream of parsed lines.

    A stream has no stable line number, so ``line_no`` is NULL; ``ts`` is
    the parsed event time to put a watermark on.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(path).select(F.lit(None).cast("long").alias("line_no"),
                                   F.lit(host).cast("string").alias("host"), F.col("value").alias("line"))
    return parse_log_lines(raw, "line", year)
