"""Zone maps of log folders: look-backs that read only the files that matter.

One row per log file holds its first and last stamp and how many of its lines
match each of a few named patterns.  A look-back leaves out, before anything
is read, every file whose stamps lie wholly outside it; a count over all time
is the sum of a column, not a scan of all lines.

A row speaks for a file only while path, size and modification time are those
it was made of.  A file that is new, has grown or was rotated has no valid row:
look-backs read it, and ``update_zones`` reads it and nothing else.  So a map
that is behind costs time, never lines.

The names of the files to read are gathered on the driver, as Spark's own
file index gathers those of a folder.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import checks
from ..sinks import versioned as V
from . import text as TX

ZONES = "zones"
IDENTITY = ["file", "size", "modified"]
DATED = [*IDENTITY, "year"]
# Counts a diagnosis asks of all lines ever written.
LOG_PATTERNS = {"agi": checks.AGI_ERROR_PATTERN}


def _identity():
    m = F.col("_metadata")
    return [m["file_path"].alias("file"), m["file_size"].alias("size"), m["file_modification_time"].alias("modified")]


def _listing(spark: SparkSession, logs: str) -> DataFrame:
    """The files there are, (path, file, size, modified); none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(logs)
    return listed.select("path", *_identity())


def _read_paths(listed: DataFrame) -> list[str]:
    """Their paths as a reader takes them, signs of file patterns escaped."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in listed.select("path").collect()]


def log_zones(lines: DataFrame, year: int | None = None, patterns: Mapping[str, str] = LOG_PATTERNS) -> DataFrame:
    """The zone map of ``lines``, a frame of ``spark.read.text``: a row for each of its files.

    ``first_ts`` and ``last_ts`` are null where no line of a file has a stamp;
    lines without one are in no look-back, but their matches count.
    """
    stamp = TX.parse_stamp(F.regexp_extract("value", TX.LOG_RX, 1), year)
    counts = [F.count_if(F.col("value").rlike(rx)).alias(f"n_{name}") for name, rx in patterns.items()]
    rows = lines.select("value", stamp.alias("ts"), *_identity())
    return rows.groupBy(*IDENTITY).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *counts).select(
        *IDENTITY, F.lit(year).cast("int").alias("year"), "first_ts", "last_ts", *[f"n_{name}" for name in patterns])


def _valid(zones: DataFrame, listed: DataFrame, year: int | None) -> DataFrame:
    return zones.where(F.col("year").eqNullSafe(F.lit(year))).join(listed.select(*IDENTITY), IDENTITY, "left_semi")


def update_zones(spark: SparkSession, logs: str, root: str, year: int | None = None,
                 patterns: Mapping[str, str] = LOG_PATTERNS) -> int:
    """Brings the map kept at ``root`` up to date with the files under ``logs``; returns how many were read.

    Rows of files that are gone or have changed go.  A map made with other
    patterns is made anew.
    """
    listed = _listing(spark, logs)
    reader = spark.read.option("recursiveFileLookup", "true")
    names = [f"n_{name}" for name in patterns]
    zones = V.read_committed(spark, root, ZONES) if V.has_table(spark, root, ZONES) else None
    if zones is None or zones.columns[len(DATED) + 2:] != names:
        return V.commit_tables({ZONES: log_zones(reader.text(logs), year, patterns)}, root)[ZONES]
    valid = _valid(zones, listed, year)
    stale = _read_paths(listed.join(valid, IDENTITY, "left_anti"))
    if stale:
        V.commit_tables({ZONES: valid.unionByName(log_zones(spark.read.text(stale), year, patterns))}, root)
    elif valid.count() < zones.count():
        V.commit_tables({ZONES: valid}, root)
    return len(stale)


def files_in_window(spark: SparkSession, logs: str, zones: DataFrame, as_of: str, lookback: str,
                    year: int | None = None) -> DataFrame:
    """The files, (path, file, size, modified), that may hold a line of the look-back: those whose stamps overlap it and those without a valid row."""
    outside = F.col("last_ts").isNull() | (F.col("last_ts") <= X.ago(as_of, lookback)) | (F.col("first_ts") > X.ts_literal(as_of))
    listed = _listing(spark, logs)
    return listed.join(_valid(zones, listed, year).where(outside), IDENTITY, "left_anti")


def read_window(spark: SparkSession, logs: str, zones: DataFrame, as_of: str, lookback: str, host: str | None = None,
                year: int | None = None) -> DataFrame:
    """The lines of ``read_log_lines`` with ``as_of - lookback < ts <= as_of``, from the files that may hold one."""
    paths = _read_paths(files_in_window(spark, logs, zones, as_of, lookback, year))
    if not paths:
        empty = spark.createDataFrame([], "line_no long, host string, line string, line_key struct<file string, block long, pos long>")
        return TX.parse_log_lines(empty, "line", year)
    return TX.read_log_lines(spark, paths, host, year).where(X.within("ts", as_of, lookback))


def find_log_errors(spark: SparkSession, logs: str, root: str, as_of: str, lookback: str = "5 minutes",
                    year: int | None = None) -> DataFrame:
    """``checks.find_log_errors`` over a folder of logs, with the map at ``root`` brought up to date first.

    Dialer errors are looked for in the files of the look-back, AGI errors of
    all time are the sum of the map's counts.
    """
    update_zones(spark, logs, root, year)
    zones = V.read_committed(spark, root, ZONES)
    dialer = read_window(spark, logs, zones, as_of, lookback, year=year).agg(
        F.count_if(F.col("line").rlike(checks.DIALER_ERROR_PATTERN)))
    agi = zones.agg(F.coalesce(F.sum("n_agi"), F.lit(0)))
    return checks.log_error_findings(spark.range(1).select(dialer.scalar().alias("dialer"), agi.scalar().alias("agi")))
