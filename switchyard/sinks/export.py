"""Writers.

Writes are plain DataFrame writes from the executors into a shared folder;
nothing is funnelled through the driver.  CSV output is properly quoted
(SURVEY Q6).  Every writer returns what it wrote as a DataFrame read back
from storage, so callers can verify counts without trusting the writer.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from ..operators.aggregates import LOG_DIRS
from ..operators.setops import union_all

CSV_WRITE_OPTIONS = {"header": "true", "escape": '"', "nullValue": "", "emptyValue": '""'}
# multiLine: quoted values may hold newlines; each written part file is one read task.
CSV_READ_OPTIONS = {"header": "true", "escape": '"', "nullValue": "\u0000", "multiLine": "true"}


def export_leads_csv(leads: DataFrame, path: str, single_file: bool = False) -> DataFrame:
    """Leads as CSV: 13 fixed columns, NULL -> '' / 0, ordered by list.

    Written by many tasks as a sorted, range-partitioned CSV folder (part
    files in list order); ``single_file`` coalesces to one file for small
    exports.  Returns the data rows read back (the header is not a row).
    """
    # (list_id, lead_id) is a total order, so range partitioning can split a
    # list holding a large share of all leads over many tasks
    keys = ["list_id", "lead_id"] if "lead_id" in leads.columns else ["list_id"]
    out = filters.project_leads(leads.orderBy(*keys))
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(**CSV_WRITE_OPTIONS).csv(path)
    return read_leads_csv(leads.sparkSession, path)


def read_leads_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} {'bigint' if c == 'list_id' else 'int' if c == 'called_count' else 'string'}"
                       for c in filters.LEAD_EXPORT_COLUMNS)
    return spark.read.options(**CSV_READ_OPTIONS).schema(schema).csv(path)


def export_package(tables: Mapping[str, DataFrame], out: str, where: Mapping[str, str] | None = None,
                   required: tuple[str, ...] = ("lists", "leads"), fmt: str = "parquet",
                   by: Mapping[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """Write each table (optional WHERE) under ``out/<table>``, the required ones first.

    ``by`` names for a table a column whose values get a folder each and the
    order of the rows in it, so that equal tables give equal bytes.  Row
    counts are observed by the write itself: nothing is read again, and a
    required table that turns out empty stops the export.  Returns
    (table_name, row_count).
    """
    spark = next(iter(tables.values())).sparkSession
    where, by = where or {}, by or {}
    counts = {}
    for name in sorted(tables, key=lambda n: n not in required):
        df = tables[name].where(where[name]) if name in where else tables[name]
        if name in by:
            column, order = by[name]
            df = df.repartition(column).sortWithinPartitions(column, *order)
        seen = Observation()
        # observed in the writing stage, where each task's count is taken once however often it is retried
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        if name in by:
            writer = writer.partitionBy(by[name][0])
        writer.format(fmt).save(f"{out}/{name}")
        counts[name] = seen.get["rows"]
        if name in required and not counts[name]:
            raise ValueError(f"required table {name} is empty")
    return spark.createDataFrame([(name, counts[name]) for name in tables], "table_name string, row_count long")


def package_manifest(lists: DataFrame, leads: DataFrame, alt: DataFrame | None = None) -> DataFrame:
    """One row per list (id, name, campaign, active, lead_count) with the
    package totals as scalar-subquery columns (no join with 1-row frames)."""
    per = leads.groupBy("list_id").agg(F.count("lead_id").alias("_n"))
    rows = lists.join(per, "list_id", "left").select(
        "list_id", "list_name", "campaign_id", "active", F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("lead_count"))
    total_lists = lists.select(F.count(F.lit(1))).scalar()
    total_leads = leads.select(F.count(F.lit(1))).scalar()
    cols = [total_lists.alias("total_lists"), total_leads.alias("total_leads")]
    if alt is not None:
        cols.append(alt.select(F.count(F.lit(1))).scalar().alias("total_alt"))
    return rows.select("*", *cols)


def write_chunked(df: DataFrame, path: str, rows: int = 10000, fmt: str = "parquet") -> DataFrame:
    """Write with at most ``rows`` rows per file; returns rows per file read back."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).format(fmt).save(path)
    back = df.sparkSession.read.format(fmt).load(path)
    return back


def chunk_sizes(df: DataFrame) -> DataFrame:
    """Rows per written file of a read-back frame."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def write_findings(findings: DataFrame, path: str) -> DataFrame:
    """Findings as JSON partitioned by side; returns totals per side read back."""
    findings.write.mode("overwrite").partitionBy("side").json(path)
    back = findings.sparkSession.read.schema(
        "check string, entity string, measure double, message string, side string").json(path)
    return back.groupBy("side").agg(F.count(F.lit(1)).alias("findings"))


def append_audit(row: DataFrame, path: str) -> DataFrame:
    """Append audit rows (one per run); returns the whole log read back."""
    row.write.mode("append").parquet(path)
    return row.sparkSession.read.parquet(path)


def cleanup_audit_row(files: DataFrame, as_of: str | None = None, threshold_mb: int = 500) -> DataFrame:
    """The audit row of a cleanup run: time, total size, action taken."""
    roots = list(LOG_DIRS)
    under = F.lit(False)
    for r in roots:
        under = under | F.col("path").startswith(r + "/")
    total = files.where(under).select(F.coalesce(F.sum("length"), F.lit(0)).cast("long")).scalar()
    kb100 = (total * 100 - (total * 100) % 1024) / 1024
    mb100 = ((kb100 - kb100 % 1024) / 1024).cast("long")
    ts = F.lit(as_of or _dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    # one row per run even when no file is under the log roots
    return files.sparkSession.range(1).select(
        ts.alias("run_ts"), total.alias("total_bytes"), (mb100 / 100).alias("total_mb"),
        F.when(total > threshold_mb * 1024 * 1024, "Deleted file logs and truncated archives")
        .otherwise("Truncated archives only (file logs under threshold)").alias("action"))


def truncate_table(spark: SparkSession, path: str) -> DataFrame:
    """Empty the table stored at ``path``, keeping its schema; one row with
    ``rows_before`` and ``rows_after``."""
    table = spark.read.parquet(path)
    before = table.count()
    spark.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).agg(F.lit(before).cast("long").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))
