"""URL filters by a temporal list join, in DataFrame operations only.

Lists hold dated entries (an entry is put on a list, or taken off it, on a
day).  They become validity intervals, and every capture is held against the
entries that were active on the day it was fetched.  An entry names a host
with all its subdomains, or a path prefix on one host; a capture is looked up
under its host, the host's parents and its path's prefixes: an equi-join on
the key and a range test on the day.  The most specific active entry decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The host in lower case without port, login and final dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.coalesce(F.regexp_replace(F.lower(bare), r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path without query and fragment, no slash at the end; empty if there is none."""
    path = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)", 1)
    return F.coalesce(F.regexp_replace(path, r"/+$", ""), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """``entries(list, pattern, verdict, listed, day)`` -> ``(list, pattern, verdict, valid_from, valid_to)``.

    ``listed``: put on (true) or taken off the list (false) on ``day``.  On
    one day the last word is the removal.  ``valid_to`` is the day it ends
    (not included), null while it lasts.  Entries with a null in list,
    pattern, listed or day say nothing; repeats change nothing; a null
    verdict blocks.
    """
    said = entries.where("list is not null and pattern is not null and listed is not null and day is not null")
    key = ["list", "pattern"]
    # one state for a day: the history of a pattern is bounded by the calendar, however often it is repeated
    days = said.groupBy(*key, "day").agg(F.min("listed").alias("listed"), F.min(F.coalesce("verdict", F.lit("block"))).alias("verdict"))
    following = F.lead("day").over(Window.partitionBy(*key).orderBy("day"))
    return (days.withColumn("valid_to", following).where("listed")
            .select(*key, "verdict", F.col("day").alias("valid_from"), "valid_to"))


def keys_of(url: Column, depth: int) -> Column:
    """The patterns that may list a URL: its host, the host's parents, and path prefixes of up to ``depth`` parts."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.slice(F.split(F.regexp_replace(path, r"^/+", ""), "/+"), 1, depth)
    prefixes = F.when((F.length(path) > 0) & F.lit(depth > 0), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(parents, prefixes))).otherwise(F.array().cast("array<string>"))


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """``id_col, url, day, verdict, n_active, list, pattern`` for every row of ``captures``.

    ``verdict`` is that of the active entry with the longest pattern (of
    equal ones block before allow, then the first list), ``none`` without
    one.  ``n_active`` counts the active entries that match.  A null URL or
    day, or a URL without host, matches nothing; repeated captures stay.
    """
    spans = validity(entries)
    depth = entries.agg(F.max(F.size(F.split(F.col("pattern"), "/")) - 1)).first()[0] or 0
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(day_col).alias("day"))
    asked = rows.select("url", "day").distinct().withColumn("key", F.explode(keys_of(F.col("url"), max(0, depth))))
    at = spans.select(F.col("pattern").alias("key"), "list", "verdict", "valid_from", "valid_to")
    active = asked.join(at, "key").where((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    order = F.struct((-F.length("key")).alias("a"), (F.col("verdict") != "block").alias("b"), F.col("list").alias("l"), F.col("key").alias("k"),
                     F.col("verdict").alias("v"))
    best = active.groupBy("url", "day").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    best = best.select(F.col("url").alias("_u"), F.col("day").alias("_d"), "best", "n")
    out = rows.join(best, (F.col("url") == F.col("_u")) & (F.col("day") == F.col("_d")), "left")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("day").alias(day_col),
                      F.coalesce("best.v", F.lit("none")).alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_active"),
                      F.col("best.l").alias("list"), F.col("best.k").alias("pattern"))
