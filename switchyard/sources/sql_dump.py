"""Rows from dump text (SURVEY src_sql_dump).

``INSERT`` and ``REPLACE`` statements are read whether a statement is one
line or a header with its tuples on the lines after it, in any letter case,
for one table of a file or all, with or without a column list.  Which
statement a tuple line belongs to is found by a segmented scan over the order
of the file: each split's last change of state, carried over the file's
splits, then each line's last change inside its split.  Lines with a header
need no scan and are parsed where they are read; only the others' text is
sorted by split.

Tuples and fields are cut with possessive regexes (no backtracking stack on
megabyte lines), quoted fields are unescaped by a left-to-right token scan
(``transform`` over ``regexp_extract_all``), and fields are cast to the
declared schema, all with native expressions.  Quotes, ``\\'``, ``''``,
``),(`` and parentheses inside strings are handled; NULL is NULL.

Nothing is lost unseen: ``dump_entries`` returns every tuple and every text
in a tuple's place, with the reason why it is no row.  Blank lines, comments
and other statements (as a CREATE TABLE of many lines) are no entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Regex texts (Java syntax).  TUPLE: a parenthesised tuple whose quoted
# strings may hold any character; FIELD: one quoted string or bare token.
TUPLE_RX = r"\((?:[^'()]++|'(?:[^'\\]++|\\.|'')*+')*+\)"
FIELD_RX = r"(?:_[A-Za-z0-9]++\s*+)?'(?:[^'\\]++|\\.|'')*+'|[^,'\s][^,']*+"
TOKEN_RX = r"\\.|''|[^'\\]++"

# MySQL escape letters and what they stand for.
ESCAPES = {"0": "\u0000", "n": "\n", "r": "\r", "t": "\t", "b": "\b", "Z": "\u001a"}


def _unescape_token(t: Column) -> Column:
    out = F.when(t == "''", F.lit("'"))
    for k, v in ESCAPES.items():
        out = out.when(t == "\\" + k, F.lit(v))
    out = out.when(F.startswith(t, F.lit("\\")), F.substring(t, 2, 1))
    return out.otherwise(t)


def unquote(field: Column) -> Column:
    """SQL field text to its value: NULL, an unescaped string, or the bare token."""
    # a character-set introducer (_binary 'x') only tells how to read the string
    field = F.regexp_replace(field, r"^_[A-Za-z0-9]++\s*+(?=')", "")
    inner = F.substring(field, F.lit(2), F.length(field) - 2)
    tokens = F.regexp_extract_all(inner, F.lit(TOKEN_RX), 0)
    text = F.array_join(F.transform(tokens, _unescape_token), "")
    bare = F.trim(field)
    return F.when(F.startswith(field, F.lit("'")), text).when(F.upper(bare) == "NULL", F.lit(None)).otherwise(bare)


PIECE_RX = TUPLE_RX + r"|[^\s,;(][^(]*+|\("  # a tuple, or text in its place
NAME_RX = r"(?:`[^`]++`|[\w$]++)"
HEADER_RX = (r"(?is)^\s*+(?:INSERT|REPLACE)\s++(?:(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY|IGNORE)\s++)*+(?:INTO\s++)?+"
             r"(?:" + NAME_RX + r"\s*+[.]\s*+)?(" + NAME_RX + r")\s*+(\([^()]*+\)\s*+(?=VALUES?\b|$))?+(?:VALUES?\b\s*+)?+")
COMMENT_RX = r"^\s*+(?:$|--|#|/\*)"
# First words of statements that hold no rows.
STATEMENT_RX = (r"(?i)^\s*+(?:ALTER|ANALYZE|BEGIN|CALL|COMMIT|CREATE|DELETE|DELIMITER|DROP|FLUSH|GRANT|LOCK|REVOKE|ROLLBACK|"
                r"SELECT|SET|SHOW|START|TRUNCATE|UNLOCK|UPDATE|USE|WITH)\b")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files at ``path`` with their place ``at``: file, split, line in the split."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", place.alias("at"))


def _marked(lines: DataFrame, line_col: str, at: str | None) -> DataFrame:
    """Lines as ``at``, ``text``, ``kind`` and ``event``: the state of the file after the line, null if unchanged.

    A state is the open statement: ``insert`` with its table and columns,
    ``other``, or ``none``.
    """
    # a frame without places is one file, its partitions the splits
    place = F.col(at) if at else F.struct(F.lit("").alias("file"), F.spark_partition_id().cast("long").alias("block"),
                                          F.monotonically_increasing_id().alias("line"))
    line = F.col(line_col)
    found = lines.select(place.alias("at"), line.alias("text"), F.regexp_extract(line, HEADER_RX, 0).alias("head"),
                         F.rtrim(F.regexp_replace(F.right(line, F.lit(64)), r"\s++$", "")).alias("tail")).where("text is not null")
    kind = (F.when(F.col("head") != "", "header").when(F.col("text").rlike(COMMENT_RX), "comment")
            .when(F.col("text").rlike(STATEMENT_RX), "statement").otherwise("more"))
    found = found.withColumn("kind", kind)
    names = F.regexp_extract("head", HEADER_RX, 2)
    columns = F.when(names != "", F.transform(F.regexp_extract_all(names, F.lit(NAME_RX), 0), lambda n: F.lower(F.replace(n, F.lit("`")))))
    header = F.struct(F.lit("insert").alias("state"), F.replace(F.regexp_extract("head", HEADER_RX, 1), F.lit("`")).alias("table"), columns.alias("columns"))

    def state(name: str) -> Column:
        return F.struct(F.lit(name).alias("state"), F.lit(None).cast("string").alias("table"), F.lit(None).cast("array<string>").alias("columns"))

    rest = F.when(F.col("kind") == "header", F.substr("text", F.length("head") + 1)).otherwise(F.col("text"))
    # a semicolon ends the statement, after a tuple only behind its parenthesis (a line may be cut off inside a string)
    closed = F.col("tail").endswith(";") & (~rest.rlike(r"^\s*+\(") | F.col("tail").rlike(r"\)\s*+;$"))
    event = (F.when(F.col("kind") == "comment", None).when(closed, state("none"))
             .when(F.col("kind") == "header", header).when(F.col("kind") == "statement", state("other")))
    own = F.when(F.col("kind") == "header", header)
    return found.select("at", "kind", event.alias("event"), own.alias("own"), rest.alias("text"))


def _attributed(lines: DataFrame, line_col: str, at: str | None) -> DataFrame:
    """Lines that may hold tuples, as ``at``, ``text`` and the statement ``own`` they belong to."""
    marked = _marked(lines, line_col, at)
    headers = marked.where("kind = 'header'").select("at", "text", "own")
    # every split's last state, and what each split begins with: the last state of the splits before it
    split = [F.col("at.file").alias("file"), F.col("at.block").alias("block")]
    last = F.max_by("event", F.when(F.col("event").isNotNull(), F.col("at.line")))
    splits = marked.groupBy(*split).agg(last.alias("event"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = splits.select("file", "block", F.last("event", ignorenulls=True).over(before).alias("begun"))
    # the other lines: their last state inside the split, else what it began with; of header lines only the state is sent
    more = F.col("kind") == "more"
    sent = marked.where(more | F.col("event").isNotNull()).select(*split, "at", "event", F.when(more, F.col("text")).alias("text"))
    inside = Window.partitionBy("file", "block").orderBy("at.line").rowsBetween(Window.unboundedPreceding, -1)
    scanned = sent.select("file", "block", "at", "text", F.last("event", ignorenulls=True).over(inside).alias("inside")).where("text is not null")
    found = scanned.join(begun, ["file", "block"], "left").select("at", "text", F.coalesce("inside", "begun").alias("own"))
    state = F.coalesce("own.state", F.lit("none"))
    return headers.unionByName(found.where((state == "insert") | (state == "none") & ~F.col("text").rlike(r"^[\s;]*+$")))


def dump_entries(lines: DataFrame, schema: StructType | str, line_col: str = "value", table: str | None = None, at: str | None = None) -> DataFrame:
    """Every entry of the dump: ``at`` (line and place in it), ``table``, ``reason``, ``text`` and the fields of ``schema``.

    ``reason`` is null for rows.  Else the text is no row: ``fields`` (a tuple
    with another number of fields than its columns), ``not a tuple`` (other
    text in a statement's tuples, one entry a line: a truncated tuple, for
    example) or ``no header`` (a line outside every statement).  With
    ``table``, entries of other tables are left out; lines without a header
    may be its own and stay.  A header's column list names the fields; columns
    that it leaves out are NULL, without a list the fields follow ``schema``.

    ``at`` names a column of places as ``file_lines`` gives it; without one
    the order of the frame's partitions and rows counts, which must be the
    same each time the frame is computed if it has tuple lines.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = _attributed(lines, line_col, at)
    inserted = F.coalesce(F.col("own.state") == "insert", F.lit(False))
    if table is not None:
        found = found.where(~inserted | (F.col("own.table") == table))
    text = F.regexp_replace("text", r"(?i)^\s*+VALUES?\b", "")
    pieces = found.withColumn("pieces", F.when(inserted, F.regexp_extract_all(text, F.lit(PIECE_RX), 0)))

    def is_tuple(p: Column) -> Column:
        return F.startswith(p, F.lit("(")) & (F.length(p) > 1)

    tuples = F.transform(F.filter("pieces", is_tuple), lambda p: F.struct(F.lit(None).cast("string").alias("reason"), p.alias("text")))
    rest = F.array_join(F.filter("pieces", lambda p: ~is_tuple(p)), " ")
    left = F.when(F.trim(rest) != "", F.array(F.struct(F.lit("not a tuple").alias("reason"), rest.alias("text"))))
    outside = F.array(F.struct(F.lit("no header").alias("reason"), F.col("text")))
    entries = F.when(inserted, F.concat(tuples, F.coalesce(left, F.slice(tuples, 1, 0)))).otherwise(outside)
    each = pieces.select("at", F.col("own.table").alias("table"), F.col("own.columns").alias("columns"), F.posexplode(entries).alias("place", "entry"))
    fields = _fields(F.col("entry.text"))
    each = each.select("at", "place", "table", "columns", F.col("entry.reason").alias("reason"), F.col("entry.text").alias("text"), fields.alias("cut"))
    named = F.transform(F.array(*[F.lit(f.name.lower()) for f in schema.fields]),
                        lambda n: F.get("cut", (F.array_position("columns", n) - 1).cast("int")))
    wanted = F.coalesce(F.size("columns"), F.lit(-1))
    wanted = F.when(wanted >= 0, wanted).otherwise(len(schema.fields))
    reason = F.coalesce("reason", F.when(F.size("cut") != wanted, "fields"))
    each = each.select("at", "place", "table", reason.alias("reason"), "text",
                       F.when(F.col("columns").isNull(), F.col("cut")).otherwise(named).alias("cut"))
    # try_cast: a value the type cannot hold (e.g. a zero date) becomes NULL
    # instead of failing the whole import under ANSI mode
    values = [F.when(F.col("reason").isNull(), unquote(F.get("cut", F.lit(i))).try_cast(f.dataType)).alias(f.name) for i, f in enumerate(schema.fields)]
    return each.select(F.struct(F.col("at").alias("line"), "place").alias("_at"), F.col("table").alias("_table"), F.col("reason").alias("_reason"),
                       F.col("text").alias("_text"), *values)


def rows_of(entries: DataFrame, order: str | None = None) -> DataFrame:
    """The typed rows among ``dump_entries``; ``order`` keeps their places in a column of that name."""
    fields = [c for c in entries.columns if c not in ("_at", "_table", "_reason", "_text")]
    return entries.where("_reason is null").select(*fields, *([F.col("_at").alias(order)] if order else []))


def rejects_of(entries: DataFrame) -> DataFrame:
    """``(table, reason, text)`` of every entry that is no row."""
    return entries.where("_reason is not null").select(F.col("_table").alias("table"), F.col("_reason").alias("reason"), F.col("_text").alias("text"))


def tally_of(entries: DataFrame) -> DataFrame:
    """One row: ``rows``, ``rejected_tuples`` and ``rejected_lines`` of ``dump_entries``."""
    reason = F.col("_reason")
    return entries.agg(F.count_if(reason.isNull()).alias("rows"), F.count_if(reason.eqNullSafe("fields")).alias("rejected_tuples"),
                       F.count_if(reason.isNotNull() & (reason != "fields")).alias("rejected_lines"))


def dump_tally(lines: DataFrame, schema: StructType | str, line_col: str = "value", table: str | None = None) -> DataFrame:
    """``tally_of`` the entries of a frame of lines."""
    return tally_of(dump_entries(lines, schema, line_col, table))


def dump_rejects(lines: DataFrame, schema: StructType | str, line_col: str = "value", table: str | None = None) -> DataFrame:
    """``rejects_of`` the entries of a frame of lines."""
    return rejects_of(dump_entries(lines, schema, line_col, table))


def parse_dump_lines(lines: DataFrame, schema: StructType | str, line_col: str = "value", table: str | None = None) -> DataFrame:
    """``rows_of`` the entries of a frame of lines."""
    return rows_of(dump_entries(lines, schema, line_col, table))


def read_sql_dump(spark: SparkSession, path: str, schema: StructType | str, table: str | None = None,
                  order: str | None = None) -> DataFrame:
    """Typed rows from dump files at ``path``.

    ``order`` adds a column of that name with the place of each row (file,
    split, line, tuple in the line), so that a merge can tell which of two
    rows of one key came first.
    """
    return rows_of(dump_entries(file_lines(spark, path), schema, "value", table, "at"), order)


def load_dump(spark: SparkSession, path: str, schema: StructType | str, out: str, table: str | None = None) -> DataFrame:
    """The entries of dump files, parsed once into the Parquet folder ``out`` and read from there.

    ``rows_of``, ``rejects_of`` and ``tally_of`` then read columns of it only.
    """
    dump_entries(file_lines(spark, path), schema, "value", table, "at").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def _fields(tuple_text: Column) -> Column:
    inner = F.substring(tuple_text, F.lit(2), F.length(tuple_text) - 2)
    return F.regexp_extract_all(inner, F.lit(FIELD_RX), 0)


def quote_sql(c: Column) -> Column:
    """A value as dump text: NULL, a bare number, or an escaped quoted string."""
    s = c.cast("string")
    esc = F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), "'", r"\\'")
    esc = F.regexp_replace(F.regexp_replace(esc, "\n", r"\\n"), "\r", r"\\r")
    return esc


def dump_lines(df: DataFrame, table: str, rows_per_line: int, order_col: str,
               quoted: set[str] | None = None, verb: str = "INSERT INTO", tuple_lines: bool = False) -> DataFrame:
    """Dump text for ``df``: one statement per block of ``rows_per_line``
    consecutive ``order_col`` values (a bounded group per statement), on one
    line, or with ``tuple_lines`` a header line and a line for each tuple."""
    quoted = quoted or {f.name for f in df.schema.fields if f.dataType.simpleString().startswith(("string", "timestamp", "date"))}
    parts = []
    for f in df.schema.fields:
        c = F.col(f.name)
        v = F.concat(F.lit("'"), quote_sql(c), F.lit("'")) if f.name in quoted else c.cast("string")
        parts.append(F.coalesce(v, F.lit("NULL")))
    tup = F.concat(F.lit("("), F.concat_ws(",", *parts), F.lit(")"))
    block = F.floor(F.col(order_col) / rows_per_line)
    # tuples in key order inside each statement: the same table gives the same bytes
    between = ",\\n" if tuple_lines else ","
    grouped = df.select(block.alias("_blk"), F.col(order_col).alias("_ord"), tup.alias("_tup")).groupBy("_blk").agg(
        F.expr(f"listagg(_tup, '{between}') within group (order by _ord)").alias("_vals"))
    head = f"{verb} `{table}` VALUES" + ("\n" if tuple_lines else " ")
    return grouped.select(F.concat(F.lit(head), F.col("_vals"), F.lit(";")).alias("value"))
