"""Dump text in every form: headers, tuple lines over split borders, several tables, broken lines."""

import random
import re

import pytest

from switchyard.session import scratch_path
from switchyard.sources import sql_dump as SD

SCHEMA = "a int, b string, c int"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def frame(spark, text):
    return spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1)


def outcome(entries):
    rows = sorted(map(tuple, SD.rows_of(entries).collect()), key=str)
    rejects = sorted(map(tuple, SD.rejects_of(entries).collect()), key=str)
    assert tuple(SD.tally_of(entries).first()) == (len(rows), sum(r[1] == "fields" for r in rejects), sum(r[1] != "fields" for r in rejects))
    return rows, rejects


TWO_TABLES = """-- a dump
DROP TABLE IF EXISTS `t`;
CREATE TABLE `t` (
  `a` int NOT NULL,
  KEY `k` (`b`)
) ENGINE=InnoDB;
/*!40000 ALTER TABLE `t` DISABLE KEYS */;
INSERT INTO `t` VALUES
(1,'x),(;',10),
(2,'it''s',20);
insert ignore into `db`.`u` (`c`, a) Values
  (5, 50),
  (6, 60)
;
replace into t values (3,'c',30),
(4,NULL,40),
(7,'cut
(8,'h',80);
(9,'lost',90);
REPLACE LOW_PRIORITY t (b, a) VALUES ('only', 11);
LOCK TABLES `t` WRITE;
what is this
INSERT INTO t VALUES (12,'short');
INSERT INTO t
VALUES (13,'m',130);"""


def test_tuple_lines_belong_to_the_statement_before(spark):
    lines = frame(spark, TWO_TABLES)
    rows, rejects = outcome(SD.dump_entries(lines, SCHEMA, table="t"))
    assert rows == sorted([(1, "x),(;", 10), (2, "it's", 20), (3, "c", 30), (4, None, 40), (8, "h", 80), (11, "only", None), (13, "m", 130)], key=str)
    assert rejects == sorted([("t", "not a tuple", "( 7,'cut"), (None, "no header", "(9,'lost',90);"), (None, "no header", "what is this"),
                              ("t", "fields", "(12,'short')")], key=str)
    rows, rejects = outcome(SD.dump_entries(lines, SCHEMA, table="u"))
    assert rows == [(50, None, 5), (60, None, 6)] and {r[1] for r in rejects} == {"no header"}
    rows, _ = outcome(SD.dump_entries(lines, SCHEMA))
    assert len(rows) == 9
    assert outcome(SD.dump_entries(lines.limit(0), SCHEMA)) == ([], [])


def plain_reader(text, table):
    """The same rules line by line."""
    state, rows, rejects = None, 0, 0
    for line in text.split("\n"):
        if not line.strip() or line.startswith("--"):
            continue
        head = re.match(r"(?i)\s*(insert into|replace into)\s+`?(\w+)`?\s*values\s*", line)
        if head:
            state, body = head.group(2), line[head.end():]
        elif re.match(r"(?i)(create|drop)\b", line):
            state, body = "-other", ""
        else:
            body = line
        own = state
        if line.rstrip().endswith(";") and (not body.lstrip().startswith("(") or line.rstrip().endswith(");")):
            state = None
        if own == "-other":
            continue
        if own is None:
            rejects += bool(body.strip(" ;"))
            continue
        if own != table:
            continue
        tuples = re.findall(r"\((?:[^'()]|'(?:[^'\\]|\\.|'')*')*\)", body)
        rest = re.sub(r"\((?:[^'()]|'(?:[^'\\]|\\.|'')*')*\)", "", body)
        good = sum(len(re.findall(r"'(?:[^'\\]|\\.|'')*'|[^,']+", t[1:-1])) == 3 for t in tuples)
        rows += good
        rejects += len(tuples) - good + bool(rest.strip(" ,;"))
    return rows, rejects


@pytest.mark.parametrize("seed", range(4))
def test_rows_and_rejects_add_up_over_split_borders(spark, small_splits, seed):
    rng = random.Random(seed)
    path = scratch_path(spark, "dump")
    want_rows = want_rejects = 0
    for file in range(3):
        out = []
        for _ in range(40):
            kind = rng.random()
            name = rng.choice(["t", "u"])
            tuples = [rng.choice([f"({rng.randrange(100)},'v{rng.randrange(9)}',{rng.randrange(9)})", "(1,'a;b),(',2)", "(1,'short')", "(NULL,NULL,NULL)"])
                      for _ in range(rng.randint(1, 8))]
            verb = rng.choice(["INSERT INTO", "insert into", "Replace Into"])
            if kind < 0.4:
                out.append(f"{verb} `{name}` VALUES " + ",".join(tuples) + ";")
            elif kind < 0.8:
                out.append(f"{verb} {name} values")
                out += [t + "," for t in tuples[:-1]] + [tuples[-1] + rng.choice([";", ""])]
            elif kind < 0.85:
                out.append(f"{verb} `{name}` VALUES (1,'cut")
            elif kind < 0.9:
                out += ["CREATE TABLE x (", "  a int,", "  b int", ");"]
            elif kind < 0.95:
                out.append("(7,'where am I',7);")
            else:
                out += ["", "-- comment", "junk"]
        text = "\n".join(out)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(path)
        rows, rejects = plain_reader(text, "t")
        want_rows, want_rejects = want_rows + rows, want_rejects + rejects
    entries = SD.dump_entries(SD.file_lines(spark, path), SCHEMA, "value", "t", "at")
    assert SD.file_lines(spark, path).select("at.file", "at.block").distinct().count() > 6
    rows, rejects = outcome(entries)
    assert (len(rows), len(rejects)) == (want_rows, want_rejects)
    loaded = SD.load_dump(spark, path, SCHEMA, scratch_path(spark, "loaded"), "t")
    assert outcome(loaded) == (rows, rejects)


def test_places_follow_the_file(spark, small_splits):
    path = scratch_path(spark, "dump")
    body = ",\n".join(f"({i},'v',{i})" for i in range(200))
    spark.createDataFrame([(f"INSERT INTO t VALUES\n{body};",)], "value string").write.text(path)
    got = SD.read_sql_dump(spark, path, SCHEMA, "t", order="at").orderBy("at").collect()
    assert [r["a"] for r in got] == list(range(200))


def test_one_line_statements_ship_no_text(spark):
    path = scratch_path(spark, "dump")
    spark.createDataFrame([("INSERT INTO t VALUES (1,'a',1);",)] * 5, "value string").write.text(path)
    marked = SD._marked(SD.file_lines(spark, path), "value", "at")
    assert marked.where("kind <> 'header'").count() == 0
    assert SD.read_sql_dump(spark, path, SCHEMA, "t").count() == 5


def test_written_in_both_forms_the_rows_come_back(spark):
    df = spark.createDataFrame([(i, [None, "x;", "a\nb", "')", "),("][i % 5], i % 3) for i in range(60)], "a int, b string, c int")
    path = scratch_path(spark, "dump")
    SD.dump_lines(df, "t", 7, "a", tuple_lines=True, verb="REPLACE INTO").unionByName(SD.dump_lines(df, "u", 7, "a")).write.text(path)
    for table in "tu":
        got = SD.read_sql_dump(spark, path, SCHEMA, table).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, df.collect()))
