"""Sets of tables that change together, and the zone maps kept with them."""

import os

import pytest
from pyspark.sql import functions as F

from switchyard.operators import checks, filters
from switchyard.session import list_names, local_fs_path, scratch_path
from switchyard.sinks import versioned as V
from switchyard.sources import log_zones as LZ
from switchyard.sources import text as TX


def _archive(spark):
    root = scratch_path(spark, "archive-test")
    V.commit_tables({t: spark.range(i + 1).select("id", F.lit(None).cast("decimal(9,2)").alias("cost"),
                                                  F.array(F.lit(t)).alias("tags"))
                     for i, t in enumerate(V.ARCHIVE_TABLES)}, root)
    return root


def _rows(spark, root):
    return [V.read_committed(spark, root, t).count() for t in V.ARCHIVE_TABLES]


def test_all_tables_are_emptied_and_keep_their_schemas(spark):
    root = _archive(spark)
    schemas = [V.read_committed(spark, root, t).schema for t in V.ARCHIVE_TABLES]
    got = {tuple(r) for r in V.truncate_tables(spark, root).collect()}
    assert got == {(t, i + 1, 0) for i, t in enumerate(V.ARCHIVE_TABLES)}
    assert _rows(spark, root) == [0] * 9
    assert [V.read_committed(spark, root, t).schema for t in V.ARCHIVE_TABLES] == schemas
    # the space is free: one folder of each table and one manifest are left
    assert all(len(list_names(spark, f"{root}/{t}")) == 1 for t in V.ARCHIVE_TABLES)
    assert list_names(spark, f"{root}/_manifests") == ["2"]
    assert {r.rows_before for r in V.truncate_tables(spark, root).collect()} == {0}


@pytest.mark.parametrize("dies_at", ["third table", "manifest", "success mark"])
def test_a_crash_empties_none_and_the_next_run_all(spark, monkeypatch, dies_at):
    root = _archive(spark)
    before = _rows(spark, root)
    real, calls = V.StructType.fromJson, []

    def third(schema):
        calls.append(schema)
        if len(calls) == 3:
            raise RuntimeError("planted")
        return real(schema)

    def no_manifest(*args):
        raise RuntimeError("planted")

    def no_mark(session, path, n, tables):
        saved(session, path, n, tables)
        os.remove(local_fs_path(f"{path}/_manifests/{n}/_SUCCESS"))
        raise RuntimeError("planted")

    saved = V._save
    with monkeypatch.context() as m:
        if dies_at == "third table":
            m.setattr(V.StructType, "fromJson", staticmethod(third))
        else:
            m.setattr(V, "_save", no_manifest if dies_at == "manifest" else no_mark)
        with pytest.raises(RuntimeError, match="planted"):
            V.truncate_tables(spark, root)
    assert _rows(spark, root) == before
    V.truncate_tables(spark, root)
    assert _rows(spark, root) == [0] * 9


def test_a_crash_between_two_writes_leaves_all_as_they_were(spark):
    root = _archive(spark)
    before = _rows(spark, root)
    bad = spark.range(1).select(F.raise_error(F.lit("planted")).alias("id"))
    with pytest.raises(Exception, match="planted"):
        V.commit_tables({V.ARCHIVE_TABLES[0]: spark.range(0), V.ARCHIVE_TABLES[1]: bad}, root)
    assert _rows(spark, root) == before


def test_an_unknown_table_changes_nothing(spark):
    root = _archive(spark)
    before = _rows(spark, root)
    with pytest.raises(FileNotFoundError, match="no table other"):
        V.truncate_tables(spark, root, [*V.ARCHIVE_TABLES, "other"])
    assert _rows(spark, root) == before


def test_tables_of_two_commits_and_a_frame_that_reads_what_it_replaces(spark):
    root = scratch_path(spark, "commits")
    V.commit_tables({"a": spark.range(3), "b": spark.range(4)}, root)
    V.commit_tables({"a": V.read_committed(spark, root, "a").where("id > 0")}, root)
    assert V.read_committed(spark, root, "a").count() == 2 and V.read_committed(spark, root, "b").count() == 4
    assert V.drop_old(spark, root) == 2 and V.drop_old(spark, root) == 0
    assert V.read_committed(spark, root, "a").count() == 2 and V.read_committed(spark, root, "b").count() == 4


# --- zone maps

def _day(d, n=5, text="NOTICE[4]: BRIDGE created"):
    return "".join(f"[2024-01-{d:02d} {h:02d}:00:00] {text}\n" for h in range(n))


def _write(folder, name, text):
    os.makedirs(local_fs_path(folder), exist_ok=True)
    with open(f"{local_fs_path(folder)}/{name}", "w") as f:
        f.write(text)


def _logs(spark):
    logs = scratch_path(spark, "logs-test")
    for d in range(1, 11):
        _write(logs, f"full-{d}", _day(d))
    _write(logs, "odd [x]{y}", _day(9, 2, "WARNING[5]: VDAD hopper error"))
    _write(logs, "no-stamps", "starting AGI script, failed to connect\n\n[not a time] X[1]: y\n")
    _write(logs, "empty", "")
    return logs


def _plain(spark, logs, as_of, lookback):
    """The same look-back by a scan of all lines."""
    lines = TX.read_log_lines(spark, logs).where(
        f"ts > timestamp_ntz '{as_of}' - interval {lookback} and ts <= timestamp_ntz '{as_of}'")
    return sorted(r.line for r in lines.collect())


def _read(df):
    return {os.path.basename(f).replace("%20", " ").replace("%7B", "{").replace("%7D", "}").replace("%5B", "[").replace("%5D", "]") for f in df.inputFiles()}


@pytest.mark.parametrize("as_of,lookback,files", [
    ("2024-01-09 03:00:00", "5 hours", {"full-9", "odd [x]{y}"}),
    ("2024-01-09 03:00:00", "1 day", {"full-8", "full-9", "odd [x]{y}"}),
    ("2024-01-05 04:00:00", "5 minutes", {"full-5"}),
    ("2024-01-05 12:00:00", "8 hours", set()),       # the last stamp of the day is at the open end
    ("2024-01-05 00:00:00", "1 second", {"full-5"}),  # the first stamp is at the closed end
    ("2030-01-01 00:00:00", "5 minutes", set()),
])
def test_look_back_reads_only_the_files_that_overlap(spark, as_of, lookback, files):
    logs, root = _logs(spark), scratch_path(spark, "zones-test")
    assert LZ.update_zones(spark, logs, root) == 12  # Spark lists no empty file
    got = LZ.read_window(spark, logs, V.read_committed(spark, root, LZ.ZONES), as_of, lookback)
    assert _read(got) == files
    assert sorted(r.line for r in got.collect()) == _plain(spark, logs, as_of, lookback)


def test_files_that_grew_or_came_or_went_since_the_map(spark):
    logs, root = _logs(spark), scratch_path(spark, "zones-test")
    LZ.update_zones(spark, logs, root)
    zones = V.read_committed(spark, root, LZ.ZONES)
    late = "[2024-01-20 01:00:00] ERROR[1]: AGI script failed to connect\n"
    with open(f"{local_fs_path(logs)}/full-2", "a") as f:
        f.write(late)
    _write(logs, "full-20", _day(20, 1))
    _write(logs, "full-3", "")
    as_of = "2024-01-20 02:00:00"
    # the map is behind: what it does not know is read
    behind = LZ.read_window(spark, logs, zones, as_of, "3 hours")
    assert _read(behind) == {"full-2", "full-20"}
    assert sorted(r.line for r in behind.collect()) == _plain(spark, logs, as_of, "3 hours") and behind.count() == 2
    # an update reads these two alone, and then nothing
    assert LZ.update_zones(spark, logs, root) == 2
    assert LZ.update_zones(spark, logs, root) == 0
    zones = V.read_committed(spark, root, LZ.ZONES)
    assert zones.count() == 12 and zones.agg(F.sum("n_agi")).first()[0] == 2
    # the grown file now spans the whole time
    assert _read(LZ.read_window(spark, logs, zones, "2024-01-10 02:00:00", "3 hours")) == {"full-2", "full-10"}


def test_a_map_of_another_year_or_other_patterns_is_not_trusted(spark):
    logs, root = scratch_path(spark, "logs-test"), scratch_path(spark, "zones-test")
    _write(logs, "full", "[Jan  5 10:00:00] NOTICE[1]: x\n[Jan 25 10:00:00] NOTICE[1]: y\n")
    _write(logs, "messages", "[Feb 10 10:00:00] NOTICE[1]: z\n")
    assert LZ.update_zones(spark, logs, root, year=2024) == 2
    zones = V.read_committed(spark, root, LZ.ZONES)
    as_of = "2024-01-05 10:30:00"
    assert _read(LZ.read_window(spark, logs, zones, as_of, "1 hour", year=2024)) == {"full"}
    assert _read(LZ.read_window(spark, logs, zones, as_of, "1 hour", year=2023)) == {"full", "messages"}
    assert LZ.update_zones(spark, logs, root, year=2023) == 2
    assert LZ.update_zones(spark, logs, root, 2023, {"y": "y$"}) == 2
    assert V.read_committed(spark, root, LZ.ZONES).agg(F.sum("n_y")).first()[0] == 1


def test_log_errors_of_a_folder_equal_those_of_its_lines(spark):
    logs, root = _logs(spark), scratch_path(spark, "zones-test")
    for as_of in ("2024-01-09 01:30:00", "2024-01-07 01:30:00"):
        want = checks.find_log_errors(TX.read_log_lines(spark, logs), as_of, "2 hours").collect()
        assert sorted(LZ.find_log_errors(spark, logs, root, as_of, "2 hours").collect()) == sorted(want) and want


def test_a_label_table_that_repeats_a_code_multiplies_no_row(spark):
    labels = spark.createDataFrame([("call", "A", "zeta", "info"), ("call", "A", "alpha", "warn"), ("call", None, "x", "y")],
                                   filters.STATUS_LABEL_SCHEMA)
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id int, status string")
    got = {(r.id, r.label, r.severity) for r in filters.label_status(rows, "call", labels=labels).collect()}
    assert got == {(1, "alpha", "warn"), (2, "other", "info"), (3, "other", "info")}
