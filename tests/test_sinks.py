"""Sinks and file sources checked against brute force on small fixtures."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from paths import SF0001
from switchyard.plans.fixtures import Fixture
from switchyard.session import local_fs_path, scratch_path
from switchyard.sinks import blocks as BL
from switchyard.sinks import checksums as CK
from switchyard.sinks import export as EX
from switchyard.sources import files as FI


def _files_under(path):
    out = {}
    for root, _, names in os.walk(local_fs_path(path)):
        for n in names:
            p = os.path.join(root, n)
            out[p] = p
    return out


def test_package_checksums_match_hashlib(spark):
    fx = Fixture(spark, SF0001)
    out = scratch_path(spark, "pkg-test")
    counts = {r.table_name: r.row_count for r in
              EX.export_package({"lists": fx.lists, "leads": fx.leads, "alt_phones": fx.alt_phones}, out).collect()}
    assert counts == {"lists": fx.lists.count(), "leads": fx.leads.count(), "alt_phones": fx.alt_phones.count()}
    got = {r.file: r.sha256 for r in CK.package_checksums(spark, out, glob="*.parquet").collect()}
    want = {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in _files_under(out) if p.endswith(".parquet")}
    assert got == want
    tampered = spark.createDataFrame([(f, "0" * 64 if i == 0 else h) for i, (f, h) in enumerate(sorted(want.items()))],
                                     "file string, sha256 string")
    status = {r.status for r in CK.verify_checksums(CK.package_checksums(spark, out, glob="*.parquet"), tampered).collect()}
    assert status == {"match", "mismatch"}


def test_required_table_must_not_be_empty(spark):
    fx = Fixture(spark, SF0001)
    try:
        EX.export_package({"lists": fx.lists.limit(0), "leads": fx.leads}, scratch_path(spark, "pkg-empty"))
    except ValueError as e:
        assert "lists" in str(e)
    else:
        raise AssertionError("empty required table accepted")


def test_table_digest_is_order_free(spark):
    fx = Fixture(spark, SF0001)
    a = CK.table_digest(fx.leads).first()
    b = CK.table_digest(fx.leads.repartition(7).orderBy(F.rand(3))).first()
    c = CK.table_digest(fx.leads.where("lead_id % 2 = 0")).first()
    assert a == b and a != c


def test_chunked_write_bounds_files(spark):
    fx = Fixture(spark, SF0001)
    back = EX.write_chunked(fx.leads, scratch_path(spark, "chunks"), rows=100)
    sizes = [r.rows for r in EX.chunk_sizes(back).collect()]
    assert max(sizes) <= 100 and sum(sizes) == fx.leads.count()


def test_file_inventory_matches_walk(spark):
    got = {r.path: r.length for r in FI.file_inventory(spark, [SF0001]).collect()}
    want = {p: os.path.getsize(p) for p in _files_under(SF0001)}
    assert got == want


def test_audit_appends_and_truncate_keeps_schema(spark):
    fx = Fixture(spark, SF0001)
    path = scratch_path(spark, "audit-test")
    row = EX.cleanup_audit_row(fx.files, "1998-06-01 00:00:00")
    EX.append_audit(row, path)
    assert EX.append_audit(row, path).count() == 2
    tpath = scratch_path(spark, "trunc-test")
    fx.call_log.write.parquet(tpath)
    before = fx.call_log.count()
    assert tuple(EX.truncate_table(spark, tpath).first()) == (before, 0)
    assert spark.read.parquet(tpath).dtypes == fx.call_log.dtypes


def _planted(root, files):
    for name, data in files.items():
        path = os.path.join(local_fs_path(root), name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


def test_block_tree_matches_hashlib_and_names_planted_edits(spark, monkeypatch):
    monkeypatch.setattr(BL, "FAN", 3)     # several levels over few blocks
    rng = random.Random(5)
    old = {"a/x.bin": rng.randbytes(1000), "a/y z.bin": rng.randbytes(640), "b/empty": b"", "b/same": rng.randbytes(77), "b/gone": b"g", "c/short": rng.randbytes(100)}
    new = dict(old)
    del new["b/gone"]
    new["b/new"] = b"n"
    new["a/x.bin"] = old["a/x.bin"][:130] + b"!" + old["a/x.bin"][131:700] + b"?" + old["a/x.bin"][701:]   # blocks 2 and 10
    new["a/y z.bin"] = old["a/y z.bin"] + b"more"                                                        # a block more
    new["c/short"] = old["c/short"][:64]                                                                  # a block less
    trees = []
    for files in (old, new):
        root = scratch_path(spark, "blocks")
        _planted(root, files)
        blocks = BL.block_digests(spark, root, 64)
        got = {(r.file, r.block): r.sha256 for r in blocks.collect()}
        assert got == {(f, i): hashlib.sha256(d[i * 64:(i + 1) * 64]).hexdigest() for f, d in files.items() for i in range(-(-len(d) // 64))}
        trees.append(BL.block_tree(blocks, scratch_path(spark, "tree")))
    found = sorted(map(tuple, BL.differences(trees[1], trees[0]).collect()), key=str)
    assert found == sorted([("a/x.bin", 2, "changed"), ("a/x.bin", 10, "changed"), ("a/y z.bin", 10, "extra"), ("c/short", 1, "missing"),
                            ("b/gone", None, "missing"), ("b/new", None, "extra"), ("b/same", None, "match")], key=str)
    assert {r.status for r in BL.differences(trees[0], trees[0]).collect()} == {"match"}


def test_package_counts_come_from_the_write(spark):
    fx = Fixture(spark, SF0001)
    out = scratch_path(spark, "pkg-once")
    tables = {"alt_phones": fx.alt_phones, "lists": fx.lists, "leads": fx.leads}
    got = EX.export_package(tables, out, where={"leads": "list_id % 2 = 0"})
    assert [tuple(r) for r in got.collect()] == [("alt_phones", fx.alt_phones.count()), ("lists", fx.lists.count()), ("leads", fx.leads.where("list_id % 2 = 0").count())]
    assert spark.read.parquet(f"{out}/leads").count() == fx.leads.where("list_id % 2 = 0").count()
