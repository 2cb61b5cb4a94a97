"""Hash trees over the blocks of files (SURVEY snk_checksums, verify_checksums at any file size).

A file's SHA-256 is one sequential task; its tree is not.  Fixed blocks are
read by range and hashed in as many tasks as the session shuffles to, and
every ``FAN`` digests of a file are hashed to one, level by level, up to one
node a file at level ``HEIGHT`` (16 PB a file with blocks of 4 MB).  Two trees
are compared from the top: only the children of nodes that differ are looked
at, so finding a changed block in a large package reads a few nodes a level.

Blocks are read in Python workers with ``pyarrow.fs``, which opens shared
folders and the common object stores by their URI.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.setops import union_all
from ..session import local_fs_path, scratch_path
from ..sources.files import file_inventory

FAN = 256
HEIGHT = 4
BLOCK_BYTES = 4 << 20


def block_digests(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, glob: str | None = None) -> DataFrame:
    """``(file, block, sha256)`` of every block of the files under ``path``.

    ``file`` is the path below ``path``.  Empty files have no block and are
    not listed (Spark's file source leaves them out).
    """
    root = path.rstrip("/") + "/"
    files = file_inventory(spark, [path], glob)
    below = F.substring_index("path", local_fs_path(root), -1)
    last = F.ceil(F.col("length") / block_bytes) - 1
    blocks = files.select("path", below.alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        name, handle = None, None
        for frame in frames:
            digests = []
            for uri, block in zip(frame["path"], frame["block"]):
                if uri != name:
                    if handle is not None:
                        handle.close()
                    system, at = fs.FileSystem.from_uri(local_fs_path(uri))
                    name, handle = uri, system.open_input_file(at)
                digests.append(hashlib.sha256(handle.read_at(block_bytes, int(block) * block_bytes)).hexdigest())
            yield pd.DataFrame({"file": frame["file"], "block": frame["block"], "sha256": digests})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = blocks.repartition(n, "path", "block").sortWithinPartitions("path", "block")
    return spread.mapInPandas(read, "file string, block long, sha256 string")


def block_tree(blocks: DataFrame, out: str) -> DataFrame:
    """The tree over ``(file, block, sha256)`` as ``(file, level, node, sha256)``, written to the folder ``out`` by level."""
    spark = blocks.sparkSession
    nodes = blocks.select("file", F.col("block").alias("node"), "sha256")
    for level in range(HEIGHT + 1):
        nodes.write.mode("overwrite").parquet(f"{out}/level={level}")
        below = spark.read.parquet(f"{out}/level={level}")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", "sha256"))), lambda s: s["sha256"])
        nodes = below.groupBy("file", F.floor(F.col("node") / FAN).alias("node")).agg(F.sha2(F.array_join(ordered, ""), 256).alias("sha256"))
    return read_tree(spark, out)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """A tree that ``block_tree`` wrote."""
    return spark.read.schema("file string, node long, sha256 string, level int").parquet(path)


def package_tree(spark: SparkSession, path: str, out: str, block_bytes: int = BLOCK_BYTES, glob: str | None = None) -> DataFrame:
    """The tree of a package's files, written to ``out``."""
    return block_tree(block_digests(spark, path, block_bytes, glob), out)


def differences(actual: DataFrame, recorded: DataFrame) -> DataFrame:
    """``(file, block, status)``: a row for each file that is ``missing``, ``extra`` or a ``match`` (block null),
    and for each block of the others that is ``changed``, ``missing`` or ``extra``.

    Both trees must have been built with one block size.
    """
    spark = actual.sparkSession

    def level_of(tree: DataFrame, level: int, name: str, among: DataFrame | None) -> DataFrame:
        rows = tree.where(F.col("level") == level).select("file", "node", F.col("sha256").alias(name))
        if among is None:
            return rows
        return rows.join(among.withColumnRenamed("node", "above"), (rows["file"] == among["file"]) & (F.floor(rows["node"] / FAN) == F.col("above")), "left_semi")

    def compared(level: int, among: DataFrame | None) -> DataFrame:
        pair = level_of(recorded, level, "e", among).join(level_of(actual, level, "a", among), ["file", "node"], "full_outer")
        status = (F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("a") == F.col("e"), "match").otherwise("changed"))
        path = scratch_path(spark, f"tree-level{level}")
        pair.select("file", "node", status.alias("status")).write.parquet(path)
        return spark.read.parquet(path)

    files = compared(HEIGHT, None)
    among = files.where("status = 'changed'").select("file", "node")
    for level in range(HEIGHT - 1, -1, -1):
        found = compared(level, among).where("status <> 'match'")
        among = found.select("file", "node")  # a node on one side only has children to name as well
    whole = files.where("status <> 'changed'").select("file", F.lit(None).cast("long").alias("block"), "status")
    return union_all(whole, found.select("file", F.col("node").alias("block"), "status"))
