"""What the operators share: reading, written tables, the hold-out rule, bounded samples."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage, so a lost executor costs no recomputation, and hides the
    partitioning of the writer, so later joins get exchanges that adaptive
    execution can split.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(docs: DataFrame) -> Column:
    """The place of each row of ``docs`` as a struct column that sorts in the order in which the rows were written.

    For a frame read from files: the number of the part that wrote the file,
    the file, and the row's number in it; a scan may deal out the files in any
    order.  For any other frame: the order of its partitions.
    """
    try:
        file = docs.metadataColumn("_metadata")
    except AnalysisException:  # not read from files
        zero = F.lit(0).cast("long")
        return F.struct(zero.alias("part"), zero.alias("nth"), zero.alias("file"), F.monotonically_increasing_id().alias("row"))
    numbers = [F.regexp_extract(file["file_name"], rule, 1).try_cast("long") for rule in (r"^part-(\d+)", r"-c(\d+)\.")]
    part, nth = (F.coalesce(n, F.lit(0).cast("long")) for n in numbers)
    return F.struct(part.alias("part"), nth.alias("nth"), F.xxhash64(file["file_path"]).alias("file"), file["row_index"].alias("row"))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, cls: str, per_class: int, seed: int = 17) -> DataFrame:
    """About ``per_class`` rows of each class at most, chosen by a hash of ``key``.

    Counts each class, then keeps the rows whose hash falls under the class's
    share, so the expected size is bounded by ``per_class`` x classes at any
    input size and no class meets in one task.  Adds ``weight``, the inverse
    of the share.
    """
    spread = 1 << 40
    counts = rows.groupBy(F.col(cls).alias("_cls")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("_n"))
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(spread))
    joined = rows.join(F.broadcast(counts), F.col(cls).eqNullSafe(F.col("_cls")))
    return (joined.where(hashed < share * spread)
            .withColumn("weight", 1.0 / share).drop("_cls", "_n"))


_OWN: dict[str, Any] = {}


def own(key: str, build: Callable[[], Any]) -> Any:
    """What ``build`` gives, built once in a worker; a worker holds one such object at a time.

    Workers outlive an operator: without this its codec or lexicon, with all
    that it remembers, would stay in memory beside the next one's.
    """
    if key not in _OWN:
        let_go()
        _OWN[key] = build()
    return _OWN[key]


def let_go() -> None:
    """Frees what a worker holds; for functions that need room and no such object."""
    if _OWN:
        _OWN.clear()
        gc.collect()  # the objects refer to themselves, by what they remember
    pa.default_memory_pool().release_unused()


class Recent(dict):
    """What ``compute`` gave for the texts met of late, about ``size`` of them; texts over ``longest`` are not kept.

    Two generations of half the size: when the younger is full it becomes the
    older, from which texts met again come back, so frequent ones stay.
    """

    def __init__(self, compute, size: int, longest: int = 64):
        self.compute, self.size, self.longest = compute, size, longest
        self.older: dict = {}

    def __missing__(self, key: str):
        if (got := self.older.get(key)) is None:
            got = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.size // 2:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got
