"""A table that micro-batches add to and look up by key, as Parquet folders.

Rows lie in buckets by the hash of one column.  A micro-batch writes its rows
as a delta, ``batch_id=<n>/part=delta/bucket=<b>``, and a manifest that names
the live folders of every bucket; until the manifest is there the batch has
not happened, so a crash leaves the state before it and a replay overwrites
what the crash left behind.  A bucket whose deltas have grown to a quarter of
its base, or to ``MOST_DELTAS`` folders, is merged into a new base in the
same commit.  A lookup reads the live folders of the buckets its keys fall
into, and of nothing else.

With a ``key`` the newest row of each key counts (a later batch replaces
rows); without one every row does.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..session import list_names, path_exists

MOST_DELTAS = 16
FIRST = -1  # the batch id of the initial table


@dataclass(frozen=True)
class KeyedTable:
    path: str
    schema: StructType
    bucket_by: str
    key: tuple[str, ...]
    buckets: int

    @classmethod
    def create(cls, df: DataFrame, path: str, bucket_by: str, key: tuple[str, ...] = (), buckets: int = 64) -> KeyedTable:
        """The table of ``df``'s rows, the base of every bucket."""
        table = cls(path, df.schema, bucket_by, tuple(key), buckets)
        rows = table._write(df, FIRST, "base")
        table._save(df.sparkSession, FIRST, {b: {"base": FIRST, "rows": n, "deltas": []} for b, n in rows.items()})
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedTable:
        m = _manifest(spark, path, None)
        return cls(path, StructType.fromJson(m["schema"]), m["bucket_by"], tuple(m["key"]), m["buckets"])

    def _with(self, **folders) -> StructType:
        """The schema with the columns that folder names hold."""
        return StructType([*self.schema.fields, *[StructField(n, t) for n, t in folders.items()]])

    def _bucket(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("string")), F.lit(self.buckets)).cast("int")

    def _live(self, spark: SparkSession, before: int | None) -> dict[int, dict]:
        return {int(b): state for b, state in _manifest(spark, self.path, before)["live"].items()}

    def _folder(self, batch_id: int, part: str) -> str:
        return f"{self.path}/batch_id={batch_id}/part={part}"

    def _write(self, rows: DataFrame, batch_id: int, part: str) -> dict[int, int]:
        """Rows of each bucket written."""
        folder = self._folder(batch_id, part)
        placed = rows.select(*self.schema.names).withColumn("bucket", self._bucket(F.col(self.bucket_by)))
        placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        back = rows.sparkSession.read.schema(self._with(bucket=IntegerType())).parquet(folder)
        return {r["bucket"]: r["n"] for r in back.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}

    def _rows(self, spark: SparkSession, live: dict[int, dict], buckets) -> DataFrame:
        paths = []
        for b in buckets:
            if state := live.get(b):
                paths += [f"{self._folder(state['base'], 'base')}/bucket={b}"] if state["base"] is not None else []
                paths += [f"{self._folder(n, 'delta')}/bucket={b}" for n, _ in state["deltas"]]
        if not paths:
            return spark.createDataFrame([], self.schema)
        stored = self._with(batch_id=LongType(), part=StringType(), bucket=IntegerType())
        rows = spark.read.schema(stored).option("basePath", self.path).parquet(*paths)
        if not self.key:
            return rows.select(*self.schema.names)
        others = [c for c in self.schema.names if c not in self.key]
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*others), "batch_id").alias("_r"))
        return newest.select(*[F.col(c) if c in self.key else F.col("_r")[c].alias(c) for c in self.schema.names])

    def read(self, spark: SparkSession, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The live rows before batch ``before``; with ``keys``, of the buckets that the values of its first column fall into."""
        live = self._live(spark, before)
        buckets = sorted(live)
        if keys is not None:
            asked = keys.select(self._bucket(F.col(keys.columns[0])).alias("b")).distinct()
            buckets = sorted(r["b"] for r in asked.collect())  # at most ``buckets`` numbers
        return self._rows(spark, live, buckets)

    def commit(self, rows: DataFrame, batch_id: int) -> None:
        """Adds the rows of a micro-batch; the same batch again replaces itself."""
        spark = rows.sparkSession
        live = self._live(spark, batch_id)
        for b, n in self._write(rows, batch_id, "delta").items():
            live.setdefault(b, {"base": None, "rows": 0, "deltas": []})["deltas"].append([batch_id, n])
        due = [b for b, s in live.items() if len(s["deltas"]) >= MOST_DELTAS or s["deltas"] and 4 * sum(n for _, n in s["deltas"]) >= max(s["rows"], 1)]
        if due:
            for b, n in self._write(self._rows(spark, live, due), batch_id, "base").items():
                live[b] = {"base": batch_id, "rows": n, "deltas": []}
        self._save(spark, batch_id, live)

    def _save(self, spark: SparkSession, batch_id: int, live: dict[int, dict]) -> None:
        m = {"schema": self.schema.jsonValue(), "bucket_by": self.bucket_by, "key": self.key, "buckets": self.buckets, "live": live}
        spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_manifests/{batch_id}")


def _manifest(spark: SparkSession, path: str, before: int | None) -> dict:
    """The manifest of the latest batch, or of the latest one before ``before``."""
    ids = sorted((int(n) for n in list_names(spark, f"{path}/_manifests")), reverse=True)
    for n in ids:
        if (before is None or n < before) and path_exists(spark, f"{path}/_manifests/{n}/_SUCCESS"):
            return json.loads(spark.read.text(f"{path}/_manifests/{n}").first()["value"])
    raise FileNotFoundError(f"no table at {path}")
