"""Session helpers: local test sessions and the shared scratch folder.

Library code never picks a machine-local folder on a cluster.  Scratch data
(written tables, streaming checkpoints, checkpoint() output) lives under the
folder the cluster names in ``spark.checkpoint.dir``.  Only a local-mode
session with no such setting gets a fresh temporary folder, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def local_session(cpus: int | str = 8, app: str = "switchyard") -> SparkSession:
    """A local[N] session configured like the tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in _CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the session, if any."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    return d or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set one only for local mode.

    On a cluster an unset ``spark.checkpoint.dir`` is a configuration error:
    a machine-local folder would not survive the loss of an executor.
    """
    d = checkpoint_dir(spark)
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    d = tempfile.mkdtemp(prefix="switchyard-ckpt-")
    # spark.checkpoint.dir cannot be changed at run time; the context's
    # checkpoint folder is what checkpoint() and checkpoint_dir() use
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/switchyard/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, through the Hadoop file system of the session."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - Hadoop FileSystem probe only
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    if not path_exists(spark, path):
        return []
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    p = jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]  # noqa: SLF001


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder and all in it, through the Hadoop file system of the session."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def local_fs_path(path: str) -> str:
    """Strip a ``file:`` scheme so a local path can be used by os functions."""
    return path[5:] if path.startswith("file:") else path


def is_local_path(path: str) -> bool:
    return "://" not in path or path.startswith("file:")
