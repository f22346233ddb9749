"""Tables written to the folder that all executors share, to cut a long lineage.

A result that reads such a table is run by its caller, later; so the tables that
it needs stay until ``release`` or the end of the process, and only those that a later
table has replaced go at once.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode, where driver and executors are one machine, if the session names no checkpoint folder.
LOCAL_SCRATCH = "/tmp/checkpoints"

_written: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_SCRATCH


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the scratch folder, which goes with ``release`` or at the end of the process."""
    path = f"{scratch_dir(spark)}/palisade-{label}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage with a replicated copy: losing an executor costs a
    re-read, not a recomputation, and rows that depend on physical placement
    cannot change between two uses.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reads, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(paths: set[str] | None = None) -> None:
    """Delete all staged tables, or those of ``paths``, once the results that read them are written."""
    spark = SparkSession.getActiveSession()
    for path in _written & (_written if paths is None else paths):
        _written.discard(path)
        if spark is not None:
            delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    release({t._scratch_path for t in tables if hasattr(t, "_scratch_path")})


def written() -> set[str]:
    """The staged tables that have not been deleted."""
    return set(_written)


def _at_exit() -> None:
    # the JVM may have gone first
    with contextlib.suppress(Exception):
        release()


atexit.register(_at_exit)
