"""Tables in the shared folder named in ``spark.checkpoint.dir``, which cut the lineage of loops."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def root(spark: SparkSession) -> str:
    """Where ``spark.checkpoint.dir`` is unset, a local session gets a temporary folder, removed at exit; on a
    cluster that is an error, since executors share no local disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _own:
        _own["root"] = tempfile.mkdtemp(prefix="edgeloom-")
        atexit.register(shutil.rmtree, _own["root"], ignore_errors=True)
    return f"file://{_own['root']}"


def write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{root(spark)}/edgeloom-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_at_exit)
    _written[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def tables() -> set[str]:
    """Scratch tables that exist now."""
    return set(_written)


def drop(spark: SparkSession, paths: set[str]) -> None:
    """Delete those of these scratch tables that still exist."""
    for path in paths & _written.keys():
        remove(spark, path)


def release(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete all scratch tables but those in ``keep``: results that read them must have been written before."""
    for path in [p for p, owner in _written.items() if owner is spark and p not in keep]:
        remove(spark, path)


def _at_exit() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the JVM may have gone before
            remove(spark, path)
