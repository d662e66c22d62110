"""Single-file sinks: rows stream from Spark to one file of any Hadoop file system, in order, without being held."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bytes(spark: SparkSession, path: str, parts: Iterable[bytes], buffer: int = 1 << 20) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        held = bytearray()
        for part in parts:
            held += part
            if len(held) >= buffer:
                out.write(bytes(held))
                held.clear()
        out.write(bytes(held))
    finally:
        out.close()


def write_lines(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    write_bytes(spark, path, (f"{line}\n".encode() for line in lines))


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos and line of formats whose lines depend on each other."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r", ""), "\n")).alias("pos", "line"))


def fields(spark: SparkSession, path: str) -> DataFrame:
    """Fields of each line, parted by white space; read in splits."""
    return spark.read.text(path).select(F.array_remove(F.split("value", r"\s+"), "").alias("f"))


def contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")
