"""Tables of attributes: CSV, databases, one reader for all formats, and access by column and by place."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, matrices, weights_text


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header. Types are sniffed over the whole file, but for columns whose type is given; values that don't fit
    a given type become null."""
    df = spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    return cast(df, types or {})


def cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select([F.expr(f"try_cast(`{c}` AS {types[c]})").alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def read_sql(spark: SparkSession, url: str, table: str, column: str | None = None, low: int | None = None, high: int | None = None, tasks: int = 8, geometry: str | None = None) -> DataFrame:
    """A table of a database. ``jdbc:`` urls are read by Spark, in ``tasks`` ranges of a numeric column if one is given;
    ``sqlite:///file`` by the driver, which streams rows in lots. geometry: a GeoJSON column, which becomes parts."""
    if url.startswith("jdbc:"):
        split = {} if column is None else {"partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": tasks}
        df = spark.read.format("jdbc").options(url=url, dbtable=table, **split).load()
    elif url.startswith("sqlite:///"):
        df = _sqlite(spark, url.removeprefix("sqlite:///"), table)
    else:
        raise ValueError("the url must begin with jdbc: or sqlite:///")
    if geometry is None:
        return df
    from ..functions.geometry import from_geojson

    return df.withColumn("parts", from_geojson(F.col(geometry))).drop(geometry)


def _sqlite(spark: SparkSession, path: str, table: str, lot: int = 50_000) -> DataFrame:
    import sqlite3

    quoted = '"' + table.replace('"', '""') + '"'
    kinds = {"INT": "bigint", "REA": "double", "FLO": "double", "DOU": "double"}
    with sqlite3.connect(path) as con:
        columns = con.execute(f"PRAGMA table_info({quoted})").fetchall()
        if not columns:
            raise ValueError(f"no table {table!r}")
        schema = ", ".join(f"`{c[1]}` {kinds.get(c[2].upper()[:3], 'string')}" for c in columns)
        cursor, out = con.execute(f"SELECT * FROM {quoted}"), None
        while rows := cursor.fetchmany(lot):
            part = spark.createDataFrame(rows, schema)
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def by_column(df: DataFrame, *names: str) -> DataFrame:
    """Columns by name; an error names those that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.select([F.col(f"`{n}`") for n in names])


def rows_between(df: DataFrame, order: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows by place in the order of a column, from ``start`` to before ``stop``."""
    from ..operators.graph import numbered

    place = numbered(df.select(F.col(order).alias("id")).distinct()).withColumnRenamed("id", order)
    at = df.join(place, order).filter(F.col("ord") >= start)
    return (at if stop is None else at.filter(F.col("ord") < stop)).drop("ord")


def with_metadata(df: DataFrame, column: str, overwrite: bool = False, **values) -> DataFrame:
    """Values attached to a column, which go with the table and its Parquet files."""
    held = dict(df.schema[column].metadata or {})
    if not overwrite and held.keys() & values.keys():
        raise ValueError(f"the column has {sorted(held.keys() & values.keys())} already; use overwrite=True")
    return df.withColumn(column, F.col(column).alias(column, metadata=held | {k: v if isinstance(v, (int, float, str, bool)) else json.dumps(v) for k, v in values.items()}))


READERS = {
    "csv": read_csv, "dbf": lambda spark, path: binary.read_dbf(spark, path), "shp": lambda spark, path: binary.read_shp(spark, path), "wkt": lambda spark, path: binary.read_wkt(spark, path),
    "geoda_txt": weights_text.read_geoda_text, "mat": matrices.read_mat, "wk1": matrices.read_wk1, "parquet_table": lambda spark, path: spark.read.parquet(path),
}


def form_of(path: str) -> str:
    """The format that a path's ending names."""
    form = path.rstrip("/").rpartition(".")[2].lower()
    if form not in {**weights_text.READERS, **READERS}:
        raise ValueError(f"no reader for {form!r}; one of {', '.join(sorted({**weights_text.READERS, **READERS}))}")
    return form


def read(spark: SparkSession, path: str, form: str | None = None, n: int = -1, types: dict[str, str] | None = None):
    """A Graph or a table, by the path's ending or by ``form``; of a table ``n`` rows (all, if negative), with given types."""
    form = form or form_of(path)
    out = {**weights_text.READERS, **READERS}[form](spark, path)
    if not isinstance(out, DataFrame):
        return out
    out = cast(out, types) if types else out
    return out if n < 0 else out.limit(n)


class Examples:
    """A registry of tables by name: readers of paths, or functions of a session, with what they say of themselves."""

    def __init__(self):
        self._known: dict[str, tuple] = {}

    def add(self, name: str, source, about: str = "") -> None:
        self._known[name] = (source, about)

    def available(self) -> list[str]:
        return sorted(self._known)

    def explain(self, name: str) -> str:
        return self._known[name][1]

    def load(self, spark: SparkSession, name: str):
        if name not in self._known:
            raise KeyError(f"no example {name!r}; one of {', '.join(self.available())}")
        source = self._known[name][0]
        return source(spark) if callable(source) else read(spark, source)
