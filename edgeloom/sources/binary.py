"""Binary formats: dBase tables, shapefiles, ArcGIS SWM weights, well-known binary and text.

Files are read with Spark's binaryFile source and decoded in Python, a file a row; many files decode in parallel.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from .files import contents, write_bytes

RINGS = "array<array<struct<x:double,y:double>>>"


def _dbf_fields(head: bytes) -> list[tuple[str, str, int, int]]:
    out, at = [], 32
    while head[at] != 0x0D:
        name = head[at : at + 11].split(b"\0")[0].decode("latin-1")
        out.append((name, chr(head[at + 11]), head[at + 16], head[at + 17]))
        at += 32
    return out


def _dbf_kind(kind: str, decimals: int) -> str:
    return {"N": "double" if decimals else "bigint", "F": "double", "D": "date", "L": "boolean"}.get(kind, "string")


def _dbf_value(raw: bytes, kind: str, decimals: int):
    text = raw.decode("latin-1").strip()
    if kind in "NF":
        try:
            return (float(text) if kind == "F" or decimals else int(float(text))) if text.strip("*") else None
        except ValueError:
            return None
    if kind == "D":
        try:
            return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
        except ValueError:
            return None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return text


def read_dbf(spark: SparkSession, path: str) -> DataFrame:
    """Rows of dBase III tables of one layout, with ``record`` (0, 1, ...). The first file's head gives the schema."""
    head = contents(spark, path).select(F.substring("content", 1, 65536).alias("h")).first()["h"]
    cols = _dbf_fields(bytes(head))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                n, start, width = struct.unpack("<IHH", data[4:12])
                rows = []
                for k in range(n):
                    raw = data[start + k * width : start + (k + 1) * width]
                    if raw[:1] == b"*":
                        continue  # deleted
                    row, at = [k], 1
                    for _, kind, size, decimals in cols:
                        row.append(_dbf_value(raw[at : at + size], kind, decimals))
                        at += size
                    rows.append(row)
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=["record", *(c[0] for c in cols)]).astype(object)
                        rows = []
                yield pd.DataFrame(rows, columns=["record", *(c[0] for c in cols)]).astype(object)

    return contents(spark, path).select("content").mapInPandas(decode, ", ".join(["record bigint", *(f"`{n}` {_dbf_kind(t, d)}" for n, t, _, d in cols)]))


def write_dbf(df: DataFrame, path: str, order: str | None = None) -> None:
    """Text (up to its greatest length), whole numbers, doubles, dates and booleans."""
    df = df.drop("record") if order != "record" else df
    longest = df.agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.octet_length(F.col(f"`{c}`"))).alias(c) for c, k in df.dtypes if k == "string"]).first()
    cols = []
    for c, kind in df.dtypes:
        if c == order == "record":
            continue
        spec = {"string": ("C", min(254, max(1, (longest[c] or 1) if kind == "string" else 1)), 0), "double": ("N", 20, 10), "float": ("N", 20, 10), "date": ("D", 8, 0), "boolean": ("L", 1, 0)}.get(kind, ("N", 20, 0))
        cols.append((c, *spec))
    width = 1 + sum(c[2] for c in cols)

    def put(v, kind: str, size: int, decimals: int) -> bytes:
        if v is None:
            return (b"?" if kind == "L" else b" ") * size
        if kind == "N":
            return (f"{v:.{decimals}f}" if decimals else str(int(v)))[:size].rjust(size).encode()
        if kind == "D":
            return v.strftime("%Y%m%d").encode()
        if kind == "L":
            return b"T" if v else b"F"
        return v.encode("latin-1", "replace")[:size].ljust(size)

    def parts() -> Iterator[bytes]:
        today = datetime.date.today()
        yield struct.pack("<BBBBIHH20x", 3, today.year - 1900, today.month, today.day, longest["_n"], 33 + 32 * len(cols), width)
        for name, kind, size, decimals in cols:
            yield struct.pack("<11sc4xBB14x", name.encode("latin-1")[:10], kind.encode(), size, decimals)
        yield b"\r"
        for r in (df.orderBy(order) if order else df).toLocalIterator():
            yield b" " + b"".join(put(r[c], k, s, d) for c, k, s, d in cols)
        yield b"\x1a"

    write_bytes(df.sparkSession, path, parts())


def dbf_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.drop("record").join(right.drop("record"), left[left_key] == right[right_key])


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1")


def read_dbf_weights(spark: SparkSession, path: str) -> Graph:
    """A table of an id, NID and WEIGHT."""
    t = read_dbf(spark, path).drop("record")
    a, b, w = t.columns[:3]
    return Graph(t.select(F.col(a).alias("focal"), F.col(b).alias("neighbor"), F.col(w).alias("weight")))


def write_dbf_weights(g: Graph, path: str, id_name: str = "UNIQUE_ID") -> None:
    write_dbf(g.links().orderBy("focal", "neighbor").select(F.col("focal").alias(id_name[:10]), F.col("neighbor").alias("NID"), F.col("weight").alias("WEIGHT")), path)


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    """record (0, 1, ...), kind and parts of shapefiles: points, lines and polygons, with Z and M left out. Closing
    points of rings are dropped."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                at, k, rows = 100, 0, []
                while at + 8 <= len(data):
                    size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
                    body = data[at + 8 : at + 8 + size]
                    kind = struct.unpack("<i", body[:4])[0]
                    parts: list = []
                    if kind % 10 == 1:
                        x, y = struct.unpack("<2d", body[4:20])
                        parts = [[{"x": x, "y": y}]]
                    elif kind % 10 in (3, 5):
                        n, m = struct.unpack("<2i", body[36:44])
                        starts = [*struct.unpack(f"<{n}i", body[44 : 44 + 4 * n]), m]
                        xy = np.frombuffer(body, "<f8", 2 * m, 44 + 4 * n).reshape(-1, 2).tolist()
                        for a, b in zip(starts, starts[1:]):
                            ring = xy[a:b]
                            if kind % 10 == 5 and len(ring) > 1 and ring[0] == ring[-1]:
                                ring = ring[:-1]
                            parts.append([{"x": x, "y": y} for x, y in ring])
                    elif kind % 10 == 8:
                        m = struct.unpack("<i", body[36:40])[0]
                        parts = [[{"x": x, "y": y}] for x, y in np.frombuffer(body, "<f8", 2 * m, 40).reshape(-1, 2).tolist()]
                    rows.append((k, {0: "null", 1: "point", 3: "line", 5: "polygon", 8: "multipoint"}.get(kind % 10, "other"), parts))
                    at, k = at + 8 + size, k + 1
                    if len(rows) == 5_000:
                        yield pd.DataFrame(rows, columns=["record", "kind", "parts"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["record", "kind", "parts"])

    return contents(spark, path).select("content").mapInPandas(decode, f"record bigint, kind string, parts {RINGS}")


def _shp_record(kind: str, parts) -> bytes:
    if kind == "point":
        return struct.pack("<i2d", 1, parts[0][0]["x"], parts[0][0]["y"])
    rings = [[(p["x"], p["y"]) for p in r] for r in parts]
    if kind == "polygon":
        rings = [r + r[:1] for r in rings]
    flat = [p for r in rings for p in r]
    xs, ys = [p[0] for p in flat], [p[1] for p in flat]
    starts = np.cumsum([0, *(len(r) for r in rings)])[:-1]
    return struct.pack("<i4d2i", 5 if kind == "polygon" else 3, min(xs), min(ys), max(xs), max(ys), len(rings), len(flat)) + struct.pack(f"<{len(rings)}i", *starts.tolist()) + struct.pack(f"<{2 * len(flat)}d", *[v for p in flat for v in p])


def write_shp(df: DataFrame, path: str, order: str = "record") -> None:
    """``kind`` and ``parts`` as .shp, with its .shx beside it. All shapes have one kind."""
    spark = df.sparkSession
    points = F.flatten("parts")
    box = df.agg(F.first("kind").alias("kind"), *[f(g(F.transform(points, lambda p: p[c]))).alias(n) for n, f, g, c in (("l", F.min, F.array_min, "x"), ("b", F.min, F.array_min, "y"), ("r", F.max, F.array_max, "x"), ("t", F.max, F.array_max, "y"))]).first()
    code = {"point": 1, "line": 3, "polygon": 5}[box["kind"]]
    rows = df.orderBy(order).select("kind", "parts")
    sizes = [len(_shp_record(r["kind"], r["parts"])) for r in rows.toLocalIterator()]
    head = lambda total: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, total // 2) + struct.pack("<2i8d", 1000, code, box["l"], box["b"], box["r"], box["t"], 0, 0, 0, 0)

    def main() -> Iterator[bytes]:
        yield head(100 + sum(s + 8 for s in sizes))
        for k, r in enumerate(rows.toLocalIterator(), 1):
            body = _shp_record(r["kind"], r["parts"])
            yield struct.pack(">2i", k, len(body) // 2) + body

    def index() -> Iterator[bytes]:
        yield head(100 + 8 * len(sizes))
        at = 50
        for s in sizes:
            yield struct.pack(">2i", at, s // 2)
            at += (s + 8) // 2

    write_bytes(spark, path, main())
    write_bytes(spark, path[:-4] + ".shx", index())


def read_table(spark: SparkSession, stem: str) -> DataFrame:
    """Shapes and attributes of ``stem``.shp and ``stem``.dbf, by record."""
    return read_shp(spark, f"{stem}.shp").join(read_dbf(spark, f"{stem}.dbf"), "record")


def write_table(df: DataFrame, stem: str) -> None:
    write_shp(df.select("record", "kind", "parts"), f"{stem}.shp")
    write_dbf(df.drop("kind", "parts"), f"{stem}.dbf", order="record")


def read_swm(spark: SparkSession, path: str) -> Graph:
    """ArcGIS SWM: a head line, counts, then for each id its neighbors, weights and row sum. With the newer head, a
    fixed flag stands for equal weights."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                end = data.index(b"\n")
                head = data[:end].decode("latin-1")
                fixed = False
                if "VERSION@" in head.split(";")[0]:
                    fixed = dict(x.split("@", 1) for x in head.split(";") if "@" in x).get("FIXEDWEIGHTS", "False").strip() == "True"
                at = end + 1
                n = struct.unpack("<l", data[at : at + 4])[0]
                at += 8  # the count, and whether rows are standardised
                rows = []
                for _ in range(n):
                    i, k = struct.unpack("<2l", data[at : at + 8])
                    at += 8
                    if not k:
                        rows.append((i, i, 0.0))
                        continue
                    ids = struct.unpack(f"<{k}l", data[at : at + 4 * k])
                    at += 4 * k
                    m = 1 if fixed else k
                    w = struct.unpack(f"<{m}d", data[at : at + 8 * m])
                    at += 8 * m + 8
                    rows += [(i, j, x) for j, x in zip(ids, w * k if fixed else w)]
                yield pd.DataFrame(rows, columns=["focal", "neighbor", "weight"])

    return Graph(contents(spark, path).select("content").mapInPandas(decode, "focal bigint, neighbor bigint, weight double"))


def write_swm(g: Graph, path: str, id_name: str = "UNIQUE_ID") -> None:
    n = g.nodes.count()
    rows = g.neighbors().orderBy("id")

    def parts() -> Iterator[bytes]:
        yield f"{id_name};Unknown\n".encode() + struct.pack("<2l", n, int(g.transformation == "R"))
        for r in rows.toLocalIterator():
            k = len(r["neighbors"])
            yield struct.pack("<2l", r["id"], k)
            if k:
                yield struct.pack(f"<{k}l", *r["neighbors"]) + struct.pack(f"<{k + 1}d", *r["weights"], sum(r["weights"]))

    write_bytes(g.edges.sparkSession, path, parts())


def parse_wkt(text) -> tuple:
    """Columns kind and parts of POINT, LINESTRING, POLYGON, MULTIPOLYGON and MULTILINESTRING text."""
    kind = F.lower(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), 1)
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y"))
    ring = lambda r: F.transform(F.split(r, ","), point)
    opened = lambda r: F.when(kind.endswith("polygon") & (F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    return kind, F.transform(F.transform(rings, ring), opened)


def read_wkt(spark: SparkSession, path: str) -> DataFrame:
    kind, parts = parse_wkt(F.col("value"))
    return spark.read.text(path).filter("trim(value) <> ''").select(F.monotonically_increasing_id().alias("record"), kind.alias("kind"), parts.alias("parts"))


def to_wkt(kind, parts):
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ", "), F.lit(")"))
    close = lambda r: F.when(kind == "polygon", F.concat(r, F.slice(r, 1, 1))).otherwise(r)
    inner = F.array_join(F.transform(F.transform(parts, close), ring), ", ")
    return F.when(kind == "point", F.concat(F.lit("POINT "), inner)).when(kind == "line", F.concat(F.lit("LINESTRING "), inner)).otherwise(F.concat(F.lit("POLYGON ("), inner, F.lit(")")))


def _wkb(data: bytes, at: int = 0) -> tuple[list, int]:
    order = "<" if data[at] == 1 else ">"
    kind = struct.unpack(order + "I", data[at + 1 : at + 5])[0] % 1000
    at += 5

    def points(m: int, at: int) -> tuple[list, int]:
        v = struct.unpack(f"{order}{2 * m}d", data[at : at + 16 * m])
        return [{"x": x, "y": y} for x, y in zip(v[::2], v[1::2])], at + 16 * m

    if kind == 1:
        p, at = points(1, at)
        return [p], at
    n = struct.unpack(order + "I", data[at : at + 4])[0]
    at += 4
    if kind == 2:
        p, at = points(n, at)
        return [p], at
    parts: list = []
    for _ in range(n):
        if kind == 3:
            m = struct.unpack(order + "I", data[at : at + 4])[0]
            p, at = points(m, at + 4)
            parts.append(p[:-1] if len(p) > 1 and p[0] == p[-1] else p)
        else:
            inner, at = _wkb(data, at)
            parts += inner
    return parts, at


def parse_wkb(data):
    """Column: parts of well-known binary, types 1 to 7 (nested types are flattened); null for null."""

    @F.pandas_udf(RINGS)
    def parse(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else _wkb(bytes(b))[0])

    return parse(data)


def read_shx(spark: SparkSession, path: str) -> DataFrame:
    """record, offset and length (in bytes) of the shapes that an index file lists."""
    body = contents(spark, path).select(F.posexplode(F.sequence(F.lit(100), F.length("content") - 8, F.lit(8))).alias("record", "at"), "content")
    word = lambda at: F.conv(F.hex(F.substring("content", at + 1, 4)), 16, 10).cast("bigint") * 2
    return body.select("record", word(F.col("at")).alias("offset"), word(F.col("at") + 4).alias("length"))


def ids_of(spark: SparkSession, stem: str, column: str) -> DataFrame:
    """The id column of a shapefile's table."""
    return read_dbf(spark, f"{stem}.dbf").select(F.col(column).alias("id"))


def points_of(spark: SparkSession, path: str) -> DataFrame:
    """id (record), x and y of a shapefile's points, or of its polygons' first rings' centroids."""
    from ..functions import geometry as geo

    ring = F.col("parts")[0]
    at = F.when(F.size(ring) < 3, ring[0]).otherwise(geo.centroid(ring))
    return read_shp(spark, path).select(F.col("record").cast("bigint").alias("id"), at["x"].alias("x"), at["y"].alias("y"))


def min_threshold_of(spark: SparkSession, path: str, p: float = 2) -> DataFrame:
    """Greatest distance to a nearest neighbor among a shapefile's points."""
    from ..operators.builders import min_threshold_distance

    return min_threshold_distance(points_of(spark, path), p)
