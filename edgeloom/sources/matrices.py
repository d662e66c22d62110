"""Binary files that hold a full or sparse matrix of weights: MATLAB (levels 4 and 5) and WK1 worksheets.

Each is one block of bytes by its format, so it is read by one task and written by the driver; both refuse matrices that
the format can't hold. Ids are places: 0 .. n-1."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from .files import contents, write_bytes

CELLS = "n bigint, i bigint, j bigint, w double"
#: Element types of MATLAB's level 5 files, and their numpy codes (fixed values).
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_COMPRESSED, _MATRIX, _SPARSE = 15, 14, 5


def _elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(f"{order}2I", raw, at)
        if kind >> 16:  # a small element: its size and type share one word
            kind, size, start, step = kind & 0xFFFF, kind >> 16, at + 4, 8
        else:
            start, step = at + 8, 8 + size + (-size % 8 if kind != _COMPRESSED else 0)
        yield kind, raw[start : start + size]
        at += step


def _values(kind: int, raw: bytes, order: str) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(_TYPES[kind]).newbyteorder(order))


def _level5(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    order = "<" if raw[126:128] == b"IM" else ">"
    for kind, body in _elements(raw[128:], order):
        if kind == _COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind != _MATRIX:
            continue
        parts = list(_elements(body, order))
        flags = int(_values(6, parts[0][1], order)[0])
        shape = _values(*parts[1], order)
        numbers = [_values(k, x, order) for k, x in parts[3:]]
        if flags & 0xFF == _SPARSE:
            rows, starts, w = numbers[0].astype(np.int64), numbers[1].astype(np.int64), numbers[2].astype(float)
            cols = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            return int(shape[0]), rows[: len(cols)], cols, w[: len(cols)]
        full = numbers[0].astype(float).reshape(shape, order="F")
        i, j = np.nonzero(full)
        return int(shape[0]), i, j, full[i, j]
    raise ValueError("the file holds no matrix")


def _level4(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    order = "<" if struct.unpack_from("<I", raw)[0] < 5000 else ">"
    kind, rows, cols, _, name = struct.unpack_from(f"{order}5I", raw)
    code = {0: "f8", 1: "f4", 2: "i4", 3: "i2", 4: "u2", 5: "u1"}[kind // 10 % 10]
    full = np.frombuffer(raw, np.dtype(code).newbyteorder(order), rows * cols, 20 + name).astype(float).reshape((rows, cols), order="F")
    if kind % 10 == 2:  # sparse: rows of i, j, w from 1, and a last one with the shape
        return int(full[-1, 0]), (full[:-1, 0] - 1).astype(int), (full[:-1, 1] - 1).astype(int), full[:-1, 2]
    i, j = np.nonzero(full)
    return rows, i, j, full[i, j]


def matlab_cells(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """n, and rows, columns and weights of the cells that aren't 0, of the first matrix of a file."""
    return _level5(raw) if raw[:6] == b"MATLAB" else _level4(raw)


def _element(kind: int, raw: bytes) -> bytes:
    return struct.pack("<2I", kind, len(raw)) + raw + bytes(-len(raw) % 8)


def matlab_parts(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, sparse: bool, name: str = "WEIGHT", block: int = 1 << 20) -> Iterator[bytes]:
    """A level 5 file of one matrix, in pieces: a full one by blocks of columns, so that it is never held whole."""
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    body = _element(6, struct.pack("<2I", _SPARSE if sparse else 6, len(w) if sparse else 0)) + _element(5, struct.pack("<2i", n, n)) + _element(1, name.encode())
    order = np.lexsort((i, j))
    i, j, w = i[order], j[order], w[order]
    if sparse:
        body += _element(5, i.astype("<i4").tobytes()) + _element(5, np.searchsorted(j, np.arange(n + 1)).astype("<i4").tobytes()) + _element(9, w.astype("<f8").tobytes())
        yield head + _element(_MATRIX, body)
        return
    yield head + struct.pack("<2I", _MATRIX, len(body) + 8 + 8 * n * n) + body + struct.pack("<2I", 9, 8 * n * n)
    step = max(1, block // max(n, 1))
    for first in range(0, n, step):
        last = min(first + step, n)
        a, b = np.searchsorted(j, (first, last))
        columns = np.zeros((last - first, n), "<f8")
        columns[j[a:b] - first, i[a:b]] = w[a:b]
        yield columns.tobytes()


def matlab_bytes(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, sparse: bool, name: str = "WEIGHT") -> bytes:
    """A level 5 file of one matrix."""
    return b"".join(matlab_parts(n, i, j, w, sparse, name))


def wk1_cells(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Records are a type, a length and a body; cells are whole numbers (13), numbers (14) and formulas (16)."""
    if raw[:6] != bytes((0, 0, 2, 0, 6, 4)):
        raise ValueError("not a WK1 file")
    at, rows, n = 6, [], 0
    while at + 4 <= len(raw):
        kind, size = struct.unpack_from("<2H", raw, at)
        body = raw[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 1:
            break
        if kind == 6:
            n = max(n, *struct.unpack("<4H", body)[2:])
        if kind in (13, 14, 16):
            r, c = struct.unpack_from("<2H", body, 1)
            w = struct.unpack_from("<h" if kind == 13 else "<d", body, 5)[0]
            n = max(n, r + 1, c + 1)
            if w > 0:
                rows.append((r, c, float(w)))
    i, j, w = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return n, i, j, w


def wk1_bytes(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> bytes:
    if n > 256:
        raise ValueError("a WK1 file has 256 columns at most")
    record = lambda kind, fmt, *values: struct.pack(f"<2H{fmt}", kind, struct.calcsize(f"<{fmt}"), *values)
    #: Settings of the worksheet between its dimension and its cells (fixed values of the format).
    head = [
        bytes((0, 0, 2, 0, 6, 4)), record(6, "4H", 0, 0, n, n), record(150, "6B", *[0] * 6), record(47, "B", 0), record(2, "b", 0), record(3, "b", 0), record(4, "b", 0), record(5, "b", 0),
        record(49, "b", 1), record(7, "2H2b13H", 0, 0, 113, 0, 10, n, n, *[0] * 8, 72, 0), record(100, "32b", *[0] * 32), record(40, "5H", 4, 76, 66, 2, 2), record(41, "c", b"'"),
    ]
    full = np.zeros((n, n))
    full[i, j] = w
    cells = [record(14, "B2Hd", 113, r, c, full[r, c]) for c in range(n) for r in range(n)]
    return b"".join([*head, *cells, struct.pack("<2H", 1, 0)])


def _read(spark: SparkSession, path: str, decode) -> Graph:
    def run(raw: pd.Series) -> pd.DataFrame:
        n, i, j, w = decode(bytes(raw.iloc[0]))
        lone = np.setdiff1d(np.arange(n), i)  # keeps n where the matrix has empty rows
        return pd.DataFrame({"i": np.concatenate([i, lone]), "j": np.concatenate([j, lone]), "w": np.concatenate([w, np.zeros(len(lone))])})

    cells = contents(spark, path).select("path", "content").groupBy("path").applyInPandas(lambda pdf: run(pdf["content"]), "i bigint, j bigint, w double")
    return Graph(cells.select(F.col("i").alias("focal"), F.col("j").alias("neighbor"), F.col("w").alias("weight")))


def _cells(g: Graph, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    n = g.nodes.count()
    if n > most:
        raise ValueError(f"this format is written by the driver, for {most} nodes at most")
    rows = g.to_sparse().toPandas()
    return n, rows["i"].to_numpy(np.int64), rows["j"].to_numpy(np.int64), rows["w"].to_numpy(float)


def read_mat(spark: SparkSession, path: str) -> Graph:
    return _read(spark, path, matlab_cells)


def write_mat(g: Graph, path: str, sparse: bool | None = None, full: int = 2_000) -> None:
    """A full matrix, or a sparse one, of ids in their order. Unless one is asked for, matrices of more than ``full`` nodes are
    sparse, as the reference writes those that don't fit in memory."""
    sparse = g.nodes.count() > full if sparse is None else sparse
    write_bytes(g.edges.sparkSession, path, matlab_parts(*_cells(g, 1_000_000 if sparse else 10_000), sparse))


def read_wk1(spark: SparkSession, path: str) -> Graph:
    return _read(spark, path, wk1_cells)


def write_wk1(g: Graph, path: str) -> None:
    write_bytes(g.edges.sparkSession, path, [wk1_bytes(*_cells(g, 256))])


def edge_list(rows: DataFrame) -> DataFrame:
    """row and col of the cells that aren't 0 of a matrix given as id and values (array)."""
    return rows.select(F.col("id").cast("bigint").alias("row"), F.posexplode("values").alias("col", "v")).filter("v <> 0").select("row", F.col("col").cast("bigint").alias("col"))
