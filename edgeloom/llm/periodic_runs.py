"""Periodic runs of words: stretches that repeat themselves ``exponent`` times or more, found by a scan of all lags.

The words of a text are numbers. For every lag up to 1 / exponent of the text's words, the array is compared with itself
shifted by the lag, and stretches of true places give the runs. A stretch counts only from (exponent - 1) x lag true places
on, so one of any so many neighboring places must lie in it: the comparison is made at those places first (for the texts of a
batch at once, longest first), and in full where one of them is true. A stretch is a run of its smallest period only: if the
period could be a divisor of the lag, the stretch belongs to that one.

Short texts are scanned where they are read. The lags of a long text are dealt out in ranges: each range is a row with the
text's numbers, so that one text's lags are scanned by several machines. The runs found are gathered by text and joined to
it; texts themselves are shuffled only if all runs are too many to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codes, id_fields, slices, staged, text_bytes
from .lines import _space

#: (start, length, period)
Run = tuple[int, int, int]
Fold = Callable[[object, int], tuple[int, int] | None]


@cache
def _divisors(q: int) -> tuple[int, ...]:
    """q / r for each prime r that divides q: a smaller period of a stretch of period q divides one of them."""
    out, rest, r = [], q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            out.append(q // r)
            while rest % r == 0:
                rest //= r
        r += 1
    return tuple(out)


def scan(words: np.ndarray, offs: np.ndarray, low: int, high: int, exponent: int, least: int) -> list[tuple[int, int, int, int]]:
    """(text, start, length, lag) of all runs with lags from ``low`` to below ``high``. ``words``: numbers of the words of
    texts, longest text first, equal within one text only; ``offs``: n + 1 offsets of the texts."""
    sizes = np.diff(offs)
    out: list[tuple[int, int, int, int]] = []
    for q in range(low, high):
        need = max(least, exponent * q) - q  # true places in a row
        texts = int(np.searchsorted(-sizes, -(need + q), side="right"))  # those with as many words
        size = int(offs[texts]) - q
        if size < need:
            break
        at = np.flatnonzero(words[need - 1 : size : need] == words[need - 1 + q : size + q : need]) * need + (need - 1)
        for j in {1, need // 2, need // 3, need - 1}:  # a stretch that holds the place holds one of these two as well
            if not len(at):
                break
            after = np.minimum(at + need - j, size - 1)
            at = at[(words[at - j] == words[at - j + q]) | ((at + need - j < size) & (words[after] == words[after + q]))]
        if not len(at):
            continue
        owner = np.searchsorted(offs, at, side="right") - 1
        for t in np.unique(owner).tolist():
            a, b = int(offs[t]), int(offs[t + 1])
            breaks = np.concatenate([[-1], np.flatnonzero(words[a : b - q] != words[a + q : b]), [max(b - q - a, 0)]])
            k = np.unique(np.searchsorted(breaks, at[owner == t] - a, side="left"))
            for x, y in zip((breaks[k - 1] + 1).tolist(), breaks[k].tolist(), strict=True):
                if y - x >= need and not any((words[a + x : a + x + q] == words[a + x + d : a + x + d + q]).all() for d in _divisors(q)):
                    out.append((t, x, y - x + q, q))
    return out


class Words:
    """The words of a column of texts as numbers, folded where ``fold`` says so."""

    def __init__(self, column: pa.Array, ids: list, fold: Fold | None):
        self.buf, self.bytes_at = buf, offs = text_bytes(column)
        self.inside = inside = ~_space[buf]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        fresh = offs[:-1][offs[:-1] < len(buf)]
        begins[fresh] = inside[fresh]
        self.begins = begins
        at = np.flatnonzero(begins)
        self.offs = np.searchsorted(at, offs)
        before = np.concatenate([[0], np.cumsum(inside)])
        places = np.append(before[at], before[-1]).astype(np.int32)
        self.number, distinct = codes(pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(buf[inside]))) if len(at) else (np.zeros(0, np.int64), pa.array([], pa.string()))
        self.names = distinct
        self.folded: set[int] = set()
        for i, n in enumerate(np.diff(self.offs).tolist()) if fold else ():
            if n and (given := fold(ids[i], n)):
                start, period = given
                own = self.number[self.offs[i] : self.offs[i + 1]]
                own[start:] = own[start + np.arange(n - start) % period]
                self.folded.add(i)

    def own(self, i: int) -> np.ndarray:
        return self.number[self.offs[i] : self.offs[i + 1]]

    def runs(self, exponent: int, least: int) -> list[list[Run]]:
        """Runs of every text, by start and then period."""
        n = np.diff(self.offs)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] >= least]
        found: list[list[Run]] = [[] for _ in n]
        if len(order):
            text = np.repeat(np.arange(len(order)), n[order])
            ends = np.cumsum(n[order])
            take = np.arange(int(ends[-1])) + np.repeat(self.offs[order] - (ends - n[order]), n[order])
            words = text * np.int64(max(len(self.names), 1)) + self.number[take]
            for t, s, length, q in scan(words, np.concatenate([[0], ends]), 1, int(n[order[0]]) // exponent + 1, exponent, least):
                found[order[t]].append((s, length, q))
        return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]

    def collapsed(self, runs: list[list[Run]]) -> list[str]:
        """Texts of the words that are kept, joined by one space. A run keeps its first period."""
        first = self.begins.copy()
        first[self.bytes_at[:-1][np.diff(self.bytes_at) > 0]] = False
        gap = np.zeros(len(self.buf), bool)  # the white space just before a word
        gap[:-1] = first[1:] & ~self.inside[:-1]
        keep = self.inside | gap
        flat = np.where(gap, np.uint8(32), self.buf)[keep].tobytes()
        total = np.concatenate([[0], np.cumsum(keep)])[self.bytes_at]
        out = []
        for i, found in enumerate(runs):
            if found or i in self.folded:
                own, drop = self.own(i), np.zeros(len(self.own(i)), bool)
                for s, length, q in found:
                    drop[s + q : s + length] = True
                out.append(" ".join(self.names.take(pa.array(own[~drop])).to_pylist()))
            else:
                out.append(flat[total[i] : total[i + 1]].decode().lstrip(" "))
        return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest exact length / period; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6, fold: Fold | None = None,
    long_bytes: int = 1 << 15, lags: int = 2048, most_ranges: int = 16,
) -> DataFrame:
    """A row a document: ``id_col``, n_words, runs (array of start, length and period, by start and period), best (the run with
    the greatest length / period, or null) and collapsed (the text of the words outside repetitions, joined by one space).

    fold: gives for an id and a number of words the start and period from which a text repeats itself, or None; texts are
    scanned after it (made-up repetitions to measure with). A run has ``least`` words or more. Texts of more than
    ``long_bytes`` bytes are scanned in ranges of at least ``lags`` lags, ``most_ranges`` at most. Null and empty texts have no
    words, no runs and an empty collapsed text. Null and repeated ids and repeated rows give a result each. An empty table
    gives an empty result; further columns are not read, whatever their names.
    """
    if exponent < 2 or least < 2:
        raise ValueError("exponent and least must be 2 or more")
    key = [F.xxhash64(F.lit(k), F.col(id_col).isNull(), F.col(id_col), F.col(text_col)).alias(f"k{k}") for k in (1, 2)]
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *key)
    kind = dict(docs.dtypes)["id"]
    long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))

    def result(batch: pa.RecordBatch, words: Words, runs: list[list[Run]]) -> pa.RecordBatch:
        fields = ["start", "length", "period"]
        one = pa.struct([(f, pa.int64()) for f in fields])
        as_rows = [[dict(zip(fields, r, strict=True)) for r in x] for x in runs]
        best = [b and dict(zip(fields, b, strict=True)) for b in map(strongest, runs)]
        arrays = [batch.column(0), pa.array(np.diff(words.offs), pa.int64()), pa.array(as_rows, pa.list_(one)), pa.array(best, one), pa.array(words.collapsed(runs), pa.string())]
        return pa.RecordBatch.from_arrays(arrays, [id_col, "n_words", "runs", "best", "collapsed"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(1), batch.column(0).to_pylist() if fold else [], fold)
            yield result(batch, words, words.runs(exponent, least))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(1), batch.column(0).to_pylist() if fold else [], fold)
            for i in range(batch.num_rows):
                own = words.own(i)
                top = len(own) // exponent
                if top:
                    parts = min(most_ranges, -(-top // lags))
                    ends = [1 + top * k // parts for k in range(parts + 1)]
                    again = [pa.array([batch.column(c)[i].as_py()] * parts, pa.int64()) for c in (2, 3)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(parts + 1) * len(own), pa.int32()), pa.array(np.tile(own.astype(np.int32), parts)))
                    yield pa.RecordBatch.from_arrays([*again, pa.array(ends[:-1], pa.int32()), pa.array(ends[1:], pa.int32()), lists], ["k1", "k2", "low", "high", "words"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(4)[k].values.to_numpy()
                found = scan(own, np.array([0, len(own)]), batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), exponent, least)
                if found:
                    same = [pa.array([batch.column(c)[k].as_py()] * len(found), pa.int64()) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(x, pa.int64()) for x in list(zip(*found, strict=True))[1:])], ["k1", "k2", "start", "length", "period"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(1), batch.column(0).to_pylist() if fold else [], fold)
            given = [sorted(((r["start"], r["length"], r["period"]) for r in x or ()), key=lambda r: (r[0], r[2])) for x in batch.column(2).to_pylist()]
            yield result(batch, words, given)

    out = f"{id_fields(docs, ('id',)).replace('`id`', f'`{id_col}`')}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, best struct<start:bigint,length:bigint,period:bigint>, collapsed string"
    short = docs.filter(~long).select("id", "text").mapInArrow(whole, out)
    units = docs.filter(long).mapInArrow(ranges, "k1 bigint, k2 bigint, low int, high int, words array<int>")
    dealt = units.repartition("k1", "k2", "low").mapInArrow(scanned, "k1 bigint, k2 bigint, start bigint, length bigint, period bigint")
    runs = staged(dealt.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "length", "period")).alias("runs")))
    size = runs.agg(F.sum(F.size("runs") * 24 + 64)).first()[0] or 0
    texts = docs.filter(long).join(F.broadcast(runs) if size <= 16 << 20 else runs, ["k1", "k2"], "left").select("id", "text", "runs")
    return short.unionByName(texts.mapInArrow(joined, out))


def digests(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of a table of ``periodic_runs``."""
    line = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    milli = F.expr("best.length * 1000 div best.period")
    return out.select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
