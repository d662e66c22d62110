"""Quality rules with cross-document line frequency.

Lines are normalised and hashed. For each line and host the distinct documents (rows) that hold it are counted. Lines
of more documents of a host than the limit are boilerplate there and are taken out; a document that loses more than
half of its words is depleted and rejected. Copies of a document count like others, so a text with more copies on one
host than the limit is depleted.

Counts are partial aggregates keyed by host and line, so a hot host or a hot line is one row a task before the shuffle.
The few lines above the limit come back to the rows by broadcast while their counted number is within a bound, and by
a plain equi-join, which adaptive execution splits where a line is hot, beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codes, slices, small_side, staged, sums
from .lines import Lines
from .site_spread import _LINE, _arrow, _lines, _marked

#: Characters counted as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True


def _repeated_words(view: Lines) -> np.ndarray:
    """Words of each text inside 3-word windows that the text has twice or more."""
    at = np.flatnonzero(view.begins)
    n = len(view.offs) - 1
    if len(at) < 3:
        return np.zeros(n, np.int64)
    keep = view.inside
    before = np.concatenate([[0], np.cumsum(keep)])
    places = np.concatenate([before[at], [int(keep.sum())]]).astype(np.int32)
    word, distinct = codes(pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(view.buf[keep])))
    doc = np.searchsorted(view.offs, at, side="right") - 1
    same = doc[:-2] == doc[2:]
    size = np.int64(len(distinct))
    pairs, pair = np.unique(word[:-1] * size + word[1:], return_inverse=True)
    key = (doc[:-2] * np.int64(len(pairs)) + pair[:-1]) * size + word[2:]
    window = np.flatnonzero(same)
    _, back, times = np.unique(key[window], return_inverse=True, return_counts=True)
    hit = np.zeros(len(at), bool)
    twice = window[times[back] > 1]
    for k in range(3):
        hit[twice + k] = True
    return np.bincount(doc[hit], minlength=n)


def measure(docs: DataFrame, host_col: str, id_col: str, text_col: str) -> DataFrame:
    """One row a document: its place, the host's hash, base counts, and its distinct lines with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            view = Lines(batch.column(3))
            n = batch.num_rows
            h1, h2 = view.hashes(0, 1)
            raw, distinct = codes(view.strings())
            has = np.flatnonzero(view.words > 0)
            once = np.unique(view.doc[has] * np.int64(max(len(distinct), 1)) + raw[has])
            dup = np.bincount(view.doc[has], minlength=n) - np.bincount(once // max(len(distinct), 1), minlength=n)
            order = has[np.lexsort((h2[has], h1[has], view.doc[has]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (view.doc[order][1:] != view.doc[order][:-1]) | (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            first = np.flatnonzero(fresh)
            words = np.add.reduceat(view.words[order], first) if len(first) else np.zeros(0, np.int64)
            ends = np.searchsorted(view.doc[order][first], np.arange(n + 1))
            fields = {"h1": pa.array(h1[order][first]), "h2": pa.array(h2[order][first]), "words": pa.array(words, pa.int64())}
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
            inner = view.inside & ((view.buf & 0xC0) != 0x80)
            counts = (view.per_text(view.words), sums(inner, view.offs), sums(_symbol[view.buf], view.offs), dup, _repeated_words(view))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(x, pa.int64()) for x in counts), lists], names)

    names = [id_col, "row", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
    kind = dict(docs.dtypes)[id_col]
    host = F.xxhash64(F.col(host_col).isNull(), F.col(host_col))  # a null has a hash of its own
    return docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), host.alias("host"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, `row` bigint, host bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<h1:bigint,h2:bigint,words:bigint>>"
    )


def quality_rules(
    docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
    max_documents: int = 20, max_removed: float = 0.5, min_words: int = 50, max_repeat: float = 0.5,
) -> DataFrame:
    """``id_col``, counts, n_removed_words, base_failed and kept of every row.

    A null or empty text has no words and fails the base rules. Null hosts are one host. Null and repeated ids and
    repeated rows keep a row each and count as documents each. A very long text is read as one. Empty tables give an empty
    result; further columns are not read, whatever their names. Lines have hashes of 128 bits, hosts of 64.
    """
    seen = staged(measure(docs, host_col, id_col, text_col))
    held = seen.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.*")
    often = held.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > max_documents)
    bad = staged(often.select("host", "h1", "h2"))
    lost = held.join(small_side(bad, 64), ["host", "h1", "h2"]).groupBy("row").agg(F.sum("words").alias("lost"))
    out = seen.drop("lines", "host").join(lost, "row", "left").withColumn("n_removed_words", F.coalesce("lost", F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return out.select(
        F.col(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", failed.alias("base_failed"),
        (~failed & (F.col("n_removed_words") <= max_removed * F.col("n_words"))).alias("kept"),
    )


def without_frequent_lines(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", max_documents: int = 20, broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """All rows and columns of ``docs`` with the text without its frequent lines (those on over ``max_documents`` documents of
    the row's host), and n_removed_lines (long).

    Null texts stay null and empty ones empty; a text of such lines only becomes empty. A null host is one host. Repeated rows
    count as documents each. A very long text is read as one. An empty table gives an empty result. A column of ``docs`` named
    n_removed_lines is replaced; others keep their values, whatever their names.
    """
    names = [c for c in docs.columns if c != "n_removed_lines"]
    host = F.xxhash64(F.col(host_col).isNull(), F.col(host_col))
    lines = _arrow(_lines, f"array<{_LINE}>")(F.coalesce(F.col(text_col), F.lit("")))
    seen = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), host.alias("host"), lines.alias("lines"), F.monotonically_increasing_id().alias("number"))
    of_host = F.transform("lines", lambda x: F.struct(x["pos"], F.xxhash64("host", x["h1"]).alias("h1"), F.xxhash64("host", x["h2"]).alias("h2"), x["words"]))
    seen = staged(seen.select("row", "number", of_host.cast(f"array<{_LINE}>").alias("lines")))
    once = F.array_distinct(F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
    often = seen.select(F.explode(once).alias("l")).groupBy("l.h1", "l.h2").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > max_documents)
    hit = _marked(seen, staged(often.select("h1", "h2")), broadcast_bytes)
    text, n = F.col("row")[text_col], F.size("lines")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, k: ~F.coalesce(F.get("marks", k), F.lit(False))), "\n")
    out = hit.select("row", n.cast("bigint").alias("n"), F.when(n == 0, text).otherwise(kept).alias("clean"))
    return out.select(*[F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names], F.col("n").alias("n_removed_lines"))
