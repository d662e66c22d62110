"""Substring dedup by hashes of passages: of equal passages the earliest ranked one stays.

Units are lines and paragraphs (what stands between blank lines) of at least ``line_words`` words, and runs of sentences:
a text is cut after every sentence end and, in a stretch of over ``STRETCH`` words without one, after words that their own
hash chooses, so that equal words are cut alike wherever they stand; from every cut on, and from the text's end back, the
shortest run of at least ``min_words`` words is a unit; a text of fewer words is one. So every word of a text is in some unit,
a short line is found by itself, and a longer passage inside longer lines, over lines wrapped otherwise, and between other
words before and after it.

Half of each digest is counted over the whole corpus with a partial aggregate, so a unit of a third of all documents is
one row a task before the shuffle. Only units whose half occurs twice or more go on; of these, whole digests of 128 bits
are grouped (count, earliest place) and joined back to their places.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codes, slices, staged, text_bytes, worker_cache
from .lines import _space

#: A word that ends a sentence: one of these marks, and closing quotes or brackets after it (fixed value).
SENTENCE_END = r"[.!?。！？][\"')\]]*$"
#: Words without a sentence end beyond which hashes choose the cuts, and of how many words one is chosen on average.
STRETCH, ONE_OF = 20, 8
_end = re.compile(SENTENCE_END)
_base = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _word(word: str) -> tuple[bool, bool, int, int]:
    """Whether a word ends a sentence, whether its hash chooses it, and its two hashes."""
    raw = word.encode()
    return _end.search(word) is not None, hashlib.md5(raw).digest()[0] % ONE_OF == 0, xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)


def _runs(doc: np.ndarray, words: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last part of each unit, in order: the shortest runs of at least ``min_words`` words that begin at each
    part or end with the text; a text of fewer words is one run."""
    total = np.concatenate([[0], np.cumsum(words)])
    at, low, high = np.arange(len(words)), first[doc], first[doc + 1]
    hi = np.searchsorted(total, total[:-1] + min_words) - 1
    ahead = np.flatnonzero(hi < high)
    ends = high[low == at]  # after the last part of each text that has words
    back = np.maximum(np.searchsorted(total, total[ends] - min_words, side="right") - 1, low[ends - 1])
    runs = np.concatenate([at[ahead] << 32 | hi[ahead], back << 32 | (ends - 1)])
    runs = np.unique(runs)
    return runs >> 32, runs & 0xFFFFFFFF


def _digests(h: np.ndarray, base: np.uint64, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the ranges of word hashes from ``lo`` to ``hi``, by differences of sums (modulo 2**64)."""
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), base, np.uint64)]), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), inverse, np.uint64)]), dtype=np.uint64)
    x = (total[hi + 1] - total[lo]) * back[lo] + (hi - lo + 1).astype(np.uint64) * _base[0]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _stretches(begins: np.ndarray, least: int) -> np.ndarray:
    """First and last word (as one number) of each stretch of ``least`` words or more; ``begins``: words that begin one."""
    a = np.flatnonzero(begins)
    b = np.concatenate([a[1:], [len(begins)]]) - 1
    return (a << 32 | b)[b - a + 1 >= least]


def passages(column: pa.Array, min_words: int, line_words: int) -> tuple[np.ndarray, ...]:
    """Units of all texts in order: n + 1 offsets, then start, end (characters of the text), h1 and h2 of each."""
    buf, offs = text_bytes(column)
    inside = ~_space[buf]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    fresh = offs[:-1][offs[:-1] < len(buf)]
    begins[fresh] = inside[fresh]
    ends[fresh[fresh > 0] - 1] = inside[fresh[fresh > 0] - 1]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    none = np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(len(offs), np.int64), none, none, none, none
    before = np.concatenate([[0], np.cumsum(inside)])
    places = np.concatenate([before[at], [int(inside.sum())]]).astype(np.int32)
    low = buf[inside]
    low = np.where((low >= 65) & (low <= 90), low + 32, low).astype(np.uint8)
    which, distinct = codes(pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(low)))
    known: dict[str, tuple[bool, bool, int, int]] = worker_cache("passages", dict)
    if len(known) > 150_000:
        known.clear()
    each = []
    for w in distinct.to_pylist():
        got = known.get(w)
        if got is None:
            got = known[w] = _word(w)
        each.append(got)
    full, chosen, h1, h2 = (np.array(x, kind)[which] for x, kind in zip(zip(*each, strict=True), (bool, bool, np.uint64, np.uint64), strict=True))
    first = np.searchsorted(at, offs)
    last = first[1:][np.diff(first) > 0] - 1
    full[last] = True
    sentence = np.cumsum(full) - full
    cut = np.flatnonzero(full | (chosen & (np.bincount(sentence)[sentence] > STRETCH)))
    start = np.concatenate([[0], cut[:-1] + 1])
    doc = np.searchsorted(offs, at[start], side="right") - 1
    lo, hi = _runs(doc, cut - start + 1, np.searchsorted(doc, np.arange(len(offs))), min_words)
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    gap = np.concatenate([[0], breaks[at[1:]] - breaks[to[:-1]]])  # line breaks before a word
    gap[first[:-1][np.diff(first) > 0]] = 2
    units = np.unique(np.concatenate([start[lo] << 32 | cut[hi], _stretches(gap > 0, line_words), _stretches(gap > 1, line_words)]))
    a, b = units >> 32, units & 0xFFFFFFFF
    doc = np.searchsorted(offs, at[a], side="right") - 1
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    base = chars[offs[doc]]
    n = np.searchsorted(doc, np.arange(len(offs)))
    return n, chars[at[a]] - base, chars[to[b]] - base, _digests(h1, _base[0], a, b), _digests(h2, _base[1], a, b)


def _units(docs: DataFrame, id_col: str, text_col: str, min_words: int, line_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, start, end, h1, h2 = passages(batch.column(2), min_words, line_words)
            fields = {"start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "h1": pa.array(h1), "h2": pa.array(h2)}
            units = pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), units], [id_col, "row", "units"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, `row` bigint, units array<struct<start:int,end:int,h1:bigint,h2:bigint>>"
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the places of each row: those that overlap or touch as one, ascending."""
    for batch in batches:
        places = batch.column(4)
        owner = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
        start, end = (places.flatten().field(k).to_numpy() for k in (0, 1))
        order = np.lexsort((end, start, owner))
        owner, start, end = owner[order], start[order].astype(np.int64), end[order].astype(np.int64)
        reach = np.maximum.accumulate(end + (owner << 32)) - (owner << 32)  # furthest end so far in the row
        new = np.ones(len(start), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])
        at = np.flatnonzero(new)
        stop = np.concatenate([at[1:], [len(start)]]) - 1 if len(at) else at
        ends = np.searchsorted(owner[at], np.arange(batch.num_rows + 1)).astype(np.int32)
        merged = pa.StructArray.from_arrays([pa.array(start[at]), pa.array(reach[stop])], ["start", "end"])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.ListArray.from_arrays(pa.array(ends), merged)], [*batch.schema.names[:4], "removed"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, line_words: int = 10) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_units, n_repeated (units that occur in other rows too, the kept
    occurrences included), n_removed (units that aren't their first occurrence), removed (the places to take out: structs of start
    and end in characters of the original text, ascending, without overlaps) and kept_in (sorted ids of the rows where
    the first occurrences stay; null ids aren't listed).

    Words are parted by ASCII white space and compared with A-Z folded. Rank: by id, nulls last, then by the order of the
    rows in the table, then by place. So the first of repeated rows keeps its units and the others lose them. A unit that
    overlaps its first occurrence in its own text loses only what comes after that. Null and empty texts have no units; a
    very long text has many, and is read in one piece; an empty table gives an empty result; further columns are not read.
    """
    seen = staged(_units(docs, id_col, text_col, min_words, line_words))
    each = seen.select(F.col(id_col).alias("id"), "row", F.explode("units").alias("u")).select("id", "row", "u.*")
    often = each.groupBy("h1").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1).select("h1")
    met = staged(each.join(staged(often), "h1", "left_semi"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row", "start", "end")
    first = met.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("kept"), (F.min("row") != F.max("row")).alias("shared")).filter(F.col("times") > 1)
    first = first.select("h1", "h2", "shared", F.col("kept.row").alias("kept_row"), F.col("kept.start").alias("kept_start"), F.col("kept.end").alias("kept_end"), F.col("kept.id").alias("kept_id"))
    first = staged(first)  # a table of its own, so that adaptive execution can split a hot digest
    own = F.col("row") == F.col("kept_row")
    met = met.drop("id").join(first, ["h1", "h2"])
    again = ~own | (F.col("start") != F.col("kept_start"))
    left = F.struct(F.when(own, F.greatest("start", F.col("kept_end"))).otherwise(F.col("start")).alias("start"), F.col("end"))
    found = met.groupBy("row").agg(
        F.count_if("shared").alias("n_repeated"), F.count_if(again).alias("n_removed"), F.sort_array(F.collect_set(F.when(~own, F.col("kept_id")))).alias("kept_in"),
        F.collect_list(F.when(again & (left["start"] < left["end"]), left)).alias("places"),
    )
    kind = dict(docs.dtypes)[id_col]
    gone = found.mapInArrow(_merged, f"`row` bigint, n_repeated bigint, n_removed bigint, kept_in array<{kind}>, removed array<struct<start:bigint,end:bigint>>")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return seen.select(F.col(id_col), "row", F.size("units").cast("bigint").alias("n_units")).join(gone, "row", "left").select(
        F.col(id_col), "n_units", F.coalesce("n_repeated", F.lit(0)).cast("bigint").alias("n_repeated"), F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("removed", none).alias("removed"), F.coalesce("kept_in", F.array().cast(f"array<{kind}>")).alias("kept_in"),
    )


def without(text, removed):
    """Column: ``text`` without the places in ``removed``."""
    start = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(removed, lambda r: r["end"]))
    end = F.concat(F.transform(removed, lambda r: r["start"]), F.array(F.length(text).cast("bigint")))
    return F.array_join(F.transform(F.arrays_zip(start.alias("a"), end.alias("b")), lambda p: text.substr((p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))), "")
