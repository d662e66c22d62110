"""Line dedup by distinct-site spread.

Every normalised line gets a HyperLogLog sketch of the sites that hold it; sketches merge by aggregation, in part
before the shuffle, so a line on every page of the web costs one small row a task. Lines whose estimate is near the
limit are counted exactly. Lines of more sites than the limit are boilerplate and are taken out of all texts.

Texts are never shuffled: rows with the places of their lines are written once, and the few lines of boilerplate, if
their counted number is within a bound, come to the tasks that read them back. Beyond that bound the lines are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, worker_cache
from .lines import Lines

_LINE = "struct<pos:int,h1:bigint,h2:bigint,words:int>"


def _lines(column: pa.Array) -> pa.Array:
    """The lines with a word of each text: place, two hashes, words."""
    out = []
    worker_cache("site_spread", dict)  # nothing to keep, and nothing of others
    for batch in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
        view = Lines(batch.column(0))
        h1, h2 = view.hashes(0, 1)
        pos = np.arange(len(h1)) - view.first[view.doc]
        out.append(view.lists(view.words > 0, pos=pos.astype(np.int32), h1=h1, h2=h2, words=view.words.astype(np.int32)))
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.int32())]))
    return pa.concat_arrays([x.cast(kind) for x in out]) if out else pa.array([], kind)


def spread_lines(seen: DataFrame, max_sites: int, log2_k: int = 12) -> DataFrame:
    """h1 and h2 of the ``lines`` on more than ``max_sites`` distinct values of ``site``."""
    each = seen.select("site", F.explode("lines").alias("l")).select("site", "l.h1", "l.h2")
    sketched = each.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", log2_k).alias("sites"))
    margin = max(1.0, 6 * 1.04 / 2 ** (log2_k / 2) * max_sites)
    guess = staged(sketched.select("h1", "h2", F.hll_sketch_estimate("sites").alias("sites")).filter(F.col("sites") > max_sites - margin))
    sure = guess.filter(F.col("sites") > max_sites + margin).select("h1", "h2")
    near = guess.filter(F.col("sites") <= max_sites + margin).select("h1", "h2")
    counted = each.join(near, ["h1", "h2"]).groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
    return sure.unionByName(counted.filter(F.col("sites") > max_sites).select("h1", "h2"))


def _among(lines: pa.Array, known: np.ndarray) -> pa.Array:
    """Those of the lines whose hashes are in ``known``, and for each text whether its lines are among them, up to the last that is."""
    flat, size = lines.flatten(), lines.value_lengths().to_numpy(zero_copy_only=False)
    pos, h1, h2 = (flat.field(k).to_numpy() for k in range(3))
    keep = np.isin(h1, known["h1"])
    at = np.flatnonzero(keep)
    both = np.empty(len(at), known.dtype)
    both["h1"], both["h2"] = h1[at], h2[at]
    keep[at] = np.isin(both, known)
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size)])]
    n, pos = np.diff(ends), pos[keep].astype(np.int64)
    last = np.where(n > 0, np.concatenate([[0], pos + 1])[np.where(n > 0, ends[1:], 0)], 0)
    total = np.concatenate([[0], np.cumsum(last)])
    marks = np.zeros(int(total[-1]), bool)
    marks[np.repeat(total[:-1], n) + pos] = True
    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(keep)))
    return pa.StructArray.from_arrays([found, pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(marks))], ["lines", "marks"])


_HIT = f"struct<lines:array<{_LINE}>,marks:array<boolean>>"


def _marked(seen: DataFrame, bad: DataFrame, most_bytes: int) -> DataFrame:
    """``seen`` with only those of its ``lines`` that are in ``bad`` (staged), and ``marks``: which of a text's lines these are."""
    if bad.count() * 16 > most_bytes:
        found = seen.select("number", F.explode("lines").alias("l")).select("number", "l.*").join(bad, ["h1", "h2"])
        found = found.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("lines"))
        every = _arrow(lambda lines: _among(lines, _pairs(lines.flatten())), _HIT)  # all that were joined
        hit = seen.drop("lines").join(found, "number", "left").withColumn("hit", every(F.coalesce("lines", F.array().cast(f"array<{_LINE}>"))))
    else:
        pairs = np.array([tuple(r) for r in bad.collect()], [("h1", np.int64), ("h2", np.int64)])  # within ``most_bytes``
        known = seen.sparkSession.sparkContext.broadcast(np.sort(pairs))
        hit = seen.withColumn("hit", _arrow(lambda lines: _among(lines, known.value), _HIT)(F.col("lines")))
    return hit.drop("lines").withColumns({"lines": F.col("hit.lines"), "marks": F.col("hit.marks")}).drop("hit")


def _pairs(lines: pa.Array) -> np.ndarray:
    out = np.empty(len(lines), [("h1", np.int64), ("h2", np.int64)])
    out["h1"], out["h2"] = (lines.field(k).to_numpy() for k in (1, 2))
    return np.unique(out)


def _arrow(f, kind: str):
    """An Arrow function of one column."""

    def run(column: pa.Array) -> pa.Array:
        return f(column)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def _words(lines):
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda n, x: n + x["words"])


def remove_spread_lines(
    docs: DataFrame, site_col: str = "source", text_col: str = "text", max_sites: int = 10,
    max_removed: float | None = None, voters: float | None = None, broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """All rows and columns of ``docs`` with the cleaned text, and n_removed_lines (long) and n_removed_chars (long).

    Null texts stay null and empty ones empty; a text of such lines only becomes empty. A null site is one site. Repeated
    rows are treated alike. A very long text is read as one. An empty table gives an empty result. Columns of ``docs``
    that clash with the two new names are replaced; others keep their values, whatever their names.

    Two options, both off. ``max_removed``: a text that would lose over this share of its words stays as it is.
    ``voters``: sites are counted again, without the texts of which over this share of the words stands in spread
    lines; these are copies of a text that went round the sites, and their common lines are their own. What is still
    spread then goes from all texts, these included.
    """

    names = [c for c in docs.columns if c not in ("n_removed_lines", "n_removed_chars")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    site = F.xxhash64(F.col(site_col).isNull(), F.col(site_col))
    seen = staged(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), site.alias("site"), _arrow(_lines, f"array<{_LINE}>")(text).alias("lines"), F.monotonically_increasing_id().alias("number"))
    )
    seen = seen.withColumn("n_words", _words(F.col("lines")))
    bad = staged(spread_lines(seen, max_sites))
    if voters is not None:  # written first: a filter over an Arrow function's result would call it a second time below
        own = staged(_marked(seen.drop("row"), bad, broadcast_bytes).select("site", "lines", "n_words"))
        bad = staged(spread_lines(own.filter(_words(F.col("lines")) <= voters * F.col("n_words")), max_sites))
    hit = _marked(seen, bad, broadcast_bytes)
    take = F.size("lines") > 0
    if max_removed is not None:
        take &= _words(F.col("lines")) <= max_removed * F.col("n_words")
    out = hit.select("row", F.when(take, F.size("lines")).otherwise(0).cast("bigint").alias("n"), "marks")
    text = F.col("row")[text_col]
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, k: ~F.coalesce(F.get("marks", k), F.lit(False))), "\n")
    out = out.select("row", "n", F.when(F.col("n") == 0, text).otherwise(kept).alias("clean"))
    return out.select(
        *[F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names],
        F.col("n").alias("n_removed_lines"), F.coalesce(F.length(text) - F.length("clean"), F.lit(0)).cast("bigint").alias("n_removed_chars"),
    )
