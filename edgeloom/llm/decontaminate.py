"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (an item with fewer words is one window). Its shingles
are runs of ``shingle`` words (of all its words, if fewer). A first pass counts how often all documents hold each word
of the benchmark; shingles are ordered by the count of their rarest word. Since a window is contained only as a whole,
the prefix that must be joined is its one rarest shingle, so documents' shingles meet these prefixes and no others. The
place of the shingle in its window and the lengths of window and document bound where the window can stand, and there
its words are compared, one by one, with the document's.

The prefixes, with their windows, are broadcast while their counted bytes are within ``broadcast_bytes``: documents are then read and verified
in one pass without a shuffle. Beyond that, places of shingles are joined by a shuffle, and candidates meet the words of
their documents, which are written once, by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_side, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, after A-Z are lower-cased (fixed value).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    """Column: the words of a text; none for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() agrees with folding A-Z on ASCII texts and is much faster there
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, BETWEEN, -1), "")


def _hash(words, pos, size, most: int):
    """Of the run of ``size`` words from ``pos`` on, ``most`` at most."""
    return F.xxhash64(size, *[F.when(size > k, F.get(words, pos + k)) for k in range(most)])


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: w (words), len, and the sorted ids of the items that have them."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    n = F.size("words")
    at = F.explode(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))))
    each = words.select("item", "words", at.alias("at")).select("item", F.slice("words", F.col("at"), window).alias("w"))
    return each.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("w"))


def _prefixes(bench: DataFrame, counts: DataFrame, shingle: int) -> DataFrame:
    """The rarest shingle of each window: win, w, len, off (its place) and h."""
    n = F.least("len", F.lit(shingle))
    places = bench.select("win", "w", "len", n.alias("size"), F.explode(F.sequence(F.lit(0), F.col("len") - n)).alias("off"))
    each = places.select("win", "size", "off", F.explode(F.slice("w", F.col("off") + 1, F.col("size"))).alias("word")).join(small_side(counts, 64), "word", "left")
    rare = each.groupBy("win", "size", "off").agg(F.min(F.coalesce("often", F.lit(0))).alias("often"))
    best = rare.groupBy("win").agg(F.min(F.struct("often", "off")).alias("p")).select("win", F.col("p.off").alias("off"))
    return bench.join(best, "win").select("win", "w", "len", "off", _hash(F.col("w"), F.col("off"), n, shingle).alias("h"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, shingle: int = 5, broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """One row a document: ``id_col``, n_words, n_hit (words inside occurring windows), items (sorted ids of items
    with occurring windows) and n_items.

    Null and empty texts have no words; a very long text is one row like others. Rows are told apart by their place in the
    table, so null or repeated ids and repeated rows have their own results. An item with a null id counts as a hit but isn't
    listed. With an empty benchmark nothing is hit; an empty table gives an empty result; further columns are not read,
    whatever their names.
    """
    bench = staged(benchmark_windows(items, item_col, item_text_col, window).withColumn("win", F.monotonically_increasing_id()))
    sizes = sorted(r[0] for r in bench.select(F.least("len", F.lit(shingle)).alias("size")).distinct().collect())  # at most ``shingle`` numbers
    base = docs.select(F.struct(F.col(id_col).alias("id")).alias("who"), F.monotonically_increasing_id().alias("row"), words_of(F.col(text_col)).alias("words"))
    base = base.withColumn("n", F.size("words"))
    empty = F.array().cast("array<string>")
    if not sizes:
        return base.select(F.col("who.id").alias(id_col), F.col("n").cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), empty.alias("items"), F.lit(0).cast("bigint").alias("n_items"))

    vocabulary = staged(bench.select(F.explode("w").alias("word")).distinct())
    spoken = docs.select(F.explode(words_of(F.col(text_col))).alias("word")).join(small_side(vocabulary, 64), "word", "left_semi")
    counts = staged(spoken.groupBy("word").agg(F.count(F.lit(1)).alias("often")))
    mark = F.struct(F.lit(-1).cast("bigint").alias("win"), empty.alias("w"), F.lit(0).alias("len"), F.lit(0).alias("off"), F.xxhash64(F.lit(0)).alias("h"))
    known = bench.sparkSession.range(1).select(mark.alias("m")).select("m.*")  # meets the shingle of no words that stands for each document
    known = staged(known.unionByName(_prefixes(bench, counts, shingle)))
    weight = known.agg(F.sum(F.lit(64) + F.aggregate("w", F.lit(0), lambda s, x: s + 16 + F.octet_length(x)))).first()[0]
    whole = weight <= broadcast_bytes
    if not whole:
        base = staged(base)
    each = base.select("who", "row", "words", "n", F.explode(F.array(*[F.lit(s) for s in [0, *sizes]])).alias("size")).filter(F.col("size") <= F.col("n"))
    last = F.when(F.col("size") == 0, 0).otherwise(F.col("n") - F.col("size"))
    each = each.select("who", "row", "words", "n", "size", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    each = each.withColumn("h", _hash(F.col("words"), F.col("pos"), F.col("size"), shingle))
    if not whole:
        each = each.drop("words")
    start = F.col("pos") - F.col("off")
    met = each.join(F.broadcast(known) if whole else known, "h").filter((F.col("size") == 0) == (F.col("win") < 0)).withColumn("start", start)
    met = met.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    if not whole:
        met = met.filter("win < 0").unionByName(met.filter("win >= 0").join(base.select("row", "words"), "row"), allowMissingColumns=True)
    same = (F.col("win") < 0) | (F.slice("words", F.col("start") + 1, F.col("len")) == F.col("w"))
    met = staged(met.filter(same).select("who", "row", "n", "win", "start", "len"))

    hit = met.filter("win >= 0").select("row", "win", "start", "len")
    span = hit.select("row", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = F.max("end").over(W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    covered = span.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.col("start")))))
    covered = covered.groupBy("row").agg(F.sum("new").cast("bigint").alias("n_hit"))
    named = hit.select("row", "win").distinct().join(bench.select("win", F.explode("items").alias("item")), "win")
    listed = named.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = met.filter("win < 0").select("who", "row", "n").join(covered.join(listed, "row", "left"), "row", "left")
    return out.select(
        F.col("who.id").alias(id_col), F.col("n").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", empty).alias("items"), F.size(F.coalesce("items", empty)).cast("bigint").alias("n_items"),
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts hold no window of an item. Rows with the same id and text go or
    stay together; a null id is an id like others, and a null or empty text stays. Columns may have any names."""
    who = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.lit(1), F.col(text_col)).alias("k1"), F.xxhash64(F.lit(2), F.col(text_col)).alias("k2"))
    keyed = docs.select(who.alias("who"), F.col(text_col).alias("text"))
    hit = contamination(keyed, items, "who", "text", **options).filter("n_hit > 0").select(F.col("who").alias("bad")).distinct()
    hit = small_side(staged(hit), 96)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), who.alias("who"))
    same = [F.col(f"who.{k}").eqNullSafe(F.col(f"bad.{k}")) for k in ("id", "k1", "k2")]
    return row.join(hit, same[0] & same[1] & same[2], "left_anti").select("row.*")
