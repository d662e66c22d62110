"""Importance resampling towards a target distribution, on hashed n-grams counted by DuckDB in each partition.

Every task has a DuckDB of its own: SQL cuts the texts of an Arrow batch into words, unnests them, makes n-grams with window
functions and puts each distinct n-gram into a bucket with a registered function (CRC-32 of zlib). The counts by text and
bucket, and one row with the task's totals by bucket, are written to Parquet in the shared folder. Spark adds up the totals of
the corpus and of the target (one row a bucket: their number is a parameter), scores every text by the buckets' gains, and ranks
scores plus Gumbel noise made of a hash of the id, so that the same rows are drawn whatever the partitions.

Texts are read once and not shuffled. The ranking sorts by ranges and numbers each range from its first place, so no task
sees all scores and a score that many texts share is no hot key (ids and places break ties).
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_fields, slices, small_side, staged

#: Letters that are folded, and what a word is made of (fixed values).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ngram_sql(most: int) -> str:
    """Table ``grams`` (row, gram) of all n-grams up to ``most`` words, from table ``words`` (row, pos, word)."""
    each = ["SELECT row, word AS gram FROM words"]
    for n in range(2, most + 1):
        parts = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER w" for k in range(1, n)]])
        each.append(f"SELECT row, {parts} AS gram FROM words WINDOW w AS (PARTITION BY row ORDER BY pos)")
    return f"SELECT row, gram FROM ({' UNION ALL '.join(each)}) WHERE gram IS NOT NULL"


class Counter:
    """A DuckDB of a task: counts by text and bucket of Arrow batches, and their totals."""

    def __init__(self, most: int, buckets: int, folder: str):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": folder})
        self.db.create_function("crc", self._crc, ["VARCHAR"], "BIGINT", type="arrow")
        self.db.execute("CREATE TABLE totals (bucket INTEGER PRIMARY KEY, n BIGINT)")
        self.steps = [
            f"CREATE OR REPLACE TEMP TABLE lists AS SELECT row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS list FROM batch",
            "CREATE OR REPLACE TEMP TABLE words AS SELECT row, unnest(list) AS word, generate_subscripts(list, 1) AS pos FROM lists",
            f"""CREATE OR REPLACE TEMP TABLE counts AS WITH grams AS ({ngram_sql(most)}), by_gram AS (SELECT row, gram, count(*) AS n FROM grams GROUP BY ALL),
            placed AS (SELECT gram, crc(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM by_gram))
            SELECT row, bucket::INTEGER AS bucket, sum(n)::BIGINT AS n FROM by_gram JOIN placed USING (gram) GROUP BY ALL""",
            "INSERT INTO totals SELECT bucket, sum(n)::BIGINT FROM counts GROUP BY bucket ON CONFLICT (bucket) DO UPDATE SET n = totals.n + excluded.n",
        ]

    @staticmethod
    def _crc(grams):
        return pa.array([zlib.crc32(x) for x in grams.cast(pa.binary()).to_pylist()], pa.int64())

    def count(self, texts: pa.Array) -> pa.Table:
        """n_words, n_features, buckets and times of each text, in order."""
        self.db.register("batch", pa.table([pa.array(range(len(texts)), pa.int32()), texts], ["row", "text"]))
        for step in self.steps:
            self.db.execute(step)
        self.db.unregister("batch")
        return self.db.sql(
            """SELECT coalesce(len(list), 0)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(buckets, []) AS buckets, coalesce(times, []) AS times
            FROM lists LEFT JOIN (SELECT row, sum(n) AS n_features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS times FROM counts GROUP BY row) USING (row) ORDER BY row"""
        ).to_arrow_table()

    def totals(self) -> tuple[list[int], list[int]]:
        rows = self.db.execute("SELECT bucket, n FROM totals ORDER BY bucket").fetchall()
        return [r[0] for r in rows], [r[1] for r in rows]


def bucket_counts(texts: DataFrame, most: int, buckets: int, id_col: str | None = None, text_col: str = "text") -> DataFrame:
    """A staged table: a row a text (id, row: its place, n_words, n_features, buckets, times) if ``id_col`` is given, and a row for
    each task (total true) with its buckets and times."""
    names = ["id", "row", "n_words", "n_features", "buckets", "times", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            counter, kind = Counter(most, buckets, folder), None
            for batch in slices(batches, "text"):
                found = counter.count(batch.column(2)).combine_chunks()
                kind = batch.column(0).type
                if id_col:
                    lists = [found.column(c).combine_chunks().cast(pa.list_(t)) for c, t in (("buckets", pa.int32()), ("times", pa.int64()))]
                    words = [found.column(c).combine_chunks() for c in ("n_words", "n_features")]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *words, *lists, pa.array([False] * batch.num_rows)], names)
            if kind is not None:
                places, times = counter.totals()
                counter.db.close()
                none = [pa.nulls(1, kind), *(pa.nulls(1, pa.int64()) for _ in range(3))]
                yield pa.RecordBatch.from_arrays([*none, pa.array([places], pa.list_(pa.int32())), pa.array([times], pa.list_(pa.int64())), pa.array([True])], names)

    ids = F.col(id_col) if id_col else F.lit(0).cast("bigint")
    read = texts.select(ids.alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return staged(read.mapInArrow(run, f"{id_fields(read, ('id',))}, row bigint, n_words bigint, n_features bigint, buckets array<int>, times array<bigint>, total boolean"))


def _merged(counts: DataFrame, name: str) -> DataFrame:
    each = counts.filter("total").select(F.explode(F.arrays_zip("buckets", "times")).alias("c"))
    return each.groupBy(F.col("c.buckets").alias("bucket")).agg(F.sum("c.times").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 ln) of each bucket's add-one share in the target over that in the source; both are tables of ``bucket_counts``.
    Only one number a bucket comes to the driver."""
    s, t = _merged(source, "s"), _merged(target, "t")
    each = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    each = staged(each, 1)
    all_s, all_t = each.agg(F.sum("s"), F.sum("t")).first()
    d = lambda c: F.col(c).cast("double") + 1
    gain = F.floor(F.log(d("t") * F.lit(float(all_s + buckets)) / (d("s") * F.lit(float(all_t + buckets)))) * 1000).cast("bigint")
    out = [0] * buckets
    for r in each.select("bucket", gain.alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def noise(id_col: str, seed: int) -> Column:
    """floor(1000 x Gumbel noise) of a hash of the seed and the id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296)) * -1000).cast("bigint")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """row and rank (from 1) of the ``most`` rows with the highest score; ties go to the lesser id (nulls last), then row.
    ``rows`` (staged): id, row, score."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    sorted_rows = staged(rows.select("row", "score", "id").orderBy(*order).select("row", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33).alias("part")
    sizes = sorted_rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row for each range
    before, first = 0, []
    for r in sizes:
        first.append((r["part"], before))
        before += r["n"]
    starts = sorted_rows.sparkSession.createDataFrame([x for x in first if x[1] < most], "part bigint, before bigint")
    placed = sorted_rows.withColumn("part", part).join(F.broadcast(starts), "part")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select("row", rank.cast("bigint").alias("rank")).filter(F.col("rank") <= most)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    most_words: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """A row a document: ``id_col``, n_words, n_features, weight (sum of the gains of its n-grams up to ``most_words`` words),
    score (weight and noise) and rank (1, 2, 3 ... of those drawn, else null).

    ``percent`` of the documents with at least ``min_words`` words are drawn, those with the highest scores: a sample without
    replacement, with chances as the weights' exponentials. Null and empty texts have no features and weight 0, and are drawn
    only if ``min_words`` is 0. Null ids share one noise; repeated ids and rows keep a row each and tie by place. A very long text
    is one row like others. Without target texts all targets' counts are 0. Empty tables give an empty result; further columns
    are not read, whatever their names.
    """
    seen = bucket_counts(docs, most_words, buckets, id_col, text_col)
    gain = np.array(gains(seen, bucket_counts(target, most_words, buckets, None, target_text_col), buckets), np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, times = batch.column(4), batch.column(5)
            each = np.concatenate([[0], np.cumsum(gain[places.flatten().to_numpy()] * times.flatten().to_numpy())])
            ends = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(each[ends[1:]] - each[ends[:-1]], pa.int64())], ["id", "row", "n_words", "n_features", "weight"])

    texts = seen.filter(~F.col("total")).select("id", "row", "n_words", "n_features", "buckets", "times")
    weighed = texts.mapInArrow(weigh, f"{id_fields(seen, ('id',))}, row bigint, n_words bigint, n_features bigint, weight bigint")
    scored = staged(weighed.withColumn("score", F.col("weight") + noise("id", seed)))
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = small_side(staged(ranked(able, able.count() * percent // 100)), 16)
    return scored.join(drawn, "row", "left").select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
