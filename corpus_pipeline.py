"""Cleaning a corpus in stages; each stage's output is written as Parquet and read again by the next.

A stage's result has to be written before the next stage is called, as ``run`` does: scratch tables that it reads are deleted then.

Every stage keeps the columns of its input, whatever their names and however many. A null or empty text has no words: the
classifier scores it like any other, no line is taken from it, such texts are copies of each other, no benchmark passage
is in it, and it encodes to no tokens. Repeated rows are copies, of which one stays; null ids are ids like others; very
long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import scratch
from edgeloom.llm import bpe_chunks, decontaminate, near_dups, quality, site_spread
from edgeloom.llm.common import staged, table
from edgeloom.llm.queries import QUALITY_FROM, WORD_BPE, bpe_digests

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


_made: set[str] = set()


def _stage(f: Stage) -> Stage:
    """A stage that deletes the scratch tables of the stage called before it: by then that one's output has been written."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.drop(spark, _made)
        before = scratch.tables()
        out = f(spark, docs, sf_dir)
        _made.clear()
        _made.update(scratch.tables() - before)
        return out

    return run_stage


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject; without labels of both
    kinds it rejects none."""
    seen = quality.tokenised(docs, {"row": _row(docs), "doc_id": F.col("doc_id")})
    model = quality.train(seen, table(spark, sf_dir, "labels"))
    return quality.score(seen, model).filter(F.col("score") >= QUALITY_FROM).select("row.*")


@_stage
def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of too many sources; n_chars follows the text.

    Near copies are removed only by the next stage, so texts that mostly consist of spread lines (copies that went
    round the sources) have no vote on what is spread, else all copies would lose their common text; what other texts show
    to be spread goes from them too.
    """
    keyed = docs.select(_row(docs).alias("doc"), "source", "text")
    clean = site_spread.remove_spread_lines(keyed, voters=0.5)
    doc = F.col("doc")
    chars = F.when(F.col("n_removed_lines") > 0, F.length("text")).otherwise(doc["n_chars"]).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": chars}
    return clean.select(*[new.get(c, doc[c]).alias(c) for c in docs.columns])


@_stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least by id, of each group connected by similarities of 0.8 or more; of texts without words one."""
    return near_dups.keep_first(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and the decoded text of each document."""
    return bpe_digests(bpe_chunks.encode_decode(docs, public_tokenizers.path(WORD_BPE)))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_spread_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: Training a classifier can't be put in SQL; tests/llm hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's scratch tables are deleted when the next one begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
