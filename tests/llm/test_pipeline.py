"""The pipeline's rows against its stages restated by brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from edgeloom.llm import quality, queries  # noqa: E402
from edgeloom.llm.bpe_chunks import ChunkEncoder  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = "[ \t\n\x0b\x0c\r]+"
FOLD = {a: a + 32 for a in range(65, 91)}


def words(text: str) -> list[str]:
    return [w for w in re.split(SPACE, text) if w]


def spread_lines(rows: list[tuple]) -> list[tuple]:
    norm = lambda line: " ".join(words(line.translate(FOLD)))

    def spread(voters, among=None):
        sites = defaultdict(set)
        for _, text, source in voters:
            for line in (text or "").split("\n"):
                if words(line) and (among is None or norm(line) in among):
                    sites[norm(line)].add(source)
        return {line for line, s in sites.items() if len(s) > 10}

    first = spread(rows)
    share = lambda text: sum(len(words(x)) for x in (text or "").split("\n") if norm(x) in first) <= 0.5 * len(words(text or ""))
    bad = spread([r for r in rows if share(r[1])], first)
    return [(i, text if text is None else "\n".join(x for x in text.split("\n") if norm(x) not in bad), source) for i, text, source in rows]


def one_of_near_copies(rows: list[tuple]) -> list[tuple]:
    def shingles(text):
        w = words((text or "").translate(FOLD))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holds = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s or {()}:
            holds[x].append(k)
    common: Counter = Counter()
    for ks in holds.values():
        common.update((a, b) for n, a in enumerate(ks) for b in ks[n + 1 :])
    for (a, b), c in common.items():
        if not sets[a] and not sets[b] or sets[a] and sets[b] and c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [r for k, r in enumerate(rows) if find(k) == k]


def uncontaminated(rows: list[tuple], items: list[str]) -> list[tuple]:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = {tuple(w[k : k + 10]) for w in map(split, items) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    return [r for r in rows if not any(tuple(w[k : k + n]) in windows for w in [split(r[1])] for n in sizes for k in range(len(w) - n + 1))]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = quality.tokenised(docs, {c: F.col(c) for c in ("doc_id", "text", "source")})
    good = quality.score(seen, quality.train(seen, spark.read.parquet(f"{SF}/labels.parquet"))).filter(F.col("score") >= queries.QUALITY_FROM)
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in good.collect())
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = uncontaminated(one_of_near_copies(spread_lines(rows)), items)
    tokenizer = ChunkEncoder(public_tokenizers.path(queries.WORD_BPE)).tokenizer
    expected = set()
    for i, text, _ in want:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        expected.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert len(got) == len(expected) > 50 and set(got) == expected


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("text", F.lit(""))).unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    long = docs.limit(1).withColumn("text", F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(20_000)), lambda k: F.concat(F.lit("line of words number "), k.cast("string"))))).withColumn("doc_id", F.lit(10**6))
    frame = docs.unionByName(odd).unionByName(long)
    for c in ("extra", "h", "_id", "_k", "_key", "row", "score", "tokens", "n_removed_lines", "who", "first", "id", "k1"):
        frame = frame.withColumn(c, F.lit(c))
    for frame in (frame, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns, name
            assert out.count() <= frame.count()
            if "row" in frame.columns:
                assert all(r[c] == c for r in out.collect() for c in ("row", "_k", "_key", "score", "n_removed_lines", "id"))
                assert out.filter("doc_id = 1000000").count() == 1 or name == "quality classifier", name
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    odd.unionByName(docs.limit(8)).unionByName(docs.limit(8)).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(out) <= 12 and len({r["doc_id"] for r in out if r["doc_id"] is not None}) >= len(out) - 1
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
