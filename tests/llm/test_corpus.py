"""Corpus operators against brute force, the libraries themselves, and DuckDB; with nulls, empty and long texts,
repeated rows, ties, empty tables and columns whose names clash."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
from edgeloom.llm import bpe_chunks, decontaminate, license_scan, line_frequency, near_dups, quality, queries, site_spread, token_counts, unit_dedup, url_filter  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, row string, size int, h int, n_copies int"


def sentences(rng: random.Random, n: int) -> str:
    vocabulary = [a + b for a in "ba be bi bo bu da de di do du ka ke ki".split() for b in "ran ren rin ron lat let lit lot".split()]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def make_texts() -> list[str | None]:
    rng = random.Random(3)
    base = [sentences(rng, 120) for _ in range(8)]
    shared = "Shared by all sites: " + sentences(rng, 30)
    texts: list[str | None] = [None, "", " \n\t ", "one", "two words", "one", *base, base[0], base[0]]
    words = base[1].split()
    for k in (1, 2, 3):  # near copies, each different
        changed = list(words)
        changed[10 * k] = "changed"
        texts.append(" ".join(changed))
    texts += [f"{sentences(rng, 60)}\n{shared}\n{sentences(rng, 60)}" for _ in range(24)]
    texts.append("# $ %% *** " + "Àé ß 数据 " * 40 + "x" * 5000)
    texts.append(sentences(rng, 30_000))  # very long
    texts.append("\n".join(["same line of text again"] * 40))
    texts.append("tail\n\n\n")
    return texts


def frame(spark, texts):
    rows = [(None if k == 7 else k // 2 if k in (14, 15) else k, t, "en", None if k % 13 == 0 else f"src{k % 12}", len(t or ""), 1, "r", 1, 1, 1) for k, t in enumerate(texts)]
    rows.append(rows[-1])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, make_texts())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(docs, **more):
    con = duckdb.connect()
    for name, df in {"documents": docs, **more}.items():
        con.register(f"_{name}", pa.Table.from_batches([], df.toArrow().schema) if df.isEmpty() else df.toArrow())
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    return con


def compare(df, con, sql):
    got = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(got.columns)
    at = [got.columns.index(c) for c in cols]
    rows = got.fetchall()
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[k] for k in at) for r in rows)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    compare(queries.QUERIES[name](spark, SF), con, queries.SQL[name])


def test_line_frequency_odd_rows(docs, empty):
    out = line_frequency.quality_rules(docs)
    compare(out, duck(docs), queries.SQL["op1_line_frequency"])
    assert line_frequency.quality_rules(empty).count() == 0
    one = docs.withColumn("source", F.lit("one"))
    strict = {r["doc_id"]: r for r in line_frequency.quality_rules(one, max_documents=3).collect()}
    assert strict[22]["n_removed_words"] == 34 and strict[22]["kept"]
    compare(line_frequency.quality_rules(one), duck(one), queries.SQL["op1_line_frequency"])


def test_line_frequency_depletes(spark):
    rng = random.Random(1)
    hot = "\n".join(sentences(rng, 30) for _ in range(3))
    rows = [(k, f"{hot}\n{sentences(rng, 20)}", "one") for k in range(30)] + [(100 + k, sentences(rng, 80), "one") for k in range(30)]
    out = {r["doc_id"]: r for r in line_frequency.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[k]["n_removed_words"] == 90 and not out[k]["kept"] and not out[k]["base_failed"] for k in range(30))
    assert all(out[100 + k]["kept"] for k in range(30))


@pytest.mark.parametrize("broadcast_bytes", [16 << 20, 0])
def test_without_frequent_lines(spark, docs, empty, broadcast_bytes):
    rows = [(k, f"own line {k}\nCookies  are used\nsame\n" + ("only here\n" if k < 4 else ""), "a" if k < 9 else None) for k in range(14)]
    rows += [(90, None, "a"), (91, "", "a"), (92, "same", "a"), (92, "same", "a"), (93, "cookies are used\n\nsame", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_removed_lines": F.lit("x"), "host": F.lit(1), "lines": F.lit(2), "row": F.lit(3)})
    got = line_frequency.without_frequent_lines(frame, max_documents=4, broadcast_bytes=broadcast_bytes)
    assert set(got.columns) == set(frame.columns) and dict(got.dtypes)["n_removed_lines"] == "bigint"
    counts = Counter((s, line) for _, t, s in rows for line in {line_frequency_key(x) for x in (t or "").split("\n")} if line)
    want = Counter()
    for i, t, s in rows:
        parts = None if t is None else t.split("\n")
        kept = None if t is None else [x for x in parts if counts[s, line_frequency_key(x)] <= 4]
        want[i, None if t is None else "\n".join(kept), s, 0 if t is None else len(parts) - len(kept)] += 1
    assert Counter((r["doc_id"], r["text"], r["source"], r["n_removed_lines"]) for r in got.collect()) == want
    assert line_frequency.without_frequent_lines(empty).count() == 0
    measured = line_frequency.quality_rules(docs.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL"))
    cleaned = line_frequency.without_frequent_lines(docs.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL"))
    words = lambda c: F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), "[ \t\n\x0b\f\r]+"), lambda w: w != ""))
    both = cleaned.select("doc_id", words("text").alias("left")).join(measured, "doc_id")
    assert both.filter("left <> n_words - n_removed_words").count() == 0


def line_frequency_key(line: str) -> str:
    from edgeloom.llm.lines import normalised

    return normalised(line)


def test_line_frequency_nulls_copies_and_large_hosts(spark, tmp_path):
    rng = random.Random(2)
    hot, copied = sentences(rng, 60), sentences(rng, 80)
    rows = [(k, f"{hot}\n{sentences(rng, 20)}", "large") for k in range(21)] + [(100 + k, sentences(rng, 60), "large") for k in range(1400)] + [(1600, None, "large"), (1601, "", "large")]
    rows += [(5000 + k, f"{hot}\n{sentences(rng, 20)}", "small") for k in range(20)] + [(6000 + k, copied, None) for k in range(21)] + [(7000 + k, copied, "null") for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op1_line_frequency(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.filter("n_removed_words > 0 AND NOT kept").collect()} == set(range(21)) | {6000 + k for k in range(21)}
    compare(out, duck(spark.read.parquet(f"{tmp_path}/documents.parquet")), queries.SQL["op1_line_frequency"])


def test_bpe_equals_library(docs, empty):
    path = public_tokenizers.path(queries.WORD_BPE)
    tokenizer = bpe_chunks.ChunkEncoder(path).tokenizer
    for bits in (0, bpe_chunks.MASK_BITS):
        out = bpe_chunks.encode_decode(docs.withColumn("key", F.xxhash64("text", "doc_id")), path, ("key",), "text", bits).collect()
        texts = {r["key"]: r["text"] for r in docs.select(F.xxhash64("text", "doc_id").alias("key"), "text").collect()}
        assert len(out) == docs.count()
        for r in out:
            ids = tokenizer.encode(texts[r["key"]] or "", add_special_tokens=False).ids
            assert list(r["ids"]) == ids and r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe_chunks.encode_decode(empty, path).count() == 0


ODD = ["<|endoftext|>", "<|startoftext|>", "<|endof", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\u00a0", "\u3000", "e\u0301", "\u0301", "İ", "Σ", "ǅ", "don't", "I'LL", "'s", "数据", "Ａ", "½", "١٢", "123", "x1y", "€%", "👍🏽", "</s>", "<s>", "▁", "\x00", "пример", "слово", "가 나", "か な", "字 字", "अ ा", "ß ö"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=5)), max_size=30).map("".join), min_size=1, max_size=6))
def test_bpe_odd_texts(texts):
    for bits in (0, 2, bpe_chunks.MASK_BITS):
        encoder = bpe_chunks._worker(public_tokenizers.path(queries.WORD_BPE), bits)
        ids, offs = encoder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == encoder.plain(texts)


def test_bpe_takes_back_cuts_that_disagree():
    encoder = bpe_chunks.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))  # a space belongs to the word after it
    texts = ["a b  c\n\nd e", "x" * 50 + " y\tz w"]
    ids, offs = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == encoder.plain(texts)


def test_bpe_reuses_chunks():
    encoder = bpe_chunks.ChunkEncoder(public_tokenizers.path(queries.WORD_BPE), 2)
    text = sentences(random.Random(9), 400)
    encoder.encode(pa.array([text, "intro " + text]))
    calls = encoder.calls
    encoder.encode(pa.array([text] * 50))
    assert encoder.calls == calls


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=5)), max_size=60).map("".join), st.integers(1, 20))
def test_token_count_cuts_are_safe(text, size):
    model = token_counts._load(public_tokenizers.path(queries.PIECE_BPE))
    assert sum(len(model.encode(p)) for p in token_counts.pieces_of(text, size)) == len(model.encode(text))


def test_token_counts(docs, empty):
    path = public_tokenizers.path(queries.PIECE_BPE)
    model = token_counts._load(path)
    out = token_counts.count_tokens(docs, path, ("doc_id", "n_chars"), piece_chars=300, call_bytes=5000).collect()
    want = [(r["doc_id"], r["n_chars"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in docs.collect()]
    assert Counter(map(tuple, out)) == Counter(want)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op3_quality(spark, sf).collect()
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 for r in out)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.93


    score, y = (np.array(x) for x in zip(*[(r["score"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]))
    bins = np.minimum((score * 10).astype(int), 9)
    error = sum(abs(score[bins == b].mean() - y[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))
    assert error < 0.06  # expected calibration error on the held-out fold


def quality_labels(docs, spark, value):
    return docs.select("doc_id", value.cast("int").alias("quality"))


def test_quality_odd_rows(spark, docs, empty):
    labels = quality_labels(docs, spark, F.col("doc_id") % 2)
    seen = quality.tokenised(docs, {"doc_id": F.col("doc_id"), "score": F.col("source"), "tokens_": F.col("h")})
    model = quality.train(seen, labels)
    out = quality.score(seen.drop("score"), model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    none = quality.tokenised(empty, {"doc_id": F.col("doc_id")})
    assert quality.score(none, model).count() == 0 and quality.train(none, labels).temperature == 1
    for few in (labels.limit(0), labels.withColumn("quality", F.lit(1))):
        assert all(r["score"] > 0.99 for r in quality.score(seen.drop("score"), quality.train(seen, few)).collect())


def test_quality_brute_force(spark):
    """Tokens, context vectors and features in plain Python; the gradient against differences; the temperature."""
    import xxhash

    texts = ["Two words here. two WORDS here", "", "a a a b", "É1 $$ Ok", " \n", sentences(random.Random(1), 50)]
    buckets = 1 << 10
    index = quality.index_vectors(buckets)
    place = lambda t: xxhash.xxh32_intdigest(t.encode()) % buckets
    lists = []
    for t in texts:
        found, before = [], None
        for w in re.findall(r"[^ \t\n\x0b\x0c\r]+", t):
            if w == before:
                found.append(place("\x01AGAIN"))
            else:
                for x in re.findall(r"[^\W\d_]+|\d|[^\w\s]|_", w):
                    found += [place("\x01UP"), place(x.lower())] if len(x) > 1 and x.isupper() else [place(x.lower())]
            before = w
        lists.append(found)
    got, offs = quality.tokens(pa.array(texts), buckets)
    assert [got[a:b].tolist() for a, b in zip(offs, offs[1:])] == lists
    want = np.zeros_like(index)
    for f in lists:
        for k, t in enumerate(f):
            for j in range(max(0, k - quality.WINDOW), min(len(f), k + quality.WINDOW + 1)):
                if j != k:
                    want[t] += index[f[j]]
    assert (quality.context_sums(got, offs, index) == want).all()
    x = quality.features(got, offs, index, want)
    for k, f in enumerate(lists):
        rows = [np.hstack([index[t], want[t]]) for t in f]
        assert np.allclose(x[k], [*(np.mean(rows, 0) if f else np.zeros(2 * quality.DIM)), np.log1p(len(f))], atol=1e-4)
    seen = quality.tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), {"doc_id": F.col("doc_id")}, buckets=buckets)
    model = quality.train(seen, spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int"), buckets=buckets)
    assert np.allclose(model.context, want / (np.linalg.norm(want, axis=1, keepdims=True) + 1e-6), atol=1e-6)  # over all documents
    rng = np.random.default_rng(3)
    z, t = rng.normal(size=(40, 6)), rng.integers(0, 2, 40)
    p = [rng.normal(size=(6, 5)), rng.normal(size=5), rng.normal(size=5), rng.normal(size=1)]
    loss = lambda q: np.logaddexp(0, -np.where(t > 0, 1, -1) * quality.logits(q, z)).mean() + 0.5e-4 * ((q[0] ** 2).sum() + (q[2] ** 2).sum())
    for k, grad in enumerate(quality.gradients(p, z, t)):
        for at in np.ndindex(p[k].shape):
            more, less = [a.copy() for a in p], [a.copy() for a in p]
            more[k][at] += 1e-6
            less[k][at] -= 1e-6
            assert abs((loss(more) - loss(less)) / 2e-6 - grad[at]) < 1e-5
    logit = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-logit / 2))).astype(int)
    assert 1.7 < quality.temperature_of(logit, y) < 2.4


def test_unit_dedup(docs, empty):
    rows = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])  # rows with equal ids rank by place, which SQL can't see
    compare(queries.passage_digests(unit_dedup.repeated_passages(rows)), duck(rows), queries.SQL["op6_unit_dedup"])
    assert unit_dedup.repeated_passages(docs).count() == docs.count() and unit_dedup.repeated_passages(empty).count() == 0
    cleaned = rows.join(unit_dedup.repeated_passages(rows), "doc_id").select("doc_id", "text", "removed", unit_dedup.without(F.col("text"), F.col("removed")).alias("clean"))
    for r in cleaned.collect():
        if r["text"] is not None:
            gone = {k for s in r["removed"] for k in range(s["start"], s["end"])}
            assert r["clean"] == "".join(c for k, c in enumerate(r["text"]) if k not in gone)


def brute_passages(rows, min_words=20, line_words=10):
    """(id, text) in order -> (n_units, n_repeated, n_removed, removed spans, kept ids) of each."""
    units, counts = [], []
    for k, (_, text) in enumerate(rows):
        found = [(m.group().translate({a: a + 32 for a in range(65, 91)}), *m.span()) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text or "")]
        full = [re.search(unit_dedup.SENTENCE_END, w) is not None or n + 1 == len(found) for n, (w, _, _) in enumerate(found)]
        edges = [n + 1 for n, x in enumerate(full) if x]
        cuts = []
        for a, b in zip([0, *edges], edges):
            cuts += [n + 1 for n in range(a, b - 1) if b - a > unit_dedup.STRETCH and hashlib.md5(found[n][0].encode()).digest()[0] % unit_dedup.ONE_OF == 0] + [b]
        starts = [0, *cuts[:-1]]
        runs = {(a, min(b for b in cuts if b - a >= min_words)) for a in starts if len(found) - a >= min_words}
        if len(found) >= min_words:
            runs.add((max(a for a in starts if len(found) - a >= min_words), len(found)))
        if found and len(found) < min_words:
            runs = {(0, len(found))}
        for apart in (1, 2):  # lines, and paragraphs between blank lines
            begins = [n for n in range(len(found)) if n == 0 or text[found[n - 1][2] : found[n][1]].count("\n") >= apart]
            runs |= {(a, b) for a, b in zip(begins, [*begins[1:], len(found)]) if b - a >= line_words}
        units += [(tuple(w for w, _, _ in found[a:b]), k, found[a][1], found[b - 1][2]) for a, b in runs]
        counts.append(len(runs))
    holders = defaultdict(set)
    for words, k, _, _ in units:
        holders[words].add(k)
    out = [[n, 0, 0, set(), set()] for n in counts]
    first: dict = {}
    for words, k, a, b in sorted(units, key=lambda u: (rows[u[1]][0] is None, rows[u[1]][0] or 0, *u[1:])):
        out[k][1] += len(holders[words]) > 1
        if words not in first:
            first[words] = (k, b)
            continue
        kept, last = first[words]
        out[k][2] += 1
        out[k][3] |= set(range(max(a, last) if kept == k else a, b))
        if kept != k:
            out[k][4].add(rows[kept][0])
    for x in out:
        gone = sorted(x[3])
        x[3] = [(a, b + 1) for a, b in zip([c for c in gone if c - 1 not in x[3]], [c for c in gone if c + 1 not in x[3]])]
        x[4] = sorted(i for i in x[4] if i is not None)
    return out


def test_repeated_passages(spark, docs, empty):
    rng = random.Random(5)
    verse = [sentences(rng, rng.randrange(3, 9)) for _ in range(12)]
    long, plain = f"{sentences(rng, 14)}. {sentences(rng, 25)}! {sentences(rng, 21)}.", sentences(rng, 60)
    texts = ["\n".join(["own opening line", *verse, sentences(rng, 25)]), "\n".join([sentences(rng, 7), "", *verse[:6], "", *verse[6:], "the end"]), f"A heading\n{long}\nafter", f"é {sentences(rng, 5)}. {long.upper()} {sentences(rng, 9)}", "few words", "Few  words"]
    texts += ["\n".join(["again and again"] * 30), "\n".join(long.split()), None, "é\n" + "\n".join(verse), f"{sentences(rng, 33)} {plain} {sentences(rng, 8)}", f"{sentences(rng, 11)} {plain} {sentences(rng, 4)}", "", sentences(rng, 20_000)]
    rows = list(enumerate(texts))
    out = {r["doc_id"]: r for r in unit_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute_passages(rows)
    for k, _ in rows:
        assert [out[k]["n_units"], out[k]["n_repeated"], out[k]["n_removed"], [tuple(x) for x in out[k]["removed"]], list(out[k]["kept_in"])] == want[k]
    cut = lambda k: [texts[k][s["start"] : s["end"]] for s in out[k]["removed"]]
    assert cut(2) == [] and out[2]["n_repeated"] > 0 and len(cut(3)[0].split()) >= 46 and len(" ".join(cut(7)).split()) >= 46 and cut(5) == ["Few  words"]
    assert len(cut(11)[0].split()) >= 20 and set(out[11]["kept_in"]) == {10}  # inside a line without a sentence end
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]  # repeated ids and rows as well: they rank by the table's order
    out = unit_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = [[r["doc_id"], r["n_units"], r["n_repeated"], r["n_removed"], [tuple(x) for x in r["removed"]], list(r["kept_in"])] for r in out]
    assert sorted(got, key=key) == sorted(([i, *x] for (i, _), x in zip(rows, brute_passages(rows), strict=True)), key=key)
    clash = docs.withColumn("units", F.lit(1)).withColumn("last", F.lit("x"))
    assert unit_dedup.repeated_passages(clash).count() == docs.count()


@pytest.mark.parametrize("n", [14, 18, 20, 30, 40, 60])
def test_lines_and_paragraphs_are_found_whole(spark, n):
    """A line, and a paragraph wrapped otherwise, of ``n`` words between other text: all copies but the first go, in full."""
    rng, rows = random.Random(n), []
    for k in range(60):
        shared = sentences(rng, n)
        wrapped = shared.split()
        wrapped = " ".join(wrapped[: n // 2]) + "\n" + " ".join(wrapped[n // 2 :])
        other = lambda: sentences(random.Random(rng.random()), 15)
        rows += [(4 * k, f"{other()}\n{shared}\n{other()}"), (4 * k + 1, f"{other()}\n{shared}\n{other()}")]
        rows += [(4 * k + 2, f"{other()}\n\n{wrapped}\n\n{other()}"), (4 * k + 3, f"{other()}\n \n{wrapped}\n\n\n{other()}")]
    out = {r["doc_id"]: r for r in unit_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = dict(rows)
    for k in range(60):
        for i, kept in ((1, 0), (3, 2)):
            cut = [texts[4 * k + i][s["start"] : s["end"]] for s in out[4 * k + i]["removed"]]
            assert len(cut) == 1 and len(cut[0].split()) == n and 4 * k in out[4 * k + i]["kept_in"] or 4 * k + kept in out[4 * k + i]["kept_in"]
        assert not out[4 * k]["removed"]


def test_decontaminate(spark, docs, empty):
    texts = make_texts()
    items = [(0, " ".join(texts[6].split()[20:45])), (1, "TWO, words!"), (2, "one"), (3, None), (4, "..."), (None, " ".join(texts[7].split()[:12])), (5, "nowhere to be found at all in any of these"), (6, " ".join(texts[8].split()[5:9])), (0, "Àé ß 数据 Àé ß 数据"), (9, "a a a a a a a a a a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(70, "b a a a a a a a a a a a a a c", "", "", 0, 0, "", 0, 0, 0)], SCHEMA))
    for most in (32 << 20, 0):
        compare(queries.contamination_digests(decontaminate.contamination(more, bench, broadcast_bytes=most)), duck(more, benchmark=bench), queries.SQL["op7_decontaminate"])
    more = more.filter("text IS NULL OR length(text) < 50000")  # the SQL takes long on it
    for window, shingle in ((13, 5), (11, 3), (6, 4), (3, 5)):
        sql = queries.SQL["op7_decontaminate"].replace("least(len(w), 10)", f"least(len(w), {window})").replace("len(w) - 9", f"len(w) - {window - 1}")
        compare(queries.contamination_digests(decontaminate.contamination(more, bench, window=window, shingle=shingle)), duck(more, benchmark=bench), sql)
    assert decontaminate.contamination(empty, bench).count() == 0
    none = decontaminate.contamination(docs, bench.limit(0))
    assert none.count() == docs.count() and none.filter("n_hit > 0 OR n_items > 0").count() == 0


def test_decontaminate_compares_all_words(spark):
    words = sentences(random.Random(11), 13).split()
    changed = words[:5] + ["other"] * 3 + words[8:]
    docs = spark.createDataFrame([(0, " ".join(changed)), (1, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    out = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(docs, bench, window=13).collect()}
    assert out == {0: 0, 1: 13}


def test_keep_uncontaminated(spark, docs, empty):
    hit = make_texts()[6]
    bench = spark.createDataFrame([(0, " ".join(hit.split()[3:20]))], "item_id long, text string")
    clash = docs
    for c in ("_id", "_key", "_k", "_who", "_text", "who", "words", "win", "bad", "k1"):
        clash = clash.withColumn(c, F.lit(c))
    kept = decontaminate.keep_uncontaminated(clash, bench)
    assert kept.columns == clash.columns
    gone = clash.exceptAll(kept).collect()
    assert {r["text"] for r in gone} == {hit} and clash.filter(F.col("text") == hit).count() == len(gone) and kept.count() == clash.count() - len(gone)
    assert decontaminate.keep_uncontaminated(empty, bench).count() == 0
    assert decontaminate.keep_uncontaminated(docs, bench.limit(0)).count() == docs.count()


def brute_classes(rows, threshold=0.8):
    """(id, text) of each row -> (class id, links, copies) of each."""
    fold = {a: a + 32 for a in range(65, 91)}
    words = [tuple(x for x in re.split("[ \t\n\x0b\x0c\r]+", (t or "").translate(fold)) if x) for _, t in rows]
    distinct = sorted(set(words))
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for w in distinct]
    holds = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holds[x].append(k)
    common: Counter = Counter()
    for ks in holds.values():
        common.update((a, b) for n, a in enumerate(ks) for b in ks[n + 1 :])
    root, links = list(range(len(distinct))), [0] * len(distinct)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), c in common.items():
        if c / (len(sets[a]) + len(sets[b]) - c) >= threshold:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    number = {w: k for k, w in enumerate(distinct)}
    group = [find(number[w]) for w in words]
    least: dict = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    times = Counter(words)
    return Counter((i, least.get(g), links[number[w]], times[w]) for (i, _), g, w in zip(rows, group, words, strict=True))


def test_near_duplicates_brute_force(spark, docs, empty):
    for df, block in ((docs, 4 << 20), (docs, 3000), (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 4 << 20)):
        out = near_dups.near_duplicates(df, block_bytes=block).cache()
        want = brute_classes([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in out.collect()) == want
    assert near_dups.near_duplicates(empty).count() == 0


def test_near_duplicates_large_group(spark):
    rng = random.Random(2)
    words = sentences(rng, 200).split()
    rows = []
    for k in range(150):
        changed = list(words)
        changed[rng.randrange(200)] = f"w{k}"
        rows.append((k, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for step, block in ((5, 60_000),):
        out = near_dups.near_duplicates(df, step=step, block_bytes=block).collect()
        assert Counter(tuple(r[c] for c in ("doc_id", "class_id", "n_links", "n_copies")) for r in out) == brute_classes(rows)


def test_near_duplicates_cluster_of_5000(spark):
    rng = random.Random(3)
    words = sentences(rng, 120).split()
    rows = []
    for k in range(5000):  # each differs in one word at one of 60 places: all are at 0.8 or more
        changed = list(words)
        changed[2 * (k % 60)] = f"w{k}"
        rows.append((k, " ".join(changed)))
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(out) == 5000 and {(r["class_id"], r["n_links"]) for r in out} == {(0, 4999)}


def test_forest_shortens_prefixes_where_clusters_meet(spark):
    assert near_dups.forest_depth(0.8, 32, 12, 0.995) == 8 and near_dups.forest_depth(0.8, 32, 12, 0.999) == 7
    h = np.random.default_rng(0).integers(0, 1 << 63, 400, dtype=np.uint64)
    long = near_dups.labels(h, np.array([0, 200, 400]), 4, 12)
    assert (near_dups.labels(h, np.array([0, 200, 400]), 4, 12) == long).all() and long.shape == (2, 4, 12)
    tag = lambda x: [x] * 32
    rows = [(0, tag(b"aabbcc")), (1, tag(b"aabbcc")), (2, tag(b"aabbdd")), (3, tag(b"xxyyzz"))]
    own = spark.createDataFrame([(r, [bytearray(t) for t in ts]) for r, ts in rows], "row long, tags array<binary>")
    pairs = lambda cluster, depth: sorted(map(tuple, near_dups._candidates(own, cluster, depth).collect()))
    assert pairs(None, 3) == [(1, 0)] and pairs(None, 2) == [(1, 0), (2, 0)]
    cluster = lambda *rows: spark.createDataFrame(rows, "node long, label long")
    assert pairs(cluster((0, 0), (1, 0), (2, 0)), 2) == [] and pairs(cluster((0, 0), (1, 0)), 2) == [(1, 0), (2, 0)]


def loose_groups(similarity: float, cross: int, groups: int = 300):
    """Texts A, A', B, B' of each group: copies at over 0.99 on both sides of a link near ``similarity`` between A and B; with
    ``cross`` of 4, A' and B' are linked to the others too."""
    rng, rows = random.Random(int(similarity * 1e4) + cross), []
    n = 410
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(n)]
        # a changed word changes five shingles: s = (S - 5k) / (S + 5k) for S shingles
        k = int((n - 4) * (1 - similarity) / (1 + similarity) / 5)
        other = list(base)
        for j in range(k):
            other[5 + 10 * j] = f"g{g}x{j}"
        for t, words in enumerate((base, other)):
            rows.append((4 * g + 2 * t, " ".join(words)))
            # the copies differ at the end: by one word if all four are to be linked, by more where A and B alone are
            rows.append((4 * g + 2 * t + 1, " ".join([*words[:-1], f"g{g}end{t}"] if cross == 4 else [f"g{g}front{t}", *words])))
    return rows


@pytest.mark.parametrize(("similarity", "cross"), [(0.8005, 1), (0.815, 4), (0.85, 4)])
def test_links_of_texts_with_close_copies(spark, similarity, cross):
    """A close copy on each side must not end the search for a loose link between them: recall of 0.99 or more by band."""
    groups = 300 if similarity < 0.82 else 100
    rows = loose_groups(similarity, cross, groups)
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out}
    want = {i: (c, n) for (i, c, n, _) in brute_classes(rows)}
    links = sum(n for _, n in want.values())
    assert links > 4 * groups  # loose links are there besides those of the copies
    lost = sum(want[i][1] - got[i][1] for i in want)
    split = sum(want[i][0] != got[i][0] for i in want)
    assert 0 <= lost <= 0.005 * links and split <= 0.005 * len(rows)


def test_keep_first(docs, empty):
    kept = near_dups.keep_first(docs)
    assert kept.columns == docs.columns
    classes = near_dups.near_duplicates(docs)
    assert kept.count() == classes.filter("first").count()
    assert near_dups.keep_first(kept).count() == kept.count()
    assert near_dups.keep_first(empty).count() == 0
    clash = docs
    for c in ("id", "who", "k1", "_id", "_key", "_k", "first", "text_"):
        clash = clash.withColumn(c, F.lit(c))
    again = near_dups.keep_first(clash)
    assert again.columns == clash.columns and again.count() == kept.count()
    assert Counter(r["text"] for r in again.collect()) == Counter(r["text"] for r in kept.collect())


def glob_match(pattern: str, text: str) -> bool:
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), text, re.S) is not None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé数*?", max_size=70), min_size=1, max_size=5), st.lists(st.text("abé数👍", max_size=80), min_size=1, max_size=5))
def test_globs(patterns, texts):
    got = url_filter.Globs(patterns).match(texts)
    assert got.tolist() == [[glob_match(p, t) for p in patterns] for t in texts]


def test_url_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://a.net", "http://a.net/", "http://xnet/", "https://www.example.net/en/x?y#z", "http://example.net/en", "http://example.com/de/?q", "http://a.org/fr/#x", "http://org/fr/b", "x://y://z/a", "http://spam-farm.org/", "http://a.com?x=/net/", "http://a.com#b?c", "http://Example.ORG/FR/", "http://é.net/ü", "http://a.com/" + "b" * 5000, "http://a.com/casino/é", "http://net:80/"]
    rows = [(k, u, "h") for k, u in enumerate(urls)] + [(None, "http://a.net/", "h"), (3, "http://", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    compare(url_filter.judge_urls(pages), con, queries.SQL["op9_url_filter"])
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    globs = url_filter.globs_of(spark.createDataFrame([("*/b?c",), (None,), ("",), ("*/b?c",), ("é*",)], "glob string"))
    assert globs == ["*/b?c", "é*"] and url_filter.Globs(url_filter.blocked_globs()).words > 20
    few = spark.createDataFrame([(0, "http://x.com/bßc"), (1, "http://x.com/bc"), (2, "http://é.com/"), (3, "http://x.com/b👍c")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge_urls(few, rules=[], blocked=globs).orderBy("page_id").collect()] == ["block", "allow", "block", "block"]


def test_site_spread(docs, empty):
    out = site_spread.remove_spread_lines(docs)
    digest = queries._cleaned(out)
    compare(digest, duck(docs), queries.SQL["op10_site_spread"])
    compare(queries._cleaned(site_spread.remove_spread_lines(docs, broadcast_bytes=0)), duck(docs), queries.SQL["op10_site_spread"])
    assert out.filter("n_removed_lines > 0").count() == 24
    assert [c for c in out.columns if c in docs.columns] == docs.columns
    assert site_spread.remove_spread_lines(empty).count() == 0
    assert out.filter("text IS NULL").count() == docs.filter("text IS NULL").count()
    clash = docs.withColumn("number", F.lit("n")).withColumn("lines", F.lit("l")).withColumn("n_removed_lines", F.lit("r"))
    kept = site_spread.remove_spread_lines(clash).select("number", "lines", "n_removed_lines").distinct().collect()
    assert {(r["number"], r["lines"]) for r in kept} == {("n", "l")} and {r["n_removed_lines"] for r in kept} == {0, 1}


def test_site_spread_options(spark, empty):
    rng = random.Random(6)
    common, copied = sentences(rng, 12), [sentences(rng, 20) for _ in range(6)]
    own = [sentences(rng, 40) for _ in range(12)]
    rows = [(k, f"{common}\n{own[k]}", f"s{k}") for k in range(12)]
    near = ["\n".join([common, *copied[: k % 6], f"changed {k}", *copied[k % 6 + 1 :]]) for k in range(36)]
    rows += [(100 + k, t, f"s{k % 13}") for k, t in enumerate(near)] + [(200, "\n".join([common] * 3 + [own[0]]), "s1"), (201, common, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = {r["doc_id"]: r["text"] for r in site_spread.remove_spread_lines(df).collect()}
    assert all(plain[100 + k] == f"changed {k}" for k in range(36)) and plain[201] == ""
    whole = {r["doc_id"]: r for r in site_spread.remove_spread_lines(df, max_removed=0.5).collect()}
    assert all(whole[100 + k]["text"] == t and whole[100 + k]["n_removed_lines"] == 0 for k, t in enumerate(near)) and whole[0]["text"] == own[0]
    for most in (16 << 20, 0):
        voted = {r["doc_id"]: r["text"] for r in site_spread.remove_spread_lines(df, voters=0.5, broadcast_bytes=most).collect()}
        assert all(voted[100 + k] == t.split("\n", 1)[1] for k, t in enumerate(near))  # the common line goes, the copies' own lines stay
        assert voted[0] == voted[200] == own[0] and voted[201] == ""
    assert site_spread.remove_spread_lines(empty, voters=0.5).count() == 0


def test_licenses(spark, empty):
    rng = random.Random(8)
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(0, None), (1, ""), (2, sentences(rng, 300)), (3, f"{sentences(rng, 50)}\n{mit.upper()}\n{sentences(rng, 50)}"), (3, "All rights reserved."), (None, mit), (None, mit), (5, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("mine")).withColumn("dice", F.lit(7)).withColumn("row", F.lit(1))
    out = license_scan.scan(df).collect()
    want = [(0, None, 0.0, 0), (1, None, 0.0, 0), (2, None, 0.0, 0), (3, "MIT", 1.0, 1), (3, "ALL-RIGHTS-RESERVED", 1.0, 1), (None, "MIT", 1.0, 1), (None, "MIT", 1.0, 1), (5, None, 0.0, 0)]
    assert Counter((r["doc_id"], r["license"], r["dice"], r["n_matches"]) for r in out) == Counter(want)
    assert license_scan.scan(empty).count() == 0


def test_whole_licences_wrapped_in_files(spark):
    rng = random.Random(12)
    wrap = lambda text, n: "\n".join(" ".join(text.split()[k : k + n]) for k in range(0, len(text.split()), n))
    names = [n for n in license_scan.TEMPLATES if n.endswith("-text")]
    rows = [(k, f"# {sentences(rng, 20)}\nCopyright 2020 Acme\n{wrap(license_scan.TEMPLATES[n], 7 + k % 5)}\n{sentences(rng, 60)}") for k, n in enumerate(names)]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[k]["license"].removesuffix("-text") for k in range(len(names))] == [n.removesuffix("-text") for n in names] and all(out[k]["dice"] == 1 for k in out)


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def test_licenses_over_lines_and_inside_them(spark):
    rng = random.Random(4)
    mit = license_scan.TEMPLATES["MIT"].split()
    wrapped = "MIT License\n\nCopyright (c) 2020 Acme\n\n" + "\n".join(" ".join(mit[k : k + 9]) for k in range(0, len(mit), 9)) + "\n\nThe above copyright notice shall be included in all copies."
    code = "\n".join(sentences(rng, 8) for _ in range(60))
    rows = [(0, f"{GPL_HEADER}\n{code}", "GPL-notice", 1.0), (1, wrapped, "MIT", 1.0), (2, "Copyright 2020 Acme. All rights reserved.", "ALL-RIGHTS-RESERVED", 1.0), (3, f"{code}\n{' '.join(mit[:12])} x\ny {' '.join(mit[14:])}\n{code}", "MIT", None), (4, code, None, 0.0), (5, "all rights " * 20_000, None, 0.0), (6, "rights all reserved " * 20_000, None, 0.0)]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for k, _, name, dice in rows:
        assert out[k]["license"] == name and (dice is None and 0.8 <= out[k]["dice"] < 1 or out[k]["dice"] == dice)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("pqr"), st.text("ab ", min_size=3, max_size=20).filter(lambda t: len(t.split()) > 1), min_size=1), st.text("abc ", max_size=60), st.sampled_from([0.5, 0.8, 1.0]))
def test_license_windows_are_exact(texts, text, threshold):
    known = license_scan.Templates(texts, threshold)
    words = text.split()
    every = [known.best(" ".join(words[a:b])) for a in range(len(words)) for b in range(a + 2, len(words) + 1)]
    assert known.best_window(text) == min((x for x in every if x), key=lambda x: (-x[0], x[1]), default=None)


def test_entry_lists_them():
    found = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in found} and "pipeline" in found
    assert set(entry.oracle_sql()) <= set(found)
