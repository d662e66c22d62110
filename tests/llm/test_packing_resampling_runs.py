"""Packing, importance resampling and periodic runs against the library and brute force; odd rows, ties and odd columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from edgeloom.llm import importance, packing, periodic_runs, queries, word_ids  # noqa: E402

SCHEMA = "doc_id bigint, text string, start int, length int, row string, id string, buckets int, runs int, n_words int"
PATH = public_tokenizers.path("word_bpe_49k.json")


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Été", "don't", "x1", "go!", "数据"]) for _ in range(n))


def texts() -> list[str | None]:
    rng = random.Random(4)
    some = [None, "", " \n ", "one", "one", "a b " * 30, "z " * 400, words(rng, 12_000), "tail\n\n", "x y z " * 9 + "p q p q p q p q p q"]
    return some + [words(rng, rng.choice([5, 19, 20, 40, 300, 900])) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 5 else 7 if k in (8, 9) else k, t, 1, 1, "r", "i", 1, 1, 1) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ids of whole texts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ'sStTlLdD19 !,—é́İ\n 数²<|>endoftx\x00ſǰJ̌क़", max_size=30), max_size=8))
def test_word_ids_are_the_librarys(some):
    encoder = _encoder()
    some += ["<|endoftext|> A", "x<|endoftext|>", "J̌ x", "don't DON'T 's", "<|ENDOFTEXT|>"]
    ids, offs = encoder.encode(pa.array(some, pa.string()))
    want = [e.ids for e in encoder.tokenizer.encode_batch(some, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == want


_made: list = []


def _encoder():
    if not _made:
        _made.append(word_ids.WordEncoder(PATH))
    return _made[0]


def test_word_ids_only_for_tokenizers_of_that_form():
    assert word_ids.splits_words(PATH)
    assert not word_ids.splits_words(public_tokenizers.path("byte_bpe_50k.json"))


def test_word_ids_forget_and_go_on():
    small = word_ids.WordEncoder(PATH, store_bytes=2000)
    rng = random.Random(2)
    for _ in range(5):
        some = ["".join(rng.choice("abcdefg é") for _ in range(200)) for _ in range(3)]
        ids, offs = small.encode(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [e.ids for e in small.tokenizer.encode_batch(some, add_special_tokens=False)]


# packing


def check_pieces(rows, sources, limits, padded=None):
    """Every id of every example in one piece; sequences without gaps and within all limits."""
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for some in by_seq.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits[0] and len(some) <= limits[1] and sum(r["n_loss"] for r in some) <= limits[2]
        if padded is None:
            assert at == limits[0] or at & (at - 1) == 0
    got, want = Counter(), Counter()  # each id of each example at its place, once
    for r in rows:
        got.update((r["doc_id"], r["doc_tokens"], r["start"] + i, x) for i, x in enumerate(np.frombuffer(r["ids"], "<u4").tolist()))
        assert len(r["ids"]) == 4 * r["length"]
    for key, some in sources.items():
        for ids in some:
            want.update((key, len(ids) // 4, i, x) for i, x in enumerate(np.frombuffer(ids, "<u4").tolist()))
    assert got == want


def encoded(rows, prompts=None):
    lib = Tokenizer.from_file(PATH)
    out: dict = {}
    for k, (key, text) in enumerate(rows):
        ids = lib.encode(prompts[k] or "", add_special_tokens=False).ids if prompts else []
        ids = ids + lib.encode(text or "", add_special_tokens=False).ids + [1]
        out.setdefault(key, []).append(np.array(ids, "<u4").tobytes())
    return out


def test_packing(docs, empty):
    given_rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for limits, pool in (((2048, 256, 2048), 1 << 18), ((2048, 3, 2048), 4000)):
        rows = packing.pack(docs, PATH, max_tokens=limits[0], max_segments=limits[1], max_loss=limits[2], pool_tokens=pool).collect()
        check_pieces(rows, encoded(given_rows), limits)
    assert packing.pack(empty, PATH).collect() == []
    assert sum(r["doc_tokens"] == 1 for r in rows) >= 3  # null and blank texts are their end alone


def test_packing_leaves_little_padding_and_ids_differ(docs):
    rows = packing.pack(docs, PATH).collect()
    full = Counter()
    for r in rows:
        full[r["sequence_id"]] += r["length"]
    assert sum(n == 2048 for n in full.values()) > len(full) // 2
    assert all(n & (n - 1) == 0 for n in full.values())


def test_packing_instructions(spark):
    """Three limits at once: prompts bear no loss; examples stay whole where they can."""
    rng = random.Random(8)
    rows = [(k, words(rng, rng.randint(1, 150)), words(rng, rng.choice([1, 30, 100, 400]))) for k in range(200)]
    frame = spark.createDataFrame([*rows, (200, None, "only text"), (201, "only prompt", None)], "doc_id bigint, prompt string, text string")
    given_rows = frame.collect()
    sources = encoded([(r["doc_id"], r["text"]) for r in given_rows], [r["prompt"] for r in given_rows])
    for cut in (True, False):
        got = packing.pack(frame, PATH, prompt_col="prompt", max_tokens=1024, max_segments=6, max_loss=500, cut=cut).collect()
        check_pieces(got, sources, (1024, 6, 500), None if cut else True)
        lib = Tokenizer.from_file(PATH)
        for r in given_rows:
            mine = [g for g in got if g["doc_id"] == r["doc_id"]]
            assert sum(g["n_loss"] for g in mine) == len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1
            if not cut and mine[0]["doc_tokens"] <= 500:
                assert len(mine) == 1


def test_dot_product_prefers_what_is_left():
    """Pieces rich in loss go first where loss is what is left, and both limits are filled together."""
    packer = packing.Packer(100, 10, 40, cut=False)
    packer.add([0, 1, 2, 3], [60, 40, 60, 40], [60, 0, 60, 0])  # two without loss, two of loss alone
    made = list(packer.sequences(0))
    assert sorted(sorted(o for o, _, _ in x) for x in made) in ([[0, 1], [2, 3]], [[0, 3], [1, 2]])


# importance resampling


def brute_resample(rows, target, most, buckets, percent, least, seed):
    fold = str.maketrans(importance.UPPER, importance.LOWER)

    def grams(text):
        import re

        w = re.findall(importance.WORD, (text or "").translate(fold))
        return w, Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1))

    s, t = Counter(), Counter()
    each = [(key, *grams(text)) for key, text in rows]
    for _, _, c in each:
        s += c
    for text in target:
        t += grams(text)[1]
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    out = []
    for key, w, c in each:
        weight = sum(gain[b] * n for b, n in c.items())
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(w), sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    top = [r[4] for r in able[: len(able) * percent // 100]]
    return sorted(map(tuple, out), key=str), top


@pytest.mark.parametrize(("most", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_resample(spark, docs, most, percent):
    target = ["alpha beta gamma", "Delta go", None, ""]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, row int")
    got = importance.resample(docs, frame, most_words=most, buckets=97, percent=percent).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, top = brute_resample(rows, target, most, 97, percent, 20, 2024)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score")) for r in got), key=str) == want
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(top) + 1))
    assert [r["score"] for r in drawn] == top
    assert all((a["score"], -(a["doc_id"] or 1 << 60)) >= (b["score"], -(b["doc_id"] or 1 << 60)) for a, b in zip(drawn, drawn[1:], strict=False))


def test_resample_empty(spark, docs, empty):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).collect() == []
    got = importance.resample(docs, none, buckets=50)
    assert got.count() == docs.count()


# periodic runs


def brute_runs(w, exponent=4, least=6):
    """All stretches by definition: smallest period from prefixes, maximal on both sides."""
    found = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.add((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(key, text, fold):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if w and (given_fold := fold(key, len(w))):
        a, p = given_fold
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        key, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)), len(w),
    )


@pytest.mark.parametrize("options", [{}, {"long_bytes": 60, "lags": 7, "most_ranges": 5}])
def test_periodic_runs(docs, empty, options):
    fold = queries.made_up_repetition
    short = docs.filter("text is null or length(text) < 9000")
    got = periodic_runs.digests(periodic_runs.periodic_runs(short, fold=fold, **options))
    want = [brute_row(r["doc_id"], r["text"], fold) for r in short.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(empty, **options).collect() == []


def test_periodic_runs_of_very_long_texts(spark):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 50)}" for _ in range(4000)]
    long = " ".join([f"u{k}" for k in range(9000)] + base * 4 + ["end"] + ["same"] * 30_000)
    frame = spark.createDataFrame([(1, long), (1, long), (2, "plain " + long)], "doc_id bigint, text string")
    got = {(r["doc_id"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"] if x["period"] in (1, 4000) and x["length"] > 100)) for r in periodic_runs.periodic_runs(frame).collect()}
    assert got == {(1, ((9000, 16000, 4000), (25001, 30000, 1))), (2, ((9001, 16000, 4000), (25002, 30000, 1)))}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5), st.integers(2, 5))
def test_scan_is_exact(some, exponent):
    text = [" ".join("abc"[k] for k in x) for x in some]
    found = periodic_runs.Words(pa.array(text, pa.string()), [], None).runs(exponent, 6)
    assert found == [brute_runs(t.split(), exponent) for t in text]
