"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Random indexing: a word's index vector is a few +1 and -1 at places that its hash gives. A word's context vector is
the sum of the index vectors of its neighbours; words share ``buckets`` rows by hash, so the table has a fixed size
however large the vocabulary grows. A document is the mean of its words' index vectors and of their normalised
context vectors.

Tokens are letter runs, digits and symbols, with the case shape as its own token (Upper for a word of two or more
capitals), and a run equal to the one before it is the one token Again, so shouting, tables, symbol noise and
stuttering have words of their own.

Every text is cut into tokens once; their rows (16 bits each) are written beside the columns that go on. Context vectors
are summed over all documents, labelled or not: a partial sum for each task, then one for each row of the table, whose
size is fixed. Fitting uses at most ``max_rows`` labelled rows outside the held-out fold, those with the smallest id
hash: a bounded sample, the documented bound of the driver's work. A part of them, chosen by another hash, sets the
temperature. Texts are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, text_bytes, worker_cache

DIM, NONZERO, WINDOW = 32, 4, 2
_strip = re.compile(r"[^\W\d_]+|\d|[^\w\s]|_")


@dataclass
class Model:
    index: np.ndarray  # buckets x DIM, int8 index vectors
    context: np.ndarray  # buckets x DIM, normalised context vectors
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))


def index_vectors(buckets: int) -> np.ndarray:
    """NONZERO places with signs for each bucket, from a fixed seed."""
    rng = np.random.default_rng(20)
    out = np.zeros((buckets, DIM), np.float32)
    rows = np.arange(buckets)
    for k in range(NONZERO):
        out[rows, rng.integers(0, DIM, buckets)] += 1 - 2 * (k % 2)
    return out


def _pieces(word: str) -> list[str]:
    """Tokens of a run without white space."""
    out = []
    for t in _strip.findall(word):
        out.append(t.lower() if len(t) < 2 or not t.isupper() else "\x01UP")
        if len(t) > 1 and t.isupper():
            out.append(t.lower())
    return out


def tokens(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens of all texts in order, and n + 1 offsets into them."""
    from .lines import _space

    buf, offs = text_bytes(column)
    inside = ~_space[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    fresh = offs[:-1][offs[:-1] < len(buf)]
    begins[fresh] = inside[fresh]
    at = np.flatnonzero(begins)
    before = np.concatenate([[0], np.cumsum(inside)])
    places = np.concatenate([before[at], [int(inside.sum())]]).astype(np.int32)
    d = pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(buf[inside])).dictionary_encode()
    which = d.indices.to_numpy(zero_copy_only=False)
    known: dict[str, list[int]] = worker_cache("quality", dict)  # hashes of a word's tokens
    if len(known) > 100_000:
        known.clear()
    lists = []
    for word in d.dictionary.to_pylist():
        found = known.get(word)
        if found is None:
            found = known[word] = [xxhash.xxh32_intdigest(t.encode()) for t in _pieces(word)]
        lists.append(found)
    lists.append([xxhash.xxh32_intdigest(b"\x01AGAIN")])
    again = np.zeros(len(at), bool)
    again[1:] = which[1:] == which[:-1]
    firsts = np.searchsorted(at, offs[:-1])
    again[firsts[firsts < len(at)]] = False  # a text's first word
    which = np.where(again, len(lists) - 1, which)
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for y in lists for x in y), np.int64, int(size.sum())) % buckets
    starts, n = np.cumsum(size) - size, size[which]
    ends = np.cumsum(n)
    take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[which] - (ends - n), n)
    total = np.concatenate([[0], ends])
    return flat[take], total[np.searchsorted(at, offs)]


def _pool(bucket: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` over each text's tokens; zeros for a text without any."""
    out = np.zeros((len(offs) - 1, table.shape[1]), np.float32)
    n = np.diff(offs)
    full = np.flatnonzero(n > 0)
    for part in np.array_split(full, max(1, int(n.sum()) // 50_000)):  # bounded memory, whatever the texts' lengths
        if len(part):
            a, b = offs[part[0]], offs[part[-1] + 1]
            out[part] = np.add.reduceat(table[bucket[a:b]], offs[part] - a, axis=0) / n[part][:, None]
    return out


def features(bucket: np.ndarray, offs: np.ndarray, index: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Mean index vector, mean context vector, log count of tokens."""
    return np.hstack([_pool(bucket, offs, np.hstack([index, context])), np.log1p(np.diff(offs))[:, None].astype(np.float32)])


def context_sums(bucket: np.ndarray, offs: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each bucket the sum of the index vectors of its tokens' neighbours, up to WINDOW places away in the text."""
    out = np.zeros(index.shape, np.int64)
    small = index.astype(np.int8)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for start in range(0, len(bucket), 250_000):  # bounded memory, whatever the texts' lengths
        at = np.arange(start, min(len(bucket), start + 250_000))
        near = np.zeros((len(at), index.shape[1]), np.int8)
        for k in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
            other = np.clip(at + k, 0, len(bucket) - 1)
            near += small[bucket[other]] * ((other == at + k) & (doc[other] == doc[at]))[:, None]
        order = np.argsort(bucket[at], kind="stable")
        mine = bucket[at][order]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        out[mine[first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
    return out


def logits(p: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """Of the two-layer network with weights and biases ``p``."""
    return np.maximum(z @ p[0] + p[1], 0) @ p[2] + p[3][0]


def gradients(p: list[np.ndarray], z: np.ndarray, t: np.ndarray, decay: float = 1e-4) -> list[np.ndarray]:
    """Of the mean log loss and half the ``decay`` of the squared weights."""
    h = np.maximum(z @ p[0] + p[1], 0)
    g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - t) / len(z)
    back = np.outer(g, p[2]) * (h > 0)
    return [z.T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]


def temperature_of(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature of a grid with the least log loss."""
    sign = np.where(y > 0, 1, -1)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    return float(grid[np.argmin([np.logaddexp(0, -sign * logit / g).mean() for g in grid])])


def fit_network(x: np.ndarray, y: np.ndarray, cal: np.ndarray, hidden: int = 24, epochs: int = 60) -> tuple:
    """Adam on the rows that aren't in ``cal``; then the temperature on ``cal``."""
    rng = np.random.default_rng(7)
    mean, scale = x[~cal].mean(0), x[~cal].std(0) + 1e-3
    z, t = (x[~cal] - mean) / scale, y[~cal].astype(np.float32)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            if not len(part):
                continue
            step += 1
            for k, grad in enumerate(gradients(p, z[part], t[part])):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    temperature = temperature_of(logits(p, (x[cal] - mean) / scale), y[cal]) if cal.any() else 1.0
    return mean, scale, p[0], p[1], p[2], float(p[3][0]), temperature


def _flat(lists: pa.Array, most: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of a column of token lists, and n + 1 offsets into them, by runs of texts of about ``most`` tokens (a longer
    text stands alone)."""
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    start = 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield lists.slice(start, stop - start).flatten().to_numpy().astype(np.int64), ends[start : stop + 1] - ends[start]
        start = stop


def tokenised(docs: DataFrame, keep: dict, text_col: str = "text", buckets: int = 1 << 14) -> DataFrame:
    """Staged: the columns of ``keep`` (name: column) and ``tokens``, the rows of the table for the text's tokens."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for batch in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text", 1 << 20):
            found, offs = tokens(batch.column(0), buckets)
            out.append(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(found.astype(np.int16))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int16()))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    text = F.coalesce(F.col(text_col), F.lit(""))
    return staged(docs.select(*[c.alias(k) for k, c in keep.items()], F.arrow_udf(run, "array<smallint>")(text).alias("tokens")))


def train(seen: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 6000, buckets: int = 1 << 14) -> Model:
    """``seen``: of ``tokenised``, with the column ``id_col``. Rows with crc32(id as text) mod 5 = 0 are never learnt from,
    but their texts count for the context vectors, which know no labels. Of repeated ids, and of repeated labels, the
    least is taken. Without labelled rows of both classes the score is 1 for everything, so nothing is rejected."""
    clean = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    picked = clean.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = seen.select(F.col(id_col).alias("id"), "tokens").join(F.broadcast(picked), "id").groupBy("id").agg(F.min("tokens").alias("tokens"), F.min("y").alias("y"))
    index = index_vectors(buckets)
    columns = [f"v{k}" for k in range(DIM)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Context sums of a task, as the rows that aren't zero."""
        total = np.zeros(index.shape, np.int64)
        for batch in batches:
            for bucket, offs in _flat(batch.column(0)):
                total += context_sums(bucket, offs, index)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, k]) for k in range(DIM))], ["bucket", *columns])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([features(*part, index, context) for part in _flat(batch.column(1))] or [np.zeros((0, 2 * DIM + 1))]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], ["h", "x", "y"])

    sums = seen.select("tokens").mapInArrow(partial, f"bucket int, {', '.join(f'{c} bigint' for c in columns)}")
    total = sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns])
    context = np.zeros((buckets, DIM), np.float32)
    for part in total.toArrow().to_batches():  # ``buckets`` rows at most, of DIM numbers
        context[part.column(0).to_numpy()] = np.stack([part.column(k + 1).to_numpy() for k in range(DIM)], 1)
    context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-6
    sample = rows.select(F.xxhash64(F.lit(3), "id").alias("h"), "tokens", F.col("y").cast("int").alias("y"))
    got = sorted((r["h"], r["x"], r["y"]) for r in sample.mapInArrow(featured, "h bigint, x binary, y int").collect())  # ``max_rows`` rows at most
    x = np.array([np.frombuffer(r[1], np.float32) for r in got], np.float32).reshape(len(got), 2 * DIM + 1).astype(np.float64)
    y = np.array([r[2] for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(index, context, np.zeros(2 * DIM + 1), np.ones(2 * DIM + 1), np.zeros((2 * DIM + 1, 1)), np.zeros(1), np.zeros(1), 30.0, 1.0)
    return Model(index, context, *fit_network(x, y, np.array([r[0] % 5 == 0 for r in got])))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def score(seen: DataFrame, model: Model) -> DataFrame:
    """The columns of ``seen`` (of ``tokenised``) without its tokens, and score (0 to 1) of every row.

    Null and empty texts have the features of no words and a score like any other; of a very long text all words count.
    Null and repeated ids and repeated rows have a score each. An empty table gives an empty result; columns are those
    that were kept.
    """
    shared = seen.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2 tables of buckets x DIM

    def run(lists: pa.Array) -> pa.Array:
        m = shared.value
        each = [m.score(features(*part, m.index, m.context).astype(np.float64)) for part in _flat(lists)]
        return pa.array(np.concatenate(each) if each else [], pa.float64())

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return seen.select(*[F.col(f"`{c}`") for c in seen.columns if c != "tokens"], F.arrow_udf(run, "double")(F.col("tokens")).alias("score"))
