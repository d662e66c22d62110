"""Jaccard join of documents on word shingles, by a MinHash LSH forest with exact verification.

Texts with the same words are one class, and only one of them, its representative, goes on. A representative has a
label of ``max_depth`` MinHash values in each of ``trees`` prefix tries; representatives with equal prefixes of their
labels, brought together by the tries' order, are candidates.

Prefixes are shortened step by step, from whole labels to the depth at which a pair at the threshold alone shares one in
some trie with the target recall. Every text takes part down to that depth, however close its matches so far: a text with
a close copy can have a link at the threshold too. What a step spares is the group of a prefix whose texts are all in one
cluster already, since clusters are compared in full; so a shorter prefix costs work only where it brings new texts together.

Candidates are never paired within a prefix's group. They are linked to the group's least member, components of
these links are the clusters, and every pair of candidates is inside one cluster. Clusters are verified exactly on
their full shingle sets when a step has changed them: small ones many at a time, larger ones as pairs of blocks of
bounded bytes, so no task holds a large cluster. Verification returns a row for each member and block (its number of
links and the least member it is linked to), never a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codes, drop_staged, slices, small_side, staged, staged_at, text_bytes, worker_cache
from .graph import components
from .lines import _space

SHINGLE = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_factors = np.random.default_rng(5).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's runs of five words (A-Z folded, parted by ASCII white space), in order, and n + 1
    offsets. A text of one to four words has one shingle of all of them; one without words has none."""
    buf, offs = text_bytes(column)
    inside = ~_space[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    fresh = offs[:-1][offs[:-1] < len(buf)]
    begins[fresh] = inside[fresh]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    before = np.concatenate([[0], np.cumsum(inside)])
    places = np.concatenate([before[at], [int(inside.sum())]]).astype(np.int32)
    low = buf[inside]
    low = np.where((low >= 65) & (low <= 90), low + 32, low).astype(np.uint8)
    which, distinct = codes(pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(low)))
    word = np.fromiter((xxhash.xxh64_intdigest(x) for x in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))[which]
    first = np.searchsorted(at, offs)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(at)) - first[doc]
    own = np.minimum(n, SHINGLE)[doc]  # words in a shingle of this text
    start = np.flatnonzero(pos <= n[doc] - own)
    h = own[start].astype(np.uint64) * _factors[SHINGLE]
    for k in range(SHINGLE):
        there = k < own[start]
        h[there] += word[start[there] + k] * _factors[k]
    count = np.bincount(doc[start], minlength=len(n))
    return _mix(h), np.concatenate([[0], np.cumsum(count)])


def _totals(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offs[1:]] - total[offs[:-1]]


def forest_depth(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """The depth at which shortening ends: a pair at the threshold shares a prefix often enough."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def labels(h: np.ndarray, offs: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The label of each text in each trie: ``depth`` MinHash values of 16 bits; texts must have a shingle."""
    rng = np.random.default_rng(11)
    factor = rng.integers(0, 1 << 31, (trees, depth), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, (trees, depth), dtype=np.uint32)
    base = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(offs) - 1, trees, depth), np.uint16)
    for t in range(trees):
        for k in range(depth):
            low = np.minimum.reduceat(base * factor[t, k] + shift[t, k], offs[:-1])
            out[:, t, k] = _mix(low.astype(np.uint64) * _factors[6] + np.uint64(t + 1)) >> np.uint64(48)
    return out


def _signatures(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near_dups", dict)  # nothing to keep, and nothing of others
        for batch in slices(batches, "text"):
            h, offs = shingles(batch.column(4))
            n = np.diff(offs)
            place = _mix((np.arange(len(h)) - np.repeat(offs[:-1], n)).astype(np.uint64) + np.uint64(1))
            same = [_totals(_mix(h * _factors[8 + k] + place), offs).view(np.int64) for k in (0, 1)]
            full = np.flatnonzero(n)
            tags = np.zeros((0, trees, depth), np.uint16)
            if len(full):
                tags = labels(h, np.concatenate([offs[full], offs[-1:]]), trees, depth)
            ends = np.concatenate([[0], np.cumsum(n > 0)]) * trees
            cuts = np.arange(len(full) * trees + 1, dtype=np.int32) * (2 * depth)
            each = pa.BinaryArray.from_buffers(pa.binary(), len(full) * trees, [None, pa.py_buffer(cuts), pa.py_buffer(tags.tobytes())])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(same[0]), pa.array(same[1]), pa.array(n), lists], names)

    names = [id_col, "row", "k1", "k2", "c1", "c2", "n", "tags"]
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), *_keys(text_col), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, `row` bigint, k1 bigint, k2 bigint, c1 bigint, c2 bigint, n bigint, tags array<binary>"
    )


def _keys(text_col: str) -> list:
    return [F.xxhash64(F.lit(k), F.col(text_col)).alias(f"k{k}") for k in (1, 2)]


class _Links:
    """Links within one cluster, or between two blocks of one; members by place."""

    def __init__(self, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float):
        self.count = np.zeros(len(sets), np.int64)
        self.root = np.arange(len(sets))
        size = np.array([len(s) for s in sets])
        if len(sets) <= 6:
            for x, i in enumerate(left):
                for j in right[x + 1 :] if left is right else right:
                    self.add(i, j, len(np.intersect1d(sets[i], sets[j], assume_unique=True)), size, threshold)
            return
        flat = np.concatenate(sets)
        _, back, times = np.unique(flat, return_inverse=True, return_counts=True)
        common = times[back] > 1
        number = np.cumsum(times > 1) - 1
        owner = np.repeat(np.arange(len(sets)), size)[common]
        column = number[back][common]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(left), len(right)), np.float32)
        row_l, row_r = np.full(len(sets), -1), np.full(len(sets), -1)
        row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
        for a in range(0, int(number[-1]) + 1 if len(number) else 0, 1024):  # bounded memory: some columns at a time
            s = slice(*np.searchsorted(column, [a, a + 1024]))
            m = np.zeros((len(left), 1024), np.float32)
            mine = row_l[owner[s]] >= 0
            m[row_l[owner[s][mine]], column[s][mine] - a] = 1
            o = m
            if left is not right:
                o = np.zeros((len(right), 1024), np.float32)
                mine = row_r[owner[s]] >= 0
                o[row_r[owner[s][mine]], column[s][mine] - a] = 1
            for rows in self._stripes(len(left), len(right)):
                both[rows] += m[rows] @ o.T
        linked = np.zeros(both.shape, bool)
        for rows in self._stripes(len(left), len(right)):  # bounded memory: some rows at a time
            union = (size[left[rows]][:, None] + size[right][None, :]).astype(np.float32) - both[rows]
            over = both[rows] - np.float32(threshold) * union
            doubt = np.abs(over) <= 1e-3 + 2e-6 * union  # decided exactly
            linked[rows] = over > 0
            for i, j in np.argwhere(doubt).tolist():
                k = int(both[rows.start + i, j])
                linked[rows.start + i, j] = k >= threshold * (int(size[left[rows.start + i]]) + int(size[right[j]]) - k) - 1e-9
        del both
        if left is right:
            np.fill_diagonal(linked, False)
        self.count[left] += linked.sum(1)
        if left is not right:
            self.count[right] += linked.sum(0)
        while True:  # the least member over chains of links, in rounds
            old = self.root.copy()
            for rows in self._stripes(len(left), len(right)):
                low = np.where(linked[rows], self.root[right][None, :], len(sets)).min(1, initial=len(sets))
                self.root[left[rows]] = np.minimum(self.root[left[rows]], low)
                low = np.where(linked[rows], self.root[left[rows]][:, None], len(sets)).min(0, initial=len(sets))
                self.root[right] = np.minimum(self.root[right], low)
            if (old == self.root).all():
                break

    @staticmethod
    def _stripes(rows: int, columns: int, cells: int = 1 << 20) -> list[slice]:
        step = max(1, cells // max(columns, 1))
        return [slice(a, min(a + step, rows)) for a in range(0, rows, step)]

    def add(self, i: int, j: int, common: int, size: np.ndarray, threshold: float) -> None:
        union = size[i] + size[j] - common
        if common >= threshold * union - 1e-9:
            self.count[[i, j]] += 1
            a, b = self.find(i), self.find(j)
            self.root[max(a, b)] = min(a, b)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i


def _verify(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        """A group: some whole clusters (i = j = 0), or one pair of blocks of a cluster."""
        group = group.combine_chunks()
        member, cluster, block, i, j = (group.column(c).to_numpy() for c in ("member", "cluster", "block", "i", "j"))
        order = np.lexsort((member, cluster))
        sets = group.column("shingles")
        out: list[tuple[np.ndarray, ...]] = []
        for part in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            part = part[np.concatenate([[True], np.diff(member[part]) > 0])]  # repeated rows
            got = [sets[int(k)].values.to_numpy() for k in part]
            if i[part[0]] == j[part[0]]:
                left = right = np.arange(len(part))
            else:
                left, right = np.flatnonzero(block[part] == i[part[0]]), np.flatnonzero(block[part] == j[part[0]])
            links = _Links(got, left, right, threshold)
            out.append((member[part], links.count, member[part][[links.find(k) for k in range(len(part))]]))
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["member", "links", "root"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingles of the texts."""
    for batch in slices(batches, "text"):
        h, offs = shingles(batch.column(4))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offs))
        at = np.lexsort((h, doc))
        fresh = np.ones(len(at), bool)
        fresh[1:] = (h[at][1:] != h[at][:-1]) | (doc[at][1:] != doc[at][:-1])
        at = at[fresh]
        ends = np.searchsorted(doc[at], np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[at].view(np.int64)))], ["member", "cluster", "block", "blocks", "shingles"])


def _checked(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, threshold: float, block_bytes: int) -> DataFrame:
    """Exact verification of whole clusters; ``members`` (staged): member, cluster, n, id, k1, k2."""
    size = members.groupBy("cluster").agg(F.sum("n").alias("total"))
    blocks = F.ceil(F.col("total") * 8 / block_bytes).cast("int")
    held = members.join(small_side(staged(size), 32), "cluster").withColumn("blocks", F.greatest(blocks, F.lit(1)))
    held = held.select("member", "cluster", "id", "k1", "k2", "blocks", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"))
    weight = members.agg(F.sum("n")).first()[0] or 0
    bins = max(1, weight * 8 // block_bytes)  # of small clusters, so that a group has about ``block_bytes`` too
    texts = docs.select(F.col(id_col).alias("id"), *_keys(text_col), F.col(text_col).alias("text"))
    held = small_side(staged(held), 80)
    mine = texts.join(held, (texts["id"].eqNullSafe(held["id"])) & (texts["k1"] == held["k1"]) & (texts["k2"] == held["k2"])).select("member", "cluster", "block", "blocks", "text")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = mine.mapInArrow(_sets, "member bigint, cluster bigint, block int, blocks int, shingles array<bigint>").withColumn("o", other).select(
        "member", "cluster", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "shingles",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")).alias("g"), (F.col("blocks") > 1).alias("large"),
    )
    return staged(dealt.groupBy("large", "g", "i", "j").applyInArrow(_verify(threshold), "member bigint, links bigint, root bigint"))


def _candidates(own: DataFrame, cluster: DataFrame | None, depth: int) -> DataFrame:
    """Links (a, b) from members of each prefix's group to its least one, of groups with texts of two or more clusters (node,
    label; a text that none has is one by itself)."""
    rows = own.select("row", "tags", F.col("row").alias("mine"))
    if cluster is not None:
        rows = own.select("row", "tags").join(cluster.select(F.col("node").alias("row"), F.col("label")), "row", "left").select("row", "tags", F.coalesce("label", "row").alias("mine"))
    entries = rows.select("row", "mine", F.posexplode("tags").alias("tree", "label"))
    entries = entries.select("row", "mine", F.xxhash64("tree", F.substring("label", 1, 2 * depth)).alias("prefix"))
    met = entries.groupBy("prefix").agg(F.min("row").alias("low"), F.min("mine").alias("first"), F.max("mine").alias("last"))
    met = met.filter(F.col("first") != F.col("last")).select("prefix", "low")
    return entries.select("row", "prefix").join(met, "prefix").filter(F.col("row") != F.col("low")).select(F.col("row").alias("a"), F.col("low").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
    trees: int = 32, max_depth: int = 12, recall: float = 0.999, step: int = 5, block_bytes: int = 4 << 20,
) -> DataFrame:
    """A row a document: ``id_col``, k1 and k2 (keys of its text), row (its place), class_id, n_links, n_copies and first.

    class_id is the least id of the documents connected by links, copies included; n_links counts the other
    distinct word sequences at the threshold or above; n_copies the documents with the same words; first is true
    for one document of each class: the least by id (nulls last), then by place. Null and empty texts, and texts of
    white space, are copies of each other without links. class_id is null if all ids of the class are null. Repeated
    rows are copies. A very long text is one set like others. Empty tables give an empty result; further columns are not
    read, whatever their names.
    """
    spark, name = docs.sparkSession, id_col
    docs, id_col, text_col = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text"
    seen = staged(_signatures(docs, id_col, text_col, trees, max_depth))
    order = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), "row", "k1", "k2")
    same = staged(seen.groupBy("c1", "c2").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("n_copies")))
    own = staged(seen.filter("n > 0").select("row", "n", "tags").join(same.select(F.col("m.row").alias("row"), F.col("m.id").alias("id"), F.col("m.k1").alias("k1"), F.col("m.k2").alias("k2")), "row"))
    known = own.select(F.col("row").alias("node"), "n", "id", "k1", "k2")
    floor = forest_depth(threshold, trees, max_depth, recall)
    cluster = checked = None
    for depth in sorted({*range(max_depth, floor, -step), floor}, reverse=True):
        links = _candidates(own, cluster, depth)
        if cluster is not None:
            links = links.unionByName(cluster.filter("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")))
        now = components(links)
        kept = now.withColumn("before", F.col("node")) if cluster is None else now.join(cluster.select("node", F.col("label").alias("old")), "node", "left").select("node", "label", F.coalesce("old", "node").alias("before"))
        changed = kept.groupBy("label").agg(F.min("before").alias("a"), F.max("before").alias("b")).filter("a != b").select("label")
        members, members_path = staged_at(now.join(changed, "label").join(known, "node").select(F.col("node").alias("member"), F.col("label").alias("cluster"), "n", "id", "k1", "k2"))
        found = _checked(docs, members, id_col, text_col, threshold, block_bytes)
        if checked is not None:
            found = staged(found.unionByName(checked.join(members.select("member"), "member", "left_anti")))
        drop_staged(spark, members_path)
        cluster, checked = now, found
    links = checked.groupBy("member").agg(F.sum("links").cast("bigint").alias("n_links")).filter("n_links > 0")
    found = components(checked.filter("member != root").select(F.col("member").alias("a"), F.col("root").alias("b")))
    reps = same.select("c1", "c2", "n_copies", F.col("m.id").alias("rep_id"), F.col("m.row").alias("rep"))
    linked = staged(found.withColumnRenamed("node", "rep").join(links.withColumnRenamed("member", "rep"), "rep").join(reps.select("rep", "rep_id"), "rep"))
    best = linked.groupBy("label").agg(F.min(F.struct(F.col("rep_id").isNull().alias("last"), "rep_id", "rep")).alias("m"))
    linked = linked.join(best, "label").select("rep", "n_links", F.col("m.rep_id").alias("class_id"), F.col("m.rep").alias("best"))
    classes = reps.join(linked, "rep", "left").select(
        "c1", "c2", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("best").isNull(), F.col("rep_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("best", "rep").alias("best"),
    )
    return seen.select("id", "row", "k1", "k2", "c1", "c2").join(classes, ["c1", "c2"]).select(
        F.col("id").alias(name), "k1", "k2", "row", "class_id", "n_links", F.col("n_copies").cast("bigint").alias("n_copies"), (F.col("row") == F.col("best")).alias("first")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are first in their class; of rows with the same id and text, one. Columns
    may have any names; null, empty, repeated and very long texts are as in ``near_duplicates``."""
    order = near_duplicates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", **options)
    each = order.groupBy("id", "k1", "k2").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("n"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & a["k1"].eqNullSafe(b["k1"]) & a["k2"].eqNullSafe(b["k2"])
    each = staged(each.filter(~F.col("first") | (F.col("n") > 1)))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), *_keys(text_col))
    gone = small_side(each, 64)
    once = row.join(gone, same(row, gone), "left_anti").select("row")
    many = small_side(each.filter("first"), 64)
    again = row.join(many, same(row, many)).groupBy(row["id"], row["k1"], row["k2"]).agg(F.first("row").alias("row")).select("row")
    return once.unionByName(again).select("row.*")
