"""BPE encoding by content-defined chunks, and decoding.

A rolling hash over the last bytes of UTF-8 chooses the places where a text is cut, always just before white
space, so equal passages of different documents give equal chunks wherever they stand. Each distinct chunk of
a batch is encoded once; a bounded store of encoded chunks lives as long as the Python worker, so later batches
and tasks of the same worker reuse it. A chunk not met before is cut again at every candidate place, and its parts
have a store of their own, so a new chunk of known words costs no call of the tokenizer. Texts are never shuffled:
once per worker is what sharing costs nothing to reach, while once per cluster would move every text over the network.

Joins: for every context of a cut (the byte before it, the white space, the byte after) the first example is
encoded both in parts and as a whole. If they disagree, cuts in that context are taken back and the longer
chunk is encoded instead, until all joins that are left agree. For a tokenizer that drops white space and
treats words one by one no join disagrees, but the operator doesn't rest on that.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_fields, slices, text_bytes, worker_cache

_WINDOW, _SPACES = 8, " \n\t\r"
MASK_BITS = 4


class ChunkEncoder:
    """mask_bits: a cut at one of 2**mask_bits candidate places on average. store_bytes: bound of both stores."""

    def __init__(self, path: str, mask_bits: int = MASK_BITS, store_bytes: int = 64_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.masks = [np.uint32((1 << b) - 1) for b in sorted({mask_bits, 0}, reverse=True)]  # of each level
        self.bounds = [store_bytes // 4, store_bytes * 3 // 4] if mask_bits else [store_bytes]
        self.stores: list[dict[str, bytes]] = [{} for _ in self.masks]
        self.stored = [0] * len(self.masks)
        self.calls = 0
        self.joins = np.zeros(1 << 24, np.int8)  # 0 not seen, 1 agrees, 2 does not

    def plain(self, texts: list[str]) -> list[list[int]]:
        self.calls += len(texts)
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def many(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, as int32 bytes. Chunks that begin with white space are put into calls of some size, one
        after another where joins of their context agree, and the places of the tokens tell them apart. A text's
        first chunk, and one with the text of an added token, is encoded by itself."""
        out = [b""] * len(chunks)
        group: list[int] = []
        size, last = 0, 0
        alone = [i for i, x in enumerate(chunks) if x[0] not in _SPACES or len(x) < 2 or self.special.search(x)]
        for i, ids in zip(alone, self.plain([chunks[i] for i in alone]), strict=True):
            out[i] = np.array(ids, np.int32).tobytes()
        single = set(alone)
        for i, chunk in enumerate(chunks):
            if i in single:
                continue
            raw = chunk.encode()
            if group and (size >= 1 << 15 or self.joins[last << 16 | raw[0] << 8 | raw[1]] != 1):
                self._apart(chunks, group, out)
                group, size = [], 0
            group.append(i)
            size += len(chunk)
            last = raw[-1]
        if group:
            self._apart(chunks, group, out)
        return out

    def _apart(self, chunks: list[str], group: list[int], out: list[bytes]) -> None:
        self.calls += len(group)
        e = self.tokenizer.encode("".join([chunks[k] for k in group]), add_special_tokens=False)
        ids = np.array(e.ids, np.int32)
        begins = np.fromiter((x[0] for x in e.offsets), np.int64, len(ids))
        start = 0
        for k, end in zip(group, np.searchsorted(begins, np.cumsum([len(chunks[k]) for k in group])).tolist(), strict=True):
            out[k] = ids[start:end].tobytes()
            start = end

    def cuts(self, buf: np.ndarray, offs: np.ndarray, mask: np.uint32) -> np.ndarray:
        """Places of cuts within texts, ascending; starts of texts are not among them."""
        n = len(buf)
        if n < 3:
            return np.zeros(0, np.int64)
        space = (buf == 32) | (buf == 10) | (buf == 9) | (buf == 13)
        at = np.flatnonzero(space[1:-1] & ~space[:-2] & ~space[2:]) + 1
        inside = np.ones(n + 1, bool)
        inside[offs] = False  # a text's first byte
        inside[np.maximum(offs[1:] - 1, 0)] = False  # its last one
        at = at[inside[at]]
        if mask:
            h = np.zeros(len(at), np.uint32)
            start = offs[np.searchsorted(offs, at, side="right") - 1]
            for k in range(1, _WINDOW + 1):  # the window ends where its text begins
                h = h * np.uint32(0x01000193) + np.where(at - k >= start, buf[np.maximum(at - k, 0)], 0).astype(np.uint32)
            h ^= h >> np.uint32(15)
            at = at[(h & mask) == 0]
        return at

    def checked(self, buf: np.ndarray, offs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The cuts whose joins agree with the encoding of the whole."""
        while len(at):
            context = (buf[at - 1].astype(np.int64) << 16) | (buf[at].astype(np.int64) << 8) | buf[at + 1]
            new = np.flatnonzero(self.joins[context] == 0)
            if len(new):
                edges = _edges(len(buf), offs, at)
                for p, k in zip(at[new].tolist(), context[new].tolist(), strict=True):
                    if not self.joins[k]:
                        j = int(np.searchsorted(edges, p))
                        left, right = (buf[a:b].tobytes().decode() for a, b in ((edges[j - 1], p), (p, edges[j + 1])))
                        a, b, whole = self.plain([left, right, left + right])
                        self.joins[k] = 1 if a + b == whole else 2
            good = self.joins[context] == 1
            if good.all():
                break
            at = at[good]
        return at

    def encode(self, column: pa.Array, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and n + 1 offsets into them."""
        buf, offs = text_bytes(column)
        edges = _edges(len(buf), offs, self.checked(buf, offs, self.cuts(buf, offs, self.masks[level])))
        if len(edges) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        chunks = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf)))
        d = chunks.dictionary_encode()
        which, distinct = d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()
        store = self.stores[level]
        ids = [store.get(x) for x in distinct]
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            texts = [distinct[i] for i in missing]
            if self.stored[level] > self.bounds[level]:
                store.clear()
                self.stored[level] = 0
            for i, text, found in zip(missing, texts, self._fresh(texts, level + 1), strict=True):
                ids[i] = found
                if len(text) <= 4096:
                    store[text] = found
                    self.stored[level] += 150 + len(text) + len(found)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        starts = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        take = np.arange(int(ends[-1])) + np.repeat(starts[which] - (ends - n), n)
        total = np.concatenate([[0], ends])
        return flat[take], total[np.searchsorted(edges, offs)]


    def _fresh(self, chunks: list[str], level: int) -> list[bytes]:
        """Ids of chunks that no store has: from their parts, or at the last level from the tokenizer."""
        if level == len(self.masks):
            return self.many(chunks)
        ids, offs = self.encode(pa.array(chunks, pa.string()), level)
        raw, at = ids.tobytes(), (offs * 4).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]


def _edges(n: int, offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    flag = np.zeros(n + 1, bool)
    flag[offs] = True
    flag[at] = True
    return np.flatnonzero(flag)


def _worker(path: str, mask_bits: int) -> ChunkEncoder:
    return worker_cache(f"bpe {mask_bits} {path}", lambda: ChunkEncoder(path, mask_bits))


def encode_decode(
    docs: DataFrame, tokenizer_path: str, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", mask_bits: int = MASK_BITS,
) -> DataFrame:
    """``id_cols``, ids (array of int: the library's encoding of the whole text) and decoded (its decoding).

    Null and empty texts have no ids and decode to an empty string. Rows are independent: null or repeated ids
    and repeated rows give a result each; an empty table gives an empty result; further columns are not read.
    ``tokenizer_path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(tokenizer_path, mask_bits)
        for batch in slices(batches, text_col, 1 << 20):
            ids, offs = encoder.encode(batch.column(batch.schema.get_field_index(text_col)))
            lists = [ids[a:b].tolist() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            decoded = pa.array(encoder.tokenizer.decode_batch(lists, skip_special_tokens=False), pa.string())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in id_cols]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32())), decoded], [*id_cols, "ids", "decoded"])

    return docs.select(*id_cols, text_col).mapInArrow(run, f"{id_fields(docs, id_cols)}, ids array<int>, decoded string")
