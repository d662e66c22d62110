"""Vector bin packing of examples into sequences, under limits on tokens, segments and loss-bearing tokens.

Each task encodes its rows and keeps a pool of pieces, bounded in tokens. A sequence is filled from the pool by the
dot-product heuristic: of the pieces that fit in all three dimensions, the one goes in whose demand has the greatest dot
product with what is left of the sequence, both as shares of the limits. When no piece fits whole, the best one is cut so
that the sequence is full. What a task has left at its end, or a sequence that the limit on segments stops early, is cut to
lengths that need no padding (powers of two). So sequences are full whatever the lengths of the texts, and no row is
shuffled: a sequence lies within one task, a retried task makes the same sequences, and a hot key has no meaning here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_fields, slices
from .word_ids import encoder

END_OF_TEXT = 1


class Packer:
    """Pieces are (owner, start, length); ``free``: so many tokens at the front of an owner bear no loss."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool = True):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be 1 or more")
        self.limits = (max_tokens, max_segments, max_loss)
        self.cut = cut
        self.owner, self.start, self.length, self.free, self.loss = (np.zeros(0, np.int64) for _ in range(5))
        self.tokens = 0

    def add(self, owners: list[int], lengths: list[int], free: list[int]) -> None:
        """Examples; one that is over a limit by itself is cut into pieces that are not."""
        rows = []
        for o, n, f in zip(owners, lengths, free, strict=True):
            start = 0
            while start < n:
                take = self._most(f, start, n - start, self.limits[0], self.limits[2])
                rows.append((o, start, take, f, max(start + take - max(start, f), 0)))
                start += take
        new = np.array(rows, np.int64).reshape(-1, 5)
        live = self.length > 0
        held = (self.owner, self.start, self.length, self.free, self.loss)
        self.owner, self.start, self.length, self.free, self.loss = (np.concatenate([x[live], y]) for x, y in zip(held, new.T, strict=True))
        self.tokens += sum(lengths)

    @staticmethod
    def _most(free: int, start: int, length: int, tokens: int, loss: int) -> int:
        """The longest front of a piece within the limits."""
        return min(length, tokens, max(free - start, 0) + loss)

    def _set(self, k: int, start: int, length: int) -> None:
        """What is left of piece ``k``; one without tokens is gone."""
        self.start[k], self.length[k] = start, length
        self.loss[k] = max(start + length - max(start, int(self.free[k])), 0) if length else 0

    def sequences(self, leave: int) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences, until the pool has ``leave`` tokens or fewer (0: all of it)."""
        while self.tokens > leave:
            made = self._fill()
            self.tokens -= sum(n for _, _, n in made)
            yield made

    def _fill(self) -> list[tuple[int, int, int]]:
        most, segments, most_loss = self.limits
        tokens, places, loss = self.limits
        made: list[tuple[int, int, int]] = []  # slot, start, length
        while tokens and places:
            # the segment's share is the same for all pieces, so two products decide
            score = self.length * (tokens / most**2) + self.loss * (loss / most_loss**2)
            score[self.length == 0] = -1
            k = int(np.where((self.length <= tokens) & (self.loss <= loss), score, -1.0).argmax())
            if not (0 < self.length[k] <= tokens and self.loss[k] <= loss):  # none fits whole
                k = int(score.argmax())
                if not self.cut or score[k] < 0:
                    break
            start, length = int(self.start[k]), int(self.length[k])
            take = self._most(int(self.free[k]), start, length, tokens, loss)
            if not take:
                break
            made.append((k, start, take))
            self._set(k, start + take, length - take)
            tokens, places = tokens - take, places - 1
            loss -= max(start + take - max(start, int(self.free[k])), 0)
        total = most - tokens
        over = total - (1 << (total.bit_length() - 1)) if self.cut and tokens else 0
        while over:  # cut back to a length without padding: the last pieces return to their slots
            k, start, take = made.pop()
            back = min(take, over)
            self._set(k, start + take - back, int(self.length[k]) + back)
            if take > back:
                made.append((k, start, take - back))
            over -= back
        return [(int(self.owner[k]), start, take) for k, start, take in made]


def pack(
    docs: DataFrame, tokenizer_path: str, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", prompt_col: str | None = None,
    max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None, end_id: int = END_OF_TEXT, cut: bool = True, pool_tokens: int = 1 << 18,
) -> DataFrame:
    """A row a piece: ``id_cols``, start and length (its place in the example's ids), ids (binary: little-endian unsigned 32-bit
    ids), doc_tokens (ids of the example), n_loss, sequence_id and offset (its place in the sequence).

    An example is the ids of its prompt (which bear no loss; instruction data), of its text, and ``end_id``. cut: examples
    may be cut to fill a sequence; else only those over a limit by themselves are cut, and sequences are padded.
    max_loss: None for no limit of its own. Null texts and prompts are empty, so an empty example is its end alone.
    Rows are independent: null or repeated ids and repeated rows are packed each. A very long text becomes many pieces. An
    empty table gives an empty result; further columns are not read. ``tokenizer_path`` must exist on every executor.
    """
    given = (tokenizer_path, max_tokens, max_segments, max_loss or max_tokens, cut)
    columns = [*id_cols, *([prompt_col] if prompt_col else []), text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, *limits = given
        packer, first = Packer(*limits), TaskContext.get().partitionId() << 33
        ids_of: dict[int, np.ndarray] = {}
        keys: dict[int, tuple] = {}
        free_of: dict[int, int] = {}
        left: dict[int, int] = {}  # tokens of an owner that no sequence has yet
        kinds: list[pa.DataType] = []
        owners = made = 0

        def out(leave: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows: list[tuple] = []
            held = 0
            for pieces in packer.sequences(leave):
                offset = 0
                for o, s, n in pieces:
                    f = free_of[o]
                    rows.append((*keys[o], s, n, ids_of[o][s : s + n].tobytes(), len(ids_of[o]), min(n, max(s + n - f, 0)), first + made, offset))
                    offset += n
                    left[o] -= n
                    if not left[o]:
                        del ids_of[o], keys[o], left[o], free_of[o]
                made += 1
                held += offset
                if held >= 1 << 18:
                    yield batch_of(rows, kinds)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows, kinds)

        for batch in slices(batches, text_col, 1 << 20):
            at = batch.schema.get_field_index
            kinds[:] = [batch.column(at(c)).type for c in id_cols]
            model = encoder(path)
            ids, offs = model.encode(batch.column(at(text_col)))
            front, front_offs = model.encode(batch.column(at(prompt_col))) if prompt_col else (ids[:0], np.zeros(batch.num_rows + 1, np.int64))
            names = list(zip(*(batch.column(at(c)).to_pylist() for c in id_cols), strict=True))
            lengths, free = [], []
            end = np.array([end_id], "<u4")
            for i, key in enumerate(names):
                before = front[front_offs[i] : front_offs[i + 1]]
                own = np.concatenate([before.astype("<u4"), ids[offs[i] : offs[i + 1]].astype("<u4"), end])
                ids_of[owners + i], keys[owners + i], left[owners + i], free_of[owners + i] = own, key, len(own), len(before)
                lengths.append(len(own))
                free.append(len(before))
            packer.add(list(range(owners, owners + len(names))), lengths, free)
            owners += len(names)
            if packer.tokens > pool_tokens:
                yield from out(pool_tokens // 2)
        yield from out(0)

    names = [*id_cols, "start", "length", "ids", "doc_tokens", "n_loss", "sequence_id", "offset"]
    rest = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [*kinds, *rest], strict=True)], names)

    schema = f"{id_fields(docs, id_cols)}, start bigint, length bigint, ids binary, doc_tokens bigint, n_loss bigint, sequence_id bigint, offset bigint"
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
