"""Token counts of a unigram or BPE piece model, without sending token ids to Spark.

Texts go through Arrow functions that return lengths only. Within a batch they are cut and gathered into
calls of about equal bytes, so that one long text neither grows the heap of the merge queue nor stalls a batch.

A text is cut only at one space between two characters of ``_SAFE``: printable ASCII, and letters of other scripts that
normalisation neither changes nor composes. The model marks a space as U+2581 and has no piece with that mark after
another character, so no piece spans such a place; the space that is dropped there comes back as the mark that the
encoder puts before every text. Where a text has no such place (as in scripts without spaces), it stays whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_fields, slices, text_bytes

#: Ranges of characters beside which a space is a safe place: ASCII, Latin, Greek, Cyrillic, Devanagari, kana, Han, Hangul (fixed values).
_BESIDE = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0131\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f\u0905-\u0928\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_SAFE = re.compile(f"(?<=[{_BESIDE}]) (?=[{_BESIDE}])")
_models: dict = {}


def _load(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def pieces_of(text: str, max_chars: int) -> list[str]:
    """Cut at the first safe place after every ``max_chars`` characters."""
    out, start = [], 0
    while len(text) - start > max_chars:
        m = _SAFE.search(text, start + max_chars)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.end()
    out.append(text[start:] if start else text)
    return out


def count_tokens(
    docs: DataFrame, model_path: str, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text",
    piece_chars: int = 4096, call_bytes: int = 1 << 20,
) -> DataFrame:
    """``id_cols``, n_bytes and n_tokens of every row, without begin or end tokens.

    ``call_bytes`` bounds a call by bytes of UTF-8; a very long text is cut into pieces of ``piece_chars`` or somewhat more.
    Null and empty texts count 0 bytes and 0 tokens. Repeated rows and null ids are counted each by itself;
    an empty table gives an empty result; further columns are not read, whatever their names.
    ``model_path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(model_path)
        for batch in slices(batches, text_col, call_bytes):
            column = batch.column(batch.schema.get_field_index(text_col))
            _, offs = text_bytes(column)
            pieces: list[str] = []
            owner: list[int] = []
            for i, text in enumerate(column.to_pylist()):
                cut = pieces_of(text, piece_chars) if text else []
                pieces += cut
                owner += [i] * len(cut)
            counts = [0] * batch.num_rows
            start = size = 0
            for k, piece in enumerate(pieces):  # a long text alone can be many calls
                size += len(piece.encode())
                if size >= call_bytes or k + 1 == len(pieces):
                    for i, ids in zip(owner[start : k + 1], model.encode(pieces[start : k + 1], num_threads=1), strict=True):
                        counts[i] += len(ids)
                    start, size = k + 1, 0
            kept = [batch.column(batch.schema.get_field_index(c)) for c in id_cols]
            sizes = pa.array(offs[1:] - offs[:-1], pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, sizes, pa.array(counts, pa.int64())], [*id_cols, "n_bytes", "n_tokens"])

    schema = f"{id_fields(docs, id_cols)}, n_bytes bigint, n_tokens bigint"
    return docs.select(*id_cols, text_col).mapInArrow(run, schema)
