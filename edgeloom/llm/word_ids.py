"""Token ids of whole texts for tokenizers that encode letter runs, digits and symbol runs one by one.

Such a tokenizer (normalisation to composed lower case, then the pattern below, then BPE with an end-of-word suffix)
treats every run by itself, so each distinct run of a batch is encoded once and kept in a bounded store of the Python
worker. Texts are cut by byte classes in numpy: only between two ASCII characters of different classes or two digits, never
beside an apostrophe (contractions) and never in a text that holds an added token; everything else stays in one piece
and is left to the library. Other tokenizers go through the content-defined chunks of ``bpe_chunks``.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from .bpe_chunks import ChunkEncoder
from .common import codes, text_bytes, worker_cache
from .lines import _space

#: The pattern and the normalisers that the byte classes below agree with (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Texts of which composition and lower case keep one run of letters, digits or symbols one run (fixed values): letters up to
#: U+017F without the two signs and the dotted capital I, one digit, or ASCII symbols without the apostrophe.
_one = re.compile("[a-zA-ZÀ-ÖØ-öø-įı-ſ]+|[0-9]|[!-&(-/:-@[-`{-~]+")

_LETTER, _DIGIT, _SYMBOL = 1, 2, 3
_kind = np.full(256, _SYMBOL, np.uint8)
_kind[_space] = 0
_kind[ord("a") : ord("z") + 1] = _kind[ord("A") : ord("Z") + 1] = _LETTER
_kind[ord("0") : ord("9") + 1] = _DIGIT


def splits_words(path: str) -> bool:
    """Whether the tokenizer is of the form that ``WordEncoder`` is right for."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = steps[0]
    return (
        [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])] == NORMALIZERS
        and first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
        and [x["type"] for x in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        and made["model"]["type"] == "BPE" and bool(made["model"].get("end_of_word_suffix")) and not made["model"].get("dropout")
    )


class WordEncoder:
    """store_bytes: bound of the store of encoded runs."""

    def __init__(self, path: str, store_bytes: int = 160_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.model._resize_cache(0)  # each run comes once, so the library's own store only costs
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a run
        for token, k in model["vocab"].items():
            self.last[k] = token.endswith(model["end_of_word_suffix"])
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.store: dict[str, int] = {}  # place of a run's ids in ``flat``
        self.flat = np.zeros(1 << 16, np.uint16 if len(self.last) <= 1 << 16 else np.int32)
        self.used, self.bound = 0, store_bytes

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, runs: list[str], sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs one after another, and how many each has. Those that are sure to be one run
        each are encoded many at a time and parted at their last ids."""
        sizes = np.zeros(len(runs), np.int64)
        parts: dict[int, np.ndarray] = {}  # of blocks and of single runs, by the first run's place
        bounds = np.flatnonzero(np.diff(sure.astype(np.int8), prepend=-1))
        alone: list[int] = []
        for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(runs)], strict=True):
            if not sure[a]:
                alone += range(a, b)
                continue
            for c in range(a, b, 4096):
                d = min(c + 4096, b)
                ids = np.array(self._plain([" ".join(runs[c:d])])[0], np.int32)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == d - c:
                    sizes[c:d] = np.diff(ends, prepend=0)
                    parts[c] = ids
                else:
                    alone += range(c, d)
        for i, ids in zip(alone, self._plain([runs[i] for i in alone]), strict=True):
            parts[i] = np.array(ids, np.int32)
            sizes[i] = len(ids)
        return np.concatenate([parts[i] for i in sorted(parts)]), sizes

    def _places(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each run's ids begin in ``flat``, and how many they are."""
        if len(self.store) * 150 + self.used * self.flat.itemsize > self.bound:
            self.store.clear()
            self.used = 0
        got = np.fromiter(map(self.store.get, runs, repeat(-1)), np.int64, len(runs))
        missing = np.flatnonzero(got < 0)
        if len(missing):
            names = [runs[i] for i in missing.tolist()]
            sure = np.fromiter((_one.fullmatch(x) is not None for x in names), bool, len(names))
            order = np.argsort(~sure, kind="stable")  # those to be encoded together first
            names, missing = [names[i] for i in order.tolist()], missing[order]
            ids, sizes = self._fresh(names, sure[order])
            need = self.used + len(ids)
            if need > len(self.flat):
                more = np.zeros(max(need, 2 * len(self.flat)), self.flat.dtype)
                more[: self.used] = self.flat[: self.used]
                self.flat = more
            self.flat[self.used : need] = ids
            got[missing] = (self.used + np.cumsum(sizes) - sizes) << 20 | sizes
            self.store.update(x for x in zip(names, got[missing].tolist(), strict=True) if len(x[0]) <= 4096)
            self.used = need
        return got >> 20, got & ((1 << 20) - 1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (as the library gives them), and n + 1 offsets into them."""
        buf, offs = text_bytes(column)
        n = len(offs) - 1
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        whole = self._whole(buf, offs)
        kind = _kind[buf]
        inside = kind != 0
        edge = np.ones(len(buf) + 1, bool)  # a run begins, or white space stands here
        before, after = kind[:-1], kind[1:]
        plain = (buf < 128) & (buf != ord("'"))
        edge[1:-1] = (before == 0) | (after == 0) | (plain[:-1] & plain[1:] & ((before != after) | (after == _DIGIT)))
        edge[offs] = True
        for k in whole:  # one run, white space and all
            edge[offs[k] + 1 : offs[k + 1]] = False
            inside[offs[k] : offs[k + 1]] = True
        begins = np.flatnonzero(edge[:-1] & inside)
        if not len(begins):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        low = buf + np.where((buf >= 65) & (buf <= 90) & np.append(buf[1:] < 128, True), 32, 0).astype(np.uint8)  # a mark composes with its letter
        for k in whole:
            low[offs[k] : offs[k + 1]] = buf[offs[k] : offs[k + 1]]
        total = np.concatenate([[0], np.cumsum(inside)])
        places = np.append(total[begins], total[-1]).astype(np.int32)
        which, distinct = codes(pa.StringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(low[inside])))
        at, sizes = self._places(distinct.to_pylist())
        size = sizes[which]
        ends = np.cumsum(size)
        take = np.arange(int(ends[-1])) + np.repeat(at[which] - (ends - size), size)
        return self.flat[take].astype(np.int32), np.concatenate([[0], ends])[np.searchsorted(begins, offs)]

    def _whole(self, buf: np.ndarray, offs: np.ndarray) -> list[int]:
        """Texts that hold an added token's string: they are encoded in one piece."""
        raw, found = buf.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found.add(int(np.searchsorted(offs, at, side="right")) - 1)
                at = raw.find(token, at + 1)
        return sorted(found)


def encoder(path: str) -> WordEncoder | ChunkEncoder:
    """This worker's encoder for the tokenizer at ``path``."""
    return worker_cache(f"ids {path}", lambda: WordEncoder(path) if splits_words(path) else ChunkEncoder(path, 0))
