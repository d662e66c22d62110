"""URL filter by a bit-parallel wildcard automaton.

All glob rules (``*``: any run, ``?``: any one character, not byte) are packed into one row of 64-bit words: a start bit and a
bit for each character of each rule. One Shift-And step a character moves every rule at once, with a carry between
words, and a mask of loops keeps the bits that stand before a ``*``. URLs of a batch advance together: longest first,
so that those which have ended leave the front of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_fields
from .lines import FOLD

#: Rules by host and path: the longest that fits decides (fixed values).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MOST_GLOBS = 20_000
#: What the globs over host and path are made of, for urls that no such rule fits (fixed values).
HOST_LABELS = "ad adclick ads adserver adservice adtrack analytics banner banners beacon clicks counter doubleclick metrics pixel popads spam stats track tracker tracking".split()
HOST_STARTS = "spam- ads- adserver- click- track- free-porn xxx-".split()
ANYWHERE = "cheap-pills casino viagra cialis porn xxx-video payday-loan free-money online-poker slot-machine replica-watches crack-serial keygen torrent-download warez escort-service".split()
SEGMENTS = "ads adserver advert banner banners captcha cart cgi-bin checkout click login logout password popup print privacy redirect register search share signin signup sitemap tag track unsubscribe wp-admin wp-json wp-login.php xmlrpc.php".split()
ENDINGS = "7z apk avi bin bz2 css csv deb dll dmg doc docx exe flv gif gz ico iso jar jpeg jpg js m3u8 mkv mov mp3 mp4 mpeg msi ogg pdf png ppt pptx rar rpm svg swf tar tgz tif tiff ttf wav webm webp wmv woff woff2 xls xlsx xz zip".split()
PARTS = "session-?????????? page-9??? post-999???".split()


def blocked_globs() -> list[str]:
    """The globs of what is blocked: host labels and starts, words anywhere, whole path segments, file endings, parts."""
    hosts = [g for x in HOST_LABELS for g in (f"{x}.*", f"*.{x}.*")] + [g for x in HOST_STARTS for g in (f"{x}*", f"*.{x}*")]
    paths = [g for x in SEGMENTS for g in (f"*/{x}", f"*/{x}/*")] + [f"*/*.{x}" for x in ENDINGS] + [f"*/{x}" for x in PARTS]
    return hosts + [f"*{x}*" for x in ANYWHERE] + paths


def globs_of(table: DataFrame, column: str = "glob") -> list[str]:
    """A rule list from a table of globs (null and empty ones left out). Every row becomes bits of the automaton, so over
    ``MOST_GLOBS`` of them are an error, never cut."""
    found = table.select(column).filter(f"`{column}` <> ''").distinct().limit(MOST_GLOBS + 1).collect()
    if len(found) > MOST_GLOBS:
        raise ValueError(f"over {MOST_GLOBS} globs: judge the urls in several runs")
    return sorted(r[0] for r in found)


class Globs:
    def __init__(self, patterns: list[str]):
        symbols: list[str | None] = []  # of each bit; None: a start
        loops, finals = [], []
        for p in patterns:
            symbols.append(None)
            for c in p:
                if c == "*":
                    loops.append(len(symbols) - 1)
                else:
                    symbols.append(c)
            finals.append(len(symbols) - 1)
        self.words = len(symbols) // 64 + 1
        known = sorted({ord(c) for c in symbols if c and c != "?"})
        self.known = np.array(known, np.uint32)  # the characters of patterns; all others are one symbol, the last
        self.step = np.zeros((len(known) + 1, self.words), np.uint64)
        self.start, self.loop = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.finals = [(k // 64, np.uint64(1 << (k % 64))) for k in finals]
        for k, c in enumerate(symbols):
            bit = np.uint64(1 << (k % 64))
            if c is None:
                self.start[k // 64] |= bit
            elif c == "?":
                self.step[:, k // 64] |= bit
            else:
                self.step[known.index(ord(c)), k // 64] |= bit
        for k in loops:
            self.loop[k // 64] |= np.uint64(1 << (k % 64))

    def match(self, texts: list[str]) -> np.ndarray:
        """Which text (row) matches which pattern (column) as a whole."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.known, chars), max(len(self.known) - 1, 0))
        buf = np.where(self.known[at] == chars, at, len(self.known)) if len(self.known) else np.zeros(len(chars), np.int64)
        first = (np.cumsum(size) - size)[order]
        state = np.tile(self.start, (len(texts), 1))
        live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
        one, top = np.uint64(1), np.uint64(63)
        for t, n in enumerate(live.tolist()):
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.step[buf[first[:n] + t]]
            moved |= now & self.loop
            state[:n] = moved
        out = np.empty((len(texts), len(self.finals)), bool)
        for j, (word, bit) in enumerate(self.finals):
            out[order, j] = (state[:, word] & bit) != 0
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(FOLD), slash + path


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES, blocked: list[str] | None = None,
) -> DataFrame:
    """``id_col``, host, path, rule (that decided, or null) and verdict (allow or block) of every row.

    A null url, or one without ``://``, has an empty host and path and is allowed unless a glob matches an empty
    text; ``blocked`` is ``blocked_globs()`` where it isn't given. A very long url takes a step for each character. Null and repeated ids and repeated rows have a result each. An empty table gives an empty result; further
    columns are not read.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    globs = [g for r, _ in ranked for g in (f"{r}*", f"*.{r}*")] + list(blocked_globs() if blocked is None else blocked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Globs(globs)
        names, kinds = (np.array([r[k] for r in ranked] or [""], object) for k in (0, 1))
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                parts = [canonical(u) for u in batch.column(1).to_pylist()]
                hit = automaton.match([h + p for h, p in parts])
                fits = hit[:, : 2 * len(ranked) : 2] | hit[:, 1 : 2 * len(ranked) : 2]
                for j, (r, _) in enumerate(ranked):  # a host ends at the first slash, so a rule must stand over it
                    at = r.index("/")
                    for i in np.flatnonzero(fits[:, j]).tolist():
                        host, path = parts[i]
                        fits[i, j] = (host == r[:at] or host.endswith(f".{r[:at]}")) and path.startswith(r[at:])
                ruled = fits.any(1)
                longest = np.where(ruled, fits.argmax(1) if ranked else 0, 0)
                rule = np.where(ruled, names[longest], None)
                verdict = np.where(ruled, kinds[longest], np.where(hit[:, 2 * len(ranked) :].any(1), "block", "allow"))
                hosts, paths = zip(*parts, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict))], [id_col, "host", "path", "rule", "verdict"])

    return pages.select(id_col, url_col).mapInArrow(run, f"{id_fields(pages, (id_col,))}, host string, path string, rule string, verdict string")
