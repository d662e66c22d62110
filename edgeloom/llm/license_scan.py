"""Licence scan: all runs of words of a text against licence templates, by the Dice coefficient over word bigrams.

Dice is 2 c / (a + b) for a and b distinct bigrams and c common ones. Since c is at most the lesser of a and b, a
unit can reach the threshold t only with templates of t / (2 - t) * a to (2 - t) / t * a bigrams; templates are kept
by size, and a line is compared only to those within the bounds.

Runs of words (windows) begin and end at any word, so a notice is found over several lines and inside one. The best
window begins and ends with a bigram of the template: cutting off others never lowers the coefficient. Nor does
cutting off the first bigram where it comes again, so a window ends before that, and the search takes time in
proportion to the text times the template.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import codes, id_fields, slices
from .lines import FOLD, Lines

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Notices of licences as they stand in documents, and (name ending in -text) whole licences (fixed values, public texts).
TEMPLATES = {
    "0BSD-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause-text": _BSD + _BSD_3 + _BSD_END,
    "BSL-1.0-text": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "WTFPL-text": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "ALL-RIGHTS-RESERVED": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bigrams(text: str) -> set[tuple[str, str]]:
    words = _word.findall(text.translate(FOLD))
    return set(zip(words, words[1:]))


class Templates:
    def __init__(self, texts: dict[str, str], threshold: float):
        self.low, self.high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.threshold = threshold
        self.known = sorted((len(bigrams(t)), name, bigrams(t)) for name, t in texts.items())
        self.sizes = [k[0] for k in self.known]
        self.most = self.sizes[-1] * self.high + 1e-9
        self.all = frozenset().union(*(k[2] for k in self.known))

    def best(self, unit: str) -> tuple[float, str] | None:
        """The template with the highest coefficient at the threshold or above; of equals, the first by name."""
        words = _word.findall(unit.translate(FOLD)) if len(unit) >= 2 * self.sizes[0] * self.low else []
        found = set()
        for x in zip(words, words[1:]):
            found.add(x)
            if len(found) > self.most:  # no template is large enough
                return None
        a = len(found)
        if not a:
            return None
        top = None
        for b, name, theirs in self.known[bisect_left(self.sizes, a * self.low - 1e-9) : bisect_right(self.sizes, a * self.high + 1e-9)]:
            dice = 2 * len(found & theirs) / (a + b)
            if dice >= self.threshold and (top is None or (-dice, name) < (-top[0], top[1])):
                top = (dice, name)
        return top

    def best_window(self, text: str) -> tuple[float, str] | None:
        """As ``best``, over all runs of words of ``text``."""
        words = _word.findall(text.translate(FOLD))
        pairs = list(zip(words, words[1:]))
        seen = self.all.intersection(pairs)
        if not seen:
            return None
        top, places = None, None
        for b, name, theirs in self.known:
            if len(seen & theirs) < b * self.low - 1e-9:
                continue
            if places is None:
                places = [p for p, x in enumerate(pairs) if x in seen]
            dice = self._window(pairs, [p for p in places if pairs[p] in theirs], b, theirs)
            if dice >= self.threshold and (top is None or (-dice, name) < (-top[0], top[1])):
                top = (dice, name)
        return top

    def _window(self, pairs: list[tuple[str, str]], hits: list[int], b: int, theirs: set[tuple[str, str]]) -> float:
        """The highest coefficient of a window that begins at one of ``hits``."""
        most, top = b * self.high + 1e-9, 0.0
        for start in hits:
            own, common, first = set(), 0, pairs[start]
            for p in range(start, len(pairs)):
                x = pairs[p]
                if x in own:
                    if x == first:
                        break
                    continue
                own.add(x)
                if len(own) > most:
                    break
                if x in theirs:
                    common += 1
                    top = max(top, 2 * common / (len(own) + b))
                    if common == b:
                        break
            if top == 1:
                break
        return top


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``id_col``, license (best template over all runs of words, so over lines and the whole text too, or null), dice (0 without one) and
    n_matches (lines that match a template) of every row.

    Null and empty texts match nothing; a very long text is searched whole. Null and repeated ids and repeated rows have a result each. An empty table
    gives an empty result; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in slices(batches, text_col):
            view = Lines(batch.column(1))
            which, distinct = codes(view.strings())
            of_line = [known.best(x) for x in distinct.to_pylist()]
            texts = batch.column(1).to_pylist()
            names, scores, matches = [], [], []
            for k, text in enumerate(texts):
                matches.append(sum(of_line[c] is not None for c in which[view.first[k] : view.first[k + 1]].tolist()))
                best = text and known.best_window(text) or (0.0, None)
                scores.append(round(best[0], 6))
                names.append(best[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(matches, pa.int64())], [id_col, "license", "dice", "n_matches"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_fields(docs, (id_col,))}, license string, dice double, n_matches bigint")
