"""License scans: units of text compared with licence templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_batches, record

LEAST = 0.8
#: Bigrams from which on a template is also looked for across blank lines.
LONG = 40
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Parts of public licence texts that several of them share.
_GRANT_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_NOTICE_MIT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS_MIT = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_AS_IS_ISC = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GRANT_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_CLAUSES_BSD = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD_BSD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Public licence notices and texts, by SPDX id. A template is one of them; a licence may have several.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "Licensed under the zlib License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("MIT", _GRANT_MIT + " " + _NOTICE_MIT + " " + _AS_IS_MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS_ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS_ISC),
    ("BSD-2-Clause", _GRANT_BSD + " " + _CLAUSES_BSD + " " + _AS_IS_BSD),
    ("BSD-3-Clause", _GRANT_BSD + " " + _CLAUSES_BSD + " " + _THIRD_BSD + " " + _AS_IS_BSD),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]


def bigrams(text: str) -> Counter:
    """Bigrams of the normalised text: lower case, words of letters and digits, dots inside version numbers kept."""
    words = WORD.findall(text.lower())
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Scanner:
    """Templates with an inverted list of their bigrams and the sizes that a match can have."""

    def __init__(self, templates: list[tuple[str, str]], least: float = LEAST):
        self.least = least
        self.templates = [(name, bigrams(text)) for name, text in templates]
        self.size = [sum(b.values()) for _, b in self.templates]
        self.holds: dict[tuple[str, str], list[int]] = {}
        for i, (_, b) in enumerate(self.templates):
            for g in b:
                self.holds.setdefault(g, []).append(i)
        bound = least / (2 - least)
        #: Templates of several sentences, which a text may set in paragraphs.
        self.long = {i for i, n in enumerate(self.size) if n >= LONG}
        self.fewest = min((n * bound for n in self.size), default=0)
        self.most = max((n / bound for n in self.size), default=0)

    def best(self, unit: str) -> tuple[str, float] | None:
        return self.best_of(WORD.findall(unit.lower()))

    def best_of(self, words: list[str]) -> tuple[str, float] | None:
        """The template nearest to the words, if its Dice reaches `least`; ties go to the first name.

        2 min(a, b) / (a + b) bounds Dice from above, so templates whose size is too far off are never compared.
        """
        n = max(0, len(words) - 1)
        if not self.fewest <= n <= self.most:
            return None
        own = Counter(zip(words, words[1:], strict=False))
        found = []
        for i in {i for g in own for i in self.holds.get(g, ())}:
            size = self.size[i]
            if 2 * min(n, size) >= self.least * (n + size) and (score := dice(own, self.templates[i][1])) >= self.least:
                found.append((-score, self.templates[i][0]))
        return (min(found)[1], -min(found)[0]) if found else None

    def windows(self, words: list[str], among: set[int] | None = None) -> list[tuple[float, int, int, str]]:
        """(Dice, first word, last word, licence) of the windows of template size that match, none overlapping another.

        Every place is tried, for all templates or those in `among`. Where windows overlap, the higher Dice wins, then the longer, then the first name.
        """
        at: dict[int, list[tuple[int, tuple[str, str]]]] = {}
        near = [(k, g) for k, g in enumerate(zip(words, words[1:], strict=False)) if g in self.holds]
        if len(near) < self.least * min((self.size[i] for i in (range(len(self.size)) if among is None else among)), default=0):
            return []
        for k, g in near:
            for i in self.holds.get(g, ()):
                if among is None or i in among:
                    at.setdefault(i, []).append((k, g))
        found = []
        for i, hits in at.items():
            name, own = self.templates[i]
            size = self.size[i]
            if len(hits) < self.least * size:
                continue
            held: Counter = Counter()
            end = shared = 0
            for k, g in hits:  # a window that begins at no bigram of the template holds no more than the next that does
                while end < len(hits) and hits[end][0] < k + size:
                    held[hits[end][1]] += 1
                    shared += held[hits[end][1]] <= own[hits[end][1]]
                    end += 1
                if shared >= self.least * size:
                    found.append((-shared / size, -size, name, k, hits[end - 1][0] + 1))
                shared -= held[g] <= own[g]
                held[g] -= 1
        taken = bytearray(len(words))
        chosen = []
        for score, _, name, a, b in sorted(found):
            if not any(taken[a : b + 1]):
                taken[a : b + 1] = b"\1" * (b + 1 - a)
                chosen.append((-score, a, b, name))
        return chosen

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first line, last line, licence, Dice) of every matching unit, in order.

        Units are each line, each run of two or more lines that are not blank, and the windows() of each such line or
        run. Lines inside a matching run that match on their own are reported as well. A window that covers half the
        words of a matching line or run of its licence is the same notice, with the higher Dice of both. Of long templates, the windows of the whole
        text count as well, since whole licences have blank lines; such a window stands for the matches of its licence
        inside it.
        """
        lines = text.split("\n")
        words = [WORD.findall(x.lower()) for x in lines]
        found = []
        begin = runs = 0
        for k in range(len(lines) + 1):
            if k < len(lines) and lines[k].strip():
                continue
            if k > begin:
                found += self.scan_run(begin, words[begin:k])
                runs += 1
            begin = k + 1
        if runs > 1:
            line_of = [k for k, own in enumerate(words) for _ in own]
            for score, a, b, name in self.windows(list(chain.from_iterable(words)), self.long):
                first, last = line_of[a], line_of[b]
                if not all(lines[k].strip() for k in range(first, last)):
                    found = [f for f in found if not (f[2] == name and first <= f[0] and f[1] <= last)]
                    found.append((first, last, name, score))
        return sorted(found)

    def scan_run(self, begin: int, lines: list[list[str]]) -> list[tuple[int, int, str, float]]:
        words = list(chain.from_iterable(lines))
        if not any(g in self.holds for g in zip(words, words[1:], strict=False)):
            return []  # a unit that reaches the bound shares bigrams; most runs have none
        edges = [0]
        for line in lines:
            edges.append(edges[-1] + len(line))
        units = [(k, k) for k in range(len(lines))] + ([(0, len(lines) - 1)] if len(lines) > 1 else [])
        found = [(a, b, *hit) for a, b in units if (hit := self.best_of(words[edges[a] : edges[b + 1]]))]
        whole = len(found)
        for score, a, b, name in self.windows(words):
            same = [k for k, u in enumerate(found[:whole]) if u[2] == name and 2 * (min(b + 1, edges[u[1] + 1]) - max(a, edges[u[0]])) >= edges[u[1] + 1] - edges[u[0]]]
            for k in same:
                found[k] = (*found[k][:3], max(score, found[k][3]))
            if not same:
                found.append((bisect_right(edges, a) - 1, bisect_right(edges, b) - 1, name, score))
        return [(begin + a, begin + b, name, score) for a, b, name, score in found]


def scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, score, n_matches, spans): a row for every document, without a shuffle.

    license and score are those of the best unit (ties: the longest unit, then the first by name), null where none
    matches. Null and empty texts match nothing; null ids stay; repeated rows give repeated results; an empty table
    gives none. Long texts are scanned whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("license", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            hits = [scanner.scan(x) if x else [] for x in batch.column("text").to_pylist()]
            best = [min(h, key=lambda s: (-s[3], s[0] - s[1], s[2])) if h else (None, None, None, None) for h in hits]
            yield record(id=batch.column("id"), license=pa.array([b[2] for b in best], pa.string()), score=pa.array([b[3] for b in best], pa.float64()), n_matches=pa.array([len(h) for h in hits], pa.int64()), spans=pa.array([[dict(zip(("first", "last", "license", "score"), s, strict=True)) for s in h] for h in hits], kind))

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, license string, score double, n_matches long, spans array<struct<first:int,last:int,license:string,score:double>>").withColumnRenamed("id", id_col)
