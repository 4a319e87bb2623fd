"""License scan by conditional compression.

Blocks of text around licence words are compressed with each template as a raw zstandard dictionary. A template is the likelier the more bytes it saves
against compression without one; the best few of a block, and of what is next to each of the words, are finalists. A finalist is aligned with the block word by word,
with free ends, so that other words on the line or another notice beside it cost nothing, and every place where few words differ and none that names
the licence is confirmed, with the exact differences in wording.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import per_document, table

# Wordings of public licences and notices.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details. You should have received a copy of the GNU {0} Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
TEMPLATES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. '
    + _AS_IS
    + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": f"{_BSD_START} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_START} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "BSD-notice": "Released under the BSD License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-or-later": _GNU.format("General", 2),
    "GPL-3.0-or-later": _GNU.format("General", 3),
    "LGPL-3.0-or-later": _GNU.format("Lesser General", 3),
    "AGPL-3.0-or-later": _GNU.format("Affero General", 3),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: What makes a line a candidate.
CANDIDATE = r"(?i)licen[sc]|copyright|warrant(?:y|ies)|redistribut|permission (?:is|to)|public domain|creative commons|SPDX|liab(?:le|ility)"
#: Words that a template may not lose, gain or change: names of licences, and clauses in capitals. Numbers count in versions.
NAMES = frozenset("mit bsd isc gpl lgpl agpl gnu lesser affero apache mozilla mpl eclipse creative commons noncommercial noderivatives sharealike zlib unlicense proprietary".split())
CLAUSES = frozenset("CC BY NC ND SA".split())
#: Characters of a long line that belong to a candidate word, before and after it; lines on either side of a candidate line that do; lines that may lie
#: between two of them; characters next to a candidate word that are ranked by themselves.
REACH, EDGE, GAP, NEAR = 700, 9, 6, 60
#: Finalists of the whole licences and as many of the notices, which save fewer bytes because they have fewer.
FINALISTS = 3
#: A place is confirmed when at most this share of the template's words differs.
MOST_DIFFERENT = 0.2
#: Bytes of blocks whose verdicts a worker keeps.
KEPT_BYTES = 8 << 20
_LEVEL = 12
_tools: dict = {}
_WORD = re.compile(r"[\w.-]*\w")


def blocks(text: str, candidate: re.Pattern) -> Iterator[tuple[int, str, list[str]]]:
    """(first line, block, what is next to its candidate words): the surroundings of candidate words, joined where they meet or are at most GAP lines apart.

    A block takes EDGE lines before and after, but at most REACH characters on either side of a word, so that one long line isn't one block.
    """
    first = last = None
    own: list[str] = []
    for m in candidate.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        lines = text[a : m.start()].split("\n")
        before = a if len(lines) <= EDGE + 1 else m.start() - len("\n".join(lines[-EDGE - 1 :]))
        lines = text[m.end() : b].split("\n")
        after = b if len(lines) <= EDGE + 1 else m.end() + len("\n".join(lines[: EDGE + 1]))
        near = text[max(before, m.start() - NEAR) : min(after, m.end() + NEAR)]
        if first is not None and before > last and (text.count("\n", last, before) > GAP or before > last + REACH):
            yield text.count("\n", 0, first), text[first:last], list(dict.fromkeys(own))
            first, own = None, []
        first, last = before if first is None else first, after
        own.append(near)
    if first is not None:
        yield text.count("\n", 0, first), text[first:last], list(dict.fromkeys(own))


def ranking(block: str) -> list[tuple[float, str]]:
    """(share of bytes saved, template), the largest saving first; ties by name."""
    import zstandard

    if not _tools:
        _tools["plain"] = zstandard.ZstdCompressor(level=_LEVEL, write_content_size=False)
        for name, text in TEMPLATES.items():
            d = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=_LEVEL)
            _tools[name] = zstandard.ZstdCompressor(level=_LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
    raw = block.encode("utf-8", "surrogatepass")
    plain = len(_tools["plain"].compress(raw))
    return sorted(((1 - len(_tools[n].compress(raw)) / plain, n) for n in TEMPLATES), key=lambda x: (-x[0], x[1]))


def _coded(words: list[str], codes: dict[str, int]) -> np.ndarray:
    return np.array([codes.setdefault(w.lower(), len(codes)) for w in words], np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each end in b, from 0 on, the least number of words to change, add or drop that turn a into some run of b that ends there."""
    row = np.zeros(len(b) + 1, np.int64)
    place = np.arange(len(b) + 1)
    for w in a:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (b != w))
        row = np.minimum.accumulate(new - place) + place
    return row


def differing(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The edits that turn a into b, fewest first: (place in a, place in b), with -1 for a word that is only in the other."""
    codes: dict[str, int] = {}
    x, y = _coded(a, codes), _coded(b, codes)
    table_ = np.empty((len(x) + 1, len(y) + 1), np.int64)
    place = np.arange(len(y) + 1)
    table_[0] = place
    for i, w in enumerate(x, 1):
        new = table_[i - 1] + 1
        new[1:] = np.minimum(new[1:], table_[i - 1, :-1] + (y != w))
        table_[i] = np.minimum.accumulate(new - place) + place
    i, j, out = len(x), len(y), []
    while i or j:
        if i and j and table_[i, j] == table_[i - 1, j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            if x[i] != y[j]:
                out.append((i, j))
        elif i and table_[i, j] == table_[i - 1, j] + 1:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def _naming(words: list[str], k: int) -> bool:
    """Whether a word names a licence, a clause or a version."""
    word = words[k]
    if word.lower() in NAMES or CLAUSES.intersection(word.split("-")):
        return True
    return bool(re.search(r"\d\.\d", word) and len(word) < 8) or bool(re.fullmatch(r"v?\d+", word.lower()) and k and words[k - 1].lower() in ("version", "v", "license", "licence"))


def places(name: str, words: list[str]) -> list[tuple[int, int, int, str]]:
    """(first word, end, words that differ, differences) of the runs of words that are the template but for a few words, none of them a name."""
    template = _WORD.findall(TEMPLATES[name])
    most = int(MOST_DIFFERENT * len(template))
    if (Counter(w.lower() for w in template) & Counter(w.lower() for w in words)).total() < len(template) - most:
        return []  # too few of its words are there at all
    codes: dict[str, int] = {}
    a, b = _coded(template, codes), _coded(words, codes)
    found: list[tuple[int, int, int, str]] = []
    refused: list[tuple[int, int, int, str]] = []
    ends = distances(a, b)
    for end in np.lexsort((np.arange(len(ends)), ends)).tolist():
        cost = int(ends[end])
        if cost > most:
            break
        if any(x < end <= y or (y < end and cost == n + end - y) for x, y, n, _ in found + refused):
            continue  # within a place, or a place and the words after it
        lo = max(0, end - len(a) - cost)
        back = distances(a[::-1], b[lo:end][::-1])
        start = end - int(np.flatnonzero(back == cost)[0]) if (back == cost).any() else lo
        if any(start < y and end > x for x, y, _, _ in found + refused):
            continue
        own = words[start:end]
        edits = differing(template, own)
        if any((i >= 0 and _naming(template, i)) or (j >= 0 and _naming(own, j)) for i, j in edits):
            refused.append((start, end, cost, ""))
            continue
        said = " ".join(" ".join([f"-{template[i]}"] * (i >= 0) + [f"+{own[j]}"] * (j >= 0)) for i, j in edits)
        found.append((start, end, len(edits), said))
    return found


def judge(block: str, parts: list[str]) -> list[tuple[str, float, int, str, bool]]:
    """(template, saving, words that differ, differences, confirmed) of each place in the block where a finalist is confirmed, those with the most equal
    words first and none over another; or one row for the block's likeliest template, not confirmed and without differences."""
    ranked = ranking(block)
    saved = dict((n, x) for x, n in ranked)
    names = []
    for order in (ranked, *map(ranking, parts)):
        for notice in (True, False):
            names += [n for x, n in order if n.endswith("-notice") == notice][:FINALISTS]
    words = _WORD.findall(block)
    found = []
    for name in dict.fromkeys(names):
        size = len(_WORD.findall(TEMPLATES[name]))
        found += [(size - 2 * n, name, start, end, n, said) for start, end, n, said in places(name, words)]
    out, taken = [], []
    for _, name, start, end, n, said in sorted(found, key=lambda x: (-x[0], x[2], x[1])):
        if all(end <= x or start >= y for x, y in taken):
            taken.append((start, end))
            out.append((start, (name, saved[name], n, said, True)))
    if out:
        return [x for _, x in sorted(out)]
    name = ranked[0][1]
    codes: dict[str, int] = {}
    return [(name, saved[name], int(distances(_coded(_WORD.findall(TEMPLATES[name]), codes), _coded(words, codes)).min()), "", False)]


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, line, license, saving, n_different, differences, confirmed): a row for each confirmed place in a candidate block of docs, in the block's
    order, or one for a block without any. line is the block's first line. Differences are counted against the template's own span.

    A null or empty text has none. Texts without a candidate word are filtered before any Python runs; each row is judged by its own text, so rows that
    repeat give rows that repeat; columns but doc_id and text are not read. Verdicts on blocks are kept in a worker, up to KEPT_BYTES of them, so copies
    of a notice cost a lookup. Ties between templates go to the one with more equal words, then to the earlier place, then by name.
    """

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        candidate, judged, held = re.compile(CANDIDATE), {}, 0
        for doc_id, text in rows:
            for line, block, parts in blocks(text, candidate):
                if block not in judged:
                    if held > KEPT_BYTES:
                        judged, held = {}, 0
                    judged[block] = judge(block, parts)
                    held += 4 * len(block) + 200
                for verdict in judged[block]:
                    yield doc_id, line, *verdict

    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("license", pa.string()), ("saving", pa.float64()), ("n_different", pa.int32()), ("differences", pa.string()), ("confirmed", pa.bool_())])
    some = docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE))
    return per_document(some, kernel, schema, "doc_id long, line int, license string, saving double, n_different int, differences string, confirmed boolean")


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


QUERIES = {"op1_licenses": op1_licenses}
ORACLE_SQL: dict[str, str] = {}
