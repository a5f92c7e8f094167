"""License scans: winnowed fingerprints pick candidates, banded alignment reports what matched.

Templates become words; of their K-word hashes each window of W gives its least (the rightmost of equals), so any run
of K + W - 1 words shared with a text shares a fingerprint. The inverted index from fingerprint to (template, place) is
broadcast; its size is bounded by MAX_WORDS words of templates, which is checked. A text's fingerprints that the
index holds are hits; hits of one template on diagonals within BAND are a candidate, and a local alignment of the
template with the text around it, in a band of 3 * BAND + 1 diagonals, reports matched words, coverage and span. The
bands of a block are aligned together in numpy, so a text that repeats a phrase makes many bands, never a wide one.

Winnowing may pass over copies with changed words, so pairs of words are looked up too, all of them: an alignment of
two words or more that reaches the coverage has two neighbouring words matched. Each pair's diagonal whose band holds
enough of the template's words is a candidate. No copy within a band of one of its pairs is missed.

Of overlapping matches of one template the best counts; an inexact match gives way to another template's of greater
score over most of it, so that "MIT License" isn't reported as the BSD line with a changed word.

Every text is scanned by itself, whole: no shuffle. A repeated license makes as many candidates as it has occurrences.

Defined results: null and wordless texts match nothing; a template of fewer than K words has no fingerprint and is
refused; of equal scores the alignment that ends first counts; repeated rows are scanned each; an empty table gives an empty table; columns beside id and text are not read.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recurra.llm import textnum as tn
from recurra.llm.scratch import small_batches

K, W = 3, 3
#: Diagonals on either side of a candidate's first (its hits lie within as many above), and cells of bands aligned together.
BAND, CELLS = 8, 1 << 16
MIN_COVERAGE = 0.7
MAX_WORDS = 2_000_000

#: The whole notices of widespread licenses, and the short lines that declare one.
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_GNU = (
    "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{either} version {n} of the License, or "
    "(at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {name}General Public License for more details. You should have received a copy of the GNU {name}General Public License along with this {what}{end}"
)
_FSF = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_GNU3 = {"colon": ":", "either": ", either", "end": ". If not, see https://www.gnu.org/licenses/."}
_CC = "Licensed under the Creative Commons {} International License."
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-2.0-line": "Licensed under the GNU General Public License, version 2.",
    "gpl-3.0-line": "Licensed under the GNU General Public License, version 3.",
    "lgpl-2.1-line": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-line": "Licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-line": "Licensed under the GNU Affero General Public License, version 3.",
    "bsd-line": "Released under the BSD License.",
    "isc-line": "Released under the ISC License.",
    "bsl-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-1.0-line": "Licensed under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
    "cc-by-4.0-line": _CC.format("Attribution 4.0"),
    "cc-by-sa-4.0-line": _CC.format("Attribution-ShareAlike 4.0"),
    "cc-by-nc-4.0-line": _CC.format("Attribution-NonCommercial 4.0"),
    "cc-by-nd-4.0-line": _CC.format("Attribution-NoDerivatives 4.0"),
    "cc-by-nc-sa-4.0-line": _CC.format("Attribution-NonCommercial-ShareAlike 4.0"),
    "cc-by-nc-nd-4.0-line": _CC.format("Attribution-NonCommercial-NoDerivatives 4.0"),
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "mpl-2.0-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": _BSD + _AS_IS,
    "bsd-3-clause": _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-2.0": _GNU.format(what="program", name="", n="2", colon=";", either="; either", end=_FSF),
    "gpl-3.0": _GNU.format(what="program", name="", n="3", **_GNU3),
    "lgpl-2.1": _GNU.format(what="library", name="Lesser ", n="2.1", colon=";", either="; either", end=_FSF),
    "lgpl-3.0": _GNU.format(what="program", name="Lesser ", n="3", **_GNU3),
    "agpl-3.0": _GNU.format(what="program", name="Affero ", n="3", **_GNU3),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
        "For more information, please refer to https://unlicense.org"
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}


def winnow(w: tn.Words, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words where a selected k-word hash begins, and the hashes."""
    h, ok = tn.ngrams(w, k)
    at = np.flatnonzero(ok)
    if not len(at):
        return at, h[:0]
    g, doc = h[at], w.doc[at]
    n = len(g)
    # the window that begins at each hash; a text with fewer hashes than a window has one of them all
    best = np.arange(n)
    for j in range(1, width):
        other = np.minimum(np.arange(n) + j, n - 1)
        same = (np.arange(n) + j < n) & (doc[other] == doc)
        best = np.where(same & (g[other] <= g[best]), other, best)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    whole = np.zeros(n, bool)
    last = np.minimum(np.arange(n) + width - 1, n - 1)
    whole[:] = (np.arange(n) + width - 1 < n) & (doc[last] == doc)
    keep = np.unique(best[whole | first])
    return at[keep], g[keep]


class Index:
    def __init__(self, templates: dict[str, str], k: int = K, width: int = W):
        self.names, self.k, self.width = list(templates), k, width
        data, off = tn.buffers(pa.array(list(templates.values()), pa.string()))
        w = tn.words(data, off, tn.PUNCTUATION, lower=True)
        if len(w.hash) > MAX_WORDS:
            raise ValueError(f"templates of {len(w.hash)} words; at most {MAX_WORDS} are broadcast")
        if len(w.counts()) and w.counts().min() < k:
            raise ValueError(f"a template needs {k} words at least")
        self.words = [w.hash[a:z] for a, z in zip(w.first[:-1], w.first[1:])]
        # every k-word hash of a template is indexed, so each selected one of a text finds its place
        h, ok = tn.ngrams(w, k)
        at = np.flatnonzero(ok)
        order = np.argsort(h[at], kind="stable")
        at = at[order]
        self.keys, self.first = np.unique(h[at], return_index=True)
        self.first = np.append(self.first, len(at))
        self.template, self.place = w.doc[at], at - w.first[w.doc[at]]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        # pairs of neighbouring words, as places in the vocabulary
        self.vocabulary, own = np.unique(w.hash, return_inverse=True)
        self.member = np.zeros((len(self.words), len(self.vocabulary)), bool)
        self.member[w.doc, own] = True
        self.maybe_word = np.zeros(1 << 20, bool)
        self.maybe_word[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        at = np.flatnonzero(w.doc[1:] == w.doc[:-1])
        pair = own[at] * len(self.vocabulary) + own[at + 1]
        order = np.argsort(pair, kind="stable")
        at = at[order]
        self.pairs, self.pair_first = np.unique(pair[order], return_index=True)
        self.pair_first = np.append(self.pair_first, len(at))
        self.pair_template, self.pair_place = w.doc[at], at - w.first[w.doc[at]]

    def hits(self, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word of the text, template, word of the template) of every posting of the fingerprints."""
        on = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[on]), max(len(self.keys) - 1, 0))
        ok = self.keys[at] == h[on] if len(self.keys) else np.zeros(len(on), bool)
        on, at = on[ok], at[ok]
        n = self.first[at + 1] - self.first[at]
        post = np.repeat(self.first[at], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(place[on], n), self.template[post], self.place[post]


def align(template: np.ndarray, words: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments (match 1, mismatch and gap -1) of the template with words[first:last] on the `width` diagonals from `low` on (place in words - place in template), one for each element of low: scores, matched words, and spans [start, end). One row of the template at a time, all bands together."""
    n = len(low)
    d = np.arange(width)
    s, m, a = (np.zeros((n, width + 1), np.int64) for _ in range(3))  # score, matches, start, by diagonal
    best = [np.zeros(n, np.int64) for _ in range(4)]
    rows = np.arange(n)
    for i, word in enumerate(template):
        j = low[:, None] + (i + d)
        inside = (j >= first[:, None]) & (j < last[:, None])
        same = inside & (words[np.where(inside, j, 0)] == word)
        score, matches = s[:, :-1] + np.where(same, 1, -1), m[:, :-1] + same
        start = np.where(same & (s[:, :-1] == 0), j, a[:, :-1])
        down = s[:, 1:] - 1 > score
        score, matches, start = np.where(down, s[:, 1:] - 1, score), np.where(down, m[:, 1:], matches), np.where(down, a[:, 1:], start)
        # gaps along the row: each cell takes the greatest of those before it, less their distance; of equals the nearest
        score = np.where(inside, score, -(2**40)) + d
        top = np.maximum.accumulate(score, 1)
        at = np.maximum.accumulate(np.where(score == top, d, 0), 1)
        score = np.where(inside, top - d, 0)
        on = score > 0
        s[:, :-1] = np.where(on, score, 0)
        m[:, :-1] = np.where(on, np.take_along_axis(matches, at, 1), 0)
        a[:, :-1] = np.where(on, np.take_along_axis(start, at, 1), 0)
        k = s[:, :-1].argmax(1)
        more = s[rows, k] > best[0]
        for old, new in zip(best, (s[rows, k], m[rows, k], a[rows, k], j[rows, k] + 1)):
            old[more] = new[more]
    return tuple(best)


def near_of(n: int, band: int) -> int:
    """Less than a short template's length, so that copies in a row stay apart."""
    return max(1, min(band, n // 3))


def by_pairs(w: tn.Words, index: Index, band: int, min_coverage: float) -> list[tuple[int, int, int]]:
    """(text, template, diagonal) of shared pairs of words whose band holds min_coverage of the template's words."""
    at = np.flatnonzero(index.maybe_word[(w.hash >> np.uint64(44)).astype(np.int64)])
    v = np.minimum(np.searchsorted(index.vocabulary, w.hash[at]), max(len(index.vocabulary) - 1, 0))
    ok = index.vocabulary[v] == w.hash[at] if len(index.vocabulary) else np.zeros(len(at), bool)
    at, v = at[ok], v[ok]
    if len(at) < 2 or not len(index.pairs):
        return []
    i = np.flatnonzero((at[1:] == at[:-1] + 1) & (w.doc[at[1:]] == w.doc[at[:-1]]))
    pair = v[i] * len(index.vocabulary) + v[i + 1]
    k = np.minimum(np.searchsorted(index.pairs, pair), len(index.pairs) - 1)
    ok = index.pairs[k] == pair
    i, k = i[ok], k[ok]
    n = index.pair_first[k + 1] - index.pair_first[k]
    post = np.repeat(index.pair_first[k], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    word, template = np.repeat(at[i], n), index.pair_template[post]
    diagonal, doc = word - index.pair_place[post], w.doc[word]
    out = []
    for t in np.unique(template):
        own = index.words[t]
        near, least = near_of(len(own), band), min_coverage * len(own)
        mine = template == t
        d, of = np.unique(np.stack([diagonal[mine], doc[mine]]), axis=1)
        # first by how many words of the band's text are any of the template's
        low, high = np.maximum(d - near, w.first[of]), np.minimum(d + near + len(own), w.first[of + 1])
        held = np.concatenate([[0], np.cumsum(index.member[t][v])])
        on = np.flatnonzero(held[np.searchsorted(at, high)] - held[np.searchsorted(at, low)] >= least)
        shift = np.arange(-near, near + 1)[:, None] + np.arange(len(own))
        for a, b in zip(d[on].tolist(), of[on].tolist()):
            place = a + shift
            inside = (place >= w.first[b]) & (place < w.first[b + 1])
            if (((w.hash[np.where(inside, place, 0)] == own) & inside).any(0)).sum() >= least:
                out.append((b, int(t), a))
    return out


def apart(found: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Of overlapping matches of one template in one text the one of greatest score, then the first."""
    out: list[tuple[int, int, int, int, int, int]] = []
    kept: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x in sorted(set(found), key=lambda x: (x[:2], -x[2], x[4], x[5])):
        spans = kept.setdefault(x[:2], [])
        k = bisect.bisect(spans, x[4:])
        if (k == 0 or spans[k - 1][1] <= x[4]) and (k == len(spans) or spans[k][0] >= x[5]):
            spans.insert(k, x[4:])
            out.append(x)
    return sorted(out, key=lambda x: (x[:2], x[4]))


def without_rivals(found: list[tuple[int, int, int, int, int, int]], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """found without inexact matches that another template's match of greater score covers by more than half."""
    out: list[tuple[int, int, int, int, int, int]] = []
    for _, group in itertools.groupby(found, key=lambda x: x[0]):
        own = sorted(group, key=lambda x: x[4])
        longest = max(x[5] - x[4] for x in own)
        starts = [x[4] for x in own]
        for x in own:
            around = own[bisect.bisect_left(starts, x[4] - longest) : bisect.bisect_left(starts, x[5])]
            exact = x[2] == len(index.words[x[1]])
            if exact or not any(y[1] != x[1] and y[2] > x[2] and 2 * (min(x[5], y[5]) - max(x[4], y[4])) > x[5] - x[4] for y in around):
                out.append(x)
    return out


def scan(data: np.ndarray, off: np.ndarray, index: Index, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> list[tuple[int, int, int, int, int, int]]:
    """(text, template, score, matched words, first byte, end byte) of each candidate's best alignment; pairs make candidates from min_coverage on."""
    w = tn.words(data, off, tn.PUNCTUATION, lower=True)
    word, template, place = index.hits(*winnow(w, index.k, index.width))
    doc, diagonal = w.doc[word], word - place
    order = np.lexsort((diagonal, template, doc))
    template, doc, diagonal = (x[order].tolist() for x in (template, doc, diagonal))
    found: dict[int, set[tuple[int, int]]] = {}
    i = 0
    while i < len(doc):  # hits on diagonals not farther apart than `near` in all are one candidate
        near, j = near_of(len(index.words[template[i]]), band), i + 1
        while j < len(doc) and doc[j] == doc[i] and template[j] == template[i] and diagonal[j] - diagonal[i] <= near:
            j += 1
        found.setdefault(template[i], set()).add((doc[i], diagonal[i]))
        i = j
    for b, t, d in by_pairs(w, index, band, min_coverage):
        found.setdefault(t, set()).add((b, d))
    out = []
    for t, places in sorted(found.items()):
        own, near = index.words[t], near_of(len(index.words[t]), band)
        width = 3 * near + 1
        b, d = np.array(sorted(places)).T
        for i in range(0, len(b), max(1, CELLS // width)):
            part = slice(i, i + max(1, CELLS // width))
            got = align(own, w.hash, d[part] - near, w.first[b[part]], w.first[b[part] + 1], width)
            out += [(int(k), t, int(s), int(m), int(w.start[x]), int(w.end[z - 1])) for k, s, m, x, z in zip(b[part], *got) if m]
    return apart(out)


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_matched, coverage (share of the template's words), start, end (code points, end exclusive)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in tn.blocks(b.column(1)):
                found = [x for x in scan(data, off, shared.value, min_coverage=min_coverage) if x[3] >= min_coverage * len(shared.value.words[x[1]])]
                found = without_rivals(found, shared.value)
                if not found:
                    continue
                points = np.concatenate([[0], np.cumsum(tn.code_points(data))])
                doc, t, _, n, a, z = (np.array(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(doc + i)),
                        pa.array([shared.value.names[k] for k in t]),
                        pa.array(n.astype(np.int64)),
                        pa.array(n / np.array([len(shared.value.words[k]) for k in t])),
                        pa.array(points[a] - points[off[doc]]),
                        pa.array(points[z] - points[off[doc]]),
                    ],
                    ["doc_id", "license", "n_matched", "coverage", "start", "end"],
                )

    return own.mapInArrow(tn.released(search), f"doc_id {own.dtypes[0][1]}, license string, n_matched long, coverage double, start long, end long")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
