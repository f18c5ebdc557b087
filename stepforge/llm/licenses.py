"""License scans by matching statistics over a suffix automaton.

One suffix automaton holds the word sequences of all license templates.  A
document's words are streamed through it; every position gets the length of
the longest template substring that ends there (its matching statistic).
Words that occur in no template reset the automaton, so a text falls into
independent runs of template words; runs shorter than the least match are
skipped, the others advance together, one word a step.  Maximal matches are
placed at all their template positions and chained in order into spans, which
are reported if they cover enough of a template.
"""

from __future__ import annotations

import pathlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm import runtime
from stepforge.llm import textbuf as tb

#: Words of the shortest match that counts.
MIN_MATCH = 3
#: Share of a template's words that a span must cover.
MIN_COVER = 0.8
#: Words of text that may lie between two matches of a span.
MAX_GAP = 12

_AS_IS = "THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND EXPRESS OR IMPLIED INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM DAMAGES OR OTHER LIABILITY WHETHER IN AN ACTION OF CONTRACT TORT OR OTHERWISE ARISING FROM OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
_BSD = "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"

#: (license, template): notices and texts under which software and writing are commonly published.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software and to permit persons to whom the Software is furnished to do so subject to the following conditions The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT", _AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License You may obtain a copy of the License at http www apache org licenses LICENSE 2.0 Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or implied See the License for the specific language governing permissions and limitations under the License"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "licensed under the GNU Lesser General Public License"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0"),
    ("BSD", _BSD),
    ("ISC", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
)


def templates_in(folder: str) -> tuple[tuple[str, str], ...]:
    """(license, template) of every file of a folder of license texts; a file's name without ending names the license."""
    files = sorted(p for p in pathlib.Path(folder).iterdir() if p.is_file())
    return tuple((p.name.removesuffix(".txt"), p.read_text(errors="replace")) for p in files)


def words(d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of lower-cased bytes."""
    s, e = tb.spans(d, off, tb.WORD)
    return s, e, tb.hash_spans(d, s, e)


class Automaton:
    """Suffix automaton of several word sequences, with the end positions of every state."""

    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        seqs, number = [], {}
        for _, text in templates:
            d = tb.LOWER[np.frombuffer(text.encode(), np.uint8)]
            _, _, h = words(d, np.array([0, len(d)]))
            seqs.append([number.setdefault(int(x), len(number)) for x in h])
        self.size = np.array([len(s) for s in seqs], np.int64)
        vocab = np.array(list(number), np.uint64)
        self.vocab = tb.IntTable(vocab, np.arange(len(vocab)))
        nxt: list[dict[int, int]] = [{}]
        length, link, ends = [0], [-1], [[]]

        def state(n: int, edges: dict[int, int], suffix: int) -> int:
            nxt.append(edges)
            length.append(n)
            link.append(suffix)
            ends.append([])
            return len(nxt) - 1

        for t, seq in enumerate(seqs):
            last = 0
            for p, w in enumerate(seq):
                last = self._extend(nxt, length, link, state, last, w)
                ends[last].append((t, p))
        # a state occurs wherever the states whose suffix links lead to it do
        for v in sorted(range(1, len(nxt)), key=lambda v: -length[v]):
            if link[v] > 0:
                ends[link[v]].extend(ends[v])
        self.length, self.link = np.array(length, np.int64), np.array(link, np.int64)
        src = [(v, w, u) for v, edges in enumerate(nxt) for w, u in edges.items()]
        key = np.array([(v << 32) | w for v, w, _ in src], np.uint64)
        self.next = tb.IntTable(key, np.array([u for _, _, u in src], np.int32))
        self.end_first = np.concatenate([[0], np.cumsum([len(x) for x in ends])])
        flat = np.array([x for e in ends for x in e], np.int64).reshape(-1, 2)
        self.end_template, self.end_pos = flat[:, 0], flat[:, 1]

    @staticmethod
    def _extend(nxt, length, link, state, last, w):
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            c = state(length[last] + 1, dict(nxt[q]), link[q])
            link[q] = c
            p = last
            while p != -1 and nxt[p].get(w) == q:
                nxt[p][w] = c
                p = link[p]
            return c
        cur = state(length[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                c = state(length[p] + 1, dict(nxt[q]), link[q])
                while p != -1 and nxt[p].get(w) == q:
                    nxt[p][w] = c
                    p = link[p]
                link[q] = link[cur] = c
        return cur

    def statistics(self, tok: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token (numbers of template words), the longest match that ends there within its run, and its state."""
        length, where = np.zeros(len(tok), np.int64), np.zeros(len(tok), np.int64)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, have = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for i in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -i, side="left"))  # runs longer than i come first
            w = tok[start[:k] + i].astype(np.uint64)
            s, h = state[:k], have[:k]
            to = self.next.get((s.astype(np.uint64) << np.uint64(32)) | w)
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                s[stuck] = self.link[s[stuck]]
                h[stuck] = self.length[s[stuck]]
                to[stuck] = self.next.get((s[stuck].astype(np.uint64) << np.uint64(32)) | w[stuck])
                stuck = stuck[to[stuck] < 0]
            s[:] = to
            h += 1
            length[start[:k] + i], where[start[:k] + i] = h, s
        return length, where


def chain(match: list[tuple[int, int, int]], max_gap: int = MAX_GAP) -> list[tuple[int, int, int]]:
    """Spans (first word, last word, template words covered) of the best chains of matches.

    match: (text position, template position, words).  In a chain both positions
    rise and text gaps stay within max_gap; overlapping parts count once.  Of
    equal scores the later earlier match is followed.
    """
    match = sorted(set(match))
    longest = max((n for _, _, n in match), default=0)
    best: list[tuple[int, int]] = []
    for i, (x, y, n) in enumerate(match):
        score, back = n, -1
        for j in range(i - 1, -1, -1):
            a, b, m = match[j]
            if x - (a + longest) > max_gap:  # all before it end too early as well
                break
            if a == x or b >= y or x - (a + m) > max_gap:
                continue
            over = max(0, a + m - x, b + m - y)
            if over < n and best[j][0] + n - over > score:
                score, back = best[j][0] + n - over, j
        best.append((score, back))
    out, used = [], set()
    for i in sorted(range(len(match)), key=lambda i: (-best[i][0], i)):
        j, path = i, []
        while j != -1 and j not in used:
            path.append(j)
            j = best[j][1]
        if j == -1 and i not in used:
            used.update(path)
            out.append((match[path[-1]][0], match[i][0] + match[i][2] - 1, best[i][0]))
    return out


def scan(a: Automaton, texts: pa.Array, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER):
    """Yields (row, license, covered words, template words, first byte, end byte) for every span."""
    data, off = tb.buffers(texts)
    for i, j in tb.slices(off):
        o = off[i : j + 1] - off[i]
        d = tb.LOWER[data[off[i] : off[j]]]
        s, e, h = words(d, o)
        tok = a.vocab.get(h)
        row = tb.owner(s, o)
        known = tok >= 0
        if not known.any():
            continue
        same = np.r_[False, row[1:] == row[:-1]]
        first = np.flatnonzero(known & ~(np.r_[False, known[:-1]] & same))
        ends = np.flatnonzero(known & ~(np.r_[known[1:], False] & np.r_[same[1:], False]))
        size = ends - first + 1
        long = size >= min_match
        first, size = first[long], size[long]
        length, where = a.statistics(tok, first, size)
        at = np.flatnonzero((length >= min_match) & (np.r_[length[1:], 0] != length + 1))
        if not len(at):
            continue
        n = a.end_first[where[at] + 1] - a.end_first[where[at]]
        occ = np.repeat(a.end_first[where[at]], n) + tb.ragged(n)
        at, t = np.repeat(at, n), a.end_template[occ]
        begin, tb_begin = at - length[at] + 1, a.end_pos[occ] - length[at] + 1
        pair = row[at] * len(a.size) + t
        keys, inv = np.unique(pair, return_inverse=True)
        enough = np.bincount(inv, length[at]) >= min_cover * a.size[keys % len(a.size)]
        groups = defaultdict(list)
        for k in np.flatnonzero(enough[inv]):
            groups[int(pair[k])].append((int(begin[k]), int(tb_begin[k]), int(length[at[k]])))
        spans = defaultdict(list)
        for key, match in groups.items():
            r, t1 = divmod(key, len(a.size))
            for x, y, covered in chain(match):
                if covered >= min_cover * a.size[t1]:
                    spans[r, a.names[t1]].append((-covered, x, y, int(a.size[t1])))
        for (r, name), found in sorted(spans.items()):
            taken: list[tuple[int, int]] = []
            for c, x, y, whole in sorted(found):
                if all(y < p or x > q for p, q in taken):  # of overlapping spans of one license the longest stays
                    taken.append((x, y))
                    yield i + r, name, -c, whole, int(s[x] - o[r]), int(e[y] - o[r])


def license_spans(docs: DataFrame, templates=TEMPLATES, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER) -> DataFrame:
    """(doc_id, license, covered_words, template_words, first_byte, end_byte) of every template span.

    Words are runs of ASCII letters, digits and non-ASCII bytes in lower case.
    Of spans of one license that overlap the longest stays, then the first.
    Null and empty texts have no spans; a null doc_id is carried; repeated rows
    are each scanned; a text of any length is scanned whole, in time in
    proportion to its matches; an empty table gives an empty result; other
    columns aren't read.  ``templates`` are TEMPLATES or those of a folder, see
    templates_in(); they are sent to every executor, for they don't grow with
    the data.
    """
    shared = runtime.text_session(docs).sparkContext.broadcast(Automaton(templates))

    @runtime.trimmed
    def run(batches):
        a = shared.value
        for b in batches:
            got = list(scan(a, b.column(1), min_match, min_cover))
            if got:
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    ["doc_id", "license", "covered_words", "template_words", "first_byte", "end_byte"],
                )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, license string, covered_words long, template_words long, first_byte long, end_byte long")
