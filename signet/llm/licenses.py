"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds every substring of every template (licence texts and notices) and of the base phrases. A text is
streamed through it word by word; at each word the longest suffix that is a substring of some template is known (the
matching statistic). A base phrase stands where the match holds it as a suffix, which its state and its suffix links
tell. Where a match can't be longer and has LEAST words or more, its places in the templates are taken. A chain is a
sequence of matches of one template that goes on in text and template with gaps of GAP words at most; where matches
overlap, words count once. The best chain ending in each match is found by dynamic programming, so a match that fits
no chain does not break one. A chain that covers COVER of the template's words is a hit.

A match of two words or more consists of pairs of words that are neighbours in some template, so the texts are
filtered by such pairs in numpy, and only runs of them reach the automaton.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

# Phrases of the base labels, and wording of public licence notices.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("reserved", "copyright all rights reserved"),
)
# The words of whole public licences.
_NO_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action "
    "of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
LICENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
     "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
     "permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included "
     "in all copies or substantial portions of the software " + _NO_WARRANTY),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
     "this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
     "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
     "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
     "performance of this software"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 "
     "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must "
     "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
     "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
     "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
     "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
     "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this "
     "software even if advised of the possibility of such damage"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
     "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
     "following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a "
     "product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be "
     "misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the "
     "license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
     "as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under "
     "the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
     "foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
     "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a "
     "copy of the gnu general public license along with this program"),
)
#: Words of the shortest match that counts; share of a template that a hit covers; gap between chained matches.
LEAST, COVER, GAP = 3, 0.8, 6

_BREAK = np.ones(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _BREAK[_lo:_hi] = False


class SuffixAutomaton:
    """Of several sequences: states, their longest lengths, suffix links, and each state's places (template, end)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [set()]
        for t, seq in enumerate(sequences):
            last = 0
            for end, symbol in enumerate(seq):
                last = self._extend(last, symbol)
                self.places[last].add((t, end))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.places[self.link[state]] |= self.places[state]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.places.append(set())
        return len(self.link) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:  # another sequence has this prefix
            return q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
        return new

    def statistics(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest match that ends at each symbol."""
        state = length = 0
        out = []
        for s in symbols:
            while state and s not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if s in self.next[state]:
                state, length = self.next[state][s], length + 1
            out.append((length, state))
        return out


class Scanner:
    def __init__(self, templates=(*TEMPLATES, *LICENCES), phrases=PHRASES, least: int = LEAST, cover: float = COVER, gap: int = GAP):
        words = sorted({w for _, t in (*templates, *((b, a) for a, b in phrases)) for w in t.split()})
        self.index = {w: i for i, w in enumerate(words)}
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw])
        h = W.word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
        order = np.argsort(h)
        self.hashes, self.number = h[order], order
        self.labels = [label for label, _ in templates]
        self.templates = [[self.index[w] for w in t.split()] for _, t in templates]
        self.phrases = [([self.index[w] for w in p.split()], label) for p, label in phrases]
        whole = [*self.templates, *[p for p, _ in self.phrases]]
        self.automaton = SuffixAutomaton(whole)
        self.least, self.cover, self.gap = least, cover, gap
        #: neighbours in some template, and the shortest match that is of use
        self.pairs = np.zeros((len(words), len(words)), bool)
        for seq in whole:
            self.pairs[seq[:-1], seq[1:]] = True
        self.shortest = min([least, *[len(p) for p, _ in self.phrases]])
        # phrases at the state that stands for them: a match holds one as a suffix where its state is that one, or below it
        self.at: list[list[int]] = [[] for _ in self.automaton.link]
        for k, (p, _) in enumerate(self.phrases):
            self.at[self.automaton.statistics(p)[-1][1]].append(k)
        self.held: list[list[int]] = [[] for _ in self.automaton.link]
        for state in sorted(range(1, len(self.held)), key=lambda s: self.automaton.length[s]):
            above = self.automaton.link[state]
            self.held[state] = self.held[above] + self.at[above]

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of the words, -1 for others."""
        h = W.word_hashes(data, starts, ends, lower=True)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.number[at], -1)

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, list[tuple[int, int, int]]]]:
        """(start, phrase) of the base phrases, and for each template (start, place, words) of its longest matches."""
        places: list[tuple[int, int]] = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        if len(ids) < 2:
            return places, found
        near = (ids[:-1] >= 0) & (ids[1:] >= 0)
        near[near] = self.pairs[ids[:-1][near], ids[1:][near]]
        edges = np.diff(np.concatenate([[0], near.astype(np.int8), [0]]))
        sizes = [len(t) for t in self.templates]
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) + 1).tolist(), strict=True):
            if b - a < self.shortest:
                continue
            stats = self.automaton.statistics(ids[a:b].tolist())
            for i, (n, state) in enumerate(stats):
                for k in self.held[state]:
                    places.append((a + i - len(self.phrases[k][0]) + 1, k))
                for k in self.at[state]:
                    if len(self.phrases[k][0]) <= n:
                        places.append((a + i - len(self.phrases[k][0]) + 1, k))
                # a match is longest where the next word does not extend it
                if n >= self.least and (i + 1 == len(stats) or stats[i + 1][0] != n + 1):
                    for t, end in self.automaton.places[state]:
                        if t < len(sizes):
                            found.setdefault(t, []).append((a + i - n + 1, end - n + 1, n))
        return places, found

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(covered words, start, end) of the best chain that ends in each match of one template.

        A chain goes on from a match that ends at most GAP words before the next one begins, in text and template, and
        that begins and ends before it in both; words that two matches share in either count once."""
        matches = sorted(matches)
        longest = max(n for _, _, n in matches)
        best: list[tuple[int, int, int]] = []
        first = 0
        for j, (at, place, n) in enumerate(matches):
            while matches[first][0] + longest + self.gap < at:
                first += 1
            top = (n, at, at + n)
            for i in range(first, j):
                x, y, m = matches[i]
                if x >= at or y >= place or at - x - m > self.gap or place - y - m > self.gap:
                    continue
                new = n - max(0, x + m - at, y + m - place)
                if new > 0 and best[i][0] + new > top[0]:
                    top = (best[i][0] + new, best[i][1], at + n)
            best.append(top)
        return best

    def chains(self, found: dict[int, list[tuple[int, int, int]]]) -> tuple[set[str], float, list[tuple[str, int, int, float]]]:
        """Labels, best cover, and (label, first word, word after the last, cover) of the spans that are hits: of chains of
        one template that overlap, the one that covers most."""
        best, spans = 0.0, []
        for t, matches in found.items():
            size = len(self.templates[t])
            taken: list[tuple[int, int]] = []
            for covered, start, end in sorted(self.chain(matches), key=lambda c: (-c[0], c[1])):
                best = max(best, covered / size)
                if covered / size < self.cover:
                    break
                if all(end <= a or start >= b for a, b in taken):
                    taken.append((start, end))
                    spans.append((self.labels[t], start, end, covered / size))
        return {s[0] for s in spans}, min(1.0, best), sorted(spans, key=lambda s: s[1:3])


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,after:long,cover:double>>"


def _scan(batches):
    scanner = Scanner()
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for batch in W.pieces(batches, "text"):
        data, offsets = W.buffers(batch.column(batch.schema.get_field_index("text")))
        starts, ends, first = W.spans(data, offsets, _BREAK)
        ids = scanner.ids(data, starts, ends)
        rows = []
        for i in range(len(offsets) - 1):
            own = ids[first[i] : first[i + 1]]
            phrases, found = scanner.scan(own)
            places, base = [a for a, _ in phrases], {scanner.phrases[k][1] for _, k in phrases}
            labels, score, spans = scanner.chains(found)
            rows.append((len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, [dict(zip(("label", "first", "after", "cover"), s, strict=True)) for s in spans]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("cover", pa.float64())]))]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], ["id", *names[:7], "spans"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row for each row of df.

    Null and empty texts have no words, no places (null first and last), empty labels and score 0. Null and
    repeated ids are kept as they are. An empty table gives none.
    """
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(_scan, f"id {kind}, {COLUMNS}")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("spans").withColumnRenamed("id", "doc_id")
