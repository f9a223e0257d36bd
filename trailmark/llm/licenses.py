"""Licence scan with a generalised suffix automaton of licence tokens.

All templates and base phrases, as word sequences, make one automaton. A
text's words stream through it and give matching statistics: at each word the
longest run ending there that occurs in some template, and by suffix links the
longest of every other template. Runs that cannot grow in their own template
and are long enough are placed in it and chained, forwards in text and
template alike, each run where it covers most, on its own or behind any open chain;
a chain that covers enough of a template is a span and gives the
template's label. Base phrases are found in the same pass: a phrase ends at
a word if the state reached, or one on its suffix links, is the phrase's.

Defined cases: null and empty texts have no words, no labels (empty strings)
and score 0; overlapping places of phrases all count; repeated rows are
scanned alike; extra columns play no part. Memory is the text and its words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import small_batches

#: Phrases whose every place counts.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Labels, and notices that licences ask for or whole licences.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "either version 3 of the license or at your option any later version"),
    ("gpl-2", "either version 2 of the license or at your option any later version"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
)
_WHOLE = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
    the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
    sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following
    conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the
    software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
    fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or
    other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other
    dealings in the software""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
    above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties
    with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any
    special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of
    contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
    are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2
    redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
    documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is
    and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular
    purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary
    or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business
    interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
    arising in any way out of the use of this software even if advised of the possibility of such damage""",
}
TEMPLATES += tuple((label, " ".join(text.split())) for label, text in _WHOLE.items())
#: A run of so many words can start or carry on a chain.
LEAST_RUN = 3
#: A chain bridges so many foreign words of a text.
GAP = 8
#: Share of a template that a chain must cover.
COVER = 0.85
KEPT_WORDS = 100_000
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode().translate(_SPACED).split()


class _Ids(dict):
    """Numbers of the templates' words; -1 for any other word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) < KEPT_WORDS:
            self[word] = -1
        return -1


class Automaton:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.ids = _Ids()
        self.labels = [label for label, _ in templates]
        self.phrase_labels = [label for label, _ in phrases]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]  # (template, words up to its end)
        self.templates = [self._add(text, i) for i, (_, text) in enumerate(templates)]
        self.phrases = [self._add(text, None) for _, text in phrases]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[state]] |= self.places[state]
        # of each state and template: length of its longest run that ends there (0: all that is matched), and the run's places
        self.runs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{} for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.link[state]
            if self.length[above] >= LEAST_RUN:
                self.runs[state] = {t: (n or self.length[above], ends) for t, (n, ends) in self.runs[above].items()}
            by: dict[int, list[int]] = {}
            for t, e in sorted(self.places[state]):
                by.setdefault(t, []).append(e)
            self.runs[state] |= {t: (0, tuple(ends)) for t, ends in by.items()}
        ends: dict[int, list[int]] = {}
        for i, phrase in enumerate(self.phrases):
            state = 0
            for w in phrase:
                state = self.next[state][w]
            ends.setdefault(state, []).append(i)
        self.ends: list[tuple[int, ...]] = [()] * len(self.next)  # phrases that are suffixes of the state's words
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.ends[state] = (*ends.get(state, ()), *self.ends[self.link[state]])

    def _add(self, text: str, template: int | None) -> list[int]:
        words = []
        for w in text.encode().split():
            if self.ids.get(w, -1) < 0:
                self.ids[w] = sum(i >= 0 for i in self.ids.values())
            words.append(self.ids[w])
        last = 0
        for i, w in enumerate(words):
            last = self._extend(last, w)
            if template is not None:
                self.places[last].add((template, i + 1))
        return words

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state for the shorter words of q that follow p by w."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # an earlier sequence has these words
            return self._split(last, self.next[last][w], w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state = n = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            yield state, n

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Number of words; phrases as (phrase, start); spans as (template, start, end, share covered)."""
        words = words_of(text)
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        found: list[tuple[int, int]] = []
        runs: list[tuple[int, tuple[int, ...], int, int]] = []  # template, places, end in the text, length
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start < LEAST_RUN:
                continue
            before: dict[int, tuple[int, tuple[int, ...]]] = {}
            for i, (state, n) in enumerate(self.statistics(ids[start:end].tolist()), start):
                for p in self.ends[state]:
                    if n >= len(self.phrases[p]):
                        found.append((p, i + 1 - len(self.phrases[p])))
                now = {t: (k or n, ends) for t, (k, ends) in self.runs[state].items()} if n >= LEAST_RUN else {}
                for t, (k, ends) in before.items():
                    if t not in now or now[t][0] <= k:
                        runs.append((t, ends, i, k))
                before = now
            runs += [(t, ends, end, k) for t, (k, ends) in before.items()]
        return len(words), found, self.chains(runs)

    def chains(self, runs: list[tuple[int, tuple[int, ...], int, int]]) -> list[tuple[int, int, int, float]]:
        """The best chains of each template that share no word of the text.

        A template's runs come by their end, and their starts do not fall. A run at each of its places either starts
        a chain or extends the one that makes it cover most; no chain is given up for being extended.
        """
        out = []
        open_: dict[int, list[tuple[int, int, int, int]]] = {}  # start, end, place in the template, words covered
        done: dict[int, list[tuple[int, int, int]]] = {}  # words covered, start, end

        def close(t: int) -> None:
            taken: list[tuple[int, int]] = []
            for covered, start, end in sorted(done.pop(t, ()), key=lambda c: (-c[0], c[2] - c[1], c[1])):
                i = bisect_left(taken, (start, end))
                if (not i or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                    taken.insert(i, (start, end))
                    out.append((t, start, end, covered / len(self.templates[t])))

        for t, ends, end, n in runs:
            # runs to come start no earlier than this one
            near = [c for c in open_.get(t, ()) if end - n - c[1] <= GAP]
            if not near:
                close(t)
            made = []
            for e in ends:
                # a run may overlap what a chain has, in text or template
                more = [(c[3] + min(n, e - c[2], end - c[1]), c[0]) for c in near if e > c[2] and end > c[1]]
                covered, start = max([(n, end - n), *more])
                made.append((start, end, e, covered))
                if covered >= COVER * len(self.templates[t]):
                    done.setdefault(t, []).append((covered, start, end))
            open_[t] = near + made
        for t in list(done):
            close(t)
        return sorted(self._own(out), key=lambda s: (s[1], s[2], s[0]))

    def _own(self, spans: list[tuple[int, int, int, float]]) -> Iterator[tuple[int, int, int, float]]:
        """Without the incomplete spans inside a span of another label that covers more words, or as many of a shorter template."""
        around: list[tuple[int, int, int, float]] = []
        worth = lambda s: (round(s[3] * len(self.templates[s[0]])), s[3])
        for span in sorted(spans, key=lambda s: (s[1], -s[2], *(-w for w in worth(s)), s[0])):
            t, start, end, share = span
            around = [s for s in around if s[2] > start]  # one of each template at most
            if share >= 1 or not any(s[2] >= end and worth(s) > worth(span) and self.labels[s[0]] != self.labels[t] for s in around):
                yield span
            around.append(span)


def scanned(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and ``spans``
    (label, first word, word behind the last, share of the template covered)."""
    small_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(Automaton(templates, phrases))  # made of the templates alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = broadcast.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                n, found, spans = auto.scan(text.as_py())
                starts = [s for _, s in found]
                base = {auto.phrase_labels[p] for p, _ in found}
                named = [{"label": auto.labels[t], "start": a, "end": b, "share": c} for t, a, b, c in spans]
                labels = base | {s["label"] for s in named}
                score = 1.0 if base else max((s["share"] for s in named), default=0.0)
                rows.append((doc_id, n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score), named))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(_SCHEMA), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DDL)


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)
_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, share: double>>"
