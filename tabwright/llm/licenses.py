"""License scans with a generalised suffix automaton over licence words.

All templates share one automaton. A text's words are fed through it and give,
at every place, the longest stretch ending there that occurs in some template
(matching statistics). Long stretches are chained in template order; the share
of a template that a chain covers decides its label. Words outside every
template reset the automaton, so only runs of template words are fed to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.exprs import c
from tabwright.llm.text import Words, buffer_of, byte_table, id_and_text, slices, words_of

#: Phrases that name a licence, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Public licence texts and notices, by label.
TEMPLATES = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    ),
    (
        "apache-2",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    ),
    (
        "cc-by-nc",
        """This work is licensed under a Creative Commons Attribution NonCommercial License. You are free to share and adapt
        the material. You must give appropriate credit, provide a link to the license, and indicate if changes were made. You
        may not use the material for commercial purposes.""",
    ),
)
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_in(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class Automaton:
    """Smallest automaton of all substrings of several word sequences, built sequence by sequence."""

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.sequences = sequences
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        #: state -> {sequence: end of the first place its stretches have there}
        self.places: list[dict[int, int]] = [{}]
        for k, seq in enumerate(sequences):
            last, path = 0, []
            for word in seq:
                last = self._extend(last, word)
                path.append(last)
            for end, state in enumerate(path, 1):
                while state > 0 and k not in self.places[state]:
                    self.places[state][k] = end
                    state = self.link[state]
        #: state -> sequences that are whole stretches of a state it links to, or its own, with their length
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * len(self.size)
        own: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(sequences):
            own.setdefault(self.walk(seq), []).append((k, len(seq)))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.whole[state] = (*own.get(state, ()), *self.whole[self.link[state]])

    def _new(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        self.places.append({})
        return len(self.size) - 1

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            to = self.next[last][word]
            return to if self.size[to] == self.size[last] + 1 else self._split(last, word, to)
        new, at = self._new(self.size[last] + 1), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            self.link[new] = to if self.size[to] == self.size[at] + 1 else self._split(at, word, to)
        return new

    def _split(self, at: int, word: bytes, to: int) -> int:
        twin = self._new(self.size[at] + 1)
        self.next[twin], self.places[twin] = dict(self.next[to]), dict(self.places[to])
        self.link[twin], self.link[to] = self.link[to], twin
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def walk(self, seq: list[bytes]) -> int:
        state = 0
        for word in seq:
            state = self.next[state][word]
        return state

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest known stretch ending at each word."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                state = size = 0
            yield state, size


class Scanner:
    """Automaton, labels and the hashed word list of all phrases and templates."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, least_match: int = 4) -> None:
        self.labels = [x for _, x in phrases] + [x for x, _ in templates]
        self.n_phrases, self.least_match = len(phrases), least_match
        self.automaton = Automaton([words_in(t) for t, _ in phrases] + [words_in(t) for _, t in templates])
        vocabulary = b" ".join(sorted({w for s in self.automaton.sequences for w in s}))
        data = np.frombuffer(vocabulary, np.uint8)
        self.hashes = np.unique(words_of(data, np.array([0, len(data)]), byte_table("alnum")).hashes)
        self.shortest = min(least_match, *(len(s) for s in self.automaton.sequences))

    def runs(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(text, first word, end word) of runs of known words long enough for a phrase or match."""
        at = np.minimum(np.searchsorted(self.hashes, w.hashes), len(self.hashes) - 1)
        known = self.hashes[at] == w.hashes
        edge = np.zeros(len(w) + 1, bool)
        edge[w.first] = True
        starts = np.flatnonzero(known & (~np.concatenate([[False], known[:-1]]) | edge[:-1]))
        ends = np.flatnonzero(known & (~np.concatenate([known[1:], [False]]) | edge[1:])) + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        texts = np.searchsorted(w.first, starts, "right") - 1
        yield from zip(texts.tolist(), starts.tolist(), ends.tolist(), strict=True)

    def scan_run(self, words: list[bytes], at: int, phrases: list, matches: dict) -> None:
        """Adds the phrases (start, number) and matches {template: [(text end, template end, length)]} of one run."""
        a, stats = self.automaton, list(self.automaton.statistics(words))
        for i, (state, size) in enumerate(stats):
            for k, length in a.whole[state]:
                if k < self.n_phrases and size >= length:
                    phrases.append((at + i + 1 - length, k))
            grows = i + 1 < len(stats) and stats[i + 1][1] == size + 1
            if size >= self.least_match and not grows:
                for k, end in a.places[state].items():
                    if k >= self.n_phrases:
                        matches.setdefault(k, []).append((at + i + 1, end, size))

    def coverage(self, k: int, matches: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        """(words of template ``k`` covered by the best chain, first word, end word of the chain in the text)."""
        matches = sorted(matches)
        #: template words covered so far -> by template end: only chains that no other beats are kept
        front: list[tuple[int, int, int, int, int]] = []
        best = (0, 0, 0)
        for text_end, end, size in matches:
            covered, start = size, text_end - size
            for c_end, c_text, c_covered, c_start, _ in front:
                gain = min(size, end - c_end, text_end - c_text)
                if gain > 0 and c_covered + gain > covered:
                    covered, start = c_covered + gain, c_start
            best = max(best, (covered, -start, text_end))
            front = [f for f in front if not (f[0] >= end and f[2] <= covered)]
            if not any(f[0] <= end and f[2] > covered and f[1] <= text_end for f in front) or covered > size:
                front.append((end, text_end, covered, start, size))
        return best[0], -best[1], best[2]


@lru_cache(1)
def default_scanner() -> Scanner:
    return Scanner()


def scanning(least_cover: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, table = default_scanner(), byte_table("alnum")
        sizes = [len(x) for x in s.automaton.sequences]
        for batch in slices(batches):
            w = words_of(*buffer_of(batch["text"]), table)
            phrases: dict[int, list] = {}
            matches: dict[int, dict] = {}
            for d, a, b in s.runs(w):
                s.scan_run([w.word(i) for i in range(a, b)], a - int(w.first[d]), phrases.setdefault(d, []), matches.setdefault(d, {}))
            rows = []
            for d in range(batch.num_rows):
                found = sorted(phrases.get(d, []))
                covers = []
                for k, m in sorted(matches.get(d, {}).items()):
                    covered, start, end = s.coverage(k, m)
                    covers.append({"label": s.labels[k], "start": start, "end": end, "share": covered / sizes[k]})
                kept = [x for x in covers if x["share"] >= least_cover]
                base = sorted({s.labels[k] for _, k in found})
                rows.append(
                    {
                        "n_words": int(w.first[d + 1] - w.first[d]), "n_base": len(found),
                        "first_word": found[0][0] if found else None, "last_word": found[-1][0] if found else None,
                        "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(x["label"] for x in kept)})),
                        "score": 1.0 if base else max((x["share"] for x in covers), default=0.0), "covered": kept,
                    }
                )
            names = [n for n in batch.schema.names if n != "text"]
            made = pa.array(rows, OUT)
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], *made.flatten()], [*names, *OUT.names])

    return scan


OUT = pa.struct(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("covered", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
    ]
)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cover: float = 0.5) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, covered) of every row.

    ``n_base`` counts all places of the naming phrases, ``first_word`` and
    ``last_word`` are their least and greatest start (null without one).
    ``covered`` has the template spans [start, end) in words whose chain covers
    ``least_cover`` of the template; ``labels`` adds theirs to ``base_labels``.
    ``score`` is 1 with a phrase, else the best coverage of any template. A null
    text is empty; repeated rows are scanned each; other columns stay behind.
    """
    d = id_and_text(docs, id_col, text_col)
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(
        scanning(least_cover),
        f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, covered array<struct<label:string,start:bigint,end:bigint,share:double>>",
    )


def license_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score); see license_scan."""
    return license_scan(docs, **options).select(c("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.least(F.col("score"), F.lit(1.0)).alias("score"))
