"""Licence scan: matching statistics on a generalised suffix automaton of licence words.

All template and phrase words go into one suffix automaton. A text streams through it:
at every word the automaton holds the longest run of words ending there that occurs in
some template. A phrase stands where its state lies on the suffix path of the current
match; long right-maximal matches are chained, in order in both text and template, into
spans, and a span that covers enough of its template adds the template's label.

Runs are entered only where both words of a pair occur side by side in some template;
matches of two or more words cannot lie elsewhere, so nothing is lost.

Edge cases: null text counts as empty (no words, score 0); repeated rows give equal results;
a label's places overlap freely and all count; texts are scanned whole; existing columns
named like the outputs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fwlog.llm._batches import out_schema, pieces, with_columns

# Phrases whose places are counted, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# The opening words and notices of public licences.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]

#: Words a match must have to be chained, words two chained matches may lie apart, share of a template a span must cover.
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 8, 0.7

_BLANKED = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Words of a text in UTF-8: runs of ASCII digits and letters, lower-cased, and of other characters."""
    return raw.lower().translate(_BLANKED).split()


class Automaton:
    """Generalised suffix automaton over word sequences, with the places of every state."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.phrase_labels = [label for _, label in phrases]
        texts = [words_of(text.encode()) for _, text in templates]
        wanted = [words_of(text.encode()) for text, _ in phrases]
        if any(len(w) < 2 for w in texts + wanted):
            raise ValueError("templates and phrases have two words at least")
        self.sizes = [len(w) for w in texts]
        self.ids = {w: i for i, w in enumerate(sorted({w for ws in texts + wanted for w in ws}), 1)}
        self.next, self.link, self.length, ends = [{}], [-1], [0], [set()]
        pairs = set()
        for t, ws in enumerate(texts + wanted):
            seq = [self.ids[w] for w in ws]
            pairs.update(zip(seq, seq[1:]))
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c, ends)
                if t < len(texts):
                    ends[last].add((t, i))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.ends = [sorted(e) for e in ends]
        # phrases that end where a state's match ends, if the match is long enough
        own = [[] for _ in self.next]
        for p, ws in enumerate(wanted):
            s = 0
            for w in ws:
                s = self.next[s][self.ids[w]]
            own[s].append((p, len(ws)))
        self.phrases = [None] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.phrases[s] = own[s] + (self.phrases[self.link[s]] if s else [])
        n = len(self.ids) + 1
        self.pair_keys = np.array(sorted(a * n + b for a, b in pairs), np.int64)

    def _new(self, length, following, link, ends):
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, p, q, c, ends):
        """State for the shorter part of q that follows p by c."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last, c, ends):
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c, ends)
        cur, p = self._new(self.length[last] + 1, {}, 0, ends), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, ends)
        return cur

    def statistics(self, seq: list[int]):
        """State and length of the longest match that ends at each word."""
        s = n = 0
        for c in seq:
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            yield s, n

    def scan(self, raw: bytes):
        """Words, places of phrases as (start, phrase), and matches as (start, length, state)."""
        words = words_of(raw)
        if len(words) < 2:
            return len(words), [], []
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        key = ids[:-1] * (len(self.ids) + 1) + ids[1:]
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        edge = np.diff(np.r_[0, (self.pair_keys[at] == key).astype(np.int8), 0])
        places, matches = [], []
        for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            held = (0, 0)
            for i, (s, n) in enumerate(self.statistics(ids[lo:hi + 1].tolist()), lo):
                if held[1] >= MIN_MATCH and n <= held[1]:
                    matches.append((i - held[1], held[1], held[0]))
                held = (s, n)
                for p, size in self.phrases[s]:
                    if n >= size:
                        places.append((i - size + 1, p))
            if held[1] >= MIN_MATCH:
                matches.append((hi + 1 - held[1], held[1], held[0]))
        return len(words), places, matches

    def spans(self, matches):
        """Chains of matches as (label, first word, past the last word, share of the template covered).

        Each match extends the chain of its template that covers most, if text and
        template both go on within MAX_GAP words, or else starts one.
        """
        live, done = {}, []
        for start, size, state in matches:
            for t, end in self.ends[state]:
                here = end - size + 1
                best = None
                chains = [c for c in live.get(t, []) if start - c[1] <= MAX_GAP]
                done.extend((t, *c) for c in live.get(t, []) if start - c[1] > MAX_GAP)
                for c in chains:  # (text start, text end, template end, covered)
                    skip = max(0, c[1] - start, c[2] - here)
                    if skip < size and here + skip - c[2] <= MAX_GAP and (best is None or c[3] - skip > best[0]):
                        best = (c[3] - skip, c)
                covered = size + (best[0] if best else 0)
                chain = (best[1][0] if best else start, start + size, end + 1, covered)
                chains.append(chain)
                # chains that end alike: only the one that covers most can lead further
                by_end = {}
                for c in chains:
                    if c[1:3] not in by_end or c[3] > by_end[c[1:3]][3]:
                        by_end[c[1:3]] = c
                live[t] = list(by_end.values())
        done.extend((t, *c) for t, chains in live.items() for c in chains)
        best = {}
        for t, start, end, _, covered in done:
            share = min(1.0, covered / self.sizes[t])
            if share >= MIN_COVER and share > best.get((t, start), (0, 0))[1]:
                best[t, start] = (end, share)
        return sorted((self.labels[t], start, end, share) for (t, start), (end, share) in best.items())


_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()),
                      T.StructField("end", T.IntegerType()), T.StructField("covered", T.DoubleType())])
_OUT = {
    "n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(),
    "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "spans": T.ArrayType(_SPAN),
}


def license_spans(df: DataFrame, text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """df with word and phrase counts, labels, score (largest share covered) and the covered spans."""
    automaton = Automaton(templates, phrases)
    span = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("covered", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def row(raw):
        n, places, matches = automaton.scan(raw or b"")
        spans = automaton.spans(matches) if matches else []
        base = {automaton.phrase_labels[p] for _, p in places}
        starts = [s for s, _ in places]
        score = 1.0 if places else max([s[3] for s in spans], default=0.0)
        return (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | {s[0] for s in spans})), score,
                [dict(zip(("label", "start", "end", "covered"), s)) for s in spans])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                rows = [row(raw) for raw in part.column(text).cast(pa.binary()).to_pylist()]
                yield with_columns(part, **{n: pa.array(c, k) for n, c, k in zip(_OUT, zip(*rows), kinds)})

    return df.mapInArrow(run, out_schema(df, **_OUT))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_spans(docs).select("doc_id", *[c for c in _OUT if c != "spans"])
