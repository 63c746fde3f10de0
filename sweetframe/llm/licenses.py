"""Licence scans: matching statistics against a generalised suffix automaton of licence tokens, chained into spans.

All templates go into one suffix automaton over words. A text is streamed through it once; the state after each word gives
the longest run of words ending there that occurs in some template (the matching statistics), and the states along its
suffix links all shorter runs with the places where templates hold them. So each template has its own longest runs, also
where another template shares the wording and more. Runs of at least ``least`` words are chained: runs on one template that
come in the template's order with small gaps form a covered span, and a span that covers enough of the template's words (or
one long run) gives the template's label, if it holds a telling run: ``least`` words in a row that only templates of this
label have. Openings that several licences share ("this work is licensed under") tell nothing. A span inside another one
that covers as many words or more, and more of its template, gives none: a notice that names one variant of a licence reads
like those that name others.

Defined cases: null and empty texts have no words and score 0; of equal spans of several labels each gives its label;
repeated rows get the same answer each; very long texts are streamed like others; words outside all templates reset the
automaton; an empty table gives no rows. Only a column is added, under the name that the caller gives it, so that no name
can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sweetframe.llm._common import bounded_batches

# Phrases that name a licence.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public licence texts and the notices by which works refer to them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under the CC0 1.0 Universal Public Domain Dedication."),
)

# The public licences of one family, by their elements' names.
_ELEMENTS = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
_VARIANTS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")


def creative_commons(versions: tuple[str, ...] = ("3.0", "4.0")) -> tuple[tuple[str, str], ...]:
    """The long and the short marking of each variant and version."""
    out = []
    for variant in _VARIANTS:
        name = "-".join(_ELEMENTS[x] for x in variant.split("-"))
        for v in versions:
            long = "International" if v == "4.0" else "Unported"
            out.append((f"cc-{variant}", f"This work is licensed under a Creative Commons {name} {v} {long} License. To view a copy of this license, visit https://creativecommons.org/licenses/{variant}/{v}/"))
            out.append((f"cc-{variant}", f"This work is licensed under CC {variant.upper()} {v}"))
    return tuple(out)


# ASCII letters and digits and all bytes beyond ASCII belong to words; A-Z become a-z; all else parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class SuffixAutomaton:
    """Accepts each run of tokens of each sequence; knows for each state where its runs end.

    Ends are kept once, in the order of a walk down the tree of suffix links, so that those of a state are one slice.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = []  # (template, place of the run's last word)
        for template, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                own.extend([] for _ in range(len(self.link) - len(own)))
                own[last].append((template, place))
        below: list[list[int]] = [[] for _ in self.link]
        for state, link in enumerate(self.link[1:], 1):
            below[link].append(state)
        self.ends: list[tuple[int, int]] = []
        self.slice = [(0, 0)] * len(self.link)
        walk = [(0, False)] if own else []
        while walk:
            state, done = walk.pop()
            if done:
                self.slice[state] = (self.slice[state][0], len(self.ends))
            else:
                self.slice[state] = (len(self.ends), 0)
                self.ends += own[state]
                walk.append((state, True))
                walk += [(x, False) for x in below[state]]

    def matches(self, state: int, length: int, least: int) -> dict[tuple[int, int], int]:
        """By (template, place): the longest run that ends there, of at least ``least`` tokens; for a state and its run's length."""
        out: dict[tuple[int, int], int] = {}
        a, b = 0, 0
        while state > 0 and length >= least:
            first, end = self.slice[state]
            for ends in (self.ends[first:a], self.ends[b:end]) if b else (self.ends[first:end],):
                out.update(dict.fromkeys(ends, length))
            a, b, state = first, end, self.link[state]
            length = self.length[state]
        return out

    def _add(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, source: int, token: int) -> int:
        """The state of source's longest run and token, made its own if it shares one with longer runs."""
        target = self.next[source][token]
        if self.length[target] == self.length[source] + 1:
            return target
        own = self._add(self.length[source] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = own
        while source >= 0 and self.next[source].get(token) == target:
            self.next[source][token] = own
            source = self.link[source]
        return own

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new, at = self._add(self.length[last] + 1, {}, 0), last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, token)
        return new

    def statistics(self, tokens: list[int]) -> tuple[list[int], list[int]]:
        """By place: the length of the longest run that ends there and occurs in a template, and its state."""
        lengths, states, state, length = [], [], 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            lengths.append(length)
            states.append(state)
        return lengths, states


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = (*TEMPLATES, *creative_commons()), phrases: tuple[tuple[str, str], ...] = PHRASES, least: int = 5, gap: int = 8, cover: float = 0.5, long_run: int = 12):
        self.least, self.gap, self.cover, self.long_run = least, gap, cover, long_run
        self.labels = [label for label, _ in templates]
        words = [split_words(t) for _, t in templates]
        self.phrases = [(split_words(p), label) for p, label in phrases]
        self.ids = {w: i for i, w in enumerate(sorted({w for ws in [*words, *(p for p, _ in self.phrases)] for w in ws}))}
        self.sizes = [len(w) for w in words]
        sequences = [[self.ids[w] for w in ws] for ws in words]
        self.automaton = SuffixAutomaton(sequences)
        windows = [[tuple(x[i : i + least]) for i in range(len(x) - least + 1)] for x in sequences]
        owners: dict[tuple[int, ...], set[str]] = {}
        for label, own in zip(self.labels, windows, strict=True):
            for window in own:
                owners.setdefault(window, set()).add(label)
        #: By template: how many windows before each place only this label's templates have.
        self.telling = [[0, *accumulate(len(owners[w]) == 1 for w in own)] for own in windows]

    def places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """Each place where a phrase's words stand consecutively."""
        found = []
        for phrase, label in self.phrases:
            want = [self.ids[w] for w in phrase]
            at = np.flatnonzero(ids[: max(0, len(ids) - len(want) + 1)] == want[0])
            for i, token in enumerate(want[1:], 1):
                at = at[ids[at + i] == token]
            found += [(int(p), label) for p in at]
        return sorted(found)

    def runs(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, start in the text, start in the template, length) of each run of at least ``least`` words that no word prolongs."""
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        found = []
        for start, end in edges[edges[:, 1] - edges[:, 0] >= self.least].tolist():  # only known words move the automaton on
            lengths, states = self.automaton.statistics(ids[start:end].tolist())
            last: dict[tuple[int, int], int] = {}
            for i, (n, state) in enumerate(zip([*lengths, 0], [*states, 0], strict=True)):
                now = self.automaton.matches(state, n, self.least) if n >= self.least else {}
                found += [(t, start + i - m, place - m + 1, m) for (t, place), m in last.items() if (t, place + 1) not in now]
                last = now
        return sorted(found)

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template's words) of each chain that covers enough of its template."""
        out = []
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for t, a, b, n in self.runs(ids):
            by_template.setdefault(t, []).append((a, b, n))
        for t, runs in by_template.items():
            chains: list[list[int]] = []  # first word, end in the text, end in the template, words covered, longest run, telling windows
            near: list[list[int]] = []  # those that end within the gap of the run's start, or later
            for a, b, n in sorted(runs):
                near = [c for c in near if a - c[1] <= self.gap]
                tells = self.telling[t][b + n - self.least + 1] - self.telling[t][b]
                fit = next((c for c in reversed(near) if a >= c[1] and b >= c[2] and a - c[1] <= self.gap and b - c[2] <= self.gap), None)
                if fit:
                    fit[1:] = [a + n, b + n, fit[3] + n, max(fit[4], n), fit[5] + tells]
                else:
                    chains.append([a, a + n, b + n, n, n, tells])
                    near.append(chains[-1])
            out += [(c[0], -c[1], c[3], c[3] / self.sizes[t], self.labels[t]) for c in chains if c[5] and (c[3] >= self.cover * self.sizes[t] or c[4] >= self.long_run)]
        # by start, the widest and best first: whatever may drop a span comes before it
        kept: list[tuple[int, int, int, float, str]] = []
        open_: list[tuple[int, int, int, float, str]] = []
        for span in sorted(out, key=lambda x: (*x[:2], -x[2], -x[3], x[4])):
            open_ = [x for x in open_ if -x[1] > span[0]]
            if not any(-x[1] >= -span[1] and x[2] >= span[2] and x[3] > span[3] for x in open_):
                kept.append(span)
            open_.append(span)
        return sorted((label, first, -end, cover) for first, end, _, cover, label in kept)

    def scan(self, text: str | None) -> dict:
        words = split_words(text)
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        places, spans = self.places(ids), self.spans(ids) if len(ids) else []
        base = {label for _, label in places}
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": places[0][0] if places else None,
            "last_word": places[-1][0] if places else None,
            "base_labels": sorted(base),
            "labels": sorted(base | {s[0] for s in spans}),
            "score": float(min(1.0, max([s[3] for s in spans], default=0.0))),
            "spans": [{"label": s[0], "first": s[1], "end": s[2], "cover": float(s[3])} for s in spans],
        }


@cache
def default_scanner() -> Scanner:
    return Scanner()


SHAPE = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
    "spans array<struct<label: string, first: long, end: long, cover: double>>"
)


def scan(spark: SparkSession, text: Column) -> Column:
    """struct of n_words, n_base, first_word, last_word, base_labels, labels, score and spans (in words, end exclusive)."""
    bounded_batches(spark)

    @F.pandas_udf(SHAPE)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = default_scanner()
        for texts in batches:
            yield pd.DataFrame.from_records([scanner.scan(t) for t in texts], columns=[c.split()[0] for c in SHAPE.split("spans")[0].rstrip(", ").split(", ")] + ["spans"]).astype({"first_word": "Int64", "last_word": "Int64"})

    return found.asNondeterministic()(text)
