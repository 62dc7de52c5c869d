"""License scans with template markup.

A template is plain wording with `<<optional>> ... <<end>>` regions, which a text may leave out, and `<<any N>>`
regions, which stand for up to N words of its own. Compiled, it is an automaton over words: a step for each mandatory
word, empty steps round optional regions, loops of bounded length for replaceable ones. A text that drives it from
start to end anywhere holds the license: the mandatory wording stands there exactly. The automaton runs only near its
anchor, the longest run of mandatory words, which is found by plain search and can't be missing from a match.

Phrases of the base list are counted wherever they stand. Words are a-z, 0-9 and non-ASCII characters after
lower-casing A-Z. A null or empty text has no words, no places and score 0. Repeated rows get a row each, an empty table
none. A very long text is scanned alone, whole. Other columns are kept if asked for, whatever they are called.
A label found several times is listed once; labels are sorted by code point.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import alnum_words, map_texts

#: Phrase and label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# licences' wording, with the regions that texts leave out or fill in themselves.
_GPL = "<<optional>>This <<any 3>> is <<end>><<optional>>licensed under the <<end>><<optional>>terms of the <<end>>GNU{} General Public License<<optional>> as published by the Free Software Foundation<<end>><<optional>> either<<end>> version {}"
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this <<any 12>> to deal in the <<any 3>> without restriction"""
_MIT_TEXT = """<<optional>>The MIT License<<end>><<optional>> MIT<<end>><<optional>> Copyright <<any 25>><<end>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice<<optional>> (including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_3 = "Neither the name of <<any 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_TEXT = (
    _BSD
    + """: <<optional>>1. <<end>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<optional>>2. <<end>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY <<any 12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
)
_ISC_TEXT = """Permission to use, copy, modify, <<optional>>and <<end>><<optional>>or <<end>>distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<any 8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL <<any 8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<optional>>1. <<end>>The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an <<any 1>> in the product documentation would be appreciated but is not required.
<<optional>>2. <<end>>Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<optional>>3. <<end>>This notice may not be removed or altered from any source distribution."""
_UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.
We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<optional>> For more information, please refer to <<any 4>><<end>>"""
_BOOST_TEXT = """<<optional>>Boost Software License - Version 1.0 - August 17th, 2003 <<end>>Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part,
and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT.
IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Label and template, or several: whole licences, the one-line notices, and the wording that notices of longer licences
#: have. What the labels say beyond the base list is the version or the kind of notice; a name ending in -text is a whole licence.
TEMPLATES = {
    "gpl-3.0": _GPL.format("", "3"),
    "gpl-2.0": _GPL.format("", "2"),
    "lgpl-3.0": _GPL.format(" Lesser", "3"),
    "lgpl-2.0": _GPL.format(" Library", "2"),
    "lgpl-2.1": _GPL.format(" Lesser", "2.1"),
    "agpl-3.0": _GPL.format(" Affero", "3"),
    "apache-2.0": ("licensed under the Apache License<<optional>> Version<<end>> 2.0", "Apache License Version 2.0 January 2004"),
    "cc-by-nc-4.0": ("licensed under <<optional>>a <<end>><<optional>>the <<end>>CC BY NC 4.0<<optional>> license<<end>>", "Creative Commons Attribution NonCommercial 4.0 International<<optional>> Public<<end>> License"),
    "cc-by-4.0": ("licensed under <<optional>>a <<end>><<optional>>the <<end>>CC BY 4.0<<optional>> license<<end>>", "Creative Commons Attribution 4.0 International<<optional>> Public<<end>> License"),
    "cc-by-sa-4.0": ("licensed under <<optional>>a <<end>><<optional>>the <<end>>CC BY SA 4.0<<optional>> license<<end>>", "Creative Commons Attribution ShareAlike 4.0 International<<optional>> Public<<end>> License"),
    "cc0-1.0": ("has waived all copyright and related or neighboring rights to", "licensed under <<optional>>the <<end>>CC0 1.0<<optional>> Universal<<end>>", "Creative Commons<<optional>> Legal Code<<end>> CC0 1.0 Universal"),
    "mpl-2.0": ("subject to the terms of the Mozilla Public License<<optional>> v<<end>><<optional>> Version<<end>> 2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    "boost-1.0": "under the Boost Software License<<optional>> Version<<end>> 1.0",
    "mit-notice": "<<any 3>> released under the <<optional>>terms of the <<end>>MIT License",
    "mit-grant": _MIT,
    "mit-text": _MIT_TEXT,
    "bsd-grant": _BSD,
    "bsd-3-clause": _BSD_3,
    "bsd-2-clause-text": _BSD_TEXT.format(""),
    "bsd-3-clause-text": _BSD_TEXT.format("<<optional>>3. <<end>>" + _BSD_3 + ". "),
    "isc-text": _ISC_TEXT,
    "zlib-text": _ZLIB_TEXT,
    "unlicense-text": _UNLICENSE_TEXT,
    "boost-1.0-text": _BOOST_TEXT,
}


@dataclass
class Automaton:
    """States are numbers; `steps` maps a state to {word: next}, `skips` to states that no word is needed for, `loops` to the next state by any word."""

    label: str
    steps: dict[int, dict[bytes, int]] = field(default_factory=dict)
    skips: dict[int, list[int]] = field(default_factory=dict)
    loops: dict[int, int] = field(default_factory=dict)
    final: int = 0
    anchor: list[bytes] = field(default_factory=list)
    mandatory: int = 0
    before: int = 0
    longest: int = 0

    def closure(self, states: set[int]) -> set[int]:
        open_, seen = list(states), set(states)
        while open_:
            for nxt in self.skips.get(open_.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    open_.append(nxt)
        return seen

    def accepts_at(self, words: list[bytes]) -> int:
        """Length of the shortest match that starts at the first word, or 0."""
        states = self.closure({0})
        for i, word in enumerate(words):
            states = self.closure({self.steps[s][word] for s in states if word in self.steps.get(s, ())} | {self.loops[s] for s in states if s in self.loops})
            if self.final in states:
                return i + 1
            if not states:
                break
        return 0


def compile_template(label: str, markup: str) -> Automaton:
    made, state, opened, run, runs, depth_words = Automaton(label), 0, [], [], [], 0
    for part in re.split(r"(<<[^>]*>>)", markup):
        if part.startswith("<<optional"):
            opened.append(state)
        elif part.startswith("<<end"):
            made.skips.setdefault(opened.pop(), []).append(state)
        elif part.startswith("<<any"):
            begin, most = state, int(part[5:-2])
            for _ in range(most):
                made.loops[state] = state + 1
                state += 1
            for s in range(begin, state):
                made.skips.setdefault(s, []).append(state)
            depth_words += most
        else:
            for word in alnum_words(part.encode()):
                made.steps[state] = {word: state + 1}
                state += 1
                depth_words += 1
                if not opened:
                    run.append((word, depth_words - 1))
            if not opened and run:
                continue
        if run:
            runs.append(run)
            run = []
    if run:
        runs.append(run)
    best = max(runs, key=len)
    made.final, made.longest = state, depth_words
    made.anchor, made.before = [w for w, _ in best], best[0][1]
    made.mandatory = sum(map(len, runs))
    return made


class Scanner:
    """Base phrases and compiled templates, over one text's words."""

    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, str | tuple[str, ...]] = TEMPLATES):
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.automata = [compile_template(k, markup) for k, v in templates.items() for markup in ((v,) if isinstance(v, str) else v)]
        self.anchors = [b" " + b" ".join(a.anchor) + b" " for a in self.automata]

    @staticmethod
    def places(line: bytes, phrase: bytes) -> list[int]:
        """Word positions at which a phrase (with its outer spaces) starts."""
        found, at, seen, word = [], line.find(phrase), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            seen = at
            found.append(word)
            at = line.find(phrase, at + 1)
        return found

    def scan(self, text: bytes | None) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, all labels, matches (label, word, n_words), score."""
        words = alnum_words(text)
        line = b" " + b" ".join(words) + b" "
        base, starts = set(), []
        for phrase, label in self.base:
            if found := self.places(line, phrase):
                base.add(label)
                starts += found
        matches = []
        for automaton, anchor in zip(self.automata, self.anchors, strict=True):
            end = 0
            for at in self.places(line, anchor):
                for begin in range(max(end, at - automaton.before), at + 1):
                    if n := automaton.accepts_at(words[begin : begin + automaton.longest]):
                        matches.append({"label": automaton.label, "word": begin, "n_words": n})
                        end = begin + n
                        break
        score = 1.0 if matches else 0.5 if starts else 0.0
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), base, base | {m["label"] for m in matches}, matches, score


MATCHES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType()), T.StructField("n_words", T.LongType())]))
SCAN = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("matches", MATCHES), T.StructField("score", T.DoubleType())]
)


def scan_licenses(docs: DataFrame, keep: list[str], text: str = "text", base: dict[str, str] = BASE, templates: dict[str, str | tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """The `keep` columns of each document with what the scanner finds; labels are distinct, sorted and comma-joined.

    score: 1 if a template matches, one half if only a base phrase stands there, else 0.
    """
    scanner = Scanner(base, templates)

    def run(texts: list[bytes | None]) -> list:
        columns = [list(x) for x in zip(*map(scanner.scan, texts), strict=True)]
        columns[4:6] = [[",".join(sorted(x)) for x in c] for c in columns[4:6]]
        return columns

    return map_texts(docs, keep, text, SCAN, run)


def op7_license_templates(spark, sf_dir: str) -> DataFrame:
    """Phrases, labels and score of every document."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
