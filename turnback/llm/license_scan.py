"""License scans by template markup: templates with optional and replaceable regions compiled to token automata.

A template is plain wording with two kinds of markup: ``<<optional>> ... <<end>>`` encloses wording that may be
absent, ``<<var n>>`` stands for up to n arbitrary words (a holder's name, a year). Everything else is mandatory
and must match word for word. A template compiles to a nondeterministic automaton over words, which is turned
into a deterministic one state by state as texts need it; words outside the template share one symbol, so an
automaton stays small whatever the texts hold.

Row-local: one Arrow pass over the texts, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: label -> template
TEMPLATES = {
    "mit-notice": "<<optional>>this <<var 2>> is<<end>> <<optional>>free software<<end>> released under the <<optional>>terms of the<<end>> mit license",
    "apache-2.0": "licensed under the <<optional>>terms of the<<end>> apache license <<optional>>version<<end>> 2 0",
    "gpl-3.0": "<<optional>>this <<var 3>> is<<end>> licensed under the <<optional>>terms of the<<end>> gnu general public license <<optional>>version<<end>> 3",
    "cc-by-nc-4.0": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by nc 4 0",
    "apache-2.0-grant": """subject to the terms and conditions of this license each contributor hereby grants to you a perpetual
        worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of
        publicly display publicly perform sublicense and distribute the work and such derivative works in source or object
        form""",
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license <<optional>>you may obtain a copy of the license at <<var 8>><<end>> unless required by applicable law
        or agreed to in writing software distributed under the license is distributed on an as is basis without warranties
        or conditions of any kind either express or implied""",
    "mit": """<<optional>>copyright <<var 12>><<end>> permission is hereby granted free of charge to any person obtaining a copy of
        this software and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
        of the software and to permit persons to whom the software is furnished to do so subject to the following
        conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall
        be included in all copies or substantial portions of the software""",
    "isc": """<<optional>>copyright <<var 12>><<end>> permission to use copy modify and or distribute this software for any purpose
        with or without fee is hereby granted provided that the above copyright notice and this permission notice appear
        in all copies""",
    "bsd-clause": """redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met <<optional>>1<<end>> redistributions of source code must retain the above copyright
        notice this list of conditions and the following disclaimer <<optional>>2<<end>> redistributions in binary form must
        reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or
        other materials provided with the distribution <<optional>><<var 60>><<end>> this software is provided by <<var 12>> as is
        and any express or implied warranties including but not limited to the implied warranties of merchantability and
        fitness for a particular purpose are disclaimed""",
    "bsd-3-clause": """redistributions in binary form must reproduce the above copyright notice this list of conditions and the
        following disclaimer in the documentation and or other materials provided with the distribution <<optional>>3<<end>>
        neither the name of <<var 16>> nor the names of <<var 6>> contributors may be used to endorse or promote products
        derived from this software without specific prior written permission""",
    "mit-full": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
        and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or
        substantial portions of the software the software is provided as is without warranty of any kind express or implied
        including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall <<var 8>> be liable for any claim damages or other liability whether in an action of contract tort
        or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "mpl-2.0": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at <<var 6>>""",
    "gpl-2.0-or-later-header": """<<var 4>> is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version 2 of the license or at your
        option any later version""",
    "gpl-3.0-or-later-header": """<<var 4>> is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version 3 of the license or at your
        option any later version""",
    "lgpl-or-later-header": """<<var 4>> is free software you can redistribute it and or modify it under the terms of the gnu
        lesser general public license as published by the free software foundation either version <<var 2>> of the license or
        at your option any later version""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
        use compile sell or distribute this software either in source code form or as a compiled binary for any purpose
        commercial or non commercial and by any means""",
    "spdx-tag": "spdx license identifier <<var 3>>",
}
#: phrase -> base label
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text: A-Z lowered, runs of digits, letters and bytes beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """A template's automaton. ``longest(words, i)``: where its longest match from i ends (-1: there is none)."""

    def __init__(self, template: str):
        #: per state: literal edges, wildcard targets, epsilon targets
        self.edges: list[tuple[dict[bytes, int], list[int], list[int]]] = [({}, [], [])]
        at, stack = 0, []
        for part in re.findall(r"<<[^>]*>>|[^<]+", template):
            if part == "<<optional>>":
                stack.append(at)
            elif part == "<<end>>":
                self.edges[stack.pop()][2].append(at := self._new(at))
            elif part.startswith("<<var"):
                most = int(part[5:-2] or 1)
                ends = []
                for _ in range(most):
                    ends.append(at)
                    nxt = self._new()
                    self.edges[at][1].append(nxt)
                    at = nxt
                out = self._new(at)
                for e in ends:
                    self.edges[e][2].append(out)
                at = out
            else:
                for w in tokens(part.encode()):
                    nxt = self._new()
                    self.edges[at][0][w] = nxt
                    at = nxt
        if stack:
            raise ValueError("an optional region isn't closed")
        self.final = at
        self.alphabet = {w for lit, _, _ in self.edges for w in lit}
        self._start = self._closure({0})
        self._next: dict[tuple[frozenset, bytes | None], frozenset] = {}
        self.anywhere = any(self.edges[s][1] for s in self._start)  # it may begin with any word
        self.first = {w for s in self._start for w in self.edges[s][0]}

    def _new(self, frm: int | None = None) -> int:
        self.edges.append(({}, [], []))
        if frm is not None:
            self.edges[frm][2].append(len(self.edges) - 1)
        return len(self.edges) - 1

    def _closure(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.edges[todo.pop()][2]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def step(self, state: frozenset, word: bytes) -> frozenset:
        key = (state, word if word in self.alphabet else None)
        got = self._next.get(key)
        if got is None:
            to = {self.edges[s][0][word] for s in state if word in self.edges[s][0]} | {t for s in state for t in self.edges[s][1]}
            got = self._next[key] = self._closure(to)
        return got

    def longest(self, words: list[bytes], i: int) -> int:
        state, end = self._start, -1
        while state:
            if self.final in state:
                end = i
            if i == len(words):
                break
            state = self.step(state, words[i])
            i += 1
        return end


#: mandatory wording is scored in runs of at most so many words
RUN = 5


def mandatory_runs(template: str) -> list[tuple[bytes, ...]]:
    """A template's mandatory wording, in order, cut at its markup and into runs of at most ``RUN`` words."""
    plain = template
    while (less := re.sub(r"<<optional>>(?:(?!<<optional>>|<<end>>).)*<<end>>", "<<cut>>", plain, flags=re.S)) != plain:
        plain = less
    out = []
    for part in re.split(r"<<[^>]*>>", plain):
        w = tokens(part.encode())
        out += [tuple(w[i : i + RUN]) for i in range(0, len(w), RUN)]
    return out


class Scanner:
    """All templates at once: a template is tried only in texts with all its mandatory words, at its first words."""

    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[tuple[str, ...], str] | None = None):
        #: label -> automaton, mandatory words, its runs (as words and as text), how many words they have
        self.automata: dict[str, tuple[Automaton, frozenset[bytes], list[tuple[frozenset[bytes], bytes, int]], int]] = {}
        for label, source in (TEMPLATES if templates is None else templates).items():
            runs = mandatory_runs(source)
            self.automata[label] = Automaton(source), frozenset(w for r in runs for w in r), [(frozenset(r), b" %b " % b" ".join(r), len(r)) for r in runs], sum(map(len, runs))
        self.phrases = {tuple(w.encode() for w in p): label for p, label in (PHRASES if phrases is None else phrases).items()}

    def scan(self, text: bytes | None) -> tuple[int, int, int | None, int | None, set[str], set[str], float]:
        """n_words, n_base, first_word, last_word, base labels, template labels, score."""
        words = tokens(text)
        have = frozenset(words)
        n_base, first, last = 0, None, None
        base: set[str] = set()
        found: set[str] = set()
        score = 0.0
        for phrase, label in self.phrases.items():
            if have.issuperset(phrase):
                for i in places(words, phrase[0]):
                    if tuple(words[i : i + len(phrase)]) == phrase:
                        n_base += 1
                        base.add(label)
                        first = i if first is None else min(first, i)
                        last = i if last is None else max(last, i)
        whole = b" %b " % b" ".join(words)
        for label, (automaton, must, runs, total) in self.automata.items():
            if have.issuperset(must):
                starts = range(len(words)) if automaton.anywhere else (i for head in automaton.first & have for i in places(words, head))
                if any(automaton.longest(words, i) > i for i in starts):
                    found.add(label)
                    score = 1.0
                    continue
            there = sum(n for r, text_, n in runs if have.issuperset(r) and text_ in whole)
            score = max(score, min(there, total - 1) / max(1, total))
        if base and not found:
            score = max(score, 0.5)
        return len(words), n_base, first, last, base, found, score


def places(words: list[bytes], word: bytes) -> Iterator[int]:
    """All indexes of a word."""
    i = -1
    while True:
        try:
            i = words.index(word, i + 1)
        except ValueError:
            return
        yield i


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its base phrases, the templates that it matches, and a score.

    score is 1 if a template matches. Otherwise it is the largest share of a template's mandatory words that the text has
    in whole runs: the mandatory wording is cut into runs of at most ``RUN`` words, and a run counts with its words if
    they stand consecutively anywhere in the text (below 1, and at least 0.5 with a base phrase). So a full license text
    with one word changed scores the share of the untouched runs. Null and empty texts: no words, no labels, score 0.
    Repeated rows and ids: one result row each. Other columns are ignored whatever their names; an empty table gives
    an empty result. Whole texts are read; nothing is cut.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            rows = [scanner.scan(t) for t in b.column(1).to_pylist()]
            base = [",".join(sorted(r[4])) for r in rows]
            both = [",".join(sorted(r[4] | r[5])) for r in rows]
            ints = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *ints, pa.array(base, pa.string()), pa.array(both, pa.string()), pa.array([r[6] for r in rows], pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return slim.mapInArrow(run, SCHEMA)


def pattern(template: str) -> str:
    """A template as a regular expression on words that each follow a space, with a space at the end."""
    out = []
    for part in re.findall(r"<<[^>]*>>|[^<]+", template):
        if part == "<<optional>>":
            out.append("(?:")
        elif part == "<<end>>":
            out.append(")?")
        elif part.startswith("<<var"):
            out.append(f"(?: [^ ]+){{0,{int(part[5:-2] or 1)}}}")
        else:
            out += [f" {w.decode()}" for w in tokens(part.encode())]
    return "".join(out) + " "


def _oracle() -> str:
    labels = sorted({*PHRASES.values(), *TEMPLATES})
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hits = ", ".join(f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p))}) AS b{n}" for n, p in enumerate(PHRASES))
    every = " || ".join(f"b{n}" for n in range(len(PHRASES)))
    base = {label: f"len(b{n}) > 0" for n, label in enumerate(PHRASES.values())}
    tests = ", ".join(f"regexp_matches(t, '{pattern(v)}') AS m{n}" for n, v in enumerate(TEMPLATES.values()))
    method = {label: f"m{n}" for n, label in enumerate(TEMPLATES)}
    listed = lambda d: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(x[k] for x in d if k in x)} THEN '{k}' END" for k in labels if any(k in x for x in d)) + "], lambda x: x IS NOT NULL), ',')"
    shares = []
    for v in TEMPLATES.values():
        runs = mandatory_runs(v)
        total = sum(map(len, runs))
        there = " + ".join(f"CASE WHEN contains(t, ' {b' '.join(r).decode()} ') THEN {len(r)} ELSE 0 END" for r in runs)
        shares.append(f"least({there}, {total - 1})::DOUBLE / {total}::DOUBLE")
    any_base, any_method = " OR ".join(base.values()), " OR ".join(method.values())
    return f"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t, {hits} FROM a),
c AS (SELECT *, {every} AS every, {tests} FROM b)
SELECT doc_id, len(w)::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
 {listed([base])} AS base_labels, {listed([base, method])} AS labels,
 CASE WHEN {any_method} THEN 1.0::DOUBLE ELSE greatest(CASE WHEN {any_base} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, {", ".join(shares)}) END AS score FROM c
"""


ORACLE_3 = _oracle()


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
