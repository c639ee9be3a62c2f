"""License scan by template-markup matching.

A template is wording with marked regions: <<beginOptional>> ... <<endOptional>> may be left out,
<<var;name=x;max=n>> stands for at most n words of any kind, and <<var;name=x;match=a b|c>> for one of the wordings named. `Automaton` compiles one into a token automaton;
a run of words is accepted if all mandatory wording stands there exactly, in order. A text carries a label if
some run of its words is accepted. Base phrases are reported beside the templates.

Words are [0-9a-z] and everything outside ASCII, after lower-casing A-Z, in whole texts. Null and empty texts have
no words, no labels and score 0; rows are independent, so repeated rows stay; other columns are not looked at."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbuf

# Phrases that count as a mention, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to
the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the
<<var;name=holders;max=12>> be liable for any claim damages or other liability whether in an action of contract tort or
otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright
notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must
reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or
other materials provided with the distribution"""
_BSD_THIRD = """<<beginOptional>>3<<endOptional>> neither the name of <<var;name=organization;max=16>> nor the names of
<<beginOptional>>its<<endOptional>> <<var;name=contributors;max=6>> may be used to endorse or promote products derived from this software
without specific prior written permission"""
_GPL_NOTICE = """is free software you can redistribute it and or modify it under the terms of the gnu {kind}
general public license as published by the free software foundation either version {version} of the license or at your
option any later version"""

_CC_NOTICE = """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>>
<<var;name=license;match=cc {code}|creative commons {name}>> <<beginOptional>>license<<endOptional>> <<beginOptional>>version<<endOptional>> {version}"""
_VERBATIM = "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"

# Label, weight in the score, template.
TEMPLATES = {
    "mit-text": (1.0, """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights
to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom
the software is furnished to do so subject to the following conditions the above copyright notice and this permission
notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the
software """ + _WARRANTY),
    "bsd-2-clause-text": (1.0, _BSD_HEAD + " <<beginOptional>>3<<endOptional>> this software is provided by <<var;name=holder;max=16>> as is"),
    "bsd-3-clause-text": (1.0, _BSD_HEAD + " " + _BSD_THIRD + " this software is provided by <<var;name=holder;max=16>> as is"),
    "isc-text": (1.0, """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies"""),
    "unlicense-text": (1.0, "this is free and unencumbered software released into the public domain"),
    "apache-2.0-notice": (0.9, """licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>>"""),
    "mit-notice": (0.9, """<<beginOptional>>this <<var;name=work;max=3>> is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> mit license"""),
    "mit-notice-licensed": (0.9, """licensed under the <<beginOptional>>terms of the<<endOptional>> mit license"""),
    "gpl-2.0-notice": (0.9, _GPL_NOTICE.format(kind="", version="2")),
    "gpl-3.0-notice": (0.9, _GPL_NOTICE.format(kind="", version="3")),
    "agpl-3.0-notice": (0.9, _GPL_NOTICE.format(kind="affero", version="3")),
    "lgpl-notice": (0.9, _GPL_NOTICE.format(kind="<<var;name=kind;match=lesser|library>>", version="<<var;name=version;max=2>>")),
    "gpl-3.0-short": (0.9, """licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>gpl<<endOptional>> version 3"""),
    "gpl-2.0-short": (0.9, """licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>gpl<<endOptional>> version 2"""),
    **{
        f"cc-{code.replace(' ', '-')}-{version.replace(' ', '.')}-notice": (0.9, _CC_NOTICE.format(code=code, name=name, version=version))
        for version in ("3 0", "4 0")
        for code, name in (
            ("by", "attribution"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by nc", "attribution noncommercial"),
            ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"),
        )
    },
    "mpl-2.0-notice": (0.9, "subject to the terms of the mozilla public license v 2 0"),
    # Headings that stand above the full texts; the texts themselves are not stated here.
    "apache-2.0-heading": (1.0, "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution 1 definitions"),
    "gpl-2.0-heading": (1.0, "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc <<var;name=address;max=16>> " + _VERBATIM),
    "gpl-3.0-heading": (1.0, "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc <<var;name=address;max=6>> " + _VERBATIM),
    "lgpl-2.1-heading": (1.0, "gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation inc <<var;name=address;max=16>> " + _VERBATIM),
    "lgpl-3.0-heading": (1.0, "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc <<var;name=address;max=6>> " + _VERBATIM),
    "agpl-3.0-heading": (1.0, "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc <<var;name=address;max=6>> " + _VERBATIM),
    "mpl-2.0-heading": (1.0, "mozilla public license version 2 0 <<var;name=rule;max=1>> 1 definitions"),
}
MENTION = 0.5


class Node:
    """One part of a template: a word, an optional run of parts, one of several wordings, or a run of any words."""

    def __init__(self, word: str = "", optional: list | None = None, most: int = 0, oneof: list[list[str]] | None = None):
        self.word, self.optional, self.most, self.oneof = word, optional, most, oneof


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def parse(markup: str) -> list[Node]:
    stack: list[list[Node]] = [[]]
    for mark, text in re.findall(r"<<(.*?)>>|([^<]+)", markup):
        if mark == "beginOptional":
            stack.append([])
        elif mark == "endOptional":
            inner = stack.pop()
            stack[-1].append(Node(optional=inner))
        elif mark:
            kind, *rest = mark.split(";")
            if kind != "var":
                raise ValueError(f"unknown markup {mark}")
            own = dict(x.split("=", 1) for x in rest)
            stack[-1].append(Node(oneof=[_words(x) for x in own["match"].split("|")]) if "match" in own else Node(most=int(own.get("max", 8))))
        else:
            stack[-1] += [Node(word=w) for w in _words(text)]
    if len(stack) > 1:
        raise ValueError("an optional region has no end")
    return stack[0]


def regex(nodes: list[Node]) -> str:
    """The same language as a regular expression over words that each end in a space."""

    def one(n: Node) -> str:
        if n.word:
            return f"{n.word} "
        if n.oneof is not None:
            return "(?:" + "|".join("".join(f"{w} " for w in ws) for ws in n.oneof) + ")"
        return f"(?:{regex(n.optional)})?" if n.optional is not None else f"(?:[^ ]+ ){{0,{n.most}}}"

    return "".join(map(one, nodes))


class Automaton:
    """States are numbers; `arcs[s]` has word (None: any) and next state; `free[s]` are moves without a word."""

    def __init__(self, markup: str):
        nodes = parse(markup)
        self.arcs: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.final = self._build(nodes, 0)
        self.closed = [self._close(s) for s in range(len(self.arcs))]
        self.first = {w for s in self.closed[0] for w, _ in self.arcs[s]}
        runs, run = [], []
        for n in [*nodes, Node(most=1)]:
            if n.word:
                run.append(n.word)
            else:
                runs.append(run)
                run = []
        #: The longest mandatory run of words: a text without it is not looked at further.
        self.anchor = f" {' '.join(max(runs, key=lambda r: len(' '.join(r))))} ".encode()

    def _state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _build(self, nodes: list[Node], at: int) -> int:
        for n in nodes:
            if n.word:
                to = self._state()
                self.arcs[at].append((n.word.encode(), to))
            elif n.optional is not None:
                end = self._build(n.optional, at_inner := self._state())
                self.free[at].append(at_inner)
                to = self._state()
                self.free[end].append(to)
                self.free[at].append(to)
            elif n.oneof is not None:
                to = self._state()
                for wording in n.oneof:
                    step = at
                    for word in wording:
                        nxt = self._state()
                        self.arcs[step].append((word.encode(), nxt))
                        step = nxt
                    self.free[step].append(to)
            else:
                to = self._state()
                self.free[at].append(to)
                for _ in range(n.most):
                    step = self._state()
                    self.arcs[at].append((None, step))
                    self.free[step].append(to)
                    at = step
            at = to
        return at

    def _close(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def accepts_at(self, words: list[bytes], at: int) -> bool:
        now = self.closed[0]
        while self.final not in now:
            if not now or at >= len(words):
                return False
            word, nxt = words[at], set()
            for s in now:
                for w, to in self.arcs[s]:
                    if w is None or w == word:
                        nxt |= self.closed[to]
            now, at = nxt, at + 1
        return True

    def found(self, joined: bytes, words: list[bytes]) -> bool:
        if self.anchor not in joined:
            return False
        anyword = None in self.first
        return any(self.accepts_at(words, i) for i, w in enumerate(words) if anyword or w in self.first)


_FOLD = bytes(0x20 if textbuf.NONWORD[textbuf.LOWER[b]] else int(textbuf.LOWER[b]) for b in range(256))


def scan(docs: DataFrame, templates: dict[str, tuple[float, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [(label, weight, Automaton(markup)) for label, (weight, markup) in templates.items()]
        phrases = [(f" {p} ".encode(), label) for p, label in base.items()]
        for batch in batches:
            data, offsets = textbuf.buffer(batch.column(1))
            cols: list[list] = [[] for _ in range(7)]
            for i in range(len(batch)):
                words = data[offsets[i] : offsets[i + 1]].tobytes().translate(_FOLD).split()
                joined = b" " + b" ".join(words) + b" " if words else b""
                places, named, score = [], set(), 0.0
                for phrase, label in phrases:
                    at, seen, word = joined.find(phrase), 0, 0
                    while at >= 0:
                        word, seen = word + joined.count(b" ", seen, at), at
                        places.append(word)
                        named.add(label)
                        at = joined.find(phrase, at + 1)
                labels = set(named)
                if named:
                    score = MENTION
                for label, weight, automaton in automata:
                    if automaton.found(joined, words):
                        labels.add(label)
                        score = max(score, weight)
                for col, value in zip(cols, (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(named)), ",".join(sorted(labels)), score)):
                    col.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [x.split()[0] for x in schema.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def oracle_sql(templates: dict[str, tuple[float, str]] = TEMPLATES, base: dict[str, str] = BASE) -> str:
    """DuckDB SQL for the same rows: templates as regular expressions over the joined words."""
    place = " UNION ALL ".join(f"SELECT doc_id, rid, i AS pos, '{label}' AS label FROM w, unnest(range(len(ws))) AS u(i) WHERE ws[i + 1:i + {len(p.split())}] = {p.split()!r}" for p, label in base.items())
    hit = " UNION ALL ".join(f"SELECT rid, '{label}' AS label, {weight}::DOUBLE AS weight FROM w WHERE regexp_matches(joined, '(?:^| ){regex(parse(markup))}')" for label, (weight, markup) in templates.items())
    return f"""WITH w AS MATERIALIZED (SELECT doc_id, rid, ws, CASE WHEN len(ws) > 0 THEN ' ' || array_to_string(ws, ' ') || ' ' ELSE '' END AS joined FROM (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents)),
p AS ({place}),
b AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS named FROM p GROUP BY rid),
h AS ({hit}),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM (SELECT * FROM h UNION ALL SELECT rid, label, {MENTION}::DOUBLE FROM p) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(named, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""
