"""License scans: exact set-similarity join of text blocks with license templates, by containment.

Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII. Blocks are windows of BLOCK words, half
overlapping, so that any run of BLOCK / 2 words lies inside one. A template of m distinct words matches a block that holds at
least ceil(CONTAINED * m) of them. Words are ordered by document frequency over all documents, rarest first: a matching
block shares one of the template's first m - need + 1 words (prefix filter), has at least need template words (length
filter), and enough words must remain after the first shared one on both sides (positional filter). Survivors are counted
exactly. The templates are a fixed list, so the index over them has a fixed size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Templates of the method's own labels: the usual notices of common licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("agpl-3.0", "GNU Affero General Public License, version 3"),
    ("apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("bsd", "Released under the BSD License"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("cc-by", "CC BY 4.0"),
    ("cc-by", "Creative Commons Attribution License"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial License"),
    ("cc-by-nc-nd", "CC BY-NC-ND 4.0"),
    ("cc-by-nc-nd", "Creative Commons Attribution-NonCommercial-NoDerivatives License"),
    ("cc-by-nc-sa", "CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa", "Creative Commons Attribution-NonCommercial-ShareAlike License"),
    ("cc-by-nd", "CC BY-ND 4.0"),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives License"),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "GNU Lesser General Public License, version 3"),
    ("mpl-1.1", "Mozilla Public License, Version 1.1"),
    ("mpl-2.0", "Mozilla Public License, Version 2.0"),
)
CONTAINED, BLOCK = 0.8, 64
_NC, _SA, _ND = "nc|noncommercial|non commercial", "sa|sharealike|share alike", "nd|noderivatives|noderivs|no derivatives|no derivs"
_V2, _V3 = "version 2|v2|license 2|or 2|gplv2", "version 3|v3|license 3|or 3|gplv3"
#: By label: what a notice's span must hold (one phrase of each entry), and phrases that make it a sibling's.
MUST = {
    "agpl-3.0": ("affero", _V3),
    "apache-1.1": ("apache", "1 1"),
    "apache-2.0": ("apache", "2|v2"),
    "bsd": ("bsd|redistribution",),
    "bsl-1.0": ("organization",),
    "cc-by": ("by|attribution",),
    "cc-by-nc": (_NC,),
    "cc-by-nc-nd": (_NC, _ND),
    "cc-by-nc-sa": (_NC, _SA),
    "cc-by-nd": (_ND,),
    "cc-by-sa": (_SA,),
    "gpl-2.0": (_V2,),
    "gpl-3.0": (_V3,),
    "lgpl-2.1": ("lesser", "2 1"),
    "lgpl-3.0": ("lesser", _V3),
    "mit": ("mit|permission",),
    "mpl-1.1": ("mozilla", "1 1"),
    "mpl-2.0": ("mozilla", "2|v2"),
}
BARRED = {
    "bsl-1.0": ("associated",),
    "cc-by": (_NC, _SA, _ND),
    "cc-by-nc": (_SA, _ND),
    "cc-by-nc-nd": (_SA,),
    "cc-by-nc-sa": (_ND,),
    "cc-by-nd": (_NC, _SA),
    "cc-by-sa": (_NC, _ND),
    "gpl-2.0": ("lesser", "affero", "library"),
    "gpl-3.0": ("lesser", "affero", "library"),
    "mit": ("organization",),
}
#: A span neither starts with the first of these after a barred word nor ends with the others before one: the name goes on.
_GOES_BACK = b"general"
_GOES_ON = frozenset(b"by nc nd sa attribution noncommercial commercial sharealike alike noderivatives noderivs derivatives derivs".split())
#: Words before a block that are looked at too.
LEAD = 2

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _need(m: int) -> int:
    return -(-int(CONTAINED * 1000) * m // 1000)


def token_frequencies(docs: DataFrame, text: str) -> dict[bytes, int]:
    """Documents that hold each template word; one row a template word."""
    vocabulary = frozenset(w for _, t in TEMPLATES for w in words(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()
        for batch in batches:
            for t in batch.column(0):
                n.update(vocabulary.intersection(words(t.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


def _phrases(said: tuple[str, ...]) -> list[list[list[bytes]]]:
    """Per entry its phrases, each a list of words."""
    return [[p.encode().split() for p in x.split("|")] for x in said]


def _starts(ws: list[bytes], phrases: list[list[bytes]]) -> list[tuple[int, int]]:
    """First and last word of every place of the phrases in ws."""
    return [(i, i + len(p) - 1) for p in phrases for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]


class Notice:
    """The check of a candidate block: the tight span of one template."""

    def __init__(self, label: str, text: str):
        ws = words(text)
        self.own, self.width = frozenset(ws), len(ws) + max(4, len(ws) // 4)
        self.need = _need(len(self.own))
        self.must, self.barred = _phrases(MUST.get(label, ())), [p for x in _phrases(BARRED.get(label, ())) for p in x]

    def share(self, block: list[bytes]) -> float:
        """The best containment of a span that is a notice of this template, 0 without one."""
        places = [_starts(block, phrases) for phrases in self.must]
        if not all(places):
            return 0.0
        barred = _starts(block, self.barred)
        best = 0
        for s in range(len(block)):
            if block[s] == _GOES_BACK and any(b == s - 1 for _, b in barred):
                continue
            # a longer span from s holds no fewer words, so the longest one before a barred phrase decides
            end = min([s + self.width, len(block)])
            first = min((a for a, _ in barred if a >= s), default=end + 1)
            if first <= end:
                end = first - (first > s and block[first - 1] in _GOES_ON)
            held = len(self.own.intersection(block[s:end]))
            if held >= self.need and held > best and all(any(s <= a and b < end for a, b in p) for p in places):
                best = held
        return best / len(self.own)


class TemplateIndex:
    """Inverted index over the templates' prefixes in global frequency order."""

    def __init__(self, frequency: dict[bytes, int]):
        tokens = {w for _, t in TEMPLATES for w in words(t)}
        self.rank = {w: k for k, w in enumerate(sorted(tokens, key=lambda w: (frequency.get(w, 0), w)))}
        self.sets, self.prefix = [], {}
        for k, (_, t) in enumerate(TEMPLATES):
            ranks = sorted({self.rank[w] for w in words(t)})
            self.sets.append(ranks)
            for i, r in enumerate(ranks[: len(ranks) - _need(len(ranks)) + 1]):
                self.prefix.setdefault(r, []).append((k, i))
        names = {r: w for w, r in self.rank.items()}
        self.triggers = frozenset(names[r] for r in self.prefix)

    def matches(self, text_words: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """Template, first word of the block, containment, for every matching block."""
        hits = self.triggers.intersection(text_words)
        if not hits:
            return
        places = [i for i, w in enumerate(text_words) if w in hits]
        half, n = BLOCK // 2, len(text_words)
        starts = sorted({s for i in places for s in (i // half * half, i // half * half - half) if s >= 0})
        for s in starts:
            if s and s + half >= n:
                continue  # the window before reaches the end
            block = sorted({self.rank[w] for w in text_words[s : s + BLOCK] if w in self.rank})
            seen = set()
            for j, r in enumerate(block):
                for k, i in self.prefix.get(r, ()):
                    m = len(self.sets[k])
                    need = _need(m)
                    if k in seen:
                        continue
                    seen.add(k)  # the first shared word decides: later ones leave less
                    if len(block) < need or 1 + min(m - i - 1, len(block) - j - 1) < need:
                        continue
                    share = len(set(block).intersection(self.sets[k]))
                    if share >= need:
                        yield k, s, share / m


def _places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Numbers of the words at which phrase stands; blanks are counted from the place before on."""
    at, start, blanks = joined.find(phrase), 0, 0
    while at >= 0:
        blanks += joined.count(b" ", start, at + 1)
        yield blanks - 1
        start = at + 1
        at = joined.find(phrase, start)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (template, word, containment).

    n_base counts the places of PHRASES, first_word and last_word are their smallest and largest start (null without
    any). score is the best containment of a notice's span, 1 with a phrase, else 0. A null text is empty; null or
    repeated keys pass through row by row; only key and text are read, so other columns never clash.
    """
    index = TemplateIndex(token_frequencies(docs, text))
    notices = [Notice(*t) for t in TEMPLATES]
    phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES]
    kind = docs.schema[key].dataType.simpleString()
    found = pa.list_(pa.struct([("template", pa.string()), ("word", pa.int64()), ("containment", pa.float64())]))

    def row(t: str) -> tuple:
        ws = words(t)
        joined = b" " + b" ".join(ws) + b" "
        starts, base = [], set()
        for phrase, label in phrases:
            if phrase in joined:
                starts += _places(joined, phrase)
                base.add(label)
        near = [(TEMPLATES[k][0], s, c) for k, s, _ in index.matches(ws) if (c := notices[k].share(ws[max(0, s - LEAD) : s + BLOCK]))]
        labels = base | {x[0] for x in near}
        score = 1.0 if base else max((x[2] for x in near), default=0.0)
        return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"template": a, "word": b, "containment": c} for a, b, c in near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*[row(t.as_py() or "") for t in batch.column(1)], strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), found]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [key, *names])

    schema = f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<template: string, word: long, containment: double>>"
    return docs.select(key, text).mapInArrow(run, schema)
