"""Licence scan by a positional index of rare words.

Templates are notices, short stretches in common use, and passages: whole licence texts cut into runs of ``PASSAGE``
words, so that a name filled in between two of them moves neither. They are indexed by word: every word of a template has
postings (template, position). A word's weight is its inverse document frequency among all templates. A template's anchors
are its heaviest words, as many as outweigh what a match may lack, so every match has an anchor in its place. A file is
reduced to its words; those that are anchors are looked up, heaviest first, and every posting votes for the place where
the template would start. A place that gathers all the anchors' weight but what a match may lack is verified: the aligned
words must agree on ``coverage`` of the template's weight. A notice also needs one of its mandatory phrases inside the
aligned stretch, word for word; a licence text needs passages that make up ``coverage`` of its weight, and one of its
mandatory phrases between the first of them and the last. No match is lost to the index: a scan of all templates at all
places finds the same. The base phrases are found on their own, wherever their words stand consecutively.

Cases: a null or empty text has no words, no places and score 0; repeated rows and ids give a row each; texts are read
whole, whatever their length; equal scores keep every label; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import map_texts, text_or_empty

#: Phrase and label of the base.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


#: Words of a passage of a licence text.
PASSAGE = 24


@dataclass(frozen=True)
class Template:
    """A notice as it usually stands in files, or a whole licence text, and phrases of which one must be there word for word."""

    label: str
    text: str
    mandatory: tuple[str, ...]
    whole: bool = False


#: Short notices in common use, by label.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl", "licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    Template("bsd", "Licensed under the BSD License", ("bsd license",)),
    Template("mpl", "subject to the terms of the Mozilla Public License", ("mozilla public license",)),
    Template("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nc", "under the Creative Commons Attribution NonCommercial license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
)


#: Whole licence texts by the name of their file: label and mandatory phrases.
WHOLE = {
    "Apache-2.0": ("apache", ("apache license version 2 0",)),
    "Artistic": ("artistic", ("the artistic license", "the copyright holder maintains some semblance of artistic control")),
    "BSD-2-Clause": ("bsd", ("redistribution and use in source and binary forms",)),
    "BSD-3-Clause": ("bsd", ("redistribution and use in source and binary forms",)),
    "BSL-1.0": ("boost", ("any person or organization obtaining a copy",)),
    "CC0-1.0": ("cc0", ("cc0 1 0 universal", "a work made available under cc0")),
    "GPL-2": ("gpl", ("gnu general public license",)),
    "GPL-3": ("gpl", ("gnu general public license",)),
    "ISC": ("isc", ("for any purpose with or without fee is hereby granted",)),
    "LGPL-2.1": ("lgpl", ("gnu lesser general public license",)),
    "LGPL-3": ("lgpl", ("gnu lesser general public license",)),
    "MIT": ("mit", ("permission is hereby granted free of charge",)),
    "MPL-2.0": ("mpl", ("mozilla public license", "this source code form is subject to the terms")),
    "Unlicense": ("unlicense", ("free and unencumbered software",)),
    "Zlib": ("zlib", ("the origin of this software must not be misrepresented",)),
}


@lru_cache(maxsize=1)
def whole_texts() -> tuple[Template, ...]:
    """The licence texts that come with the package, read on the driver."""
    folder = Path(__file__).parent / "license_texts"
    return tuple(Template(label, (folder / f"{name}.txt").read_text(), mandatory, True) for name, (label, mandatory) in sorted(WHOLE.items()))


#: Every byte that isn't in a word becomes a space, A to Z become small.
_FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def cut(words: list[bytes], size: int = PASSAGE) -> list[list[bytes]]:
    """Runs of ``size`` words; a rest of less than half a run belongs to the one before it."""
    out = [words[i : i + size] for i in range(0, len(words), size)]
    if len(out) > 1 and 2 * len(out[-1]) < size:
        out[-2:] = [out[-2] + out[-1]]
    return out


class LicenseIndex:
    def __init__(self, templates: tuple[Template, ...], base=BASE, coverage: float = 0.8):
        self.base = [(p.encode().split(), label) for p, label in base]
        self.templates, self.coverage = templates, coverage
        self.mandatory = [[words_of(m.encode()) for m in t.mandatory] for t in templates]
        #: (template, words) of every notice and passage.
        self.rows = [(n, ws) for n, t in enumerate(templates) for ws in (cut(words_of(t.text.encode())) if t.whole else [words_of(t.text.encode())])]
        used = Counter(w for _, ws in self.rows for w in set(ws))
        self.idf = {w: math.log(1 + len(self.rows) / n) for w, n in used.items()}
        self.total = [sum(self.idf[w] for w in ws) for _, ws in self.rows]
        self.text_weight: dict[int, float] = defaultdict(float)
        postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for k, (n, ws) in enumerate(self.rows):
            self.text_weight[n] += self.total[k]
            lack, anchored = (1 - coverage) * self.total[k] + 1e-9, 0.0
            for w in sorted(set(ws), key=lambda w: (-self.idf[w], w)):
                if anchored > lack:
                    break
                places = [i for i, x in enumerate(ws) if x == w]
                postings[w] += [(k, i) for i in places]
                anchored += self.idf[w] * len(places)
            self.needed.append(anchored - lack)
        self.postings = dict(postings)
        self.watched = frozenset(self.postings) | {p[-1] for p, _ in self.base}

    def agreed(self, k: int, start: int, words: list[bytes]) -> float:
        """The share of a row's weight that stands in the file if the row starts there."""
        ws = self.rows[k][1]
        low = max(0, -start)
        met = sum(self.idf[w] for w, x in zip(ws[low:], words[start + low : start + len(ws)], strict=False) if w == x) if start + len(ws) > 0 else 0.0
        return met / self.total[k]

    def settle(self, matches: list[tuple[int, int, float]], words: list[bytes]) -> list[tuple[str, int, float]]:
        """Notices and licence texts, as (label, first word, share), from verified rows (row, start, share)."""
        found, passages = [], defaultdict(list)
        for k, start, share in matches:
            n, ws = self.rows[k]
            if self.templates[n].whole:
                passages[n].append((k, start, share))
            elif any(_holds(words[max(0, start) : max(0, start + len(ws))], m) for m in self.mandatory[n]):
                found.append((self.templates[n].label, start, share))
        for n, those in passages.items():
            best: dict[int, float] = {}
            for k, _, share in those:
                best[k] = max(share, best.get(k, 0.0))
            share = sum(self.total[k] * s for k, s in best.items()) / self.text_weight[n]
            first, last = min(s for _, s, _ in those), max(s + len(self.rows[k][1]) for k, s, _ in those)
            if share >= self.coverage and any(_holds(words[max(0, first) : last], m) for m in self.mandatory[n]):
                found.append((self.templates[n].label, first, share))
        return sorted(found)

    def matches(self, at: dict[bytes, list[int]], words: list[bytes]) -> list[tuple[int, int, float]]:
        """Verified rows, by the votes of anchors."""
        votes: dict[tuple[int, int], float] = defaultdict(float)
        for w in sorted((w for w in at if w in self.postings), key=lambda w: (-self.idf[w], w)):
            weight, held = self.idf[w], self.postings[w]
            for p in at[w]:
                for k, q in held:
                    votes[k, p - q] += weight
        near = ((k, start, self.agreed(k, start, words)) for (k, start), weight in votes.items() if weight >= self.needed[k])
        return [m for m in near if m[2] >= self.coverage]

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, float]]]:
        words = words_of(text)
        if self.watched.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0, []
        places: list[tuple[int, str]] = []
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.watched:
                at[w].append(i)
        for phrase, label in self.base:
            for end in at.get(phrase[-1], ()):
                start = end - len(phrase) + 1
                if start >= 0 and words[start : end + 1] == phrase:
                    places.append((start, label))
        found = self.settle(self.matches(at, words), words)
        base_labels = sorted({label for _, label in places})
        labels = sorted({*base_labels, *(label for label, _, _ in found)})
        score = max([0.5 if places else 0.0, *(share for _, _, share in found)])
        starts = [s for s, _ in places]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), min(1.0, score), found


@lru_cache(maxsize=4)
def _index(templates, base, coverage: float) -> LicenseIndex:
    return LicenseIndex(templates, base, coverage)


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,word:bigint,share:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] | None = None, base=BASE, coverage: float = 0.8) -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices); notices are the verified
    templates with the word where each starts and its share of agreeing weight. Without ``templates``, all notices and
    licence texts of the package."""
    templates = (*TEMPLATES, *whole_texts()) if templates is None else templates
    notice = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = [re.split(r"\s", x.strip())[0] for x in _SCHEMA.split(", ")]

    def worker(texts: list[bytes]):
        index = _index(templates, base, coverage)
        rows = [index.scan(t) for t in texts]
        made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        made.append(pa.array([[{"label": a, "word": b, "share": c} for a, b, c in r[7]] for r in rows], notice))
        return list(zip(names, made, strict=True))

    return map_texts(docs, text_or_empty(text_col).cast("binary"), {id_col: F.col(f"`{id_col}`")}, worker, _SCHEMA, "licenses")
