"""Small document tables and plain-Python versions of the contracts."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Null and empty texts, ties, repeated rows and ids, one very long text, odd characters.
TRICKY = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (4, "one two"), (None, "no id here at all my friend"), (5, "naïve café ﬁn 日本語 😀 " * 3),
    (6, "lorem ipsum dolor sit amet " * 4000), (7, "lorem ipsum dolor sit amet " * 4000), (8, "a" * 5000), (9, "tab\tnew\nline\x0bvt\x0cff\rcr \x1c\x85 end"),
    (10, "▁▁ marks ▁ and  double  spaces "), (11, "<|endoftext|> <s> </s> <unk> 's 'll don't"),
]


def frame(spark, rows=TRICKY, **more):
    made = [(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def low(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(low(text or ""))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def linked(a: frozenset, b: frozenset) -> bool:
    i = len(a & b)
    return i > 0 and 100 * i >= 80 * (len(a) + len(b) - i)


def components(texts: list[str | None]) -> list[int]:
    """Index of the first text of each text's component."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]


def quality(text: str | None) -> tuple[int, ...]:
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)
