"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built. A text is parsed against it from left to right into
phrases, each the longest match that the labelled text has at that place (a symbol that the labelled text lacks is a
phrase of its own). A phrase costs as many bits as a place in the labelled text needs, log2 of its length; the language
that needs fewest bits wins, ties going to the name that sorts first.

Texts are put in normal form C and reduced to small letters and one separator between runs of them; every letter of the
labelled texts is a symbol, letters that none of them has share one. Transitions of all automata are the entries of one
hash table by (state, symbol), so that a table takes memory by the number of transitions, not by states times letters.
Parsing never looks back beyond a phrase, so texts are cut into blocks of ``BLOCK`` symbols, and all blocks and languages go
one symbol at a time in arrays, as if a phrase opened at each block's start. The parse that enters a block is then followed
until it opens a phrase where the block's own parse opens one; from there on both are the same. So the blocks leave no
trace: a text costs what one parse from its first symbol to its last does.

Labelled text is a bounded sample of whole texts: per language one text for each of ``PASSAGES`` buckets of the texts'
hashes (copies of a text share a bucket), that of the smallest hash among the bucket's texts of at most ``LONGEST`` code
points, or its shortest text, should all be longer.

Cases: a null text, or one without a letter, is ``und`` with score 0; where nothing is labelled, everything is; rows with
a null label or text teach nothing; repeated rows and ids give a row each; texts are parsed whole; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import caches, map_texts, text_or_empty

PASSAGES, LONGEST = 32, 3000
#: Symbols of a block; blocks times languages that are parsed at once.
BLOCK, LANES = 1024, 16384
UNKNOWN = "und"
Sample = tuple[tuple[str, tuple[str, ...]], ...]


def normal(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


class SuffixAutomaton:
    """Minimal automaton of all substrings of a sequence."""

    def __init__(self, text: list[int] | str):
        self.next: list[dict] = [{}]
        link, size, last = [-1], [0], 0
        for c in text:
            cur = len(size)
            self.next.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    twin = len(size)
                    self.next.append(dict(self.next[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur

    def match(self, text, start: int) -> int:
        """Length of the longest substring that starts at ``start`` of the text."""
        state, at = 0, start
        while at < len(text) and (state := self.next[state].get(text[at], -1)) >= 0:
            at += 1
        return at - start

    def phrases(self, text) -> int:
        at = n = 0
        while at < len(text):
            at += max(1, self.match(text, at))
            n += 1
        return n


class Alphabet:
    """Code points to symbols: 0 separates, letters of the labelled texts have their own, all other letters share the last."""

    def __init__(self, texts: Iterable[str]):
        self.letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        self.size = len(self.letters) + 2
        own = {c: i + 1 for i, c in enumerate(self.letters)}
        self.table = np.zeros(0x110000, np.int32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                self.table[code] = own.get(c.lower(), self.size - 1)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, and where each starts (with the end); runs of separators become one."""
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), "<u4")
        ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
        raw = self.table[codes]
        keep = raw != 0
        keep[1:] |= raw[:-1] != 0
        return raw[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


class Transitions:
    """(state, symbol) to state, for many automata at once: a hash table with open places, a quarter full at most."""

    def __init__(self, keys: np.ndarray, to: np.ndarray):
        self.shift = 64 - max(4, int(4 * len(keys) - 1).bit_length())
        self.mask = (1 << (64 - self.shift)) - 1
        if len(to) and to.max() >= 1 << 31:
            raise OverflowError("labelled texts have more states than 32 bits count")
        self.keys, self.to = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        at, left = self.places(keys), np.arange(len(keys))
        while len(left):  # all keys that find their place open settle, one a place; the others move on by one
            spot = at[left]
            open_ = self.keys[spot] == -1
            _, one = np.unique(np.where(open_, spot, -1 - np.arange(len(spot))), return_index=True)
            won = one[open_[one]]
            self.keys[spot[won]], self.to[spot[won]] = keys[left[won]], to[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left = left[rest]
            at[left] = (at[left] + 1) & self.mask
        self.flat = memoryview(self.keys), memoryview(self.to)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys lead, -1 where there is no transition."""
        at = self.places(keys)
        held = self.keys.take(at)
        out = self.to.take(at)  # an open place leads to -1
        left = np.flatnonzero(held != keys)
        left = left[held.take(left) != -1]
        while len(left):
            at[left] = (at.take(left) + 1) & self.mask
            held = self.keys.take(at.take(left))
            here = keys.take(left)
            out[left] = np.where((held == here) | (held == -1), self.to.take(at.take(left)), -1)
            left = left[(held != here) & (held != -1)]
        return out

    def one(self, key: int) -> int:
        keys, to = self.flat
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> self.shift
        while (held := keys[at]) != key:
            if held == -1:
                return -1
            at = (at + 1) & self.mask
        return to[at]


class CrossParser:
    """The automata of all languages over one table of transitions; a language's start state is its root."""

    def __init__(self, sample: Sample):
        self.names = [name for name, _ in sample]
        texts = [[normal(t) for t in ts] for _, ts in sample]
        self.alphabet = Alphabet(t for ts in texts for t in ts)
        self.width, states = self.alphabet.size, 0
        keys, to, roots, bits = [], [], [], []
        for ts in texts:
            symbols, _ = self.alphabet.symbols(ts)
            automaton = SuffixAutomaton(symbols.tolist())
            degree = np.fromiter(map(len, automaton.next), np.int64, len(automaton.next))
            n = int(degree.sum())
            symbol = np.fromiter((c for row in automaton.next for c in row), np.int64, n)
            keys.append((np.repeat(np.arange(len(degree)), degree) + states) * self.width + symbol)
            to.append(np.fromiter((q for row in automaton.next for q in row.values()), np.int64, n) + states)
            roots.append(states)
            states += len(degree)
            bits.append(np.log2(max(2, len(symbols))))
        self.roots, self.bits = np.array(roots, np.int64), np.array(bits)
        self.moves = Transitions(np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*to, np.zeros(0, np.int64)]))

    def _blocks(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a phrase opens, by (language, block, place), and the state at every block's end, of blocks parsed alone."""
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        langs, n = len(self.roots), len(first)
        roots = np.broadcast_to(self.roots[:, None], (langs, n))
        state, longest = roots.copy(), int(size[0])
        opens = np.zeros((longest, langs, n), bool)
        active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        for t in range(longest):
            m = active[t]
            now, root = state[:, :m].ravel(), roots[:, :m].ravel()
            c = np.broadcast_to(symbols[first[:m] + t], (langs, m)).ravel()
            after = self.moves.find(now * self.width + c)
            dead = np.flatnonzero(after < 0)
            new = now == root  # a phrase opens where none is open, or where the open one ends
            if len(dead):
                new[dead] = True
                after[dead] = root[dead]
                again = dead[now[dead] != root[dead]]
                if len(again):
                    there = self.moves.find(root[again] * self.width + c[again])
                    after[again] = np.where(there < 0, root[again], there)  # a symbol that the language lacks is a phrase
            state[:, :m] = after.reshape(langs, m)
            opens[t, :, :m] = new.reshape(langs, m)
        back = np.argsort(order, kind="stable")
        return np.ascontiguousarray(opens.transpose(1, 2, 0)[:, back]), state[:, back]

    def _enter(self, state: int, root: int, symbols: memoryview, opens: memoryview, total: int) -> tuple[int, int | None]:
        """Phrases that a parse in ``state`` opens in a block, and its state at the end, null where it is the block's own."""
        one, width, mine, own = self.moves.one, self.width, 0, 0
        for c, opened in zip(symbols, opens, strict=False):
            after = one(state * width + c)
            if after < 0 or state == root:
                if opened:
                    return mine + total - own, None
                mine += 1
                if after < 0 and state != root:
                    after = one(root * width + c)
            own += opened
            state = root if after < 0 else after
        return mine, state

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of every text by language, and which texts have a letter."""
        symbols, starts = self.alphabet.symbols([normal(t) for t in texts])
        lengths = np.diff(starts)
        counts = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = starts[:-1][owner] + inside * BLOCK
        size = np.minimum(BLOCK, starts[1:][owner] - first)
        langs = len(self.roots)
        phrases, state = np.zeros((langs, len(texts)), np.int64), [0] * langs
        per, view = max(1, LANES // max(1, langs)), memoryview(symbols)
        for low in range(0, len(owner), per):
            part = slice(low, low + per)
            opens, ends = self._blocks(symbols, first[part], size[part])
            total = opens.sum(2)
            head = inside[part] == 0
            np.add.at(phrases.T, owner[part][head], total[:, head].T)
            ends_at = ends.T.tolist()
            for b in range(len(head)):
                if head[b]:
                    state = ends_at[b]
                    continue
                at, j = low + b, int(owner[low + b])
                cut, after = view[first[at] : first[at] + size[at]], []
                for k in range(langs):
                    n, end = self._enter(state[k], int(self.roots[k]), cut, opens[k, b].data, int(total[k, b]))
                    phrases[k, j] += n
                    after.append(ends_at[b][k] if end is None else end)
                state = after
        letters = np.concatenate([[0], np.cumsum(symbols != 0)])
        return phrases * self.bits[:, None], letters[starts[1:]] > letters[starts[:-1]]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and the share of bits that it saves against the runner-up."""
        if not self.names:
            return [(UNKNOWN, 0.0)] * len(texts)
        bits, lettered = self.costs(texts)
        best = bits.argmin(0)
        low = np.sort(bits, 0)
        score = 1 - low[0] / np.maximum(low[1], 1e-9) if len(self.names) > 1 else np.ones(len(texts))
        return [(self.names[b], float(s)) if ok else (UNKNOWN, 0.0) for b, s, ok in zip(best, score, lettered, strict=True)]


@lru_cache(maxsize=2)
def cross_parser(sample: Sample) -> CrossParser:
    return CrossParser(sample)


caches("languages", cross_parser.cache_clear)


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", passages: int = PASSAGES, longest: int = LONGEST) -> Sample:
    """The bounded sample of every label, on the driver: at most ``passages`` whole texts a label."""
    t, label = F.col(f"`{text_col}`"), F.col(f"`{label_col}`").cast("string")
    over = F.greatest(F.lit(0), F.length(t) - longest)
    rows = labelled.where(t.isNotNull() & label.isNotNull()).select(label.alias("label"), over.alias("over"), F.xxhash64(t).alias("h"), t.alias("p"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(passages)))
    # Texts don't travel until one a bucket is chosen: at most ``passages`` rows a label.
    best = rows.groupBy("label", "bucket").agg(F.min(F.struct("over", "h")).alias("m")).select("label", "bucket", "m.h")
    picked = rows.join(F.broadcast(best), ["label", "bucket", "h"]).groupBy("label", "bucket").agg(F.min("p").alias("p")).collect()
    by: dict[str, list[tuple[int, str]]] = {}
    for r in picked:
        by.setdefault(r["label"], []).append((r["bucket"], r["p"]))
    return tuple((k, tuple(p for _, p in sorted(v))) for k, v in sorted(by.items()))


def identify(docs: DataFrame, sample: Sample, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Rows (id, kept columns, lang_pred, score)."""

    def worker(texts: list[str]):
        made = cross_parser(sample).predict(texts)
        return [("lang_pred", pa.array([a for a, _ in made], pa.string())), ("score", pa.array([b for _, b in made], pa.float64()))]

    return map_texts(docs, text_or_empty(text_col), {id_col: F.col(f"`{id_col}`"), **(keep or {})}, worker, "lang_pred string, score double", "languages")
