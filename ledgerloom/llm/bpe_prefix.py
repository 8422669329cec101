"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that can end its encoding: the one that the merges of
that prefix end with. A token t can follow the last token s of the prefix before it exactly if merging the bytes of s
and t together gives s and t again. So the table ``last[i]`` is filled from left to right: of the vocabulary's tokens
that end at byte i, the one that may follow ``last[i - len(t)]``. Reading the table backwards gives the encoding of any
prefix; appending bytes adds entries and changes none; after an edit at byte i, the entries up to i stay and those
after it are filled anew.

Texts are cut by the pattern first, as the vocabulary's library does, and every match is encoded alone. A worker keeps
the packed ids of the pre-tokens it has met, up to ``memo_size`` of them, then starts anew; that only saves time.

Cases: a null or empty text has no ids and decodes to no bytes; repeated rows and ids give a row each; long texts and
long pre-tokens are encoded whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import caches, map_texts, text_or_empty


class Vocabulary:
    """Ranks of byte strings, which pairs of tokens may stand together, and the ids' bytes."""

    def __init__(self, ranks: dict[bytes, int], pair_memo: int = 300_000):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size_of = {i: len(b) for b, i in ranks.items()}
        #: Every end of a token: the token it is itself, or -1.
        self.ends = dict.fromkeys((b[i:] for b in ranks for i in range(len(b))), -1) | ranks
        self.pairs: dict[int, bool] = {}
        self.pair_memo = pair_memo
        self.stable = {i for b, i in ranks.items() if len(b) == 1}
        self.checked = set(self.stable)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merged(self, piece: bytes) -> list[int]:
        """The plain definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def may_stand(self, token: int) -> bool:
        """Whether the merges of a token's own bytes end in the token."""
        if token not in self.checked:
            self.checked.add(token)
            if self.merged(self.bytes_of[token]) == [token]:
                self.stable.add(token)
        return token in self.stable

    def may_follow(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= self.pair_memo:
                self.pairs.clear()
            known = self.pairs[left << 32 | right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known


class PrefixEncoder:
    """The table of last tokens of one piece of text, open at its end."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = bytearray()
        self.last: list[int] = [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Extend the text; the entries there are stay."""
        self.piece += more
        v, last, piece = self.vocabulary, self.last, bytes(self.piece)
        ends, pair = v.ends.get, v.pairs.get
        for end in range(len(last), len(piece) + 1):
            start, fit = end - 1, None
            while start >= 0:
                token = ends(piece[start:end])
                if token is None:
                    break
                if token >= 0:
                    if start:
                        ok = pair(last[start] << 32 | token)
                        if ok is None:
                            ok = v.may_follow(last[start], token)
                    else:
                        ok = v.may_stand(token)
                    if ok:
                        fit = token
                        break
                start -= 1
            if fit is None:
                raise ValueError(f"no token ends {piece[:end][-16:]!r}; the vocabulary lacks single bytes")
            last.append(fit)

    def become(self, piece: bytes) -> None:
        """Turn into another text, keeping the entries of the common beginning."""
        old, same = self.piece, 0
        for a, b in zip(old, piece):  # noqa: B905  up to the shorter
            if a != b:
                break
            same += 1
        del old[same:], self.last[same + 1 :]
        self.append(piece[same:])

    def edit(self, at: int, removed: int, inserted: bytes) -> None:
        """Replace ``removed`` bytes at ``at``; only entries after ``at`` are filled anew."""
        rest = bytes(inserted) + bytes(self.piece[at + removed :])
        del self.piece[at:], self.last[at + 1 :]
        self.append(rest)

    def tokens(self, end: int | None = None) -> list[int]:
        """Ids of the first ``end`` bytes, of all if not given."""
        out, end, size = [], len(self.piece) if end is None else end, self.vocabulary.size_of
        while end:
            out.append(self.last[end])
            end -= size[out[-1]]
        return out[::-1]


class PackedPieces(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def learn(self, pieces: set[str]) -> None:
        """Add pieces; in sorted order each starts from the table of the one before."""
        ranks, table = self.vocabulary.ranks, PrefixEncoder(self.vocabulary)
        for raw, piece in sorted((p.encode(), p) for p in pieces):
            whole = ranks.get(raw)  # a piece that is itself in the ranks is that token, whatever its merges
            if whole is None:
                table.become(raw)
            self[piece] = np.array([whole] if whole is not None else table.tokens(), "<u4").tobytes()


@lru_cache(maxsize=4)
def _codec(ranks_file: str, pattern: str):
    import regex

    vocabulary = Vocabulary.from_file(ranks_file)
    return PackedPieces(vocabulary), regex.compile(pattern).findall


@lru_cache(maxsize=4)
def _bytes_of(ranks_file: str) -> dict[int, bytes]:
    with open(ranks_file, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}


def _decoded(ids: list[bytes | None], ranks_file: str) -> pa.Array:
    of = _bytes_of(ranks_file)
    return pa.array([None if x is None else b"".join(map(of.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids], pa.binary())


caches("bpe", _codec.cache_clear, _bytes_of.cache_clear)


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memo_size: int = 300_000, decoded: bool = False) -> DataFrame:
    """Rows (id, n_tokens, ids) with the ids as little-endian unsigned 32-bit integers.

    With ``decoded`` there is also what the ids decode to, made in the same pass by the same worker.
    """

    def worker(texts: list[str]):
        pieces, cut = _codec(ranks_file, pattern)
        if len(pieces) > memo_size:
            pieces.clear()
        cuts = [cut(t) for t in texts]
        pieces.learn(set().union(*cuts) - pieces.keys())
        out = [b"".join(map(pieces.__getitem__, c)) for c in cuts]
        made = [("n_tokens", pa.array([len(x) // 4 for x in out], pa.int64())), ("ids", pa.array(out, pa.binary()))]
        return [*made, ("decoded", _decoded(out, ranks_file))] if decoded else made

    return map_texts(docs, text_or_empty(text_col), {id_col: F.col(f"`{id_col}`")}, worker, "n_tokens long, ids binary" + ", decoded binary" * decoded, "bpe")


def decode(encoded: DataFrame, ranks_file: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the bytes that the ids stand for; null where the ids are null."""

    def worker(ids: list[bytes | None]):
        return [("decoded", _decoded(ids, ranks_file))]

    keep = {c: F.col(f"`{c}`") for c in encoded.columns if c != "decoded"}
    return map_texts(encoded, F.col(f"`{ids_col}`"), keep, worker, "decoded binary", "bpe")
