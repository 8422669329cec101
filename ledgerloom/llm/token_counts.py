"""Token counts by distinct pre-token.

A pre-token is a run of word-boundary marks with what follows it up to the next mark. The vocabulary has no piece that
continues past such a mark (checked when the model is loaded), so no merge crosses a pre-token and the tokens of a text
are those of its pre-tokens. Three steps:

1. Frequencies: the distinct pre-tokens of each document as numbers, and how often each occurs. Numbers are places in the
   list of distinct pre-tokens of the document's block, a run of documents of one task that ends at ``BLOCK_DOCS``
   documents or ``BLOCK_WORDS`` distinct pre-tokens; a row a block, numbers as compressed steps. The block's list is
   dealt to buckets by a hash of the pre-token.
2. Pieces: the blocks' lists, dealt by bucket. All that list a pre-token meet in its bucket, where the library counts it
   once; back go the counts in the list's order, without the strings.
3. A block's counts then meet its documents' frequencies, and a document's tokens are the sum of products.

What is joined is a vocabulary a block, not the words of a corpus, and ids are never kept. A block lists a pre-token once,
so the most frequent one of the corpus is no more than one of the thousands of its block. A worker holds the distinct
pre-tokens of one bucket; there are ``BUCKETS`` times as many buckets as shuffle partitions.

Cases: a null or empty text has 0 bytes and 0 tokens; repeated rows and ids give a row each; very long texts are
counted whole (one that fills a block alone ends it); an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import SLICE, caches, enter, materialise, ready, text_or_empty

MARK = "▁"
BLOCK_DOCS, BLOCK_WORDS, BUCKETS = 16_384, 400_000, 4
#: Between the words of a list: a byte that UTF-8 never has.
_END = b"\xff"
_RUN = re.compile(r" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first mark, which the library puts before any text itself."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [m[1:] for m in _RUN.findall(" " + text)]
    return text.split(" ")


class Pieces:
    """How many pieces a pre-token has, by the library."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if any(re.search(f"[^{MARK}]{MARK}", self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())):
            raise ValueError(f"{model_file} has pieces that cross a word boundary; pre-tokens can't be counted alone")
        #: A lone mark at the end of a text is a pre-token too; the library gives nothing for empty text.
        self.lone = len(self.model.encode("x ")) - len(self.model.encode("x"))

    def count(self, words: list[str]) -> list[int]:
        return [len(ids) if w else self.lone for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True)]


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


caches("pieces", pieces.cache_clear)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32: all lowest bytes, then the next ones up, which hardly vary, compressed."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(held: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(held), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


class Block:
    """Documents in the making: their frequencies by place in one list of distinct pre-tokens."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.heads: list[pa.RecordBatch] = []
        self.words: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, text: str) -> None:
        seen, places = Counter(pre_tokens(text)), self.places
        at = np.fromiter((places.setdefault(w, len(places)) for w in seen), np.uint32, len(seen))
        n = np.fromiter(seen.values(), np.uint32, len(seen))
        order = np.argsort(at)
        self.words.append(at[order])
        self.times.append(n[order])

    def full(self, words: int) -> bool:
        return len(self.words) >= BLOCK_DOCS or len(self.places) >= words

    def lists(self, buckets: int) -> tuple[bytes, list[dict]]:
        """The bucket of every place, and each bucket's words in the order of their places."""
        words = [w.encode() for w in self.places]
        deal = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
        order = np.argsort(deal, kind="stable")
        found, starts = np.unique(deal[order], return_index=True)
        pack = zstandard.ZstdCompressor(3).compress
        held = [{"bucket": int(k), "words": pack(_END.join([words[i] for i in run]))} for k, run in zip(found, np.split(order, starts[1:]), strict=False)]
        return _pack(deal), held

    def row(self, name: int, buckets: int, schema: pa.Schema) -> pa.RecordBatch:
        heads = pa.Table.from_batches(self.heads).combine_chunks()
        ends = pa.array([0, heads.num_rows], pa.int32())
        ids, n_bytes = (pa.ListArray.from_arrays(ends, pa.concat_arrays(c.chunks)) for c in heads.columns)
        # Steps from place to place, through the ends of documents; a document's new words are steps of one.
        at = np.diff(np.concatenate([np.zeros(1, np.uint32), *self.words]))
        deal, lists = self.lists(buckets)
        made = [[name], ids, n_bytes, [[len(w) for w in self.words]], [_pack(at)], [_pack(np.concatenate(self.times))], [deal], [lists]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], names=schema.names)


def frequencies(docs: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (block, ids, n_bytes, distinct, words, times, deal, lists): a row a block of documents, stored."""
    text = text_or_empty(text_col)
    thin = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pieces")
        part, made, block, schema = TaskContext.get().partitionId(), 0, Block(), None
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            schema = schema or pa.schema({
                "block": pa.int64(), "ids": pa.list_(b.schema.field("id").type), "n_bytes": pa.list_(pa.int64()), "distinct": pa.list_(pa.int32()),
                "words": pa.binary(), "times": pa.binary(), "deal": pa.binary(), "lists": pa.list_(pa.struct({"bucket": pa.int32(), "words": pa.binary()})),
            })
            heads, first = b.select(["id", "n_bytes"]), 0
            for k, t in enumerate(b.column(2).to_pylist(), 1):
                block.add(t)
                if block.full(block_words):
                    block.heads.append(heads.slice(first, k - first))
                    yield block.row(part << 32 | made, buckets, schema)
                    block, first, made = Block(), k, made + 1
            if first < b.num_rows:
                block.heads.append(heads.slice(first))
        if block.words:
            yield block.row(part << 32 | made, buckets, schema)

    held = f"block long, ids array<{thin.dtypes[0][1]}>, n_bytes array<long>, distinct array<int>, words binary, times binary, deal binary, lists array<struct<bucket: int, words: binary>>"
    return materialise(thin.mapInArrow(run, held), "frequencies")


def piece_counts(listed: DataFrame, model_file: str) -> DataFrame:
    """Rows (of, bucket, counts) from (block, bucket, words): how many pieces each listed pre-token has, each distinct one counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pieces")
        model, last, known = pieces(model_file), None, {}
        for b in batches:
            counts = []
            for bucket, held in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket != last:
                    last, known = bucket, {}
                words = zstandard.decompress(held).split(_END)
                new = [w for w in words if w not in known]
                known.update(zip(new, model.count([w.decode() for w in new]), strict=True))
                counts.append(_pack(np.fromiter((known[w] for w in words), np.uint32, len(words))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.binary())], names=["of", "bucket", "counts"])

    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("block", "bucket", "words").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "of long, bucket int, counts binary")


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit); see the module for the cases."""
    ready(docs.sparkSession)
    held = frequencies(docs, id_col, text_col, block_words)
    counts = piece_counts(held.select("block", F.inline("lists")), model_file)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = {c: left.column(c)[0] for c in left.column_names}
        deal = _unpack(block["deal"].as_py())
        table = np.zeros(len(deal), np.int64)
        if len(deal):
            buckets = right.column("bucket").to_numpy()
            counts = [_unpack(c) for c in right.column("counts").to_pylist()]
            table[np.argsort(deal, kind="stable")] = np.concatenate([counts[i] for i in np.argsort(buckets)])
        at = np.cumsum(_unpack(block["words"].as_py()), dtype=np.uint32)
        upto = np.concatenate([[0], np.cumsum(table[at] * _unpack(block["times"].as_py()))]).astype(np.int64)
        ends = np.cumsum(block["distinct"].values.to_numpy(zero_copy_only=False), dtype=np.int64)
        totals = np.diff(upto[ends], prepend=0)
        return pa.table([block["ids"].values, block["n_bytes"].values, pa.array(totals, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    met = held.drop("lists").groupBy("block").cogroup(counts.groupBy("of"))
    made = met.applyInArrow(run, f"id {docs.select(F.col(f'`{id_col}`')).dtypes[0][1]}, n_bytes long, n_tokens long")
    return made.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
