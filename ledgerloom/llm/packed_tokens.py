"""Token ids as fixed-width bit-packed files with random access.

File image (all numbers little-endian):

    8 bytes   magic ``LLTOK001``
    5 x u32   bits per id, ids per block, number of blocks, number of documents, 0
    u64       number of ids
    u64 x (blocks + 1)     block offsets: byte where each block's payload starts, counted from the payload's start
    u64 x (documents + 1)  document offsets: first id of each document in this file, and the end
    payload   every block: its ids in ``bits`` bits each, least significant bit first, padded to whole bytes

``bits`` is the least number that holds every id of the vocabulary. A block is unpacked on its own and whole arrays at a
time, so a reader maps the file, looks up the blocks of a range of ids and unpacks just those.

A data set is a Parquet folder whose rows are such images (``part``, ``shard``, ``n_ids``, ``doc_ids``, ``image``): Spark's commit
protocol makes the write atomic and repeatable when executors are lost, and any Hadoop file system will do. Documents
are range-partitioned by (id, hash of the text) and written in that order; (part, shard) is the order of the files.

Cases: a null or empty text has just the end id; rows with a null id come first; repeated rows and ids give an entry
each, one after the other, in the order of their texts' hashes; an empty table makes an empty data set; other columns
are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import caches, enter, materialise, ready, text_or_empty

MAGIC = b"LLTOK001"
_HEAD = struct.Struct("<8s5IQ")


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view("u1").reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(payload, "u1"), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), "u1")
    wide[:, :bits] = flat
    return np.packbits(wide.reshape(-1), bitorder="little").view("<u4").copy()


def image_of(docs: list[np.ndarray], bits: int, block: int) -> bytes:
    """One file's bytes."""
    ids = np.concatenate(docs) if docs else np.zeros(0, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    at = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    starts = np.cumsum([0, *map(len, docs)]).astype("<u8")
    return b"".join([_HEAD.pack(MAGIC, bits, block, len(blocks), len(docs), 0, len(ids)), at.tobytes(), starts.tobytes(), *blocks])


class PackedFile:
    """A file image, of bytes or a memory map; ids are unpacked block by block when asked for."""

    def __init__(self, image: bytes | memoryview | np.ndarray):
        self.image = memoryview(image)
        magic, self.bits, self.block, blocks, docs, _, self.n_ids = _HEAD.unpack_from(self.image)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = _HEAD.size
        self.blocks = np.frombuffer(self.image, "<u8", blocks + 1, at)
        self.docs = np.frombuffer(self.image, "<u8", docs + 1, at + 8 * (blocks + 1))
        self.payload = at + 8 * (blocks + docs + 2)

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, "<u4")
        parts, first = [], start // self.block
        for b in range(first, (end - 1) // self.block + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self.image[self.payload + int(self.blocks[b]) : self.payload + int(self.blocks[b + 1])], self.bits, n))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.docs[k]), int(self.docs[k + 1]))


class WordEncoder:
    """The library's ids of texts, through a table of the words between ASCII spaces.

    The normaliser and the pre-tokeniser drop white space and never look across it, so a text's ids are those of its
    words. Texts without combining marks are folded (A to Z) before the look-up, as the library would fold them.
    """

    _HIGH = bytes(range(0xCC, 256))

    def __init__(self, tokenizer_file: str, end_id: int, table_size: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size()
        self.end = np.array([end_id], "<u4").tobytes()
        self.table: dict[bytes, bytes] = {b"": b""}
        self.table_size = table_size
        # Folding before the library is safe only if the library folds itself.
        a, b = (self.library.encode(x, add_special_tokens=False).ids for x in ("Ab, cD.", "ab, cd."))
        self.folds = a == b

    @staticmethod
    def _gaps(found: list) -> Iterator[int]:
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                yield at
        except ValueError:
            return

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.table) > self.table_size:  # short words come again most often
            self.table = {w: x for w, x in self.table.items() if len(w) <= 8}
            if len(self.table) > self.table_size // 2:
                self.table = {b"": b""}
        table = self.table
        held, new = [], set()
        for t in texts:
            if self.folds and b"<|" not in t and len(t.translate(None, self._HIGH)) == len(t):
                t = t.lower()
            words = t.replace(b"\n", b" ").split(b" ")
            found, open_ = list(map(table.get, words)), []
            for at in self._gaps(found):
                open_.append((at, words[at]))
                new.add(words[at])
            held.append((found, open_))
        new_words = list(new)
        for at in range(0, len(new_words), 20_000):
            part = new_words[at : at + 20_000]
            made = self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            table.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, made, strict=True))
        for found, open_ in held:
            for at, word in open_:
                found[at] = table[word]
            found.append(self.end)
        return [b"".join(found) for found, _ in held]


@lru_cache(maxsize=2)
def _encoder(tokenizer_file: str, end_id: int, table_size: int) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(tokenizer_file, end_id, table_size)


caches("tokens", _encoder.cache_clear)


def write_tokens(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = 4096, shard_ids: int = 1_000_000, table_size: int = 1_500_000) -> DataFrame:
    """Encode and write; returns the data set read back: (part, shard, n_ids, doc_ids, image), an image of about ``shard_ids`` ids a row."""
    spark = ready(docs.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    thin = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = thin.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enter("tokens")
        encoder, part, shard = _encoder(tokenizer_file, end_id, table_size), TaskContext.get().partitionId(), 0
        bits, ids, docs_, held = bits_for(encoder.size), [], [], 0

        def row():
            image = image_of(docs_, bits, block)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([image], pa.binary())], names=["part", "shard", "n_ids", "doc_ids", "image"])

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                for key, packed in zip(keys[at : at + 500], encoder.encode(texts[at : at + 500]), strict=True):
                    ids.append(key)
                    docs_.append(np.frombuffer(packed, "<u4"))
                    held += len(packed) // 4
                    if held >= shard_ids:
                        yield row()
                        ids, docs_, held, shard = [], [], 0, shard + 1
        if docs_:
            yield row()

    made = ordered.mapInArrow(worker, "part int, shard int, n_ids long, doc_ids array<bigint>, image binary")
    return materialise(made, "tokens")


def read_documents(files: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of every document of a data set, ids unpacked from the images.

    Starts need the ids of all files before: one number a file is summed up per part in Spark, and the parts' sums (as many
    as the write had partitions, whatever the corpus holds) are laid end to end on the driver.
    """

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, ids, image in zip(*(b.column(i) for i in range(4)), strict=True):
                f = PackedFile(image.as_buffer())
                n, starts, crc = len(f.docs) - 1, f.docs.astype("i8"), []
                for lo in range(0, n, 256):  # unpack a run of documents at once
                    hi = min(n, lo + 256)
                    raw, base = memoryview(f.ids(int(starts[lo]), int(starts[hi])).tobytes()), starts[lo]
                    crc += [zlib.crc32(raw[4 * (starts[k] - base) : 4 * (starts[k + 1] - base)]) for k in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int32()), pa.array(ids.values), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    docs = files.select("part", "shard", "doc_ids", "image").mapInArrow(worker, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "shard", F.col("n_ids").alias("n"))
    per_part = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total, base = 0, []
    for part, n in per_part:
        base.append((part, total))
        total += n
    bases = files.sparkSession.createDataFrame(base, "part int, base long")
    before = F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before", F.coalesce(before, F.lit(0))).join(bases, "part").select("part", "shard", (F.col("before") + F.col("base")).alias("offset"))
    return docs.join(offsets, ["part", "shard"]).select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
