import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from helpers import TRICKY, documents, frame
from pyspark.sql import functions as F

from ledgerloom.llm import bpe_prefix, packed_tokens, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")
WORDS = P.path("word_bpe_49k.json")


def keyed(rows, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in rows), key=repr)


def both(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    return TRICKY + [(1000 + i, t) for i, t in rows]


def test_counts(spark):
    import sentencepiece

    rows = both(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t in rows), key=repr)
    got = token_counts.count_tokens(frame(spark, rows).withColumn("n_tokens", F.lit("clash")), PIECES, limit=100)
    assert keyed(got.collect(), "n_bytes", "n_tokens", "over_limit") == want
    assert keyed(token_counts.count_tokens(frame(spark, rows), PIECES, limit=100, block_words=50).collect(), "n_bytes", "n_tokens", "over_limit") == want
    wide = [(i, " ".join(f"w{i}x{k}" for k in range(40_000)) + " the" * 300) for i in range(3)]
    got = token_counts.count_tokens(frame(spark, wide).coalesce(1), PIECES).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(sp.encode(t)) for i, t in wide}
    assert token_counts.count_tokens(frame(spark, []), PIECES).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_prefix.Vocabulary.from_file(RANKS)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_prefix(vocabulary, library):
    text = b" incomprehensibilities aaaaaaaaaa"
    e = bpe_prefix.PrefixEncoder(vocabulary)
    for i in range(len(text)):
        e.append(text[i : i + 1])
        assert e.tokens() == library._encode_single_piece(text[: i + 1]) == e.tokens(i + 1)


def test_edits(vocabulary, library):
    rng, e = random.Random(5), bpe_prefix.PrefixEncoder(vocabulary, b"the quick brown fox jumps")
    for _ in range(60):
        at = rng.randrange(len(e.piece) + 1)
        e.edit(at, rng.randrange(4), bytes(rng.choice(b"abcdefgh the") for _ in range(rng.randrange(4))))
        assert e.tokens() == vocabulary.merged(bytes(e.piece))


def test_encode_decode(spark, library):
    rows = both(spark)
    ids = {i: t for i, t in enumerate(library.encode_ordinary(t or "") for _, t in rows)}
    got = bpe_prefix.encode(frame(spark, rows).withColumn("decoded", F.lit(1)), RANKS, P.PATTERN, memo_size=100, decoded=True)
    want = sorted(((d, len(ids[i]), np.array(ids[i], "<u4").tobytes(), (t or "").encode()) for i, (d, t) in enumerate(rows)), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got.collect()), key=repr) == want
    again = bpe_prefix.decode(got.drop("decoded"), RANKS)
    assert again.where(F.col("decoded").isNull()).count() == 0 and again.count() == len(rows)
    assert bpe_prefix.encode(frame(spark, []), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
    assert len(packed_tokens.pack(ids, bits)) == -(-1000 * bits // 8)
    assert (packed_tokens.unpack(packed_tokens.pack(ids, bits), bits, 1000) == ids).all()
    docs = np.split(ids, [0, 7, 7, 600])
    f = packed_tokens.PackedFile(packed_tokens.image_of(docs, bits, 64))
    assert (f.ids(0, 1000) == ids).all() and (f.ids(63, 130) == ids[63:130]).all() and len(f.ids(5, 5)) == 0
    assert all((f.document(k) == d).all() for k, d in enumerate(docs))


def test_bits():
    assert [packed_tokens.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]
    with pytest.raises(ValueError):
        packed_tokens.image_of([np.array([9], "<u4")], 3, 8)
    with pytest.raises(ValueError):
        packed_tokens.PackedFile(b"x" * 64)
    assert packed_tokens.PackedFile(packed_tokens.image_of([], 16, 8)).n_ids == 0


def test_written_and_read(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = both(spark)
    t = Tokenizer.from_file(WORDS)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    files = packed_tokens.write_tokens(frame(spark, rows).withColumn("part", F.lit("clash")), WORDS, end_id=1, shard_ids=5000, table_size=300)
    got = packed_tokens.read_documents(files).orderBy("start").collect()
    want = [t.encode(rows[k][1] or "", add_special_tokens=False).ids + [1] for k in order]
    assert [r["doc_id"] for r in got] == [rows[k][0] for k in order]
    assert [r["n_tokens"] for r in got] == [len(w) for w in want] and [r["start"] for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    image = files.where("part = 0 AND shard = 0").first()
    (tmp_path / "x.tok").write_bytes(image["image"])
    mapped = packed_tokens.PackedFile(np.memmap(tmp_path / "x.tok", np.uint8, "r"))
    assert mapped.document(0).tolist() == want[0] and mapped.n_ids == image["n_ids"]
    assert packed_tokens.read_documents(packed_tokens.write_tokens(frame(spark, []), WORDS, end_id=1)).count() == 0


def test_word_table_equals_whole_texts():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(WORDS), packed_tokens.WordEncoder(WORDS, 7, 20)
    texts = ["ÀB ÇD", "J̌ á Ω", "İstanbul ΑΣ", "don't CAN'T 's", "x y　z", "a\n\n b", "<|EndOfText|> <|endoftext|>x", "12 3.4,5", ""]
    for x in texts:
        assert np.frombuffer(e.encode([x.encode()])[0], "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 7], x


def test_packed_blocks(spark):
    for numbers in ([], [0], [1, 70_000, 2**32 - 1]):
        assert token_counts._unpack(token_counts._pack(np.array(numbers, np.uint32))).tolist() == numbers
    got = token_counts.count_tokens(frame(spark, [(1, None), (1, ""), (None, "")]).coalesce(1), PIECES).collect()
    assert keyed(got, "n_bytes", "n_tokens") == [(1, 0, 0), (1, 0, 0), (None, 0, 0)]
