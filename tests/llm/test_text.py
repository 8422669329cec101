import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from helpers import TRICKY, WORD, base_spans, components, documents, frame, quality
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, language_id, licenses, mixing, secrets
from ledgerloom.llm import quality as rules


def both(spark):
    return TRICKY + [(1000 + r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]


def clashing(df):
    for c in ("w", "h", "cid", "n", "pos", "a", "b", "kind", "start", "size", "hash", "id", "rid", "component_id", "part"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# Language


def test_automaton():
    text = "the cat sat on the mat; the bat"
    a = language_id.SuffixAutomaton(text)
    for probe in ("the mat sat", "bat on the catx", "zzz", ""):
        for i in range(len(probe)):
            want = max(n for n in range(len(probe) - i + 1) if probe[i : i + n] in text)
            assert a.match(probe, i) == want
    assert a.phrases("zzthe cat") == 3


def test_parser_equals_automata(spark):
    sample = language_id.learn(documents(spark))
    parser = language_id.cross_parser(sample)
    texts = ["The quick brown fox", "ñandú ß 日本", "", "!!", "x" * 5000, *[r["text"] for r in documents(spark).limit(20).collect()]]
    bits, lettered = parser.costs(texts)
    assert lettered[:4].tolist() == [True, True, False, False]
    for k, (_, passages) in enumerate(sample):
        a = language_id.SuffixAutomaton(parser.alphabet.symbols(list(passages))[0].tolist())
        for j, t in enumerate(texts):
            s = parser.alphabet.symbols([t])[0].tolist()
            assert bits[k, j] == pytest.approx(a.phrases(s) * parser.bits[k])


def test_many_languages():
    rng = random.Random(7)
    alphabet = [chr(c) for c in (*range(0x430, 0x450), *range(0x4E00, 0x5200), *range(0x61, 0x7B))]
    made = {}
    for k in range(60):
        letters = rng.sample(alphabet, 30)
        made[f"l{k:03d}"] = ["".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(60)]
    text = lambda name, n: " ".join(rng.choices(made[name], k=n))
    parser = language_id.CrossParser(tuple((name, tuple(text(name, 300) for _ in range(3))) for name in made))
    assert len(parser.alphabet.letters) > 600
    names = list(made)
    assert [a for a, _ in parser.predict([text(n, 30) for n in names])] == names
    same = language_id.CrossParser((("a", ("one two three",)), ("b", ("one two three",))))
    assert same.predict(["two", "日"]) == [("a", 0.0), ("a", 0.0)]  # ties


def test_normal_forms():
    fr = "l'été à la forêt, où l'élève préféré a dû goûter la crème brûlée près du château, ça va très bien"
    es = "el niño pequeño comió piña y jamón en el jardín del señor, después cantó una canción con corazón"
    parser = language_id.CrossParser((("es", (es,)), ("fr", (fr,))))
    probes = ["la crème brûlée du château préféré", "el niño comió jamón en el jardín"]
    bits = [parser.costs([unicodedata.normalize(form, p) for p in probes])[0] for form in ("NFC", "NFD")]
    assert (bits[0] == bits[1]).all() and [a for a, _ in parser.predict([unicodedata.normalize("NFD", p) for p in probes])] == ["fr", "es"]


def test_sample_is_of_whole_texts(spark):
    rows = [(i, f"wort{i} " * 20, "de", "s", 0) for i in range(100)] + [(200, "nur dies " * 2000, "la", "s", 0), (201, "nur das " * 3000, "la", "s", 0), (202, None, "la", "s", 0), (203, "x", None, "s", 0)] + [(300 + i, "kopie " * 50, "de", "s", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sample = dict(language_id.learn(docs, passages=8))
    texts = {r[1] for r in rows}
    assert set(sample) == {"de", "la"} and len(sample["de"]) == 8 and all(t in texts for ts in sample.values() for t in ts) and 1 <= len(sample["la"]) <= 2


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    sample = language_id.learn(docs.where(fold != 2))
    out = language_id.identify(docs, sample, keep={"lang": F.col("lang"), "held": fold == 2}).where("held").toPandas()
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()


def test_language_cases(spark):
    sample = language_id.learn(documents(spark))
    got = {r["doc_id"]: r for r in language_id.identify(clashing(frame(spark)), sample).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["score"] == 0
    assert language_id.identify(frame(spark), sample).count() == len(TRICKY)
    nothing = language_id.learn(frame(spark, []))
    assert {r["lang_pred"] for r in language_id.identify(frame(spark), nothing).collect()} == {"und"}
    assert language_id.identify(frame(spark, []), sample).count() == 0


# Quality


def test_quality_measures(spark):
    rows = [*both(spark), (20, "a b c d e a b c d e a b c d e x"), (21, "same line\nsame line\n\nother"), (22, "# * $ % & | < > !")]
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.measure(clashing(frame(spark, rows))).collect()), key=repr)
    assert got == sorted(((i, *quality(t)) for i, t in rows), key=repr)
    assert rules.measure(frame(spark, [])).count() == 0


def test_quality_policies(spark):
    rows = both(spark)
    docs = frame(spark, rows)
    book = rules.ledger(rules.measure(docs))
    kept = clashing(docs).transform(rules.keep_good)
    assert kept.columns == clashing(docs).columns and kept.count() == book.where(rules.passes("v1")).count()
    ab = {r["rule"]: r for r in rules.ablations(book, "v1").collect()}
    bits = [r["fail_bits"] for r in book.collect()]
    for r in rules.rules():
        one = 1 << r.bit
        assert ab[r.name]["n_failed"] == sum(b & one > 0 for b in bits) and ab[r.name]["n_alone"] == sum(b == one for b in bits)
        assert ab[r.name]["n_kept_without"] == sum(b & ~one == 0 for b in bits)


# Near copies


def near(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, shared = [], " ".join(rng.choices(vocabulary, k=15))
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(6, 90))
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) + 100, " ".join(copy) + (f" {shared}" if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rows = near(seed) + TRICKY if seed == 1 else near(seed)
    rows = [r for r in rows if r[0] is not None]
    want = components([t for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, want, strict=True):
        least[c] = min(i, least.get(c, i))
    got = jaccard.jaccard_components(clashing(frame(spark, rows)))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == sorted((i, least[c]) for (i, _), c in zip(rows, want, strict=True))


def test_every_link(spark):
    from helpers import linked, shingles

    rows = near(4)
    sets = {shingles(t) for _, t in rows}
    want = sum(linked(a, b) for a in sets for b in sets if a is not b) // 2
    members, links = jaccard.linked_pairs(frame(spark, rows), every_link=True)
    assert links.count() == want and members.count() == len(rows)


def test_near_copies_go(spark):
    rows = near(5)
    docs = frame(spark, rows)
    kept = jaccard.drop_near_copies(clashing(docs))
    assert kept.columns == clashing(docs).columns and kept.count() == len(set(components([t for _, t in rows])))
    assert jaccard.drop_near_copies(frame(spark, [])).count() == 0
    assert jaccard.drop_near_copies(frame(spark, [(None, "a b"), (None, "a b"), (1, None), (2, None)])).count() == 4


def test_near_copies_go_by_row(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    near_a = a + " more"

    def kept(rows):
        return sorted(((r["doc_id"], r["text"]) for r in jaccard.drop_near_copies(clashing(frame(spark, rows))).collect()), key=repr)

    assert kept([(5, a), (5, a), (5, a), (6, b)]) == [(5, a), (6, b)]
    assert kept([(3, a), (7, near_a), (7, b)]) == [(3, a), (7, b)]
    assert kept([(7, a), (7, b)]) == sorted([(7, a), (7, b)])
    assert kept([(None, a), (4, near_a), (None, b)]) == [(4, near_a), (None, b)]
    assert len(kept([(5, a), (5, near_a)])) == 1 and kept([(5, a), (5, near_a)]) == kept([(5, near_a), (5, a)])


def test_postings_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        entries = spark.createDataFrame([(h, 0, 1, c, 10, c % 4) for h in range(9) for c in range(h)], "h long, part int, parts int, cid long, n int, pos int")
        entries = entries.union(entries.where("cid = 1"))  # a class that two tasks have seen
        got = jaccard.postings(entries.coalesce(1)).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for h in range(9):
        own = got[got.h == h]
        assert sorted(own.cid) == (list(range(h)) if h > 1 else []) and (own.empty or set(own.pcid) == {0})


# Secrets


SECRETS = [
    (1, None), (2, ""), (3, 'password: "hunter2hunter2" token=abc secret = 12345678'), (4, "token=secret: abcdefgh12 ApI_KEY='Zz.9=-+/Zz'"), (5, "é😀 AKIAABCDEFGHIJKL and " + "0123456789abcdef" * 2 + " AKIAAKIA"),
    (6, "user=bob then Zx9kQw3rTy7uIoP1aSdF at https://db.example.com/x"), (7, "Zx9kQw3rTy7uIoP1aSdF alone, " + "far " * 100 + "user=bob"), (8, "https://example.com and user: alice"), (9, "PASSWD:" + "x" * 30000), (9, "PASSWD:" + "x" * 30000), (None, "secret=abcdefghij"),
]


def test_secret_spans(spark):
    rows = SECRETS + [(1000 + r["doc_id"], r["text"]) for r in documents(spark).collect()]
    got = secrets.scan_secrets(clashing(frame(spark, rows))).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.written("base_spans"), 256).alias("s"), secrets.written("spans").alias("spans")).collect()
    want = []
    for i, t in rows:
        b = base_spans(t)
        want.append((i, *(sum(k == name for _, _, k, _ in b) for name in ("assign", "access", "hex")), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in b).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["s"]) for r in got), key=repr) == sorted(want, key=repr)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[6] == "identifier:0:8,secret:14:34,endpoint:38:62" and spans[7] == "" and spans[8] == "" and spans[1] == ""
    assert secrets.scan_secrets(frame(spark, [])).count() == 0


def every_span(text, scope=secrets.SCOPE):
    """Linked spans by comparing every part with every other."""
    t = text or ""
    base = [(s, o, k, e) for s, o, k, e in base_spans(t)]
    runs = [(m.start(), 3, "secret", m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]+", t) if len(m[0]) >= 20 and all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
    names = "user_?name|user|login|account|client_?id|access_?key_?id"
    runs += [(m.start(), 4, "identifier", m.end()) for m in re.finditer(rf"""(?<![A-Za-z0-9])(?i:{names})["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{{3,}}""", t, re.ASCII)]
    runs += [(m.start(), 5, "endpoint", m.end()) for m in re.finditer(r"(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D\"'<>]+", t)]
    weak = [w for w in runs if not any(max(b[0], w[0]) < min(b[3], w[3]) for b in base)]
    role = {"assign": "s", "hex": "s", "secret": "s", "access": "i", "identifier": "i", "endpoint": "e"}
    out = list(base)
    for w in weak:
        near = {role[p[2]] for p in base + weak if p is not w and max(p[0] - w[3], w[0] - p[3]) <= scope}
        if {"s": bool(near & {"i", "e"}), "i": "s" in near, "e": {"i", "s"} <= near}[role[w[2]]]:
            out.append(w)
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_every_pair(spark, seed):
    rng = random.Random(seed)
    bits = ["user=bob", "login: alice", "https://db.example.com/x?y=1", "Zx9kQw3rTy7uIoP1aSdF", "internationalizationalistic", "token=abc", "secret: abcdefgh12", "AKIAABCDEFGHIJKLMN", "AKIAABC", "0123456789abcdef" * 2, "Room 9", "é😀", "token=secret=abcdefgh9", "user=ab", "ftp://Zx9kQw3rTy7uIoP1aSdF/x", "password:'Zx9kQw3rTy7uIoP1aSdF'"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice([" ", "\n", " and ", " far" * rng.randrange(60)]) for _ in range(rng.randrange(0, 25)))) for i in range(150)]
    rows += [r for r in SECRETS if r[0] != 9]
    got = secrets.scan_secrets(frame(spark, rows)).select("doc_id", secrets.written("spans").alias("spans")).collect()
    assert sorted(((r["doc_id"], r["spans"]) for r in got), key=repr) == sorted(((i, every_span(t)) for i, t in rows), key=repr)


def test_long_words_are_no_secrets(spark):
    text = "user: bob sees internationalizationalistic stuff. Then Room 9"
    assert [r["spans"] for r in secrets.scan_secrets(frame(spark, [(1, text)])).collect()] == [[]]
    long = " ".join(["face", "decade", "add", "x1"] * 10_000) + " " + "0123456789abcdef" * 2 + " user=bob"
    got = secrets.scan_secrets(frame(spark, [(1, long)])).first()
    assert [x["kind"] for x in got["spans"]] == ["hex", "identifier"] and got["n_hex"] == 1


def test_links_span_long_parts(spark):
    secret, far, url, token = "Zx9kQw3rTy7uIoP1aSdF", "far " * 49, "https://db.example.com/" + "x." * 150, "Zx9kQw3rTy7uIoP1aSdF" * 20
    rows = [(1, f"{url} {secret}"), (2, f"{token} user=bob"), (3, f"{token} {url} user=bob"), (4, f"user={'u.' * 150} {secret}"), (5, f"{secret} {far}  user=bob"), (6, f"{secret} {far}    user=bob"), (7, f"user=bob {url} {url} {secret}")]
    got = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert got[1] == ["secret"] and got[2] == ["secret", "identifier"] and got[3] == ["secret", "endpoint"] and got[4] == ["identifier", "secret"]
    assert got[5] == ["secret", "identifier"] and got[6] == [] and got[7] == ["secret"]
    text = {r["doc_id"]: r["text"] for r in secrets.redact(frame(spark, rows)).collect()}
    assert text[1] == f"{url} [SECRET]" and text[2] == "[SECRET] [SECRET]" and text[6] == rows[5][1]


def test_redaction(spark):
    docs = frame(spark, SECRETS)
    out = secrets.redact(clashing(docs))
    assert out.columns == clashing(docs).columns and out.count() == len(SECRETS)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[3] == '[SECRET]" token=abc [SECRET]' and text[6] == "[SECRET] then [SECRET] at [SECRET]" and text[9] == "[SECRET]" and text[1] is None
    assert text[5].startswith("é😀 [SECRET] and [SECRET] ") and text[7] == dict(SECRETS)[7]
    long = [(1, "plain words " * 300 + "token=abcdefgh12 " + "more " * 500 + "secret: 1234567890")]
    assert secrets.redact(frame(spark, long)).first()["text"] == "plain words " * 300 + "[SECRET] " + "more " * 500 + "[SECRET]"
    assert secrets.redact(frame(spark, [])).count() == 0


# Mixing


def targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, list(order)
    while free:
        share = {s: (total - sum(out.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    return out


@pytest.mark.parametrize("skew", [1, 40])
def test_mix(spark, skew):
    rng = random.Random(skew)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), "en", rng.choice(["a", "b", "é", "z", None] + ["a"] * skew), 0) for i in range(600)]
    docs = spark.createDataFrame([*rows, (1, None, "en", "a", 0), (2, "x y", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_report(clashing(docs)).toPandas()
    size = [len(WORD.findall(r["text"] or "")) for r in docs.collect()]
    assert len(out) == len(size) and sorted(out["size"]) == sorted(size)
    by: dict = {}
    for r, n in zip(docs.collect(), size, strict=True):
        by[r["source"]] = by.get(r["source"], 0) + n
    want = targets(by)
    assert sorted(set(np.round(out.target, 6))) == sorted({round(v, 6) for v in want.values()})
    assert (out.taken <= 3 * out["size"]).all()
    for (_, t), part in out.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - t) <= max(5, 0.01 * t)
    assert out.equals(mixing.mix_report(clashing(docs)).toPandas()) or sorted(map(tuple, out.values.tolist())) == sorted(map(tuple, mixing.mix_report(docs).toPandas().values.tolist()))
    twice = mixing.mix_documents(clashing(docs))
    assert twice.columns == clashing(docs).columns and twice.count() == out.copies.sum()


def test_mix_empty(spark):
    assert mixing.mix_report(frame(spark, [])).count() == 0
    only = mixing.mix_report(frame(spark, [(1, None), (2, "")])).collect()
    assert [(r["size"], r["taken"]) for r in only] == [(0, 0), (0, 0)]


# Licences


def test_licenses(spark):
    rows = [
        *TRICKY, (20, "Released under the MIT License. Later: the mit-LICENSE again"), (21, "Licensed under CC BY-NC 4.0."), (22, "the Apache License, Version 2.0 and GNU General Public License"), (23, "licence of mit; license"),
        (24, "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (25, "license mit mit license mit license"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(clashing(frame(spark, rows))).collect()}
    assert (got[20]["n_base"], got[20]["first_word"], got[20]["last_word"], got[20]["base_labels"], got[20]["score"]) == (2, 3, 7, "mit", 1.0)
    assert (got[21]["base_labels"], got[21]["labels"]) == ("", "cc-by-nc") and got[22]["base_labels"] == "apache,gpl" and got[24]["labels"] == "mit" and got[24]["n_base"] == 0
    assert (got[23]["n_base"], got[23]["labels"], got[23]["first_word"]) == (1, "mit", 2) and (got[25]["n_base"], got[25]["first_word"], got[25]["last_word"]) == (2, 2, 4)
    assert got[1]["n_words"] == 0 and got[1]["score"] == 0 and got[21]["notices"][0]["word"] == 0
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in rows:
        if i not in (4, None):
            from helpers import low

            w = word.findall(low(t or ""))
            places = [(k, lab) for p, lab in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(places)), i
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_licenses_against_every_place(spark):
    """The index finds what a scan of all rows at all places finds, with licence texts whole, cut, changed and filled in."""
    rng = random.Random(3)
    templates = (*licenses.TEMPLATES, *licenses.whole_texts())
    index = licenses.LicenseIndex(templates)
    texts = {name: next(t.text for t in licenses.whole_texts() if t.label == label) for name, label in (("mit", "mit"), ("bsd", "bsd"), ("zlib", "zlib"), ("isc", "isc"), ("boost", "boost"), ("unlicense", "unlicense"))}
    made = [None, "", *texts.values()]
    for text in texts.values():
        words = text.split()
        for loss in (0.02, 0.1, 0.3):
            made.append("# " + " ".join(w if rng.random() > loss else rng.choice(["", "x", "other words"]) for w in words))
        made += [" ".join(words[: len(words) // 2]), "code before\n" * 5 + text.replace("the", "THE") + "\ncode after"]
    made += [" ".join(rng.choice([t.text for t in licenses.TEMPLATES]) + rng.choice([" and ", " mit license ", ". "]) for _ in range(3)) for _ in range(20)]
    got = {r["doc_id"]: (r["labels"], [tuple(x) for x in r["notices"]]) for r in licenses.scan_licenses(frame(spark, list(enumerate(made)))).collect()}
    for i, t in enumerate(made):
        words = licenses.words_of((t or "").encode())
        every = ((k, s, index.agreed(k, s, words)) for k, (_, ws) in enumerate(index.rows) for s in range(1 - len(ws), len(words)))
        want = index.settle([m for m in every if m[2] >= 0.8], words)
        base = {label for p, label in licenses.BASE if any(words[k : k + len(p.split())] == p.encode().split() for k in range(len(words)))}
        assert got[i] == (",".join(sorted(base | {label for label, _, _ in want})), want), i
    for name, text in texts.items():
        assert name in got[made.index(text)][0].split(",")


def test_whole_licences(spark):
    whole = licenses.whole_texts()
    filled = [(i, t.text.replace("copyright notice", "copyright notice of Some One").replace("\n", "\n// ")) for i, t in enumerate(whole)]
    rows = [(i, t.text) for i, t in enumerate(whole)]
    for made in (rows, filled):
        got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(frame(spark, made)).collect()}
        assert all(t.label in got[i] for i, t in enumerate(whole))
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert all("lgpl" not in got[i] for i, t in enumerate(whole) if t.label not in ("lgpl", "gpl"))
