"""Every operator against brute force on a fixture of nulls, blanks, long texts, ties, repeated rows and copies."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from groundflow.llm import jaccard_join, language_id, license_scan, line_dedup, multiset_hash, packing, positional_index, sharding, token_records, tokens, warc
from groundflow.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, component long"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 8))) for _ in range(400)]
BASE = " ".join(rng.choice(WORDS) for _ in range(120))


def make(n=150):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "É, ß. 'tis  odd  \r\n x"), (6, "word " * 30_000), (7, "123 ... 456")]
    for k in range(10, n):
        text = ". ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 60))) for _ in range(rng.randint(1, 6)))
        if k % 7 == 0:
            words = BASE.split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words[: rng.randint(80, 120)])
        if k % 11 == 0:
            text += "\nThis very common line stands in many of them.\n  THIS very common line stands in many of them. "
        if k % 13 == 0:
            text += "\nLicensed under CC BY 4.0. GNU General Public License. All  rights reserved"
        rows.append((k, text))
    rows += [(200 + k, "the same text of eight words in all") for k in range(20)]
    return [(i, t, "en" if i % 2 else "fr", "s0", len(t or ""), 1, 2) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_sharding(docs, rows, empty):
    got = sharding.kd_shards(docs, n_shards=7).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    total = {}
    for r in got:
        assert r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id])
        total.setdefault(r.shard, []).append(r)
    for part in total.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    small = [sum(r.size for r in p) for p in (v for v in total.values()) if not any(r.doc_id == 6 for r in p)]
    assert max(small) - min(small) <= 2 * max(len(t) for i, t in text.items() if i != 6) + 64
    assert sharding.kd_shards(empty, n_shards=3).count() == 0


def test_sharding_keeps_copies_together(spark):
    """Copies of a text share a shard while they have a tenth of its bytes at most; larger groups are dealt out, and sizes stay near equal."""
    gen, rows = random.Random(3), []
    for k in range(400):
        text = " ".join(gen.choice(WORDS) for _ in range(gen.randint(20, 60)))
        rows += [(len(rows) + j, text, "en" if k % 2 else None, f"s{k % 3}") for j in range(gen.choice([1, 1, 1, 2, 3]))]
    rows += [(None, "without an id and twice", "en", "s")] * 2 + [(10_000 + k, "a text that half of all documents have, word for word", "fr", "s0") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = sharding.kd_shards(docs.withColumns({"whole": F.lit(1), "shard": F.lit("x"), "text_hash": F.lit(1)}), n_shards=8).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "size", "text_crc32", "shard", "slot"}
    share = sum(r.size for r in got) / 8
    shards, total, slots = {}, {}, {}
    for r in got:
        shards.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        total[r.shard] = total.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    copies = {}
    for i, t, *_ in rows:
        copies[t] = copies.get(t, 0) + 1
    for t, n in copies.items():
        if n * (len(t.encode()) + 16) <= share / 10:
            assert len(shards[zlib.crc32(t.encode()), len(t.encode()) + 16]) == 1
    assert len(shards[zlib.crc32(rows[-1][1].encode()), len(rows[-1][1]) + 16]) > 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(total.values()) - min(total.values()) <= 0.1 * share


@pytest.mark.parametrize(("name", "keeps"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder(rows, name, keeps):
    coder, plain = tokens.Encoder(public_tokenizers.path(name), keeps), Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    texts = [r[1] or "" for r in rows] + ["a\x00b", "x\x01y, z", "a.,b c., é, Ω:", "don't we'll's", "<|endoftext|> a", "\n\nA\n b"]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids


def ids_of(name, rows, end):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    return {r[0]: [*plain.encode(r[1] or "", add_special_tokens=False).ids, end] for r in rows}


def test_packing(docs, rows, empty):
    ids = ids_of("word_bpe_49k.json", rows, 2)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2).collect()
    seen, sequences = {i: 0 for i in ids}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(v) for i, v in ids.items()}
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.02 * sum(seen.values())
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0


def test_packing_limits(docs):
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, max_tokens=256, max_segments=3, max_loss=100)
    most = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum("loss_tokens").alias("l")).agg(F.max("n"), F.max("k"), F.max("l")).first()
    assert most[0] <= 256 and most[1] <= 3 and most[2] <= 100


@pytest.mark.parametrize("size", [5, 10, 30, 60, 120])
def test_packing_of_equal_short_documents(size):
    """Within all limits, hardly any padding, and time that does not grow with the square of the pool."""
    packer = packing.Packer(4096, 64, 4096, 0)
    docs = 120_000 // size
    for k in range(docs):
        packer.add(k, np.full(size, k % 50_000, np.uint16), 0)
    start = time.process_time()
    packer.drain(0)
    assert time.process_time() - start < 10
    total, segments, padding = {}, {}, 0
    for doc_id, _, n, _, whole, sequence, _, _ in packer.out:
        assert whole == size
        total[sequence], segments[sequence] = total.get(sequence, 0) + n, segments.get(sequence, 0) + 1
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in total.values())
    assert sum(total.values()) == docs * size and max(segments.values()) <= 64 and max(total.values()) <= 4096 and padding <= 0.02 * docs * size


def test_packing_of_conversations(spark):
    """Dialogues whose first turn bears no loss: all three limits hold, and the third is the one that binds."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    texts, prompts = {}, {}
    for r in turns:
        if r.conv_id not in texts:
            prompts[r.conv_id] = len(plain.encode(r.text or "", add_special_tokens=False).ids)
        texts.setdefault(r.conv_id, []).append(r.text or "")
    docs = spark.createDataFrame([(i, "\n".join(t), prompts[i], 7) for i, t in texts.items()], "doc_id long, text string, first long, prompt long").coalesce(2)
    got = packing.pack(docs, path, 2, max_tokens=1024, max_segments=16, max_loss=300, prompt_column="first").collect()
    seen, sums = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen.get(r.doc_id, 0)
        seen[r.doc_id] = r.start + r.length
        assert r.loss_tokens == r.length - max(0, min(r.length, prompts[r.doc_id] - r.start))
        one = sums.setdefault(r.sequence_id, [0, 0, 0])
        for k, v in enumerate((r.length, 1, r.loss_tokens)):
            one[k] += v
    assert seen == {r.doc_id: r.doc_tokens for r in got} and len(seen) == len(texts)
    assert all(a <= 1024 and b <= 16 and c <= 300 for a, b, c in sums.values()) and sum(c > 290 for _, _, c in sums.values()) >= 2
    for bad in ({"max_loss": 0}, {"max_tokens": 0}, {"max_segments": 0}):
        with pytest.raises(ValueError):
            packing.pack(docs, path, 2, **bad)


def test_packing_of_odd_rows(spark):
    rows = [(None, "one two", None), (None, None, -5), (3, "a b c", 100), (3, "a b c", 0), (4, "", 1)]
    got = packing.pack(spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, p int, length int, offset string"), public_tokenizers.path("word_bpe_49k.json"), 2, prompt_column="p").collect()
    whole = {}
    for r in got:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append(r.loss_tokens)
    assert {k: sum(v) for k, v in whole.items()} == {(None, 3): 3, (None, 1): 1, (3, 4): 4, (4, 1): 0}


def test_packing_of_short_texts_pads_nothing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    short = [(k, " ".join(WORDS[(k * 7 + j) % len(WORDS)] for j in range(2 + k % 4))) for k in range(500)]
    ids = ids_of("word_bpe_49k.json", short, 2)
    got = packing.pack(spark.createDataFrame(short, "doc_id long, text string").coalesce(1), path, 2)
    for r in got.collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    sizes = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).collect()
    assert sum(r.n for r in sizes) == sum(map(len, ids.values())) and max(r.k for r in sizes) <= 64
    assert all(r.n & (r.n - 1) == 0 for r in sizes)


def test_token_records(spark, docs, rows, empty):
    ids, path = ids_of("byte_bpe_50k.json", rows, 0), shared_dir(spark, "records")
    manifest = token_records.write_token_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    got = token_records.read_token_records(manifest).orderBy("doc_id").collect()
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        at += r.n_tokens
    assert len(got) == len(rows)
    first = token_records.fetch(manifest.orderBy("part").first().path, [2, 0])
    assert first[1].tolist() == ids[min(ids)]
    damaged = bytearray(token_records.frame(b"abcd"))
    damaged[13] ^= 1
    with pytest.raises((ValueError, struct.error)):
        token_records.unframe(bytes(damaged), 0)
    assert token_records.read_token_records(token_records.write_token_records(empty, shared_dir(spark, "records"), public_tokenizers.path("byte_bpe_50k.json"), 0)).count() == 0


def test_token_records_of_odd_ids(spark):
    rows = [(None, "b"), (None, None), (-(1 << 63), "a"), ((1 << 63) - 1, "c d"), (0, ""), (0, "z"), (5, "a tail<|endoftext|> next")]
    path = shared_dir(spark, "records")
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, path string")
    got = token_records.read_token_records(token_records.write_token_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 0)).orderBy("start").collect()
    ids = [ids_of("byte_bpe_50k.json", [r], 0)[r[0]] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    at = 0
    for r, want in zip(got, ids, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert [r.doc_id for r in got] == [None, None, -(1 << 63), 0, 0, 5, (1 << 63) - 1]


def test_language_codes():
    for n in (2, 4, 7, 12):
        code = language_id.code_matrix(n).astype(int)
        assert len({tuple(c) for c in code}) == n


def test_language_id(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(real.where(language_id.is_training()))
    held = language_id.predict(real.where(~language_id.is_training()), model)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3, 7)) and all(0 <= r.score <= 1 for r in got.values())
    assert len({got[200 + k].score for k in range(20)}) == 1
    assert language_id.predict(docs, language_id.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_dirty_labels_are_not_learned(spark, monkeypatch):
    """A column full of single labels, and rows without doc_id or with repeated ones."""
    monkeypatch.setattr(language_id, "LEAST_SHARE", 0.1)
    gen = random.Random(8)
    rows = [(None if k % 9 == 0 else k // 2, " ".join(gen.choice(("the house of", "and then it")) if k % 2 else gen.choice(("la maison de", "et puis il")) for _ in range(20)), "en" if k % 2 else "fr") for k in range(120)]
    rows += [(k, "qq ww", f"dirt {k}") for k in range(60)] + [(7, None, "en"), (None, "", None), (8, "the house of and then it", None)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.fit(docs.where(language_id.is_training()))
    assert model.languages == ["en", "fr"]
    found = language_id.predict(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"] and found.count() == len(rows)
    assert {(r.lang_pred, r.score > 0) for r in found.where("text is null or text = ''").collect()} == {("und", False)}
    known = found.where("lang in ('en', 'fr') and text is not null").collect()
    assert all(r.lang_pred == r.lang for r in known) and found.where("doc_id = 8 and lang is null").first().lang_pred == "en"


def test_license_scan_of_odd_rows(spark):
    rows = [(None, "MIT License"), (1, "MIT License"), (1, None), (1, ""), (None, None), (2, "cc by " * 30_000)]
    docs = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], "doc_id long, text string, matches string, n_words int, label string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_words, len(r.matches)) for r in license_scan.scan(docs).collect())
    assert got == [(0, 0, 0), (0, 2, 1), (1, 0, 0), (1, 0, 0), (1, 2, 1), (2, 60_000, 30_000)]


def test_license_scan(docs, rows, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, text, *_ in rows:
        words = word.findall(low(text))
        want = sorted((n.label, k) for n in license_scan.BASE for k in range(len(words)) if words[k : k + len(n.words.split())] == n.words.split())
        assert got[i].n_words == len(words) and sorted((m.label, m.first_word) for m in got[i].matches if m.base) == want
    finders = [license_scan.Finder(n) for n in license_scan.NOTICES]
    _, found = license_scan.matches_of("x Licensd under the Apache Licence, v2. Gnu genral public license. accbyx", finders)
    assert {(f[0], f[2]) for f in found} == {("apache", 2), ("apache", 1), ("gpl", 1)}  # the short form stands there too
    for text in ("small rights reserved", "unlicensed under the apache licensor", "gnu general public licensees", "all rights preserved", "gnu general publican license", "xgnu general public licenses"):
        assert license_scan.matches_of(text, finders)[1] == [], text
    assert [(*f[:3], *f[6:8]) for f in license_scan.matches_of("all rightsreserved", finders)[1]] == [("reserved", False, 1, 0, 2)]
    assert license_scan.scan(empty).count() == 0


def test_license_labels_equal_a_search_by_words():
    """Own labels against every run of words, on texts with planted notices whose letters were changed."""
    draw = random.Random(8)
    finders = [license_scan.Finder(n) for n in license_scan.NOTICES]

    def change(word):
        k, c = draw.randrange(1, len(word)), draw.choice("abcdefghijklmnopqrstuvwxyz")
        return draw.choice((word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]))

    planted = caught = alien = 0
    for _ in range(300):
        notice = draw.choice(license_scan.NOTICES)
        words, edits = notice.words.split(), 0
        for k in draw.sample(range(len(words)), len(words)):
            if len(words[k]) >= 4 and edits < draw.randint(0, notice.edits):
                words[k], edits = change(words[k]), edits + 1
        text = " ".join([*draw.choices(WORDS, k=draw.randint(0, 30)), *words, *draw.choices(WORDS, k=draw.randint(0, 30))])
        stream, want = text.encode().split(), set()
        for n in license_scan.NOTICES:
            own = n.words.encode().split()
            for k in range(len(stream) - len(own) + 1):
                if license_scan.misspelt(stream[k : k + len(own)], own, n.edits) is not None:
                    want.add((n.label, k))
        got = {(f[0], f[6]) for f in license_scan.matches_of(text, finders)[1]}
        assert want <= got
        alien += len(got - want)  # another number of words
        planted += 1
        caught += any(label == notice.label for label, _ in got)
    assert caught == planted and alien == 0


#: Texts that are not made from the list of notices, with the labels that a reader gives them.
READ = [
    ("This project is available under the MIT License.", "mit"), ("Distributed under the MIT licence, see LICENSE", "mit"), ("MIT-licensed, do as you like", ""), ("we hereby limit licensees", ""),
    ("Apache License, Version 2.0 (the \"License\")", "apache"), ("Licensed under the Apache License", "apache"), ("the Apache helicopter was licensed", ""), ("GNU GPL v3 or later", "gpl"), ("under the GPLv2 only", "gpl"),
    ("General Public Licence, version 3", "gpl"), ("the GNU general public licnese", "gpl"), ("a general, public license to fish", "gpl"), ("a general and public debate", ""), ("BSD 3-Clause License", "bsd"), ("the 2-clause BSD", "bsd"), ("released under a BSD license", "bsd"),
    ("CC BY-SA 4.0", "cc-by,cc-by-sa"), ("CC-BY 4.0", "cc-by"), ("Creative Commons Atribution", "cc"), ("all rights preserved for later", ""), ("All rigts reserved.", "reserved"), ("All Rights Reserved", "reserved"), ("all rights are reversed", ""),
    ("an open software licensee signs", ""), ("common public licenses are rare", ""), ("Common Public License", "cpl"), ("Mozilla Public License 2.0", "mpl"), ("mozila public license", "mpl"), ("MPL 2.0", "mpl"), ("ISC license", "isc"), ("zlib licence", "zlib"),
    ("licensed under the new mit license", "mit"), ("icensed under the apache license here", "apache"), ("Permission is hereby granted, free of any charge, to any person", "mit"), ("permission was granted to any person", ""),
    ("this program is free software; you can redistribute it and modify it", "gpl"), ("free beer for the software person", ""), ("public domain", ""), ("dedicated to the public domain", "public-domain"), ("GNU Lesser General Public License", "gpl,lgpl"),
]


def test_license_scan_of_texts_as_read():
    finders = [license_scan.Finder(n) for n in license_scan.NOTICES]
    found = {t: ",".join(sorted({f[0] for f in license_scan.matches_of(t, finders)[1]})) for t, _ in READ}
    wrong = {t: found[t] for t, want in READ if found[t] != want}
    pairs, given = {(t, x) for t, w in READ for x in w.split(",") if x}, {(t, x) for t in found for x in found[t].split(",") if x}
    precision, recall = len(pairs & given) / len(given), len(pairs & given) / len(pairs)
    assert precision >= 0.95 and recall >= 0.95, wrong


def test_license_edits_and_words():
    edits = lambda found, words, most: license_scan.misspelt(found.encode().split(), words.encode().split(), most)
    assert edits("all rihgts reserved", "all rights reserved", 2) == 2 and edits("all rights reversed", "all rights reserved", 2) is None and edits("all rigts reserved", "all rights reserved", 1) == 1
    assert edits("licensed under the new mit license", "licensed under the mit license", 4) == 4 and edits("licensed under the new mit license", "licensed under the mit license", 3) is None
    assert edits("icensed under the mit license", "licensed under the mit license", 1) == 1 and edits("licensed under mit license", "licensed under the mit license", 4) == 4
    assert edits("alllights reserved", "all rights reserved", 3) is None and edits("allrights reserved", "all rights reserved", 1) == 1
    assert edits("the mit license new", "the mit license", 9) is None and edits("licensed", "licensed under", 9) is None
    found = license_scan.matches_of("x released undr the mit license", [license_scan.Finder(license_scan.Notice("mit", "released under the mit license", 2))])[1]
    assert [tuple(f)[:8] for f in found] == [("mit", False, 1, 0, 0, 1, 1, 5)]


def test_license_scan_takes_linear_time():
    finders = [license_scan.Finder(n) for n in license_scan.NOTICES]
    took = []
    for size in (60_000, 240_000):
        start = time.process_time()
        n, found = license_scan.matches_of("cc by " * (size // 6), finders)
        took.append(time.process_time() - start)
        assert len(found) == size // 6 and found[-1][6] == n - 2
    assert took[1] < 9 * took[0]


def test_multiset_hash(spark, docs, rows, empty):
    ordered = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in multiset_hash.edit_likeness(docs).collect()}
    assert len(got) == len(rows)
    prints = {}
    for k, (i, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(rows)][1] or ""
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(text)
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    assert len(set(prints.values())) == len(prints)
    one, two = (multiset_hash.encode(multiset_hash.vectors([t.encode()])[0]) for t in ("b line\na line", "a line\nb line"))
    more = multiset_hash.encode(multiset_hash.vectors([b"a line\nb line\nc"])[0])
    assert one == two and multiset_hash.combine(one, inserted=["c"]) == more and multiset_hash.combine(more, deleted=["c"]) == one
    assert multiset_hash.edit_likeness(empty).count() == 0


def test_multiset_hash_of_odd_rows(spark):
    big = 1 << 53
    rows = [(None, "n one"), (None, None), (big, "x" * 40), (big + 1, "y" * 40), (big + 2, ""), (big + 2, "z")] + [(k, f"text {k}") for k in range(300)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, ends int").repartition(4)
    got = multiset_hash.edit_likeness(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = []
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(rows)][1] or ""
        want.append((i, len(text), hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(multiset_hash.encode(multiset_hash.decode(r.fingerprint)) == r.fingerprint for r in got)


def test_multiset_hash_tells_halves_from_strangers(spark):
    """Half a text is kept in the edited one, next to nothing in the next one; one window repeated very often changes neither."""
    draw = random.Random(4)
    prose = lambda: " ".join(draw.choices(WORDS, k=draw.randint(150, 600))) + (" ha" * 3000 if draw.random() < 0.3 else "")
    docs = spark.createDataFrame([(k, prose()) for k in range(200)], "doc_id long, text string")
    got = [r for r in multiset_hash.edit_likeness(docs).collect()]
    plain = [r for r in got if r.n_chars < 6000]
    assert np.mean([r.near_edited > 0.25 for r in plain]) > 0.97 and np.quantile([r.near_next for r in got], 0.9) < 0.35


def test_multiset_hash_of_short_lines(spark):
    draw = random.Random(9)
    lines = lambda: ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 11))) for _ in range(400)]
    one, other = lines(), lines()
    near = one[:20] + other[:20] + one[40:]
    texts = {4: "\n".join(near), 3: "\n".join(one), 2: "\n".join(other), 1: "short"}
    got = {r.doc_id: r for r in multiset_hash.edit_likeness(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[4].near_next > 0.75 and got[3].near_next < 0.4
    assert 0.3 < got[3].near_edited < 0.8 and got[4].near_edited > 0.3
    # by the sum, line by line
    long = "a line that is longer than a window"
    whole, parts = multiset_hash.vectors(["\n".join([*one, long, "", *other]).encode(), b"", b"abc"]), multiset_hash.vectors([x.encode() for x in [*one, long, "", *other]])
    assert (whole[0] == parts.sum(axis=0, dtype=np.uint32)).all()
    lanes = slice(multiset_hash.IDENTITY_LANES, None)
    assert not whole[1, lanes].any() and np.abs(whole[2, lanes].view(np.int32)).sum() == 1
    assert len(multiset_hash.vectors([b"abc"])) == 1 and (multiset_hash.vectors([b"abc"])[0] == whole[2]).all()


def test_decontamination(spark, docs, rows, empty):
    items = [("a", BASE), ("b", "one two"), ("c", None), ("d", " ".join(rows[20][1].split()[2:14])), ("e", "absent words here")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for name, text in items:
        w = word.findall(low(text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(name)
    got = {r.doc_id: r for r in positional_index.decontaminate(docs, bench).collect()}
    for i, text, *_ in rows:
        w, hit, names = word.findall(low(text)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(names))
    assert positional_index.decontaminate(empty, bench).count() == 0
    assert positional_index.decontaminate(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    index = positional_index.build_index(docs)
    pairs = positional_index.items_of(spark.createDataFrame([("p", "TWO one"), ("q", "one absent")], "item_id string, text string"))
    near = positional_index.search(index, pairs, within=3).where(F.size("items") > 0).collect()
    assert [(r.doc_id, r["items"]) for r in near] == [(4, ["p"])]
    # every term of every text is in the index
    words = sum(len(word.findall(low(r[1]))) for r in rows)
    assert index.where("term is not null").agg(F.sum("n"), F.sum(F.size("positions"))).first() == (words, words)


def test_decontamination_in_many_blocks(spark, docs, rows, monkeypatch):
    """Small blocks, more items than documents, items without id and repeated ones, against a search in every text."""
    monkeypatch.setattr(positional_index, "BLOCK_BYTES", 2_000)
    draw = random.Random(3)
    items = [(None, BASE), (1, BASE), (1, "one two"), (2, None), (3, "")]
    for k, (_, text, *_) in enumerate(rows):
        w = (text or "").split()[:400]
        if len(w) > 12:
            a = draw.randrange(len(w) - 10)
            items += [(10 + k, " ".join(w[a : a + draw.choice((5, 10, 14))])), (1000 + k, " ".join(draw.sample(w, 10)))]
    extra = docs.select("doc_id", "text", F.lit(1).alias("n"), F.lit("x").alias("name"), F.lit(2).alias("block"), F.lit(3).alias("term"))
    repeated = extra.unionByName(extra.where("doc_id = 14")).unionByName(extra.where("doc_id = 14").withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, no long")
    got = positional_index.decontaminate(repeated, bench)
    assert got.count() == len(rows) + 2 and got.where("doc_id = 14 or doc_id is null").select("n_words", "n_hit", "items").distinct().count() == 1
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for name, text in items:
        w = word.findall(low(text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(name)
    text = {r[0]: r[1] for r in rows}
    for r in got.collect():
        w, hit, names = word.findall(low(text[r.doc_id or 14])), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= {str(x) for x in found if x is not None}
        assert (r.n_words, sorted(r.places), r["items"]) == (len(w), sorted(hit), sorted(names))


def brute_components(rows):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(docs, rows, empty):
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want) - 15
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_join_in_small_parts(spark, docs, rows, monkeypatch):
    """Hand-overs, hot signatures, blocks around centres and look-ups by shuffle, at limits that the fixture crosses."""
    for name, value in (("FLUSH", 1500), ("HOT", 2), ("BLOCK", 4), ("BROADCAST_DOCS", 0), ("BUCKET_BYTES", 20_000)):
        monkeypatch.setattr(jaccard_join, name, value)
    # many variants of a text that are alike in chains only, and long unlike texts that share one passage
    draw = random.Random(12)
    words = BASE.split()
    more = [(1000 + k, " ".join(words[k : k + 60])) for k in range(40)]
    more += [(2000 + k, " ".join([*words[:40], *draw.choices(WORDS, k=8 + k % 5)])) for k in range(60)]
    more += [(3000 + k, " ".join(draw.choices(WORDS, k=30))) for k in range(20)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string").repartition(2))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(both).collect()}
    assert got == brute_components([*rows, *more])


def test_jaccard_join_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "A  b c d\te f"), (None, "a b c d e f"), (3, None), (3, " "), (4, "q r s t u v"), (5, "x"), (6, "X ")]
    docs = spark.createDataFrame([(*r, 1, b"", 2) for r in rows], "doc_id long, text string, bucket int, cells binary, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 0, 3), (3, 0, 3), (4, 2, 1), (5, 1, 5), (6, 1, 5)], key=str)


def test_cell_counts_never_exceed_the_difference():
    gen = np.random.default_rng(8)
    for n in [*range(1, 140), 181, 182, 725, 1447, 1449, 2200, 49_000, 49_600, 55_000]:
        a = np.unique(gen.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n // 5 :], gen.integers(0, 1 << 64, n // 9, dtype=np.uint64))))
        cells, sizes = [jaccard_join.cells_of(s).tobytes() for s in (a, b)], [len(a), len(b)]
        bits, narrow = jaccard_join.cell_layout(len(a))
        whole = np.bincount((a >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        assert (jaccard_join.counts_in(cells[0], len(a)) == np.minimum(whole, 3 if narrow else 255)).all()
        x, y = jaccard_join.aligned(cells, sizes)
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b))
        x, y = (jaccard_join.folded(v, max(8, len(v) // 4)) for v in (x, y))
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_signatures_lose_no_pair():
    gen = np.random.default_rng(3)
    for n in [*range(3, 40), 60, 97, 200, 411, 900]:
        for _ in range(6):
            plan, a = jaccard_join.Plan(3, 4), np.unique(gen.integers(0, 1 << 63, n, dtype=np.uint64))
            d = len(a) // 7  # replaced: just similar enough
            b = np.unique(np.concatenate((a[d:], gen.integers(0, 1 << 63, d, dtype=np.uint64))))
            c = a[len(a) - -(-3 * len(a) // 4) :]
            for other in (b, c):
                shared = len(np.intersect1d(a, other))
                if 4 * shared >= 3 * (len(a) + len(other) - shared) and len(other) != shared or len(a) != shared:
                    prints, of = jaccard_join.signatures([a, other], plan)
                    assert np.intersect1d(prints[of == 0], prints[of == 1]).size


def archived(df, path):
    return warc.write_index(warc.write_archives(warc.with_revisits(df), path), path)


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = [(3, "http://www.example.com/b?x=1", "same"), (1, "https://m.example.com/a", "same"), (2, None, None), (4, "http://b.org/\nx\ty", ""), (5, "http://www.example.com/b?x=1", "é" * 5000), (6, "not a url", "same"), (6, "not a url", "same"), (-7, "http://z.org/ü", "z")]
    pages += [(100 + k, "http://hot.org/", f"page {k % 7}") for k in range(40)] + [(1000 + k, f"http://h{k % 5}.org/{k}", f"own {k}") for k in range(30)]
    path = shared_dir(spark, "warc")
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, refers_to string, offset long").repartition(3)
    directory = archived(df, path)
    assert directory.count() > 5
    found = warc.read_archives(df, directory, path).collect()
    assert len(found) == len(pages)
    got = {r.page_id: r for r in found}
    firsts = {}
    for i, _, html in sorted(pages, key=lambda p: p[0]):
        data = (html or "").encode()
        first = firsts.setdefault(data, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.digest_of(data))
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
    urls = spark.createDataFrame([("http://example.com/b?x=1",), ("http://hot.org",), ("http://hot.org/",), ("http://nowhere.org/",)], "url string")
    caught = warc.captures(directory, path, urls).collect()
    assert sorted(r.page_id for r in caught) == [3, 5, *range(100, 140)]
    assert {r.page_id: r.payload for r in caught}[5] == bytearray("é".encode() * 5000) and {r.page_id: r.payload for r in caught}[107] is None
    none = df.limit(0)
    assert warc.read_archives(none, archived(none, path + "x"), path + "x").count() == 0


def test_warc_of_pages_without_id(spark):
    pages = [(None, "http://a.org/", "same"), (None, "http://a.org/", "same"), (4, "http://a.org/", "same"), (4, "http://a.org/", "same"), (5, None, "same"), (None, None, None)]
    path = shared_dir(spark, "warc")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.read_archives(df, archived(df, path), path).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == [(0, "response", 0, 0), (0, "response", 0, 4), (0, "response", 0, 4), (4, "response", 0, 4), (4, "response", 0, 4), (5, "revisit", 4, 4)]


def test_line_dedup(spark, docs, rows, empty):
    holders = {}
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    for i, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders.setdefault(k, []).append(i)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text or "") == (len(lines), len(lines) - len(stay), "\n".join(stay))
    assert line_dedup.dedup_lines(empty).count() == 0
    left = line_dedup.reference_counts(line_dedup.postings(docs).unionByName(line_dedup.postings(docs.where("doc_id > 100"), -1)), 3)
    want = line_dedup.reference_counts(line_dedup.postings(docs.where("doc_id <= 100")), 3)
    assert sorted(left.collect()) == sorted(want.collect())


def prints_of(filters):
    """The fingerprints that each shard's filter holds."""
    return {r.shard: sorted(x for x in np.frombuffer(bytes(r["filter"]), np.uint16).tolist() if x) for r in filters.collect() if any(r["filter"])}


def test_line_dedup_after_changes(spark, docs):
    """Documents that go and come back leave filters, counts and results as if they had never been there or gone."""
    rows_of = lambda d: sorted((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in d.collect())
    left, gone = docs.where("doc_id <= 100"), docs.where("doc_id > 100")
    whole = line_dedup.build_index(docs)
    fewer = line_dedup.change_index(whole, deleted=gone)
    rebuilt = line_dedup.build_index(left)
    assert sorted(fewer.counts.collect()) == sorted(rebuilt.counts.collect())
    assert prints_of(fewer.filters) == prints_of(rebuilt.filters) != prints_of(whole.filters)
    got = rows_of(line_dedup.dedup_lines(left, index=fewer))
    assert got == rows_of(line_dedup.dedup_lines(left)) and sum(r[3] for r in got) > 0
    again = line_dedup.change_index(fewer, inserted=gone)
    assert prints_of(again.filters) == prints_of(whole.filters)
    assert rows_of(line_dedup.dedup_lines(docs, index=again)) == rows_of(line_dedup.dedup_lines(docs))
    assert line_dedup.change_index(whole) is whole
    other = spark.createDataFrame([(900 + k, "\n".join(f"a line that only new documents have {j}" for j in range(400))) for k in range(3)], "doc_id long, text string")
    grown = line_dedup.change_index(fewer, inserted=other)  # more keys than the stored filter has room for
    rebuilt = line_dedup.build_index(left.select("doc_id", "text").unionByName(other))
    assert prints_of(grown.filters) == prints_of(rebuilt.filters) and grown.filters.where("filter is null").isEmpty()


def test_line_dedup_with_many_shards(spark, docs, monkeypatch):
    rows_of = lambda d: sorted((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in d.collect())
    more = [(900 + k, "\n".join(f"a line that many documents have {j}" for j in range(k, 40 + k))) for k in range(4)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = rows_of(line_dedup.dedup_lines(docs, 5, 2))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    monkeypatch.setattr(line_dedup, "PROBE_ROWS", 3)
    index = line_dedup.build_index(docs, 5, 2)
    assert index.filters.count() > 1 and rows_of(line_dedup.dedup_lines(docs, index=index)) == want


def test_line_dedup_equals_its_sql_on_odd_rows(spark):
    import duckdb

    line, other = "a line that is long enough", "ANOTHER line that is long enough "
    rows = [(1, line), (2, line), (2, line + "\nx\n" + other), (None, line), (None, f"{other}\n{other}"), (3, other), (4, other.lower()), (5, f"{other}\n\n{other}"), (6, None), (6, ""), (7, "short\nshort"), (8, "short"), (9, "short")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, n_lines long, _shard int, change int")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(entry.oracle_sql()["op10_line_dedup"]).fetchall()
    found = line_dedup.dedup_lines(docs)
    assert found.columns == ["doc_id", "text", "_shard", "change", "n_lines", "n_dropped"]
    got = found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_cuckoo_filter():
    gen = np.random.default_rng(1)
    k1, k2 = (gen.integers(-(1 << 62), 1 << 62, 3000) for _ in range(2))
    made = line_dedup.build_filter(k1, k2)
    assert made.may_hold(k1, k2).all()
    made.delete(k1[:1500], k2[:1500])
    assert made.may_hold(k1[1500:], k2[1500:]).all() and made.may_hold(k1[:1500], k2[:1500]).mean() < 0.01


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs.select(P.COLUMNS).write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.parquet(str(tmp_path / name)), sf)
        assert docs.columns == P.COLUMNS
    kept = {r.doc_id: r for r in docs.collect()}
    ids = ids_of("word_bpe_49k.json", [(i, r.text) for i, r in kept.items()], 2)
    got = P.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(v) for i, v in ids.items()}


def test_sql_of_line_dedup(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(entry.oracle_sql()["op10_line_dedup"]).fetchall()
    got = entry.queries()["op10_line_dedup"](spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
