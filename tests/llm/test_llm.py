import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptmeter.llm import fingerprints, langid, licenses, linededup, matroska, minmax, mixing, packing, quality, secrets, shared, word_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, __band string"
ODD = [(None, "no id", "en", "s", 1), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, "same words in two rows", "en", "s", 5), (3, "same words in two rows", "en", "s", 5), (4, "x " * 30_000, "en", "t", 60_000), (5, "\n\n\n", None, None, 3), (6, "word", "de", "t", 4)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture
def none(spark):
    return docs(spark, [])


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


# 1


def test_language_model_learns_from_its_split_only(spark):
    rng = random.Random(1)
    pools = {"en": ["the", "and", "thing", "with"], "fr": ["les", "été", "où", "eaux"]}
    rows = [(k, words(rng, 30, pools[lang]), lang, "s", 1) for k, lang in enumerate(["en", "fr"] * 40)]
    d = docs(spark, rows)
    model = langid.fit(langid.learnable(d), max_train_docs=60)
    got = langid.identify(d, model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got) and len(got) == 80
    held = {r["doc_id"] for r in d.where(langid.held_out()).collect()}
    assert held == {k for k in range(80) if zlib.crc32(str(k).encode()) % 4 == 2}


def test_language_of_odd_rows(spark, odd, none):
    got = langid.identify(odd, langid.fit(langid.learnable(odd))).collect()
    assert len(got) == len(ODD) and all(r["lang_pred"] == "und" for r in got if not (r["text"] or "").strip())
    assert langid.fit(langid.learnable(none)).langs == [] and langid.identify(none, langid.fit(none)).count() == 0
    assert langid.identify(odd, langid.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert langid.reject_unclear(odd).columns == odd.columns


# 2


def check_packing(rows, capacity=2048):
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values(), default=0) <= capacity
    return len(fill)


def adversarial(rng, n):
    """Texts of words, signs, blanks and strings of special tokens that run into one another."""
    parts = ["a", "Bc", "é", "É", "e\u0301", "ß", "œ", "日本", "\u200b", "\xa0", "\x85", "\x1c", "\0", " ", "  ", "\n", "\t", "'s", "'LL", "12", "²", "!?", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "</w>", "İ", "ς", "😀", "l'été", "don't", "\u0301"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_pieces_are_those_of_the_tokenizer(spark, odd, none):
    """Against the library's call with its defaults, so that strings of special tokens are those tokens."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_ids.vocabulary_path())
    more = ["ÉCOLE d'été don't I'LL 3rd x² ß ŒUF J̌ a\xa0b\x1cc <|endoftext|> 日本語.", "a <|endoftext|> b", "x<|startoftext|>y <|STARTOFTEXT|> é<|endoftext|>\u0301", *adversarial(random.Random(5), 2000)]
    extra = docs(spark, [(9 + k, x, "", "", 0) for k, x in enumerate(more)])
    texts = [r[1] for r in ODD] + more
    got = packing.pack(packing.tokenised(odd.union(extra)), group_items=400).collect()
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    expected = []
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        expected += [(len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    check_packing(got)
    assert packing.pack(packing.tokenised(none)).count() == 0


def test_word_merges_are_those_of_the_library():
    from tokenizers import Tokenizer

    rng, w = random.Random(6), word_ids.WordIds(word_ids.vocabulary_path())
    t = Tokenizer.from_file(word_ids.vocabulary_path())
    syllables = ["th", "e", "ing", "an", "ou", "st", "ch", "ment", "tion", "é", "ß", "aux", "q", "zz", "ll", "é", "ö", "..", "!", "?!", "((", "/"]
    tried = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 9))) for _ in range(30_000)]
    flat, at, size = w.distinct(pa.array(tried))
    for word, a, n, e in zip(tried, at, size, t.encode_batch(tried, add_special_tokens=False), strict=True):
        assert flat[a : a + n].tolist() == e.ids, word


def test_packing_against_its_bound(spark):
    rng = random.Random(3)
    lengths = [rng.randrange(1, 2049) for _ in range(3000)]
    items = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], packing._ITEM)
    bins = check_packing(packing.pack(items, group_items=500).collect())
    assert bins <= 1.03 * packing.lower_bound(np.array(lengths), 2048)
    assert packing.lower_bound(np.array([1025] * 7), 2048) == 7 and packing.lower_bound(np.array([683] * 4), 2048) == 2


# 3


def brute_components(rows, width, percent=80):
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(set(shared.shingles(text, width).tolist()))
    near = {d: d for d in sets}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                near[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_all_pairs(spark, width):
    rng = random.Random(width)
    pool = [f"w{k}" for k in range(300)]
    rows = [(k, words(rng, rng.randrange(1, 80), pool)) for k in range(60)]
    for k in range(60, 220):
        text = rng.choice(rows)[1].split()
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(pool)
        rows.append((k, " ".join(text)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in minmax.near_duplicates(d, width).collect()}
    expected = brute_components(rows, width)
    assert {k: v[0] for k, v in got.items()} == expected
    assert all(kept == (k == c) for k, (c, kept, _) in got.items())
    assert all(n == len(shared.shingles(t, width)) for (k, t), n in zip(rows, (got[k][2] for k, _ in rows)))


def test_rows_of_one_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(1, a), (5, b), (9, a), (9, b), (9, c), (7, c), (8, "by itself"), (None, a)]
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == [(0, None, True), (1, 1, True), (5, 1, False), (7, 1, False), (8, 8, True), (9, 1, False), (9, 1, False), (9, 1, False)]


def test_buckets_of_distinct_documents_are_looked_at_in_blocks(spark, monkeypatch):
    rng = random.Random(33)
    shared_words = [f"s{k}" for k in range(60)]  # a template: documents of it are near 0.7, some of them over 0.8
    rows = []
    for k in range(150):
        own = [f"o{rng.randrange(12)}x{j}" for j in range(rng.choice([4, 12]))]
        rows.append((k, " ".join(shared_words + own)))
    monkeypatch.setattr(minmax, "PART", 7)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 2):
        got = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(d, 2, hub_rounds=rounds).collect()}
        assert got == brute_components(rows, 2)
    labelled = spark.createDataFrame([(1, k, 50, k % 3, [0] * minmax.SKETCH) for k in range(40)], "band long, doc_id long, n long, c long, sketch array<long>")
    met = minmax._across(labelled, 80).select(F.greatest("u", "v"), F.least("u", "v")).collect()
    assert sorted(map(tuple, met)) == sorted((u, v) for u in range(40) for v in range(u) if u % 3 != v % 3)  # each pair once


def test_components_of_links_found_one_after_the_other(spark):
    """Against plain merging, on a path, a star, a cycle and random links; later links join components that are there."""
    rng = np.random.default_rng(5)
    edges = [(k, k + 1) for k in range(12)] + [(20, k) for k in range(21, 30)] + [(40, 41), (41, 42), (42, 40), (50, 50)] + [tuple(map(int, x)) for x in rng.integers(60, 120, (45, 2))]
    later = [(3, 25), (25, 3), (119, 0), (200, 201), (41, 42), *(tuple(map(int, x)) for x in rng.integers(0, 120, (12, 2)))]

    def plain(links):
        root = {n: n for link in links for n in link}
        for u, v in links:
            a, b = sorted((root[u], root[v]))
            root = {n: a if r == b else r for n, r in root.items()}
        return {n: r for n, r in root.items() if n != r}

    table = lambda links: spark.createDataFrame(links, "u long, v long")
    labels = minmax.components(table(edges), "test-stars")
    assert {r.node: r.component for r in labels.collect()} == plain(edges) and labels.count() == len(plain(edges))
    after = minmax._joined(labels, table(later))
    assert {r.node: r.component for r in after.collect()} == plain(edges + later) and after.count() == len(plain(edges + later))
    assert minmax.components(table([]), "test-stars").count() == 0


def test_near_dedup_keeps_columns_of_any_name(spark, odd):
    own = odd.withColumn("__copy", F.lit("mine")).withColumn("__keep", F.lit("mine"))
    kept = minmax.drop_near_duplicates(own)
    assert kept.columns == own.columns and kept.select("__copy", "__keep").distinct().collect() == [("mine", "mine")]


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = minmax.near_duplicates(odd, 2).collect()
    assert len(got) == len(ODD) and {(r["doc_id"], r["n_shingles"]) for r in got} >= {(1, 0), (2, 0), (4, 1), (6, 1), (3, 4)}
    kept = minmax.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id is null").count() == 1
    assert minmax.near_duplicates(none).count() == 0


def test_min_max_signatures_estimate_similarity():
    x = shared.mix64(np.arange(1000, dtype=np.uint64))
    for shift, true in [(0, 1.0), (100, 900 / 1100), (500, 1 / 3)]:
        y = shared.mix64(np.arange(shift, 1000 + shift, dtype=np.uint64))
        assert abs(minmax.similarity(minmax.signature(x), minmax.signature(y)) - true) < 0.08


def test_unlike_texts_of_one_id_stay(spark):
    """A stage drops a row for what its own text is like, not for its id."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near_a = a.replace("a39", "zz")
    rows = [(1, a), (1, b), (2, near_a), (3, c), (3, c), (3, near_a), (4, d), (4, b), (5, None), (5, ""), (5, c), (None, a), (None, a), (-7, d)]
    got = minmax.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sum(r["doc_id"] is None for r in got) == 2
    left = [(r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None]
    assert len(left) == len(set(left)) and {t for _, t in left if t} & {a, near_a} and sum(t in (a, near_a) for _, t in left) == 1
    assert [sum(t == x for _, t in left) for x in (b, c, d, "", None)] == [1, 1, 1, 1, 1]
    assert (-7, d) in left  # the smallest id of its group, as (4, d) is the first of id 4 or a later one
    edge = [(2**63 - 1, a), (2**63 - 1, b), (-(2**63) + 5, c)]
    assert minmax.drop_near_duplicates(spark.createDataFrame(edge, "doc_id long, text string")).count() == 3


# 4


def test_fingerprints_against_the_definition(spark):
    rng = random.Random(4)
    rows = [(k * 3, words(rng, rng.randrange(0, 60), ["a", "é", "cd", "xyz", "日本"]), "", "", 0) for k in range(50)]
    d = docs(spark, rows)
    for parts in (1, 7, 120):  # one partition, several, and more than there are rows
        got = {r["doc_id"]: r for r in fingerprints.compare_with_next(d, parts).collect()}
        assert sorted(got) == [r[0] for r in rows]
        for k, (doc_id, text, *_) in enumerate(rows):
            following = rows[(k + 1) % len(rows)][1]
            n = len(text)
            edited, own = text[: n - n // 2] + following[: n // 2], got[doc_id]
            assert (own["n_chars"], own["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
            assert own["fingerprint"] == fingerprints.fingerprint(text).hex() and own["edited_fingerprint"] == fingerprints.fingerprint(edited).hex()
            sets = [set(shared.shingles(t, 5).tolist()) for t in (text, edited, following)]
            for name, other in (("near_edited", sets[1]), ("near_next", sets[2])):
                true = len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0
                assert abs(own[name] - true) < 0.16


def test_fingerprints_against_a_plain_form():
    """One permutation: a bin's value is its least hash, an empty bin's that of the first full bin of its probes."""
    text = " ".join(f"w{k}" for k in range(90))
    hashes, size = shared.shingles(text, 5).tolist(), fingerprints.BINS
    full = {}
    for h in hashes:
        full[h * size >> 64] = min(h, full.get(h * size >> 64, 1 << 64))
    values = []
    for b in range(size):
        probe, attempt = b, 0
        while probe not in full:
            attempt += 1
            probe = int(shared.mix64(np.array([(b * 0x9E3779B97F4A7C15 + attempt) % 2**64], np.uint64))[0]) * size >> 64
        values.append(full[probe])
    assert fingerprints.fingerprint(text) == fingerprints.packed(shared.mix64(np.array(values, np.uint64)))
    for bits in (1, 2, 4, 8, 16):
        x = np.array(values, np.uint64)
        assert (fingerprints.unpacked(fingerprints.packed(x, bits), bits) == (x & np.uint64((1 << bits) - 1))).all()


def test_fingerprints_estimate_similarity():
    base = [f"w{k}" for k in range(1000)]
    other = base[:800] + [f"x{k}" for k in range(200)]
    a, b = (shared.shingles(" ".join(t), 5) for t in (base, other))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(fingerprints.likeness(fingerprints.fingerprint(" ".join(base)), fingerprints.fingerprint(" ".join(other))) - true) < 0.12
    assert fingerprints.likeness(b"", b"") == 1.0 and fingerprints.likeness(b"", fingerprints.fingerprint("a")) == 0.0


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = fingerprints.compare_with_next(odd).collect()
    assert len(got) == len(ODD) and fingerprints.compare_with_next(none).count() == 0
    alone = next(r for r in got if r["doc_id"] is None)
    assert alone["n_chars"] == 5 and alone["fingerprint"] == fingerprints.fingerprint("no id").hex() and alone["near_next"] is None
    one = fingerprints.compare_with_next(docs(spark, [(7, "a b c d e f", "", "", 0)])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest()


# 5


@pytest.mark.parametrize("size", [1, 575, 576, 577, 576 * 8, 576 * 9, 576 * 129, 576 * 300 + 1])
def test_matroska_round_trip(size):
    payload = bytes(random.Random(size).randrange(256) for _ in range(size))
    file = matroska.mux(payload)
    m = matroska.parse(file)
    assert b"".join(file[a:b] for _, _, a, b, _ in m.packets) == payload
    assert m.tracks[1]["codec"] == "A_PCM/INT/LIT" and m.tracks[1]["depth"] == 8
    assert all((at, t) in m.clusters for t, _, at in m.cues) and len(m.cues) == len(m.clusters)
    assert [p[1] for p in m.packets] == sorted(p[1] for p in m.packets)


@pytest.mark.parametrize("how", [1, 2, 3])
def test_lacing(how):
    sizes = [300] * 4 if how == 2 else [3, 700, 255, 254, 0, 9000, 1]
    frames = [bytes([k]) * n for k, n in enumerate(sizes)]
    body = matroska.laced(frames, how)
    assert [body[a:b] for a, b in matroska._frames(body, 0, len(body), how)] == frames


def test_unknown_sizes_and_broken_files():
    file = matroska.mux(b"abc" * 1000)
    at = file.index(bytes.fromhex("18538067")) + 4
    assert len(matroska.parse(file[:at] + b"\x01" + b"\xff" * 7 + file[at + 8 :]).packets) == 6
    for broken in (file[:-3], b"\x00" * 40, b"\x1a", b"\xe7\x81\x05"):
        with pytest.raises(ValueError):
            matroska.parse(broken)


def test_media_cut_or_changed_anywhere_is_an_error_or_a_table(spark):
    file = matroska.mux(bytes(range(256)) * 9)
    rng = random.Random(55)
    files = [file[:k] for k in range(len(file))]
    for _ in range(1500):
        x = bytearray(file)
        x[rng.randrange(min(400, len(x)))] = rng.randrange(256)
        files.append(bytes(x))
    good = 0
    for x in files:
        try:
            good += all(0 <= a <= b <= len(x) for _, _, a, b, _ in matroska.parse(x).packets)
        except ValueError:
            pass
    assert good > 100
    d = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(file[:-3])), (3, None), (4, bytearray(b"\x1a"))], "doc_id long, media binary")
    got = matroska.packet_table(d, "doc_id", "media").collect()
    assert [r["doc_id"] for r in got if r["error"]] == [2, 3, 4] and sum(r["doc_id"] == 1 for r in got) == 4


def test_media_of_any_text(spark):
    rng = random.Random(56)
    texts = ["".join(rng.choice(["a", "é", "日", "\n", "x" * 50]) for _ in range(rng.randrange(0, 300))) for _ in range(25)] + ["é" * 288, "x" * 576]
    got = {r["doc_id"]: r for r in matroska.round_trip(docs(spark, [(k, t, "", "", 0) for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        raw = t.encode()
        whole = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        assert (got[k]["n_bytes"], got[k]["payload_bytes"], got[k]["payload_sha256"], got[k]["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))


def test_media_of_odd_rows(spark, odd, none):
    got = {r["doc_id"]: r for r in matroska.round_trip(odd).collect()}
    assert got[1]["n_bytes"] == 0 and got[1]["payload_bytes"] == 576 and got[1]["payload_sha256"] == hashlib.sha256(b"\xff" * 576).hexdigest()
    assert got[4]["payload_bytes"] % 576 == 0 and got[1]["feature"] == got[2]["feature"]
    assert matroska.round_trip(none).count() == 0
    table = matroska.packet_table(matroska.store(odd.where("doc_id = 4")), "doc_id", "media")
    assert table.count() == got[4]["packets"]


# 6


def brute_spans(t):
    out = []
    for k, (kind, pattern, fold, least) in enumerate(secrets.RULES):
        p = pattern.replace("[A-Za-z0-9+/_.=-]+", "([A-Za-z0-9+/_.=-]+)") if kind == "assign" else pattern.replace("{24,}", "+")
        for m in re.finditer(p, t, (re.I | re.A) if fold else 0):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= (24 if kind == "hex" else least):
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_secrets_against_regexes():
    rng = random.Random(6)
    parts = ["token", "secret", "passwd", "api_key", "TOKEN", " ", "=", ":", '"', "abc", "abcdefgh", "AKIA", "AKIAABCDEFGH", "IJKLMNOP1234", "0123456789abcdef", "é", "ſecret", "\n", "ghp_", "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "日本", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 50))) for _ in range(800)]
    texts += ["".join(rng.choice(parts) for _ in range(3000)), "a" * 9000, "token=" + "b" * 5000]
    assert secrets.scanner().texts([*texts, None]) == [*map(brute_spans, texts), []]


def test_secrets_of_odd_rows(spark, odd, none):
    got = secrets.find_secrets(odd).collect()
    assert len(got) == len(ODD) and {r["spans"] for r in got} == {""} and secrets.find_secrets(none).count() == 0
    d = docs(spark, [(1, "my token = abcdefgh ok", "", "", 0), (2, None, "", "", 0)])
    assert {r["text"] for r in secrets.redacted(d).collect()} == {"my [secret] ok", None}


# 7


def test_licenses(spark, odd, none):
    d = docs(spark, [(1, "Hello there.\nReleased under the MIT License.\nx", "", "", 0), (2, "released under the mit", "", "", 0), (3, "Licensed under the\nApache License, Version 2.0", "", "", 0)])
    got = {(r["doc_id"], r["unit"], r["unit_no"], r["license"]) for r in licenses.scan_licenses(d).collect()}
    assert (1, "line", 2, "MIT") in got and (3, "paragraph", 1, "Apache-2.0") in got
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0


MIT = """{title}

Copyright (c) 2020 Foo Authors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_whole_license_files(spark):
    files = {"MIT": MIT.format(title="MIT License"), "MIT (MIT)": MIT.format(title="The MIT License (MIT)")}
    for name in ("Apache-2.0", "BSD", "CC0-1.0", "GPL-2", "GPL-3", "LGPL-3", "MPL-2.0"):
        path = f"/usr/share/common-licenses/{name}"
        if os.path.exists(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                files[name] = f.read()
    d = docs(spark, [(k, text, "en", "s", 1) for k, text in enumerate(files.values())])
    got = {}
    for r in licenses.scan_licenses(d).collect():
        got.setdefault(list(files)[r["doc_id"]], set()).add((r["unit"], r["license"]))
    assert ("text", "MIT-text") in got["MIT"] and {("text", "MIT-text"), ("line", "MIT-title")} <= got["MIT (MIT)"]
    for name in files:
        assert any(x.startswith(name.split(" ")[0]) for _, x in got.get(name, ())), (name, got.get(name))


def test_notices_inside_longer_passages(spark):
    texts = [
        "Copyright 2020 Foo Authors. Licensed under the Apache License, Version 2.0. See the LICENSE file for details.",
        "This project is released under the MIT License.",
        "# Copyright 2020 Foo\n# Licensed under the Apache License,\n# Version 2.0.\nimport os\nimport sys\nprint(os.name, sys.path)\ndef main(): return 0",
        "Hello there.\nReleased under the MIT License.\nx",
        "Some text. Released under the MIT License. " + "More words follow here. " * 9 + "Released under the MIT License. Done with it all.",
        " ".join(MIT.format(title="A project of ours, see below for its terms, which are as follows").split()) + " And then many other words follow. " * 40,
        "the software and the license of the public under the terms of which " * 20,
    ]
    d = docs(spark, [(k, text, "en", "s", 1) for k, text in enumerate(texts)])
    got = {}
    for r in licenses.scan_licenses(d).collect():
        got.setdefault(r["doc_id"], []).append((r["unit"], r["unit_no"], r["license"], r["dice"]))
    assert got[0] == [("window", 5, "Apache-2.0", 1.0)] and got[1] == [("window", 4, "MIT", 1.0)] and got[2] == [("window", 4, "Apache-2.0", 1.0)]
    assert [x[:3] for x in got[3]] == [("line", 2, "MIT")]
    assert sorted(got[4]) == [("window", 3, "MIT", 1.0), ("window", 44, "MIT", 1.0)]
    assert [(u, name, d) for u, _, name, d in got[5]] == [("window", "MIT-text", 1.0)] and 6 not in got  # repeated bigrams are common as often as both hold them


# 8


def test_mix(spark, odd, none):
    rng = random.Random(8)
    rows = [(k, "w " * rng.randrange(0, 40), "en", rng.choice(["a", "b", "c", None]), 1) for k in range(400)]
    got = mixing.mix(docs(spark, rows)).collect()
    taken, target = {}, {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        taken[r["src"]] = taken.get(r["src"], 0) + r["taken"]
        target[r["src"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in got)) < 1
    assert mixing.mixed(docs(spark, rows)).count() == sum(r["copies"] for r in got)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns
    own = odd.withColumns({c: F.lit("mine") for c in ("copies", "__src", "__h", "__n", "src", "done", "whole", "room", "target")})
    kept = mixing.mixed(own)
    assert kept.columns == own.columns and kept.count() == mixing.mixed(odd).count() and kept.select("copies", "__h", "done").distinct().collect() == [("mine", "mine", "mine")]
    again = sorted(map(tuple, mixing.mix(docs(spark, rows[::-1])).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)  # reruns agree, whatever the order of rows


# 9


def test_quality(spark, odd, none):
    rng = random.Random(9)
    good, bad = ["good", "text", "here"], ["good###", "text$$$", "|"]
    rows = [(k, words(rng, 20, good if k % 3 else bad), "en", "s", 1) for k in range(200)]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(200)] + [(None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    got = quality.score(d, model).where("held_out").collect()
    assert got and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got)
    assert quality.score(odd, model).where("score between 0 and 1").count() == len(ODD)
    assert quality.fit(none, labels).bias == 0.0


def plain_gram_bucket(gram):
    """The bucket of an n-gram, a step a byte."""
    h = 0
    for byte in gram:
        h = (h * 0x01000193 + byte) % 2**32
    return ((h ^ len(gram)) * 0x9E3779B1) % 2**32 >> 16


def plain_features(token):
    marked = b"<" + token + b">"
    own = quality.word_hash(token) * 0x9E3779B1 % 2**32 >> 16
    return [own] + [plain_gram_bucket(marked[k : k + n]) for n in (3, 4, 5) for k in range(len(marked) - n + 1)]


def plain_score(text, direction, bias):
    words = (text or "").encode().split()
    values = [np.mean([direction[b] for b in plain_features(w)]) for w in words]
    for a, b in zip(words, words[1:]):
        mixed = (quality.word_hash(a) * 0x85EBCA77 % 2**32) ^ quality.word_hash(b)
        values.append(direction[mixed * 0x9E3779B1 % 2**32 >> 16])
    return 1 / (1 + np.exp(-(np.mean(values) if values else 0.0) - bias))


def test_quality_scores_against_a_plain_form(monkeypatch):
    rng = random.Random(19)
    texts = [words(rng, rng.randrange(0, 40), ["a", "日本語", "token,", "é", "xyz" * 30, *(f"w{k}" for k in range(50))]) for _ in range(60)] + [None, "", " \n", "one"]
    direction = np.random.default_rng(2).normal(size=quality.BUCKETS)
    expected = [plain_score(t, direction, 0.3) for t in texts]
    for block, most, long in ((1 << 20, 100_000, 1 << 12), (64, 10, 40)):  # texts in one block and in many, tokens forgotten all the time, and too long ones
        monkeypatch.setattr(quality, "BLOCK", block)
        monkeypatch.setattr(quality, "LONG", long)
        one = quality.Scorer(direction, 0.3)
        one.tokens.most = most
        assert np.allclose(one(texts), expected) and np.allclose(one(texts[::-1]), expected[::-1])


def test_quality_learns_by_the_gradient():
    rng = random.Random(4)
    texts = [words(rng, 30, ["good", "fine"] if k % 2 else ["bad", "poor"]) for k in range(40)]
    model = quality.train(texts, [k % 2 for k in range(40)])
    got = quality.Scorer(model.direction(), model.bias)(["good fine good", "poor bad bad"])
    assert got[0] > 0.9 and got[1] < 0.1
    # the weights of a document's buckets are those of the score: both give the same mean
    for t in texts[:5]:
        ids, w = quality.document_features(t)
        z = float(w @ model.direction()[ids]) + model.bias
        assert abs(1 / (1 + np.exp(-z)) - plain_score(t, model.direction(), model.bias)) < 1e-5


def test_quality_reads_long_tokens_to_their_end():
    rng = np.random.default_rng(1)
    for size in (65, 5000, 300_000):
        token = bytes(rng.integers(97, 123, size, dtype=np.uint8))
        n = np.bincount(quality.token_features([token])[0], minlength=quality.BUCKETS)
        assert (quality.long_token_counts(token) == n).all() and n.sum() == 1 + 3 * (size + 2) - 9
    head = "日本語" * 30
    good, bad = (head + w * 60 for w in ("良い", "悪く"))
    model = quality.train([good, bad] * 20, [1, 0] * 20)
    one = quality.Scorer(model.direction(), model.bias)([good + "良", bad + "悪"])
    assert one[0] > 0.7 and one[1] < 0.3


def test_quality_of_repeated_ids_and_empty_tables(spark, none):
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, [(2, f"text {k}", "en", "s", 1) for k in range(30)] + [(3, "x" * 900, "", "", 0), (4, None, "", "", 0)])
    model = quality.fit(d, labels, max_train_docs=10, max_train_chars=100)
    assert quality.score(d, model).count() == 32 and quality.score(none, model).count() == 0
    assert quality.score(none, model).columns == ["doc_id", "held_out", "score", "predicted"]


# 10


def test_line_dedup(spark, odd, none):
    passage = "\n".join(f"line number {k} of a passage that is shared by documents" for k in range(12))
    rows = [(k, f"own start {k}\n{passage}\nown end {k}", "en", "s", 1) for k in range(5)] + [(9, "nothing\nshared\nhere", "en", "s", 1)]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert got[0]["__removed"] == 0 and got[0]["text"] == rows[0][1] and got[9]["text"] == rows[-1][1]
    assert all(got[k]["__lines_removed"] >= 2 and f"own end {k}" in got[k]["text"] for k in range(1, 5))
    same = linededup.dedup_lines(odd)
    assert sorted(str(r["text"]) for r in same.collect()) == sorted(str(r[1]) for r in ODD) and linededup.dedup_lines(none).count() == 0


def test_no_rows_are_lost_by_the_stages(spark):
    import corpus_pipeline

    rng = random.Random(10)
    rows = [(k, words(rng, 40, ["the", "and", "thing", "with", f"n{k}"]), "en", f"s{k % 3}", 1) for k in range(30)]
    d = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "")
        assert name == "packing" or d.columns == docs(spark, []).columns
    check_packing(d.collect())


def test_odd_sketches_never_leave_out_a_link(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], []
    for k in range(120):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        keep = rng.random(n) < rng.uniform(0.6, 1.0)
        b = np.concatenate((a[keep], rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 2)), dtype=np.uint64)))
        common, total = int(keep.sum()), len(a) + len(b)
        rows.append((k, minmax.odd_sketch(a).tolist(), minmax.odd_sketch(b).tolist(), total))
        truth.append(100 * common >= 80 * (total - common))
    df = spark.createDataFrame(rows, "k int, su array<long>, sv array<long>, n long")
    passed = {r.k for r in df.where(minmax._may_reach(F.col("su"), F.col("sv"), F.col("n"), 80)).select("k").collect()}
    assert passed >= {k for k, linked in enumerate(truth) if linked}
    assert 0 < sum(truth) <= len(passed) < len(rows)


def lines_by_definition(rows, least=linededup.MIN_CHARS, divisor=linededup.DIVISOR):
    """doc_id -> (text, chunks, lines removed); also what stays of the lines in adjacent pairs that stood before."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        last, long = len(lines) - 1, [len(x) >= least for x in lines]
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        stop = [k > 0 and (hashes[k] + 31 * hashes[k - 1]) % divisor == 0 for k in range(len(lines))]
        spans, a = set(), 0
        for k in range(len(lines)):
            if k == last or k < last - 1 and stop[k] and not stop[k - 1]:
                spans.add((a, k))
                a = k + 1
        for k in range(len(lines)):
            if not long[k] and (k == 0 or long[k - 1]):
                z = k
                while z < last and not long[z + 1]:
                    z += 1
                spans |= {(k, z), (max(k - 1, 0), z), (k, min(z + 1, last))}
        spans = {x for x in spans if x[0] < x[1]} | {(k, k) for k in range(len(lines))}
        gone, chunks = set(), 0
        for a, z in sorted(spans):
            unit = tuple(lines[a : z + 1])
            if len("\n".join(unit)) >= least:
                if unit in seen:
                    gone |= set(range(a, z + 1))
                    chunks += z > a
                seen.add(unit)
        out[doc_id] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), chunks, len(gone))
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 5, 10, 20])
def test_line_dedup_removes_whole_planted_passages(spark, size):
    rng = random.Random(size)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(60) for _ in range(size)] for _ in range(10)]
    rows = [(k, "\n".join([line(20), line(20), *passages[k % 10], line(20), line(20)]), "en", "s", 1) for k in range(30)]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert all(got[k]["text"] == rows[k][1] for k in range(10))
    for k in range(10, 30):
        lines = rows[k][1].split("\n")
        assert got[k]["text"] == "\n".join(lines[:2] + lines[-2:]) and got[k]["__lines_removed"] == size and (got[k]["__removed"] > 0 or size < 20)


LINES = ["", "}", "short line", "a line of middling length", "one line that is longer than forty characters are", "ünïcode lines, too, have their forty characters ✓", *(f"w{k}" for k in range(8))]


def line_rows(n=60):
    rng = random.Random(11)
    return [(k, "\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 14)))) for k in range(n)]


def removed(df):
    return {r["doc_id"]: (r["text"], r["__removed"], r["__lines_removed"]) for r in df.collect()}


def test_line_dedup_against_its_definition(spark):
    rows = line_rows()
    assert removed(linededup.dedup_lines(docs(spark, [(*r, "", "", 0) for r in rows]))) == lines_by_definition(rows)


def test_line_dedup_compares_bytes_where_hashes_are_equal(spark, monkeypatch):
    rows = line_rows()
    monkeypatch.setattr(linededup, "unit_hash", lambda x: F.length(x).cast("long"))  # all texts of one length clash
    monkeypatch.setattr(linededup, "PART", 3)  # and what stands in over three places is dealt to several parts
    assert removed(linededup.dedup_lines(docs(spark, [(*r, "", "", 0) for r in rows]))) == lines_by_definition(rows)


def test_line_dedup_writes_and_groups_no_texts(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(linededup, "written", lambda df, *a: tables.append(df) or shared.written(df, *a))
    passage = "\n".join(f"a line of the passage that stands twice, number {k}" for k in range(5))
    rows = [(1, passage, "", "", 0), (2, f"own line\n{passage}\nlast", "", "", 0)]
    assert removed(linededup.dedup_lines(docs(spark, rows))) == lines_by_definition([r[:2] for r in rows])
    assert len(tables) == 2 and not [f.name for t in tables for f in t.schema.fields if f.dataType.simpleString() == "string"]


def test_line_dedup_of_shifted_passages(spark):
    rng = random.Random(12)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12)))
    passage, own = [line() for _ in range(40)], lambda n: [line() for _ in range(n)]
    rows = [(k, "\n".join([*own(k), *passage, *own(3)])) for k in range(12)]
    got = removed(linededup.dedup_lines(docs(spark, [(*r, "", "", 0) for r in rows])))
    assert all(got[k][2] >= 38 for k in range(1, 12)) and got[0] == (rows[0][1], 0, 0)


def test_line_dedup_keeps_columns_of_any_name(spark, odd):
    names = ["__id", "__row", "__gone", "__known", "__lines", "__key", "__keyr", "__removed", "__lines_removed"]
    own = odd
    for c in names:
        own = own.withColumn(c, F.lit("mine"))
    kept = linededup.drop_repeats(own)
    assert kept.columns == own.columns and kept.select(*names).distinct().collect() == [tuple(["mine"] * len(names))]
    long = "a line that has more than forty characters in it, surely"
    rows = [(None, long, "", "", 0), (1, long, "", "", 0), (1, long, "", "", 0), (2, long, "", "", 0), (2, None, "", "", 0), (3, "", "", "", 0)]
    left = sorted((r["doc_id"] or 0, str(r["text"])) for r in linededup.dedup_lines(docs(spark, rows)).collect())
    assert left == [(0, long), (1, long), (1, long), (2, ""), (2, "None"), (3, "")]
