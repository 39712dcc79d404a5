import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_llm import ODD, adversarial, docs, words

from promptmeter.llm import alignment, fim, rans, word_ids

BLANK = "\x20\x09-\x0d"


@pytest.fixture
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture
def none(spark):
    return docs(spark, [])


# 11


def plain_fim(doc_id, text):
    """The contract's words, read literally."""
    text = text or ""
    units = re.findall(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), sha(output), sha(text)


def test_cuts_against_the_plain_form(spark, odd, none):
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n", "word", " word", "word \t", "a<P>b", "<M>", "a\xa0b c\x85d e", "日本 語 😀😀 x\x1cy", "x " * 30_000, *adversarial(rng, 400)]
    rows = [(k, t) for k, t in enumerate(texts * 3)] + [(None, "a b c"), (7, "twice"), (7, "twice")]
    got = fim.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_fim(*r)) for r in rows)
    assert {"plain", "spm", "psm"} == {r["form"] for r in got}
    assert fim.digests(odd).count() == len(ODD) and fim.digests(none).count() == 0


def test_transformed_texts_come_back(spark, odd):
    out = fim.fill_in_middle(odd.withColumnRenamed("score", "Form"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__band", "n", "form", "output"]
    for r in out.collect():
        assert fim.restored(r["output"].encode(), r["form"]).decode() == (r["text"] or "")


@pytest.mark.parametrize("units", ["words", "chars"])
def test_runs_have_every_cut(units):
    rng = random.Random(2)
    for text in ["", " ", "é", *adversarial(rng, 300)]:
        data = text.encode()
        parts = re.findall(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+", text) if units == "words" else list(text)
        runs = fim.RUNS[units](data)
        assert runs.total == len(parts)
        assert [runs.offset(k) for k in range(len(parts) + 1)] == [len("".join(parts[:k]).encode()) for k in range(len(parts) + 1)]
    assert len(fim.char_runs(b"abc" * 1000).start) == 1  # runs are maximal, whatever they hold


# 12


@pytest.mark.parametrize("n", [1, 63, 64, 65, rans.CHECKPOINT - 1, rans.CHECKPOINT, rans.CHECKPOINT + 1, rans.BLOCK + 5, 3 * rans.BLOCK])
def test_blocks_come_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 60_000).astype(np.uint32)
    table = rans.Table.of(*np.unique(ids, return_counts=True))
    assert int(table.freq.sum()) == 1 << rans.SCALE and rans.Table.from_bytes(table.to_bytes()).freq.tolist() == table.freq.tolist()
    lengths = np.array([n // 3, 0, n - n // 3])
    part = rans.encode_part(np.array([5, 0, -7]), np.array([False, True, False]), lengths, ids, table)
    got = list(rans.decode_part(part, table))
    assert [d for d, _ in got] == [5, None, -7] and [len(x) for _, x in got] == lengths.tolist()
    assert np.concatenate([x for _, x in got]).tolist() == ids.tolist()


def test_one_symbol_and_many():
    for ids in (np.full(10_000, 7, np.uint32), np.arange(49_408, dtype=np.uint32), np.concatenate((np.zeros(1_000_000, np.uint32), np.arange(40_000, dtype=np.uint32)))):
        table = rans.Table.of(*np.unique(ids, return_counts=True))
        part = rans.encode_part(np.array([1]), np.array([False]), np.array([len(ids)]), ids, table)
        assert next(iter(rans.decode_part(part, table)))[1].tolist() == ids.tolist()
    counts = np.bincount(ids)
    bound = -(counts[counts > 0] / len(ids) * np.log2(counts[counts > 0] / len(ids))).sum() * len(ids) / 8
    assert len(part) < 1.3 * bound + 600 * (len(ids) // rans.CHECKPOINT + 2)  # near the entropy, but for checkpoints and rare symbols
    with pytest.raises(ValueError):
        rans.encode_part(np.array([1]), np.array([False]), np.array([1]), np.array([50_000], np.uint32), table)
    with pytest.raises(ValueError):
        rans.normalised(np.ones(100), 6)


def test_damage_is_an_error():
    ids = np.random.default_rng(1).integers(0, 500, 20_000).astype(np.uint32)
    table = rans.Table.of(*np.unique(ids, return_counts=True))
    part = rans.encode_part(np.arange(4), np.zeros(4, bool), np.full(4, 5000), ids, table)
    for at in (0, 5, 40, len(part) // 2, len(part) - 1):
        broken = bytearray(part)
        broken[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            list(rans.decode_part(bytes(broken), table))
    with pytest.raises(ValueError):
        rans.Table.from_bytes(table.to_bytes()[:-1] + b"x")


def test_token_files_against_the_library(spark, odd, none, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_ids.vocabulary_path())
    rows = [(k * 37 % 500 - 100, x) for k, x in enumerate(adversarial(random.Random(8), 500))] + [(2**62 + 1, "a <|endoftext|> b"), (None, "no id"), (None, None), (3, None), (3, "again"), (4, "word " * 5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = rans.write(rans.plain_parts(d.repartition(3), partitions=4))
    got = rans.digests(manifest).collect()
    ids = {k: t.encode(x or "", add_special_tokens=False).ids + [1] for k, x in enumerate(x for _, x in rows)}
    expected = sorted((d is None, d, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())) for k, (d, _) in enumerate(rows) if d is not None)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == expected
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):  # gapless, in ascending order, rows without id last
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(d for d, _ in rows if d is not None) + [None, None]
    assert {tuple(r["ids"]) for r in rans.read(manifest).collect()} == {tuple(x) for x in ids.values()}
    assert rans.digests(rans.write(rans.plain_parts(odd))).count() == len(ODD)
    assert rans.digests(rans.write(rans.plain_parts(none))).count() == 0


def test_long_documents_fill_parts(spark):
    texts = [(k, f"w{k} a b c " * (40_000 if k % 3 == 0 else 10)) for k in range(12)]
    manifest = rans.write(rans.plain_parts(spark.createDataFrame(texts * 3, "doc_id long, text string"), partitions=2))
    assert manifest.count() > 2
    got = rans.digests(manifest).collect()
    assert len(got) == 36 and len({(r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got}) == 12


# 13


def plain_alignment(rows):
    """The contract's words, read literally, on whole texts and all pairs of a group's ids."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.vocabulary_paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    byte = word_ids.byte_chars()
    piece = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("\u2581", " ").encode()
    every, holders = [], defaultdict(set)
    for n, (_, text) in enumerate(rows):
        groups = []
        if text:
            data = (" " + text).encode()
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xb, yb = [bytes(byte[c] for c in a.id_to_token(k)) for k in x], [piece(k) for k in y]
            if b"".join(xb) == b"".join(yb) == data:
                ends = set(np.cumsum([len(t) for t in xb]).tolist()) & set(np.cumsum([len(t) for t in yb]).tolist())
                at = 0
                for end in sorted(ends):
                    take = lambda ids, parts: [k for k, e, t in zip(ids, np.cumsum([len(t) for t in parts]), parts, strict=True) if at <= e - len(t) and e <= end]  # noqa: B023, E731
                    groups.append((take(x, xb), take(y, yb)))
                    at = end
        every.append(groups)
        for p, q in groups:
            for i in p:
                for j in q:
                    holders[i, j].add(n)
    most = defaultdict(int)
    for (i, _), docs_ in holders.items():
        most[i] = max(most[i], len(docs_))
    out = []
    for (doc_id, _), groups in zip(rows, every, strict=True):
        links = [(i, j) for p, q in groups for i in p for j in q]
        counts = [len(holders[x]) for x in links]
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(c == most[i] for c, (i, _) in zip(counts, links, strict=True)), sum(counts), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out, {k: len(v) for k, v in holders.items()}


TEXTS = ["\u2581", "a\u2581b", " a  b   c ", "\n a \n\n  b\t c", "   ", "don't I'LL 3rd 12345 x² ﬁne", "日本語テキスト 한국어 😀😀👍🏽 e\u0301é", "<s></s><unk><0x0A> <|endoftext|>", "\0\x01\x1c \x85 \xa0 \u3000x\u2003 y", "aaaa" * 300, "=-=-" * 100 + " " * 50 + "x", "\r\n\r\n  z", "ab\u200bcd \ufeff q"]


def test_alignment_against_the_plain_form(spark, odd, none, monkeypatch):
    rng = random.Random(13)
    pool = ["the", "theater", "antidisestablishment", "naïve", "Straße", "ﬁ", "x=y+1;", "http://a.b/c?d", "résumé,", "12,345.67", "über", "zzzxq", "(foo)", "日本", "😀"]
    texts = [*TEXTS, None, "", *adversarial(rng, 150), *(words(rng, 40, pool) for _ in range(60))]
    rows = [(k - 20, t) for k, t in enumerate(texts)] + [(None, "no id the theater"), (5, "again naïve"), (5, "again naïve"), (2**62 + 1, "far Straße")]
    expected, counts = plain_alignment(rows)
    monkeypatch.setattr(alignment, "SLICE", 300)
    monkeypatch.setattr(alignment, "BLOCK_DOCUMENTS", 50)
    made = alignment.Alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = [tuple(r) for r in made.documents().collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert {(r["a"], r["b"]): r["documents"] for r in made.links().collect()} == counts
    assert made.groups.select("g").distinct().count() == made.groups.count()
    assert alignment.Alignment(odd).documents().count() == len(ODD) and alignment.Alignment(none).documents().count() == 0


def test_chunks_align_alike_alone_and_together():
    aligner = alignment.Aligner(*alignment.vocabulary_paths())
    chunks = list(dict.fromkeys(c for t in (*TEXTS, *adversarial(random.Random(3), 400)) for c in alignment.cut_chunks([t])[0]))
    x, y = aligner.align(chunks), aligner.align(chunks, 1)
    for name in ("bad", "n_a", "n_b", "links", "groups"):
        assert getattr(x, name).tolist() == getattr(y, name).tolist()
    block = alignment._Block(0)
    p, q = block.interned(x), block.interned(y)
    for k in range(len(chunks)):
        assert p[x.first[k] : x.first[k] + x.groups[k]].tolist() == q[y.first[k] : y.first[k] + y.groups[k]].tolist()
    assert x.bad.any() and len(set(block.groups)) == len(block.groups)


def test_pairs_in_several_groups_of_a_document_count_once(spark):
    """Ids that meet in several distinct groups of one document: the sum over groups alone would be too large."""
    rng = random.Random(4)
    junk = ["".join(rng.choice("日本語한국😀👍é\u0301ß") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    rows = [(k, words(rng, 50, junk)) for k in range(40)]
    _, counts = plain_alignment(rows)
    made = alignment.Alignment(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
    assert made.rows.where(made.rows["kind"] == alignment.TWICE).count() > 0
    assert {(r["a"], r["b"]): r["documents"] for r in made.links().collect()} == counts
