"""Alignment of the tokens of two tokenizers by a dictionary of groups.

Both tokenizers encode a space and the text; where tokens of both end at one byte, a group ends: A-ids and B-ids whose
bytes are the same. Groups are interned: documents hold numbers of a block's groups, a block's groups are interned
once more over all blocks, and each distinct group is expanded to its links once. The count of an id pair, the number
of documents that hold it linked, is the sum of its groups' documents, less the documents that hold it in several
groups, which each block knows by itself. What links are worth is summed once a distinct group and goes back to the
documents by the group's key, a block's groups at once.

Neither tokenizer joins what stands on both sides of a blank after a non-blank, so a text falls into chunks there, and
a chunk's groups do not hang on its neighbours: the distinct chunks of a batch are encoded once, many in a string, and
aligned by numpy over all their tokens.

Edge cases: null and empty texts, and texts that either tokenizer does not give back byte for byte (U+2581 is a blank
to B), have no tokens: zeros, and an empty string for the groups. The strings of special tokens are ordinary text.
Documents are rows: equal rows count one by one, also those of one doc_id or of none.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix64, written
from .word_ids import byte_chars

#: Characters that are cut at once, and the documents and distinct groups after which a block ends.
SLICE, BLOCK_DOCUMENTS, BLOCK_GROUPS = 6_000_000, 8000, 40_000
#: Chunks and characters of a string that is encoded.
TOGETHER, LONG = 64, 2000
_BOUNDARY = re.compile(r"(?<=\S)(?= )")


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def written_group(group: tuple[tuple[int, ...], tuple[int, ...]]) -> str:
    return f"{','.join(map(str, group[0]))}|{','.join(map(str, group[1]))}"


class Aligned:
    """Chunks by number: `bad` ones don't come back from a tokenizer; numbers of A-ids, B-ids, links and groups, and where a chunk's groups begin; of each group the place and number of its A-ids and B-ids."""

    def __init__(self, n: int):
        self.bad = np.zeros(n, bool)
        self.n_a, self.n_b, self.links, self.groups, self.first = (np.zeros(n, np.int64) for _ in range(5))
        self.a = self.b = self.a_at = self.a_n = self.b_at = self.b_n = np.empty(0, np.int64)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte, vocabulary = byte_chars(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(k)[3:5], 16)]) if self.b.is_byte(k) else piece(k).replace("▁", " ").encode() for k in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))

    def _encoded(self, items: list[list[int]], chunks: list[str]) -> Iterator[tuple[list[int], list[int], list[int], bool]]:
        """Each item, its ids of A and B, and whether both have the bytes of its chunks."""
        strings = ["".join([" " + chunks[k] for k in item]) for item in items]
        blank = [self.b.piece_to_id("▁")]  # to an empty string alone B adds no blank
        for item, x, a, b in zip(items, strings, self.a.encode_batch(strings, add_special_tokens=False), self.b.encode([x[1:] for x in strings], num_threads=1), strict=True):
            data, a, b = x.encode("utf-8", "replace"), a.ids, b if len(x) > 1 else blank
            yield item, a, b, b"".join([self.a_bytes[k] for k in a]) == data == b"".join([self.b_bytes[k] for k in b])

    def align(self, chunks: list[str], together: int = TOGETHER) -> Aligned:
        """Of distinct chunks, given without the blank before them."""
        items: list[list[int]] = []
        size = 0
        for k, c in enumerate(chunks):
            alone = not c or c[-1].isspace()  # no boundary would follow
            if not items or alone or size + len(c) > LONG or len(items[-1]) >= together:
                items.append([])
                size = 0
            items[-1].append(k)
            size += LONG if alone else len(c)
        out, order, a, b = Aligned(len(chunks)), [], [], []
        for attempt in range(2):
            again = []
            for at in range(0, len(items), 500):
                for item, x, y, same in self._encoded(items[at : at + 500], chunks):
                    if same:
                        order += item
                        a += x
                        b += y
                    elif len(item) > 1:
                        again += [[k] for k in item]
                    else:
                        out.bad[item[0]] = True
            items = again
        if not order:
            return out
        own, out.a, out.b = np.array(order), np.array(a, np.int64), np.array(b, np.int64)
        ends = np.cumsum([len(chunks[k].encode("utf-8", "replace")) + 1 for k in order])
        a_ends, b_ends = np.cumsum(self.a_size[out.a]), np.cumsum(self.b_size[out.b])
        last_a = np.flatnonzero(b_ends[np.searchsorted(b_ends, a_ends)] == a_ends)
        cut = a_ends[last_a]
        if together > 1 and not np.isin(ends, cut, assume_unique=True).all():  # never met
            return self.align(chunks, 1)
        last_b = np.searchsorted(b_ends, cut)
        out.a_n, out.b_n = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        out.a_at, out.b_at = last_a + 1 - out.a_n, last_b + 1 - out.b_n
        chunk = np.searchsorted(ends, cut)
        n = np.bincount(chunk, minlength=len(own))
        out.groups[own], out.first[own] = n, np.cumsum(n) - n
        for to, values in ((out.n_a, out.a_n), (out.n_b, out.b_n), (out.links, out.a_n * out.b_n)):
            to[own] = np.add.reduceat(values, np.cumsum(n) - n)
        return out


@lru_cache(2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def cut_chunks(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks of the texts, which of them each text has in order, and where each text's begin, with the end."""
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    offsets, values = split.offsets.to_numpy(), split.values
    coded = values.dictionary_encode()
    # a blank after a blank is no boundary: such texts are cut anew
    odd = np.array([not c or c[-1].isspace() for c in coded.dictionary.to_pylist()], bool)
    wrong = odd[coded.indices.to_numpy()] if len(odd) else np.zeros(0, bool)
    wrong[offsets[1:] - 1] = False  # nothing follows the last one
    again = np.unique(np.searchsorted(offsets, np.flatnonzero(wrong), side="right") - 1)
    if len(again):
        parts, counts, last = [], np.diff(offsets), 0
        for k in again.tolist():
            own = [c[1:] for c in _BOUNDARY.split(" " + texts[k])]
            parts += [values.slice(offsets[last], offsets[k] - offsets[last]), pa.array(own, pa.large_string())]
            counts[k], last = len(own), k + 1
        parts.append(values.slice(offsets[last]))
        coded = pa.concat_arrays(parts).dictionary_encode()
        offsets = np.concatenate(([0], np.cumsum(counts)))
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), offsets


def _spread(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of sizes[k] entries for each k."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


DOCUMENT, GROUP, TWICE = 0, 1, 2
_ROWS = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, times binary, k int, g string, documents long, a int, b int"


class _Block:
    """Documents whose distinct groups are numbered together."""

    def __init__(self, number: int):
        self.number, self.numbers, self.groups, self.names, self.documents = number, {}, [], [], []
        self.docs: list[np.ndarray] = []  # of each document the numbers of its distinct groups

    def group(self, g) -> int:
        k = self.numbers.get(g)
        if k is None:
            k = self.numbers[g] = len(self.groups)
            self.groups.append(g)
            self.names.append(written_group(g))
        return k

    def interned(self, x: Aligned) -> np.ndarray:
        """The number of each group."""
        whole = lambda k: (tuple(x.a[x.a_at[k] : x.a_at[k] + x.a_n[k]].tolist()), tuple(x.b[x.b_at[k] : x.b_at[k] + x.b_n[k]].tolist()))
        if not len(x.a_n):
            return np.empty(0, np.int64)
        single = (x.a_n == 1) & (x.b_n == 1)
        hashes = []
        for seed in (1, 2):  # 128 bits of what stands where on which side
            sums = []
            for side, (ids, at, n) in enumerate(((x.a, x.a_at, x.a_n), (x.b, x.b_at, x.b_n))):
                place = np.arange(len(ids)) - np.repeat(at, n)
                sums.append(np.add.reduceat(mix64((ids * 4 + side * 2 + seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), at))
            hashes.append(mix64(sums[0] + np.uint64(seed)) ^ mix64(sums[1] * np.uint64(3)))
        code = (x.a[x.a_at] << 32 | x.b[x.b_at]).astype(np.uint64)
        key = np.where(single, code, hashes[0] | np.uint64(1 << 63))
        _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        if (~single & (hashes[1] != hashes[1][at][inverse])).any():  # two groups with one hash
            return np.array([self.group(whole(k)) for k in range(len(single))])
        return np.array([self.group(whole(k)) for k in at.tolist()])[inverse]

    def add(self, ids: list, texts: list[str], aligner: Aligner) -> None:
        distinct, order, starts = cut_chunks(texts)
        x = aligner.align(distinct)
        flat = self.interned(x)
        names, numbers = self.names, flat.tolist()
        said = [";".join([names[k] for k in numbers[a : a + n]]) for a, n in zip(x.first.tolist(), x.groups.tolist(), strict=True)]
        listed = order.tolist()
        for doc_id, text, a, z in zip(ids, texts, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            mine = order[a:z]
            if not text or x.bad[mine].any():
                self.documents.append((doc_id, 0, 0, 0, 0, "", b"", b""))
                self.docs.append(np.empty(0, np.int64))
                continue
            held, times = np.unique(flat[_spread(x.groups[mine], x.first[mine])], return_counts=True)
            sha = hashlib.sha256(";".join([said[k] for k in listed[a:z]]).encode()).hexdigest()
            self.documents.append((doc_id, *(int(v[mine].sum()) for v in (x.n_a, x.n_b, x.groups, x.links)), sha, held, times))
            self.docs.append(held)

    def twice(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a, b, n: how many times too often documents count for a pair, as they hold it in several of their groups."""
        single = [k for k, (x, y) in enumerate(self.groups) if len(x) == len(y) == 1]
        codes = [np.array([self.groups[k][0][0] << 32 | self.groups[k][1][0] for k in single], np.int64)]
        owner = [np.array(single, np.int64)]
        for k, (x, y) in enumerate(self.groups):
            if len(x) > 1 or len(y) > 1:
                pairs = (np.unique(np.array(x, np.int64))[:, None] << 32 | np.unique(np.array(y, np.int64))).ravel()
                codes.append(pairs)
                owner.append(np.full(len(pairs), k, np.int64))
        codes, owner = np.concatenate(codes), np.concatenate(owner)
        _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
        some = counts[inverse] > 1
        codes, owner = codes[some], owner[some]
        order = np.argsort(owner, kind="stable")
        codes, owner = codes[order], owner[order]
        n = np.bincount(owner, minlength=len(self.groups))
        start = np.cumsum(n) - n
        found: Counter = Counter()
        for held in self.docs:
            own = held[n[held] > 0]
            if len(own) > 1:
                pairs, times = np.unique(codes[_spread(n[own], start[own])], return_counts=True)
                more = times > 1
                found.update(dict(zip(pairs[more].tolist(), (times[more] - 1).tolist(), strict=True)))
        pairs = np.fromiter(found, np.int64, len(found))
        return pairs >> 32, pairs & 0xFFFFFFFF, np.fromiter(found.values(), np.int64, len(found))

    def rows(self) -> Iterator[pd.DataFrame]:
        wide = "<u4" if len(self.groups) > 0xFFFF else "<u2"
        columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "times"]
        docs = pd.DataFrame(self.documents, columns=columns)
        docs["doc_id"] = pd.array([d[0] for d in self.documents], "Int64")
        docs["held"] = [x if isinstance(x, bytes) else x.astype(wide).tobytes() for x in docs["held"]]
        docs["times"] = [x if isinstance(x, bytes) else x.astype("<u4").tobytes() for x in docs["times"]]
        yield _filled(docs, DOCUMENT, self.number)
        held = np.bincount(np.concatenate(self.docs), minlength=len(self.groups)) if self.docs else np.empty(0, np.int64)
        used = np.flatnonzero(held)
        yield _filled(pd.DataFrame({"k": used.astype(np.int32), "g": [self.names[k] for k in used], "documents": held[used]}), GROUP, self.number)
        a, b, n = self.twice()
        yield _filled(pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "documents": n}), TWICE, self.number)


def _filled(pdf: pd.DataFrame, kind: int, block: int) -> pd.DataFrame:
    kinds = {"int": "Int32", "long": "Int64"}
    out = {}
    for name, of in (c.split() for c in _ROWS.split(", ")):
        out[name] = pdf[name] if name in pdf else pd.Series([None] * len(pdf), dtype=kinds.get(of, "object"))
    return pd.DataFrame(out).assign(kind=np.int32(kind), block=block)


def _blocks(paths: tuple[str, str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(*(paths or vocabulary_paths()))
        first = TaskContext.get().partitionId() << 32
        block, held, size = _Block(first), ([], []), 0
        for pdf in batches:
            for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                held[0].append(None if pd.isna(key) else int(key))
                held[1].append(text or "")
                size += len(held[1][-1])
                if size >= SLICE or len(block.documents) + len(held[0]) >= BLOCK_DOCUMENTS:
                    block.add(*held, aligner)
                    held, size = ([], []), 0
                    if len(block.documents) >= BLOCK_DOCUMENTS or len(block.groups) >= BLOCK_GROUPS:
                        yield from block.rows()
                        block = _Block(block.number + 1)
        if held[0]:
            block.add(*held, aligner)
        if block.documents:
            yield from block.rows()

    return run


def _expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """gid, documents, a, b, links of each pair of ids of each group."""
    columns = ["gid", "documents", "a", "b", "links"]
    for pdf in batches:
        out = []
        for gid, g, documents in pdf.itertuples(index=False):
            a, b = (Counter(map(int, x.split(","))) for x in g.split("|"))
            for x, m in a.items():
                out += [(gid, documents, x, y, m * n) for y, n in b.items()]
                if len(out) > 100_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        yield pd.DataFrame(out, columns=columns)


class Alignment:
    """The tables of an alignment of docs (doc_id, text): rows of blocks, groups and their links."""

    def __init__(self, docs: DataFrame, paths: tuple[str, str] | None = None):
        texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
        self.rows = written(texts.mapInPandas(_blocks(paths), _ROWS), "align-blocks", "zstd")
        groups = self.rows.where(F.col("kind") == GROUP).groupBy("g").agg(F.sum("documents").alias("documents"))
        #: gid, g (the group as written), documents that hold it
        self.groups = written(groups.withColumn("gid", F.monotonically_increasing_id()), "align-groups")
        self.expanded = written(self.groups.select("gid", "g", "documents").mapInPandas(_expanded, "gid long, documents long, a int, b int, links long"), "align-expanded")
        twice = self.rows.where(F.col("kind") == TWICE).select("a", "b", (-F.col("documents")).alias("documents"))
        counts = self.expanded.select("a", "b", "documents").union(twice).groupBy("a", "b").agg(F.sum("documents").alias("documents"))
        self.counts = written(counts, "align-counts")

    def links(self) -> DataFrame:
        """a, b, documents (those that hold the pair linked), best (whether it is its A-id's most frequent, ties included)."""
        most = self.counts.groupBy("a").agg(F.max("documents").alias("most"))
        return self.counts.join(most, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
        links = self.links().select("a", "b", F.col("documents").alias("count"), F.col("best").cast("long"))
        worth = self.expanded.join(links, ["a", "b"]).groupBy("gid").agg(F.sum(F.col("links") * F.col("best")).alias("best"), F.sum(F.col("links") * F.col("count")).alias("count"))
        worth = self.groups.select("gid", "g").join(worth, "gid").drop("gid")
        values = self.rows.where(F.col("kind") == GROUP).select("block", "k", "g").join(worth, "g").select(F.col("block").alias("of"), "k", "best", "count")
        docs = self.rows.where(F.col("kind") == DOCUMENT).select("block", F.col("doc_id").cast("string"), "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "times")
        return docs.groupBy("block").cogroup(values.groupBy("of")).applyInPandas(_summed, _SUMMED)


_SUMMED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(docs: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    size = int(values["k"].max()) + 1 if len(values) else 0
    best, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
    best[values["k"]], count[values["k"]] = values["best"], values["count"]
    sums = []
    for held, times in zip(docs["held"], docs["times"], strict=True):
        n = np.frombuffer(times, "<u4").astype(np.int64)
        k = np.frombuffer(held, f"<u{len(held) // max(1, len(n)) or 2}")
        sums.append((int((best[k] * n).sum()), int((count[k] * n).sum())))
    out = docs.assign(n_best=[s[0] for s in sums], count_sum=[s[1] for s in sums])
    out["doc_id"] = pd.array([None if pd.isna(d) else int(d) for d in docs["doc_id"]], "Int64")
    return out[[c.split()[0] for c in _SUMMED.split(", ")]]
