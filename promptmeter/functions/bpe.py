"""Byte-pair encoding over pre-tokenized pieces, with a vocabulary given as bytes to rank.

A piece's ids depend on its bytes alone, so each Python worker remembers the pieces it has met, up to a
bound. Without a vocabulary there are no ids; counts are then word counts and say so.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pretok import split
from .slices import column
from .text import approximate_tokens

LONGEST = 256  # bytes of a token that merging looks up


@dataclass
class Encoding:
    """Pre-tokenizer and vocabulary; specials are known but never produced from ordinary text."""

    name: str
    kind: str
    ranks: dict[bytes, int] | None = None
    specials: dict[str, int] = field(default_factory=dict)


# Special tokens of the two public encodings.
CL100K = Encoding("cl100k_base", "cl100k", None, {"<|endoftext|>": 100257, "<|fim_prefix|>": 100258, "<|fim_middle|>": 100259, "<|fim_suffix|>": 100260, "<|endofprompt|>": 100276})
O200K = Encoding("o200k_base", "o200k", None, {"<|endoftext|>": 199999, "<|endofprompt|>": 200018})
ENCODINGS = {e.name: e for e in (CL100K, O200K)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of lowest rank merges first, the leftmost of equals; unknown bytes are id 0.

    Parts are named by where they start; a heap holds the possible merges, and those whose parts have changed are passed over.
    """
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        if a >= 0 and (b := end[a]) < n:
            stop = end[b]
            if stop - a <= LONGEST and (rank := ranks.get(piece[a:stop])) is not None:
                heapq.heappush(heap, (rank, a, stop))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, stop = heapq.heappop(heap)
        if not alive[a] or (b := end[a]) >= n or not alive[b] or end[b] != stop:
            continue
        alive[b] = False
        end[a] = stop
        if stop < n:
            before[stop] = a
        offer(before[a])
        offer(a)
    return [ranks.get(piece[a : end[a]], 0) for a in range(n) if alive[a]]


def native_merger(encoding: Encoding):
    """A compiled function piece -> ids with the same ranks, or None where none is installed or it could differ.

    It needs all 256 single bytes, and takes a piece that is itself a token as it is, so such pieces are merged here.
    """
    ranks = encoding.ranks
    try:
        from tiktoken._tiktoken import CoreBPE
    except ImportError:
        return None
    if any(bytes([b]) not in ranks for b in range(256)) or max(map(len, ranks)) > LONGEST:
        return None
    core = CoreBPE(ranks, {}, r"(?s:.)")
    return lambda piece: merge(piece, ranks) if piece in ranks else core.encode_single_piece(piece)


class Encoder:
    """Ids of pieces, remembered in two generations: a full one becomes the old one, whose pieces come back on use."""

    def __init__(self, encoding: Encoding, most: int = 100_000, native: bool = True):
        if encoding.ranks is None:
            raise ValueError(f"{encoding.name} has no vocabulary")
        self.encoding, self.most = encoding, most
        self.merge = native and native_merger(encoding) or (lambda piece: merge(piece, encoding.ranks))
        self.memo: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def piece(self, p: str) -> list[int]:
        ids = self.memo.get(p)
        if ids is None:
            ids = self.old.get(p)
            if ids is None:
                ids = self.merge(p.encode("utf-8", "replace"))
            if len(self.memo) >= self.most:
                self.old, self.memo = self.memo, {}
            self.memo[p] = ids
        return ids

    def ids(self, text: str | None) -> list[int]:
        return [i for p in split(text, self.encoding.kind) for i in self.piece(p)]

    def count(self, text: str | None) -> int:
        memo, piece = self.memo.get, self.piece
        return sum(len(memo(p) or piece(p)) for p in split(text, self.encoding.kind))


def _column(text, encoding: Encoding, of, returns: str) -> Column:
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(encoding)

    def make():
        encoder = Encoder(shared.value)
        return lambda t: of(encoder, t)

    return column(text, make, returns)


def encode(text, encoding: Encoding) -> Column:
    """Token ids; an encoding without vocabulary is an error."""
    return _column(text, encoding, Encoder.ids, "array<int>")


def count_tokens(text, encoding: Encoding | None) -> Column:
    """struct(tokens, approximate): exact with a vocabulary, else the number of words (1 if there are only blanks)."""
    if encoding is None or encoding.ranks is None:
        return F.struct(approximate_tokens(text).alias("tokens"), F.lit(True).alias("approximate"))
    return F.struct(_column(text, encoding, Encoder.count, "long").alias("tokens"), F.lit(False).alias("approximate"))


def decode(rows: DataFrame, ids: str, vocabulary: DataFrame) -> DataFrame:
    """rows with column `bytes`: the ids' bytes in order; ids that the vocabulary (token, rank) lacks add none.

    Vocabularies are bounded (ranks_of refuses larger ones), so every worker has the whole one.
    """
    from ..sources.files import ranks_of

    shared = rows.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks_of(vocabulary).items()})

    def make():
        token = shared.value.get
        return lambda x: b"" if x is None else b"".join(token(i, b"") for i in x)

    return rows.withColumn("bytes", column(F.col(ids), make, "binary"))


def parity_counts(cases: DataFrame, encodings: dict[str, Encoding]) -> DataFrame:
    """passed, failed, skipped of cases (encoding, text, tokens): whether encoding the text gives the tokens; unknown encodings are skipped."""
    verdict = F.lit("skipped")
    for name, encoding in encodings.items():
        if encoding.ranks is not None:
            verdict = F.when(F.col("encoding") == name, F.when(encode("text", encoding) == F.col("tokens"), "passed").otherwise("failed")).otherwise(verdict)
    kinds = cases.select(verdict.alias("v"))
    return kinds.agg(*(F.count_if(F.col("v") == v).alias(v) for v in ("passed", "failed", "skipped")))
