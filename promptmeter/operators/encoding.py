"""Byte-pair encoding of a corpus in which each distinct piece is merged once in the cluster.

Texts are dealt to blocks as they are read. A block numbers its distinct pieces; a text is the numbers of its pieces
in order. The pieces of all blocks are grouped (a piece counts once a block, so a frequent one is a few rows, not one
a text), merged once, and their ids go back to each block, which puts the ids of its texts together.

Edge cases: null and empty texts have no piece and no id; rows with equal keys stay apart; an encoding without
vocabulary has pieces, but no ids.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bpe import Encoding, merge
from ..functions.pretok import split
from ..sources.cut import cut

#: Characters and texts of a block.
BLOCK, TEXTS = 4_000_000, 10_000
#: Pieces of a block that go out at once.
OUT = 10_000
_TEXT, _PIECE = 0, 1
_ROWS = "kind int, block long, key string, places binary, k int, piece string, occurrences long, documents long"


def _blocks(kind: str, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32

        def rows(keys: list, cuts: list[np.ndarray], known: dict[str, int]) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"kind": _TEXT, "block": number, "key": keys, "places": [c.tobytes() for c in cuts], "k": None, "piece": None, "occurrences": None, "documents": None})
            occurrences, documents = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            for c in cuts:
                held, n = np.unique(c, return_counts=True)
                occurrences[held] += n
                documents[held] += 1
            names = list(known)
            for k in range(0, len(names), OUT):
                part = slice(k, k + OUT)
                own = names[part]
                yield pd.DataFrame({"kind": _PIECE, "block": number, "key": None, "places": None, "k": np.arange(k, k + len(own), dtype=np.int32), "piece": own, "occurrences": occurrences[part], "documents": documents[part]})

        # a text's pieces become numbers as it is read, so a block holds each distinct piece once
        keys, cuts, known, held = [], [], defaultdict(count().__next__), 0
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                keys.append(key)
                cuts.append(np.array([known[p] for p in split(text, kind)], "<i4"))
                held += len(text or "")
                if held >= size or len(keys) >= TEXTS:
                    yield from rows(keys, cuts, known)
                    keys, cuts, known, held, number = [], [], defaultdict(count().__next__), 0, number + 1
        if keys:
            yield from rows(keys, cuts, known)

    return run


def _merged(encoding):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = encoding.value.ranks
        for pdf in batches:
            yield pdf.assign(ids=[np.array(merge(p.encode("utf-8", "replace"), ranks), "<i4") for p in pdf["piece"]])

    return run


class PieceTable:
    """Texts (key, text) cut into pieces by an encoding."""

    def __init__(self, texts: DataFrame, key: str, text: str, encoding: Encoding, block: int = BLOCK):
        self.encoding, self.key, self.kind = encoding, key, texts.schema[key].dataType
        given = texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
        self.rows = cut(given.mapInPandas(_blocks(encoding.kind, block), _ROWS), "pieces")

    def pieces(self) -> DataFrame:
        """piece, occurrences, documents (texts that hold it) of each distinct piece."""
        own = self.rows.where(F.col("kind") == _PIECE)
        return own.groupBy("piece").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))

    def merged(self) -> DataFrame:
        """pieces() with ids: each distinct piece is merged once."""
        if self.encoding.ranks is None:
            raise ValueError(f"{self.encoding.name} has no vocabulary")
        shared = self.rows.sparkSession.sparkContext.broadcast(self.encoding)  # vocabularies are bounded, see ranks_of
        return self.pieces().mapInPandas(_merged(shared), "piece string, occurrences long, documents long, ids array<int>")

    def _back(self, value, kind: str, put, returns: str) -> DataFrame:
        known = self.merged().select("piece", value.alias("value"))
        values = self.rows.where(F.col("kind") == _PIECE).select(F.col("block").alias("of"), "k", "piece").join(known, "piece").select("of", "k", "value")
        texts = self.rows.where(F.col("kind") == _TEXT).select("block", "key", "places")

        def run(docs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            by_place = own.sort_values("k")["value"].to_numpy()
            return pd.DataFrame({"key": docs["key"], "out": put([np.frombuffer(p, "<i4") for p in docs["places"]], by_place)})

        done = texts.groupBy("block").cogroup(values.groupBy("of")).applyInPandas(run, f"key string, out {returns}")
        return done.select(F.col("key").cast(self.kind).alias(self.key), F.col("out").alias(kind))

    def counts(self) -> DataFrame:
        """key, tokens of every text."""
        return self._back(F.size("ids").cast("long"), "tokens", lambda places, n: [int(n[p].sum()) if len(p) else 0 for p in places], "long")

    def ids(self) -> DataFrame:
        """key, ids of every text."""

        def put(places, ids):
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate([*ids, np.empty(0, np.int32)]) if len(ids) else np.empty(0, np.int32)
            first = np.cumsum(size) - size
            out = []
            for p in places:
                n = size[p]
                ends = np.cumsum(n)
                out.append(flat[np.arange(int(ends[-1]) if len(p) else 0) + np.repeat(first[p] - ends + n, n)])
            return out

        return self._back(F.col("ids"), "ids", put, "array<int>")

    def used(self) -> DataFrame:
        """token (rank), occurrences of every token that the texts use: a piece's ids count as often as the piece."""
        return self.merged().select("occurrences", F.explode("ids").alias("token")).groupBy("token").agg(F.sum("occurrences").alias("occurrences"))

    def utilisation(self, rare: int = 5) -> DataFrame:
        """One row: vocabulary, used, unused, rare (used at most `rare` times), tokens. What is used is a bit map, so the count of a vocabulary's tokens bounds the sums."""
        used = self.used().select("occurrences", "token", F.expr("bitmap_bucket_number(token + 1)").alias("bucket"), F.expr("bitmap_bit_position(token + 1)").alias("bit"))
        maps = used.groupBy("bucket").agg(F.expr("bitmap_count(bitmap_construct_agg(bit))").alias("n"), F.sum("occurrences").alias("tokens"), F.count_if(F.col("occurrences") <= rare).alias("rare"))
        size = F.lit(len(self.encoding.ranks)).cast("long")
        sums = maps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("used"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("rare"), F.lit(0)).alias("rare"))
        return sums.select(size.alias("vocabulary"), F.col("used"), (size - F.col("used")).alias("unused"), "rare", "tokens")

    def unused(self, vocabulary: DataFrame) -> DataFrame:
        """The tokens (token, rank) of the vocabulary that no text uses."""
        return vocabulary.join(self.used().select(F.col("token").alias("rank")), "rank", "left_anti")
