"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle is hashed once; the upper bits choose its bin, the rest is its value, and a bin keeps its minimum.
Empty bins copy the bin that a 2-universal sequence of probes reaches first. `BITS` low-order bits of each of the
`BINS` values are stored, and the share of agreeing bins is corrected for accidental agreement.

Documents are compared with their next in order of doc_id: one shuffle by ranges of doc_id, a pass over each sorted
partition, and a join of each partition's last row with the first of the next one by the partitions' numbers. What
the driver holds and what a plan says don't depend on the number of rows.

Edge cases: null and empty texts and texts without words have the fingerprint of no shingles, an empty string,
whose likeness is 1 to itself and 0 to others; fewer than five words are one shingle. Rows with one doc_id follow by
a hash of their text. Rows whose doc_id is null have no place in the order: they have their size and fingerprint, and
null for what needs a next document. A document that is alone is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mix64, shingles, written

BINS, BITS, WIDTH = 256, 8, 5
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BIN = np.arange(BINS, dtype=np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> bytes:
    h = shingles(text, width)
    if not len(h):
        return b""
    bins = np.full(BINS, _EMPTY, np.uint64)
    home = (h >> _SHIFT).astype(np.int64)
    # the hashes are sorted, so the first of each bin is its minimum
    first = np.flatnonzero(np.diff(home, prepend=-1))
    bins[home[first]] = h[first]
    full = bins != _EMPTY
    open_bins, attempt = np.flatnonzero(~full), 1
    while len(open_bins):
        probe = (mix64(_BIN[open_bins] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) >> _SHIFT).astype(np.int64)
        hit = full[probe]
        bins[open_bins[hit]] = bins[probe[hit]]
        open_bins, attempt = open_bins[~hit], attempt + 1
    return packed(mix64(bins))


def packed(values: np.ndarray, bits: int = BITS) -> bytes:
    """The low-order bits of each value, without gaps."""
    if bits == 8:
        return values.astype(np.uint8).tobytes()
    return np.packbits((values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()


def unpacked(data: bytes, bits: int = BITS) -> np.ndarray:
    if bits == 8:
        return np.frombuffer(data, np.uint8)
    rows = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: len(data) * 8 // bits * bits].reshape(-1, bits)
    return rows.astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity: agreement of the bins, less what b bits agree by accident."""
    if not a or not b:
        return float(a == b)
    same = float((unpacked(a) == unpacked(b)).mean())
    accident = 0.5**BITS
    return min(1.0, max(0.0, (same - accident) / (1 - accident)))


def _edited(text: str, following: str) -> str:
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def _compared(doc_id: int, text: str, own: bytes, following: str, next_print: bytes) -> tuple:
    edited = _edited(text, following)
    edited_print = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).digest(), own, edited_print, likeness(own, edited_print), likeness(own, next_print)


_OUT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
#: Kinds of rows of a pass: compared ones, and the first and the last of a partition, which carry their text.
DONE, FIRST, LAST = 0, 1, 2


def _pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares the rows (doc_id, text) of one sorted partition, each with the one after it."""
    place, held = TaskContext.get().partitionId(), None
    columns = ["kind", "place", *_NAMES, "text"]
    for pdf in batches:
        out = []
        for doc_id, text in pdf[["doc_id", "text"]].itertuples(index=False):
            own = fingerprint(text)
            if held:
                out.append((DONE, place, *_compared(*held, text, own), None))
            else:
                out.append((FIRST, place, doc_id, len(text), None, own, None, None, None, text))
            held = doc_id, text, own
        yield pd.DataFrame(out, columns=columns)
    if held:
        yield pd.DataFrame([(LAST, place, held[0], len(held[1]), None, held[2], None, None, None, held[1])], columns=columns)


def _at_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([_compared(*row) for row in pdf.itertuples(index=False)], columns=_NAMES)


def _alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([(None, len(t), None, fingerprint(t), None, None, None) for t in pdf["text"]], columns=_NAMES)


def compare_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness to one another and to the next document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "h", "text"]
    ranged = docs.where("doc_id is not null").withColumn("h", F.xxhash64("text"))
    ranged = ranged.repartitionByRange(*([partitions] if partitions else []), "doc_id", "h").sortWithinPartitions(*order).select("doc_id", "text")
    rows = written(ranged.mapInPandas(_pass, f"kind int, place int, {_OUT}, text string"), "fingerprints")
    first = rows.where(F.col("kind") == FIRST).select("place", F.col("text").alias("following"), F.col("fingerprint").alias("next_print"))
    # the partition after each one that has rows; after the last the first: one number a partition
    around = first.select("place").withColumn("next", F.coalesce(F.lead("place").over(Window.orderBy("place")), F.min("place").over(Window.partitionBy())))
    last = rows.where(F.col("kind") == LAST).join(around, "place").join(first.withColumnRenamed("place", "next"), "next")
    edges = last.select("doc_id", "text", F.col("fingerprint").alias("own"), "following", "next_print").mapInPandas(_at_edges, _OUT)
    alone = docs.where("doc_id is null").select("text").mapInPandas(_alone, _OUT)
    out = rows.where(F.col("kind") == DONE).select(*_NAMES).union(edges).union(alone)
    return out.select(*(F.lower(F.hex(c)).alias(c) if "fingerprint" in c or "sha256" in c else F.col(c) for c in _NAMES))
