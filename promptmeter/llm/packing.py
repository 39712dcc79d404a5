"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Pieces are dealt by a hash into groups of bounded size; each group is packed by best-fit decreasing and its
number of sequences compared with a lower bound from dual-feasible functions. Groups that miss their bound put
the pieces of their slack sequences into a pool, which is dealt anew (documents change groups) and packed
again; the new packing of a pool counts only if it takes fewer sequences.

Edge cases: a null or empty text is one piece of one token (the end id); equal rows are separate pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slices import python_values
from .shared import written
from .word_ids import batch_ids, vocabulary_path

CAPACITY = 2048
END_ID = 0
#: Characters of texts that are cut into ids at once.
CHARS = 1_000_000
_PIECES = pa.list_(pa.struct({"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}))


def pieces_udf(path: str | None = None, capacity: int = CAPACITY):
    @F.arrow_udf("array<struct<piece int, start long, length long, ids_crc32 long>>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        where, end = path or vocabulary_path(), END_ID.to_bytes(4, "little")
        for batch in batches:
            for ids, starts in batch_ids(python_values(batch), where, CHARS):
                out = []
                for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    data = ids[a:z].tobytes() + end
                    out.append([{"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} for k, at in enumerate(range(0, len(data), 4 * capacity)) for part in (data[at : at + 4 * capacity],)])
                yield pa.array(out, _PIECES)

    return pieces


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual-feasible functions: rounding about a threshold, and Fekete and Schepers' u(k)."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * sizes)
    best = -(-int(total[-1]) // capacity)
    for eps in range(1, capacity // 2 + 1):
        big = int(number[-1] - number[capacity - eps])
        middle = int(total[capacity - eps] - total[eps - 1])
        best = max(best, big - (-middle // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times k x capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length (given in falling order) and the number of bins.

    Open bins lie in stacks by the room they have left; a bit set of the non-empty stacks finds the tightest fit.
    """
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    rooms: dict[int, list[int]] = {}
    some = 0
    for k, length in enumerate(lengths.tolist()):
        fits = some >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                some ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[k], offsets[k] = b, capacity - room
        if left := room - length:
            rooms.setdefault(left, []).append(b)
            some |= 1 << left
    return bins, offsets, used


_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _packer(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, used = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=pdf["length"], minlength=used).astype(np.int64)
        return pdf.assign(bin=bins, offset=offsets, fill=fill[bins], bins=used, bound=lower_bound(pdf["length"].to_numpy(), capacity))

    return pack


def _packed(items: DataFrame, n_items: int, round_no: int, group_items: int, capacity: int) -> DataFrame:
    groups = max(1, -(-n_items // group_items))
    deal = F.pmod(F.xxhash64(F.lit(round_no), "doc_id", "piece", "ids_crc32"), F.lit(groups))
    out = items.select(*(c.split()[0] for c in _ITEM.split(", "))).withColumn("grp", deal)
    out = out.groupBy("grp").applyInPandas(_packer(capacity), f"{_ITEM}, grp long, bin long, offset long, fill long, bins long, bound long")
    return written(out.withColumn("round", F.lit(round_no)), f"packing-{round_no}")


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long"), F.explode(pieces_udf(path, capacity)("text")).alias("p")).select("doc_id", "p.*")


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = 4096, rounds: int = 4) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Also given: certified (the group's number of sequences equals its lower bound).
    """
    items = written(items, "pieces")
    current = _packed(items, items.count(), 0, group_items, capacity)
    done: list[DataFrame] = []
    for k in range(1, rounds + 1):
        slack = (F.col("bins") > F.col("bound")) & (F.col("fill") <= capacity - capacity // 64)
        pool = current.where(slack)
        before = pool.agg(F.count("*").alias("n"), F.sum(F.when(F.col("offset") == 0, 1).otherwise(0)).alias("bins")).first()
        if not before["n"]:
            break
        again = _packed(pool, before["n"], k, group_items, capacity)
        after = again.agg(F.sum(F.when(F.col("offset") == 0, 1).otherwise(0)).alias("bins")).first()["bins"]
        if after >= before["bins"]:
            break
        done.append(current.where(~slack))
        current = again
    out = current
    for part in done:
        out = out.unionByName(part)
    number = (F.col("round").cast("long") * (1 << 54)) + F.col("grp") * (1 << 22) + F.col("bin")
    return out.select(*(c.split()[0] for c in _ITEM.split(", ")), number.alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified"))
