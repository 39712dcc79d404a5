"""Token ids in files of a static range asymmetric numeral system (rANS).

Ids of documents, in ascending order of doc_id, are written to shards in the folder that driver and executors share.
One table of frequencies, counted over all ids, serves every shard. A shard consists of parts (whole documents, about
PART ids), a part of independent blocks of BLOCK ids. In a block the ids are dealt to LANES interleaved coders, whose
states are 64 bits and which give off 32-bit words into one stream. Every CHECKPOINT ids the block's header notes the
coders' states and the place in the stream, so each such segment decodes by itself, and numpy decodes the segments of
a block at once. Blocks carry a CRC-32 of their ids, indexes one of their bytes: a damaged file is an error, not
wrong ids.

Layout, little-endian. Table: magic `RANT`, scale bits (int32), number of symbols (int64), the symbols' ids and
frequencies (uint32 each), crc32. Shard: magic `RANS`, then its parts. Part: magic `PART`, documents, ids, blocks
(int64 each), doc_ids (int64), whether they are null (uint8), ids of each document (int64), of each block its length
in bytes (int64) and the CRC-32 of its ids (uint32), crc32 of all this; then the blocks: for each segment the LANES
states (uint64) and its place (int64), then the words (uint32). Shards are named by range and first part, so their
names ascend as the documents do. The manifest, the table that write() returns, has a row for each part; a shard whose
task failed is not named there, so readers never see it.

Texts are sorted by ranges of doc_id before they become ids; ids are then written once as plain parts, counted, and
coded part by part, without another shuffle.

Edge cases: null and empty texts are one id, the end id; rows without doc_id come after all others; rows with one
doc_id follow in the order of a hash of their text, equal rows side by side; a document of any length is whole in one
part.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written
from .word_ids import batch_ids, vocabulary_path

SCALE, LANES = 20, 64
CHECKPOINT = LANES * 128
BLOCK = CHECKPOINT * 16
#: Ids of a part, and blocks that are coded at once.
PART, TOGETHER = 1 << 20, 16
END_ID = 1
_LOW = np.uint64(1 << 31)
_32, _S = np.uint64(32), np.uint64(SCALE)


# the code


def normalised(counts: np.ndarray, bits: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2^bits, at least 1 for each counted symbol, near the counts' shares."""
    counts = np.asarray(counts, np.int64)
    used, total, room = int((counts > 0).sum()), int(counts.sum()), 1 << bits
    if not used:
        return np.zeros(len(counts), np.int64)
    if used > room:
        raise ValueError(f"{used} symbols don't fit {bits} bits")
    share = counts / total * (room - used)
    out = np.floor(share).astype(np.int64)
    rest = np.where(counts > 0, share - out, -1.0)
    out[np.argsort(-rest, kind="stable")[: room - used - int(out.sum())]] += 1
    return out + (counts > 0)


class Table:
    """Frequencies, where each symbol's slots begin, and the symbol of each slot; symbols are numbered by rank in `ids`."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = np.asarray(ids, np.uint32), np.asarray(freq, np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))
        self.rank = np.full(int(self.ids.max(initial=0)) + 1, -1, np.int32)
        self.rank[self.ids] = np.arange(len(self.ids))

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        order = np.argsort(ids, kind="stable")
        return cls(np.asarray(ids)[order], normalised(np.asarray(counts)[order]))

    def to_bytes(self) -> bytes:
        body = struct.pack("<4siq", b"RANT", SCALE, len(self.ids)) + self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        magic, bits, n = struct.unpack_from("<4siq", data)
        if magic != b"RANT" or bits != SCALE or len(data) != 20 + 8 * n or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a table of frequencies, or a damaged one")
        return cls(np.frombuffer(data, "<u4", n, 16), np.frombuffer(data, "<u4", n, 16 + 4 * n))


def encode_blocks(symbols: np.ndarray, table: Table) -> list[bytes]:
    """Bodies of blocks of one length each: rows of symbols."""
    blocks, n = symbols.shape
    steps = -(-n // LANES)
    f = np.zeros((blocks, steps * LANES), np.uint64)
    c = np.zeros_like(f)
    f[:, :n], c[:, :n] = table.freq[symbols], table.start[symbols]
    f, c = f.reshape(blocks, steps, LANES), c.reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), _LOW)
    per = CHECKPOINT // LANES
    segments = -(-steps // per)
    states = np.empty((blocks, segments, LANES), np.uint64)
    gave = np.zeros((blocks, steps, LANES), bool)
    words = np.zeros((blocks, steps, LANES), np.uint32)
    for t in range(steps - 1, -1, -1):
        ft = f[:, t]
        live = ft > 0
        full = live & (x >= ft << np.uint64(63 - SCALE))
        gave[:, t], words[:, t] = full, x.astype(np.uint32)
        x = np.where(full, x >> _32, x)
        quotient, rest = np.divmod(x, np.where(live, ft, np.uint64(1)))
        x = np.where(live, (quotient << _S) + rest + c[:, t], x)
        if t % per == 0:
            states[:, t // per] = x
    counts = gave.sum(2)
    out = []
    for b in range(blocks):
        at = np.concatenate(([0], np.cumsum(counts[b])))[: steps : per].astype("<i8")
        head = np.concatenate((states[b], at.astype(np.uint64)[:, None]), 1).astype("<u8")
        out.append(head.tobytes() + words[b][gave[b]].astype("<u4").tobytes())
    return out


def decode_block(body: bytes, n: int, table: Table) -> np.ndarray:
    """The n symbols of a block, all its segments at once."""
    steps, per = -(-n // LANES), CHECKPOINT // LANES
    segments = -(-steps // per)
    head = np.frombuffer(body, "<u8", segments * (LANES + 1)).reshape(segments, LANES + 1)
    words = np.append(np.frombuffer(body, "<u4", offset=head.nbytes).astype(np.uint64), np.uint64(0))
    x, at = head[:, :LANES].copy(), head[:, LANES].astype(np.int64)
    out = np.zeros((segments, per, LANES), np.uint32)
    mask, last = np.uint64((1 << SCALE) - 1), n - (segments - 1) * CHECKPOINT
    for t in range(per):
        slot = x & mask
        symbol = table.slot[slot]
        new = table.freq[symbol] * (x >> _S) + slot - table.start[symbol]
        if last - t * LANES < LANES:  # the last segment may be shorter
            over = np.arange(LANES) >= last - t * LANES
            symbol[-1, over], new[-1, over] = 0, x[-1, over]
        low = new < _LOW
        if last - t * LANES < LANES:
            low[-1, over] = False
        place = at[:, None] + np.cumsum(low, 1) - low
        x = np.where(low, (new << _32) | words[np.where(low, place, -1)], new)
        at += low.sum(1)
        out[:, t] = symbol
    return out.reshape(-1)[:n]


def encode_part(docs: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    symbols = table.rank[np.minimum(ids, len(table.rank) - 1)]
    if len(ids) and (symbols.min() < 0 or ids.max() >= len(table.rank)):
        raise ValueError("an id that the table lacks")
    cuts = range(0, len(ids), BLOCK)
    bodies, whole = [], len(ids) // BLOCK
    for k in range(0, whole, TOGETHER):
        m = min(TOGETHER, whole - k)
        bodies += encode_blocks(symbols[k * BLOCK : (k + m) * BLOCK].reshape(m, BLOCK), table)
    if len(ids) % BLOCK:
        bodies += encode_blocks(symbols[None, whole * BLOCK :], table)
    head = struct.pack("<4sqqq", b"PART", len(docs), len(ids), len(bodies)) + docs.astype("<i8").tobytes() + null.astype("u1").tobytes() + lengths.astype("<i8").tobytes()
    head += np.array([len(b) for b in bodies], "<i8").tobytes() + np.array([zlib.crc32(ids[a : a + BLOCK]) for a in cuts], "<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(bodies)


def decode_part(data: bytes, table: Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document of a part."""
    magic, n_docs, n_ids, n_blocks = struct.unpack_from("<4sqqq", data)
    at = 28
    docs, at = np.frombuffer(data, "<i8", n_docs, at), at + 8 * n_docs
    null, at = np.frombuffer(data, "u1", n_docs, at), at + n_docs
    lengths, at = np.frombuffer(data, "<i8", n_docs, at), at + 8 * n_docs
    sizes, at = np.frombuffer(data, "<i8", n_blocks, at), at + 8 * n_blocks
    sums, at = np.frombuffer(data, "<u4", n_blocks, at), at + 4 * n_blocks
    if magic != b"PART" or zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("damaged index of a part")
    at, held, k = at + 4, np.empty(0, np.uint32), 0
    for b in range(n_blocks):
        body, at = data[at : at + sizes[b]], at + sizes[b]
        ids = table.ids[decode_block(body, min(BLOCK, n_ids - b * BLOCK), table)]
        if zlib.crc32(ids) != sums[b]:
            raise ValueError(f"damaged block {b}")
        held, used = np.concatenate((held, ids)), 0
        while k < n_docs and used + lengths[k] <= len(held):
            yield None if null[k] else int(docs[k]), held[used : used + lengths[k]]
            used, k = used + int(lengths[k]), k + 1
        held = held[used:]


# files


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, ...) or of a path without scheme."""
    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


_PLAIN = "place long, part long, documents long, tokens long, docs binary, nulls binary, lengths binary, wide boolean, ids binary"


def _plain_parts(path: str | None, end_id: int):
    """Parts of consecutive documents as plain ids, of 16 bits each where they fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, end, place, part = path or vocabulary_path(), np.array([end_id], np.uint32), TaskContext.get().partitionId(), 0
        docs, ids, size = [], [], 0

        def row() -> pd.DataFrame:
            null, numbers = np.array([d is None for d in docs]), np.array([d or 0 for d in docs], np.int64)
            lengths, all_ids = np.array([len(x) for x in ids], np.int64), np.concatenate(ids)
            wide = int(all_ids.max()) > 0xFFFF
            values = (place, part, len(docs), len(all_ids), numbers.tobytes(), null.tobytes(), lengths.tobytes(), wide, all_ids.astype("<u4" if wide else "<u2").tobytes())
            return pd.DataFrame([values], columns=[c.split()[0] for c in _PLAIN.split(", ")])

        for pdf in batches:
            keys = iter(pdf["doc_id"])  # strings: as numbers they would lose digits beside nulls
            for some, starts in batch_ids(pdf["text"], where):
                for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    key = next(keys)
                    docs.append(None if pd.isna(key) else int(key))
                    ids.append(np.concatenate((some[a:z], end)))
                    size += z - a + 1
                    if size >= PART:
                        yield row()
                        docs, ids, size, part = [], [], 0, part + 1
        if docs:
            yield row()

    return run


def plain_parts(docs: DataFrame, path: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """The ids of docs (doc_id, text) with the end id after each, in ascending order of doc_id, as a written table of parts."""
    keys = ["none", "doc_id", "h", "tie"]
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie"), "text")
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    return written(ranged.select(F.col("doc_id").cast("string"), "text").mapInPandas(_plain_parts(path, end_id), _PLAIN), "rans-plain", "zstd")


def _ids(row) -> np.ndarray:
    return np.frombuffer(row.ids, "<u4" if row.wide else "<u2").astype(np.uint32)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(0, np.int64)
    for pdf in batches:
        for row in pdf.itertuples():
            own = np.bincount(_ids(row), minlength=len(total))
            own[: len(total)] += total
            total = own
    some = np.flatnonzero(total)
    yield pd.DataFrame({"id": some, "n": total[some]})


def frequencies(parts: DataFrame) -> Table:
    """The table of all ids: as many entries as the vocabulary has, whatever the number of documents."""
    found = parts.select("wide", "ids").mapInPandas(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return Table.of(np.array([r["id"] for r in found], np.int64), np.array([r["n"] for r in found], np.int64))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows by a schema; whole numbers beside nulls keep their digits."""
    columns = zip(*rows, strict=True)
    return pd.DataFrame({c.split()[0]: pd.array(list(x), "Int64") if c.endswith(" long") else list(x) for c, x in zip(schema.split(", "), columns, strict=True)})


_MANIFEST = "file string, at long, size long, place long, part long, documents long, tokens long, first_id long, last_id long"


def write(parts: DataFrame, folder: str | None = None) -> DataFrame:
    """Codes a written table of plain parts into shards in the folder; gives the manifest, one row a part."""
    spark = parts.sparkSession
    folder = folder or f"{shared_dir(spark)}/promptmeter/rans-{uuid.uuid4().hex}"
    table = frequencies(parts).to_bytes()
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/table.rant")
    stream = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(name)
    stream.write(table)
    stream.close()

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, system, made = Table.from_bytes(table), None, []
        place, out, file, at = None, None, "", 0
        for pdf in batches:
            for row in pdf.itertuples():
                if row.place != place:
                    if out:
                        out.close()
                    place, file, at = row.place, f"{folder}/shard-{row.place:06d}-{row.part:06d}-{uuid.uuid4().hex}.rans", 4
                    system, inner = _file_system(file)
                    out = system.open_output_stream(inner)
                    out.write(b"RANS")
                docs, null = np.frombuffer(row.docs, "<i8"), np.frombuffer(row.nulls, bool)
                body = encode_part(docs, null, np.frombuffer(row.lengths, "<i8"), _ids(row), own)
                out.write(body)
                made.append((file, at, len(body), row.place, row.part, row.documents, row.tokens, *((int(docs[~null][0]), int(docs[~null][-1])) if not null.all() else (None, None))))
                at += len(body)
        if out:
            out.close()  # parts are named only when their shard is whole
        if made:
            yield _frame(made, _MANIFEST)

    return written(parts.mapInPandas(shards, _MANIFEST).withColumn("table", F.lit(f"{folder}/table.rant")), "rans-manifest")


def _documents(manifest: DataFrame, of, schema: str) -> DataFrame:
    """of(doc_id, start, ids) of every document of the files; each part is decoded by itself."""
    # a row a part: sums before each within its range, and a row a range: sums before it
    ranges = manifest.groupBy("place").agg(F.sum("tokens").alias("all"))
    ranges = ranges.select("place", (F.sum("all").over(Window.orderBy("place")) - F.col("all")).alias("before"))
    inside = Window.partitionBy("place").orderBy("part")
    parts = manifest.withColumn("own", F.sum("tokens").over(inside) - F.col("tokens")).join(ranges, "place")
    parts = parts.select("file", "at", "size", "table", (F.col("before") + F.col("own")).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, own, out = None, None, []
        for pdf in batches:
            for file, at, size, table, start in pdf.itertuples(index=False):
                if table != name:
                    system, inner = _file_system(table)
                    with system.open_input_stream(inner) as f:
                        name, own = table, Table.from_bytes(f.read())
                system, inner = _file_system(file)
                with system.open_input_file(inner) as f:
                    f.seek(at)
                    data = f.read(size)
                if len(data) != size:
                    raise ValueError(f"{file} ends early")
                for doc_id, ids in decode_part(data, own):
                    out.append(of(doc_id, start, ids))
                    start += len(ids)
                    if len(out) == 2000:
                        yield _frame(out, schema)
                        out = []
        if out:
            yield _frame(out, schema)

    # parts are few rows: dealt to tasks by their place
    return parts.repartitionByRange(manifest.sparkSession.sparkContext.defaultParallelism, "start").mapInPandas(run, schema)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document of the files."""
    return _documents(manifest, lambda doc_id, start, ids: (doc_id, start, ids.tolist()), "doc_id long, start long, ids array<long>")


def digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids (little-endian unsigned 32-bit) of every document of the files."""
    return _documents(manifest, lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))), "doc_id long, start long, n_tokens long, ids_crc32 long")
