"""Media columns: Matroska (EBML) files in binary columns, written from samples and parsed into packet tables.

The parser reads variable-length element ids and sizes (also unknown ones), clusters, simple blocks and block
groups with no, Xiph, EBML and fixed-size lacing, and cues; each packet has its track, timestamp and byte range.
The layout follows the published EBML and Matroska specifications (RFC 8794, RFC 9559).

Edge cases: a null text is the empty text; an empty text is one frame of padding. A file that isn't Matroska, is cut
off or contradicts itself is a ValueError of parse(); in packet_table it is one row with its error and no packet, and
a null file is one such row too, so one broken file costs no other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column_udf

FRAME = 576
RATE = 8000
#: Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, NUMBER, UID, KIND, CODEC, AUDIO = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
FREQUENCY, CHANNELS, DEPTH, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA0, 0xA1
FRAME_TIME = 0x23E383
CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_PARENTS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, CUES, CUE, CUE_PLACES, GROUP}
#: Elements that end a segment child of unknown size.
_TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}


def vint(value: int, width: int = 0) -> bytes:
    """A size in the shortest (or the given) width; all ones are kept for the unknown size."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes, width: int = 0) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(body), width) + body


def number(key: int, value: int) -> bytes:
    return element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], how: int) -> bytes:
    """The body of a block after its flags: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if how == 0:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if how == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif how == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1))
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, block_frames: int = 8, cluster_blocks: int = 16) -> bytes:
    """8-bit samples as a Matroska file of one PCM track; a block's lacing goes by its place in the file."""
    frames = [payload[k : k + frame] for k in range(0, len(payload), frame)]
    ms = lambda k: k * frame * 1000 // RATE
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(FRAME_TIME, frame * 1_000_000_000 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    step = block_frames * cluster_blocks
    for c in range(0, len(frames), step):
        start = ms(c)
        body = [number(TIMESTAMP, start)]
        for b in range(c, min(c + step, len(frames)), block_frames):
            own = frames[b : min(b + block_frames, c + step)]
            how = (b // block_frames) % 3 + 1 if len(own) > 1 else 0
            body.append(element(SIMPLE, b"\x81" + struct.pack(">hB", ms(b) - start, 0x80 | how << 1) + laced(own, how)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE, number(CUE_TIME, start) + element(CUE_PLACES, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    return head + element(SEGMENT, b"".join(parts), 8)


@dataclass
class Media:
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)  # track, timestamp, start, end, key
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, byte of the cluster
    clusters: list[tuple[int, int]] = field(default_factory=list)  # byte, timestamp
    tracks: dict[int, dict] = field(default_factory=dict)
    scale: int = 1_000_000
    duration: float = 0.0


def _vint(data: bytes, at: int) -> tuple[int, int, bool]:
    """Value without the marker, where it ends, and whether all its bits are ones."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length number of up to 8 bytes at byte {at}")
    width = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    if at + width > len(data):
        raise ValueError(f"cut off in a number at byte {at}")
    return value, at + width, value == (1 << 7 * width) - 1


def _frames(data: bytes, at: int, end: int, how: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if how == 0:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    if how == 2:
        size, odd = divmod(end - at, n)
        if odd:
            raise ValueError("fixed-size lacing doesn't divide the block")
        return [(at + k * size, at + (k + 1) * size) for k in range(n)]
    sizes: list[int] = []
    for k in range(n - 1):
        if how == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            start = at
            value, at, _ = _vint(data, at)
            size = value if not k else sizes[-1] + value - (1 << 7 * (at - start) - 1) + 1
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames exceed their block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """All packets, cues, clusters and tracks of a Matroska file; ValueError where it isn't one."""
    try:
        return _parsed(data)
    except (IndexError, struct.error, OverflowError, ZeroDivisionError) as e:
        raise ValueError(f"broken file: {e}") from e


def _parsed(data: bytes) -> Media:
    out, segment, cluster_time, track, cue = Media(), 0, 0, {}, {}
    stack: list[tuple[int, int]] = []  # ends of open parents; -1: unknown
    at = 0
    while at < len(data):
        while stack and stack[-1][1] == at:
            stack.pop()
        key_width = 9 - data[at].bit_length() if data[at] else 9
        if key_width > 4:
            raise ValueError(f"no element id at byte {at}")
        key, body = int.from_bytes(data[at : at + key_width], "big"), at + key_width
        size, body, unknown = _vint(data, body)
        end = -1 if unknown else body + size
        if end > len(data):
            raise ValueError(f"element {key:X} at byte {at} is cut off")
        if end > (limit := next((e for _, e in reversed(stack) if e >= 0), len(data))):
            raise ValueError(f"element {key:X} at byte {at} ends after its parent at byte {limit}")
        while key in _TOP and stack and stack[-1][1] == -1 and (stack[-1][0] != SEGMENT or key in (EBML, SEGMENT)):
            stack.pop()
        if key in _PARENTS:
            if key == SEGMENT:
                segment = body
            elif key == CLUSTER:
                out.clusters.append((at, 0))
            elif key == TRACK:
                track = {}
            elif key == CUE:
                cue = {}
            stack.append((key, end))
            at = body
            continue
        if unknown:
            raise ValueError(f"element {key:X} of unknown size")
        value = data[body:end] if size <= 64 else b""
        if key in (SIMPLE, BLOCK):
            number_, place, _ = _vint(data, body)
            relative, flags = struct.unpack_from(">hB", data, place)
            ranges = _frames(data, place + 3, end, flags >> 1 & 3)
            step = out.tracks.get(number_, {}).get("frame_ns", 0) / out.scale
            out.packets += [(number_, cluster_time + relative + int(k * step), a, b, key == SIMPLE and flags > 127) for k, (a, b) in enumerate(ranges)]
        elif key == TIMESTAMP:
            if not out.clusters:
                raise ValueError(f"timestamp outside a cluster at byte {at}")
            cluster_time = int.from_bytes(value, "big")
            out.clusters[-1] = (out.clusters[-1][0], cluster_time)
        elif key == SCALE:
            out.scale = int.from_bytes(value, "big")
        elif key == DURATION:
            out.duration = struct.unpack(">d" if size == 8 else ">f", value)[0]
        elif key == NUMBER:
            track = out.tracks.setdefault(int.from_bytes(value, "big"), track)
        elif key == CODEC:
            track["codec"] = value.decode("ascii")
        elif key in (KIND, CHANNELS, DEPTH, FRAME_TIME):
            track[{KIND: "kind", CHANNELS: "channels", DEPTH: "depth", FRAME_TIME: "frame_ns"}[key]] = int.from_bytes(value, "big")
        elif key == FREQUENCY:
            track["rate"] = struct.unpack(">d" if size == 8 else ">f", value)[0]
        elif key == CUE_TIME:
            cue["time"] = int.from_bytes(value, "big")
        elif key == CUE_TRACK:
            cue["track"] = int.from_bytes(value, "big")
        elif key == CUE_CLUSTER:
            out.cues.append((cue.get("time", 0), cue.get("track", 0), segment + int.from_bytes(value, "big")))
        at = end
    return out


def feature(media: Media, payload: bytes) -> str:
    """What the packet table and the samples show, as key=value pairs."""
    x = np.frombuffer(payload, np.uint8)
    mean = int(x.sum(dtype=np.int64)) * 1000 // max(1, len(x))
    turns = int(np.count_nonzero((x[1:] > 127) != (x[:-1] > 127)))
    hist = "/".join(map(str, np.bincount(x >> 5, minlength=8)))
    clusters = set(media.clusters)
    seek = sum((at, t) in clusters for t, _, at in media.cues)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={seek};last_ms={media.packets[-1][1] if media.packets else 0};duration_ms={int(media.duration)};mean_milli={mean};turns={turns};hist={hist}"


_PACKET = "array<struct<packet int, track int, timestamp_ns long, start long, end long, key boolean>>"


@column_udf("array<struct<packet int, track int, timestamp_ns long, start long, end long, key boolean, error string>>")
def _packets(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in files:
        out = []
        for data in s:
            try:
                if data is None:
                    raise ValueError("no file")
                m = parse(data)
                out.append([{"packet": k, "track": t, "timestamp_ns": ts * m.scale, "start": a, "end": b, "key": key, "error": None} for k, (t, ts, a, b, key) in enumerate(m.packets)])
            except ValueError as e:
                out.append([{"packet": None, "track": None, "timestamp_ns": None, "start": None, "end": None, "key": None, "error": str(e)}])
        yield pd.Series(out)


def packet_table(files: DataFrame, key: str, media: str) -> DataFrame:
    """One row a packet of the Matroska files in column `media`: packet, track, timestamp, byte range, key flag; a broken or null file is one row with its error."""
    return files.select(key, F.explode(_packets(media)).alias("p")).select(key, "p.*")


@column_udf("binary")
def _muxed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([mux(padded(t)[1]) for t in s])


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def store(docs: DataFrame) -> DataFrame:
    """doc_id and the text's bytes as a Matroska file in column media."""
    return docs.select("doc_id", _muxed("text").alias("media"))


@column_udf("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets long")
def _round_trip(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        rows = []
        for text in s:
            n, payload = padded(text)
            file = mux(payload)
            m = parse(file)
            back = b"".join([file[a:b] for _, _, a, b, _ in m.packets])
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(m, back), len(m.packets)))
        yield pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets"])


def round_trip(docs: DataFrame) -> DataFrame:
    """Each text stored as Matroska, parsed from the stored bytes and described."""
    return docs.select("doc_id", _round_trip("text").alias("r")).select("doc_id", "r.*")
