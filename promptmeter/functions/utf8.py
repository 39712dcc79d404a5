"""Raw bytes as text, the tolerant way: a byte that begins no sound sequence is U+FFFD and one byte is passed.

Decoders that replace whole broken sequences give fewer replacement signs; token counts of untrusted bytes hang on it.
Sound bytes take the fast way; others go through an automaton over classes of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column

from . import bpe, slices
from .pretok import split


def _length(first: int) -> int:
    """Bytes of a sequence by its first one; 0 where none begins so."""
    return 1 if first < 0x80 else 0 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4 if first < 0xF8 else 0


#: The least code point that a sequence of so many bytes may stand for.
_LEAST = (0, 0, 0x80, 0x800, 0x10000)


def decode_bytes(data: bytes | None) -> str:
    """The text of the bytes; one U+FFFD for each byte that is part of no sound sequence."""
    if not data:
        return ""
    try:
        return bytes(data).decode()
    except UnicodeDecodeError:
        pass
    out, at, n = [], 0, len(data)
    while at < n:
        size = _length(data[at])
        tail = data[at + 1 : at + size]
        if size == 1:
            stop = at + 1  # a run of ASCII at once
            while stop < n and data[stop] < 0x80:
                stop += 1
            out.append(bytes(data[at:stop]).decode("ascii"))
            at = stop
            continue
        if size and len(tail) == size - 1 and all(0x80 <= b < 0xC0 for b in tail):
            point = data[at] & (0x7F >> size)
            for b in tail:
                point = point << 6 | b & 0x3F
            if point >= _LEAST[size] and point <= 0x10FFFF and not 0xD800 <= point < 0xE000:
                out.append(chr(point))
                at += size
                continue
        out.append("�")
        at += 1
    return "".join(out)


def true_pieces(data: bytes | None, kind: str) -> list[bytes]:
    """The pieces of a pre-tokenizer with the bytes that stand there: U+FFFD made of a faulty byte is that byte again."""
    data = bytes(data or b"")
    text = decode_bytes(data)
    out, at = [], 0
    for piece in split(text, kind):
        start = at
        for c in piece:
            size = len(c.encode())
            if c == "�" and data[at : at + 3] != b"\xef\xbf\xbd":
                size = 1
            at += size
        out.append(data[start:at])
    return out


def as_text(column) -> Column:
    """Text of a BINARY column; null is empty."""
    return slices.column(column, lambda: decode_bytes, "string")


def pieces(column, kind: str) -> Column:
    """Pieces of a BINARY column, as the bytes that stand there."""
    return slices.column(column, lambda: lambda data: true_pieces(data, kind), "array<binary>")


def encode(column, encoding: bpe.Encoding) -> Column:
    """Token ids of a BINARY column by its true bytes, so that decoding gives them back."""
    from pyspark.sql import SparkSession

    if encoding.ranks is None:
        raise ValueError(f"{encoding.name} has no vocabulary")
    shared = SparkSession.getActiveSession().sparkContext.broadcast(encoding)

    def of(data):
        own = shared.value
        return [i for piece in true_pieces(data, own.kind) for i in bpe.merge(piece, own.ranks)]

    return slices.column(column, lambda: of, "array<int>")
