"""Texts, lines, snapshots and vocabularies as DataFrames."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_TEXT, MOST_LINE = 100 * 1024 * 1024, 10 * 1024 * 1024


def read_texts(spark: SparkSession, path: str | list[str], most: int = MOST_TEXT) -> DataFrame:
    """path, content of whole files; one above `most` bytes is an error."""
    out = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    stop = F.raise_error(F.concat(F.lit("file too large: "), "path"))
    return out.withColumn("content", F.when(F.octet_length("content") > most, stop).otherwise(F.col("content")))


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """One text that didn't come from a file."""
    return spark.createDataFrame([("-", text)], "path string, content string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value of each line, and error where a line is longer than 10 MB."""
    return with_line_errors(spark.read.text(path))


def with_line_errors(lines: DataFrame) -> DataFrame:
    over = F.octet_length("value") > MOST_LINE
    return lines.withColumn("error", F.when(over, "Line too long (max 10MB)")).withColumn("value", F.when(~over, F.col("value")))


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, value of the lines of a text column."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "value"))


def discover_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Relative paths of .txt, .md and .prompt files under a folder, without hidden ones and those of git."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    relative = F.expr(f"substring(path, instr(path, {_quoted(folder.rstrip('/') + '/')}) + {len(folder.rstrip('/')) + 1})")
    return files.select(relative.alias("path")).where(is_prompt_path("path"))


def is_prompt_path(path) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return path.rlike(r"\.(txt|md|prompt)$") & ~path.startswith(".") & ~path.contains(".git")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def valid_path(path: str) -> bool:
    """A relative path inside the repository that can't be mistaken for something else."""
    return bool(path) and len(path) <= 4096 and not re.search(r"[\0:]|\.\.", path) and path[0] not in "/~"


def read_revision(folder: str, revision: str, path: str) -> str | None:
    """A file as of a git revision; None where it wasn't there. Runs on the driver."""
    if not valid_path(path):
        raise ValueError(f"not a path inside a repository: {path!r}")
    try:
        done = subprocess.run(["git", "-C", folder, "--no-pager", "show", f"{revision}:{path}"], capture_output=True, text=True, check=False)
    except FileNotFoundError as e:
        raise RuntimeError("git isn't installed") from e
    if done.returncode == 0:
        return done.stdout
    if re.search("does not exist|exists on disk, but not in", done.stderr):
        return None
    if re.search("invalid object name|bad revision|unknown revision", done.stderr):
        raise ValueError(f"no revision {revision}")
    raise RuntimeError(done.stderr.strip())


def read_working_tree(folder: str, path: str, most: int = MOST_LINE) -> str | None:
    full = os.path.join(folder, path)
    if not os.path.isfile(full) or os.path.getsize(full) > most:
        return None
    with open(full, encoding="utf-8", errors="replace") as f:
        return f.read()


def snapshot(spark: SparkSession, paths: list[str], read) -> DataFrame:
    """path, content of the files that `read` finds; content is null where it finds none."""
    return spark.createDataFrame([(p, read(p)) for p in paths], "path string, content string")


def read_tiktoken(spark: SparkSession, path: str) -> DataFrame:
    """token, rank of a vocabulary of lines `<base64> <rank>`."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("value <> ''").select(F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("rank"))


def ranks_of(vocabulary: DataFrame, most: int = 1_000_000) -> dict[bytes, int]:
    """A vocabulary for the byte-pair encoder; vocabularies are small, larger ones than `most` are refused."""
    rows = vocabulary.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("vocabulary too large to share with every worker")
    return {bytes(r["token"]): r["rank"] for r in rows}


_HEAD = struct.Struct("<4sIIII32s")
MAGIC, VERSION, HEAD_BYTES = b"BPE2", 2, 64


def pack_vocabulary(ranks: dict[bytes, int]) -> bytes:
    """The binary form: head of 64 bytes, a table of offset and length by rank, all tokens; gaps have length 0."""
    by_rank = {r: t for t, r in ranks.items()}
    count = max(by_rank, default=-1) + 1
    table, blob = [], bytearray()
    for rank in range(count):
        token = by_rank.get(rank, b"")
        table.append(struct.pack("<II", len(blob), len(token)))
        blob += token
    head = _HEAD.pack(MAGIC, VERSION, count, max(map(len, ranks), default=0), len(blob), hashlib.sha256(bytes(blob)).digest())
    return head.ljust(HEAD_BYTES, b"\0") + b"".join(table) + bytes(blob)


def unpack_vocabulary(data: bytes) -> dict[bytes, int]:
    """Bytes to rank of the binary form; ValueError names what is wrong with it."""
    if len(data) < HEAD_BYTES:
        raise ValueError("truncated data")
    magic, version, count, longest, size, _ = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("invalid magic")
    if version != VERSION:
        raise ValueError("unsupported version")
    start = HEAD_BYTES + 8 * count
    if len(data) < start + size:
        raise ValueError("truncated data")
    out = {}
    for rank in range(count):
        at, length = struct.unpack_from("<II", data, HEAD_BYTES + 8 * rank)
        if at + length > size or length > longest:
            raise ValueError("invalid token table")
        if length:
            out[data[start + at : start + at + length]] = rank
    return out


def read_packed_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    return spark.createDataFrame([(bytearray(t), r) for t, r in unpack_vocabulary(data).items()], "token binary, rank int")


def tiktoken_lines(ranks: dict[bytes, int]) -> str:
    return "".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in sorted(ranks.items(), key=lambda x: x[1]))
