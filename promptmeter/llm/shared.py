"""What several operators of this subpackage need: tables, written cuts of lineage, word hashes."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cut import shared_dir

_WRITTEN: list[tuple[SparkSession, str]] = []
_M64 = np.uint64(0xFF51AFD7ED558CCD)
_C64 = np.uint64(0xC4CEB9FE1A85EC53)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage ends there and lost executors cost nothing.

    The tables of a session are deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/promptmeter/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    if not _WRITTEN:
        atexit.register(_drop_written)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that written() made and that nothing reads any more."""
    for spark, path in list(_WRITTEN):
        if any(path in f for f in df.inputFiles()[:1]):
            _delete(spark, path)
            _WRITTEN.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_written() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            return


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, on an array of uint64."""
    x = (x ^ (x >> np.uint64(33))) * _M64
    x = (x ^ (x >> np.uint64(33))) * _C64
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; forgets all words once it holds too many, so its memory is bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than the width count as one shingle."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    w = min(n, width)
    x = h[: n - w + 1] + np.uint64(w)
    for j in range(1, w):
        x = x * np.uint64(0x9E3779B97F4A7C15) ^ (x >> np.uint64(29))
        x = x + h[j : n - w + 1 + j]
    return np.unique(mix64(x))


def count_words(text_col):
    """Number of words `[^\\x20\\x09-\\x0D]+`, 0 for null."""
    return F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def column_udf(schema: str, pinned: bool = False):
    """A pandas UDF that is built when it is used, so that modules import without a session.

    A pinned one stays where it is written: the optimizer would run others below a join, on rows that the join drops.
    """

    def wrap(fn):
        def call(*cols):
            udf = F.pandas_udf(fn, schema)
            return (udf.asNondeterministic() if pinned else udf)(*cols)

        call.__doc__ = fn.__doc__
        return call

    return wrap
