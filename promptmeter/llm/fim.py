"""Fill-in-the-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of one character class (blank or not) with the cumulative number of units up to
each run's end. A cut after k units is found by binary search of the run that holds the k-th unit; its offset follows
by arithmetic from the run's start, its units and their width. Units are `words` (blanks and the word after them; the
blanks after the last word are one unit) or `chars` (code points). Runs lie over UTF-8 bytes, as blanks are ASCII, so
texts are never decoded; where code points are counted, only bytes that begin one count.

Edge cases: a null text is an empty one, and an empty text is plain; texts that hold a marker are plain; a null doc_id
is written as an empty string in the hash that chooses the cuts; equal rows give equal rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that begin a code point.
_BEGINS = np.ones(256, bool)
_BEGINS[0x80:0xC0] = False


@dataclass
class Runs:
    """Maximal runs of one class: where each begins and ends, and the units up to its end."""

    start: np.ndarray
    end: np.ndarray
    units: np.ndarray

    @property
    def total(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def offset(self, k: int) -> int:
        """Where the first k units end."""
        if k <= 0:
            return 0
        run = int(np.searchsorted(self.units, k))  # the first run by whose end k units are complete
        before = int(self.units[run - 1]) if run else 0
        start, end = int(self.start[run]), int(self.end[run])
        width = (end - start) // (int(self.units[run]) - before)  # of each unit: a word is its whole run, a character its bytes
        return start + (k - before) * width


def word_runs(data: bytes) -> Runs:
    """Runs of blanks and of other bytes; a word's unit is complete at the end of its run, that of last blanks at theirs."""
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    start = np.concatenate(([0], np.flatnonzero(blank[1:] != blank[:-1]) + 1)) if len(data) else np.empty(0, np.int64)
    end = np.append(start[1:], len(data)) if len(data) else start
    counts = (~blank[start]).astype(np.int64)
    if len(counts):
        counts[-1] = 1
    return Runs(start, end, np.cumsum(counts))


def char_runs(data: bytes) -> Runs:
    """Runs of code points of one length in bytes; each is a unit."""
    b = np.frombuffer(data, np.uint8)
    first = np.flatnonzero(_BEGINS[b])
    size = np.diff(np.append(first, len(b)))
    at = np.concatenate(([0], np.flatnonzero(size[1:] != size[:-1]) + 1)) if len(size) else np.empty(0, np.int64)
    end = np.append(at[1:], len(size)) if len(size) else at
    return Runs(first[at] if len(size) else at, np.append(first, len(b))[end], end)


RUNS = {"words": word_runs, "chars": char_runs}


def code_points(data: bytes) -> int:
    return int(np.count_nonzero(_BEGINS[np.frombuffer(data, np.uint8)]))


def transform(data: bytes, doc_id: int | None, units: str = "words", seed: int = 42, rate: int = 50, spm: int = 80) -> tuple[int, str, int, int, bytes]:
    """Units, form, and the bytes at which prefix and middle end, and the output: of 100 documents about `rate` are plain, of the others `spm` put the suffix first."""
    runs = RUNS[units](data)
    n = runs.total
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))
    if not data or h3 % 100 >= rate or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", 0, 0, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, z = runs.offset(low), runs.offset(high)
    prefix, middle, suffix = data[:a], data[a:z], data[z:]
    if h4 % 100 < spm:
        return n, "spm", a, z, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, z, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restored(output: bytes, form: str) -> bytes:
    """The text of an output."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at, middle = output.index(second), output.index(MIDDLE)
    parts = {first: output[len(first) : at], second: output[at + len(second) : middle]}
    return parts[PREFIX] + output[middle + len(MIDDLE) :] + parts[SUFFIX]


def _rows(texts: pd.Series, ids: pd.Series, **options) -> Iterator[tuple]:
    for text, doc_id in zip(texts, ids, strict=True):
        data = (text or "").encode("utf-8", "replace")
        n, form, a, z, output = transform(data, None if doc_id is None or pd.isna(doc_id) else int(doc_id), **options)
        yield data, n, form, a, z, output


def fill_in_middle(docs: DataFrame, **options) -> DataFrame:
    """docs with n (units), form and output, the transformed text; columns of these names are replaced."""
    names = ("n", "form", "output")

    def run(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(n, form, output.decode()) for _, n, form, _, _, output in _rows(texts, ids, **options)], columns=list(names))

    run.__annotations__ = {"texts": pd.Series, "ids": pd.Series, "return": pd.DataFrame}
    made = F.pandas_udf(run, "n long, form string, output string")(F.col("text"), F.col("doc_id").cast("string"))
    own = [c for c in docs.columns if c.lower() not in names]
    held = docs.select(*own, made.alias("__fim"))
    return held.select(*own, *(F.col(f"__fim.{c}").alias(c) for c in names))


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and the digest of the text that is restored from the output."""

    def run(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        out = []
        for data, n, form, a, z, output in _rows(texts, ids, **options):
            chars = (None, None) if form == "plain" else (code_points(data[:a]), code_points(data[a:z]))
            out.append((n, form, *chars, hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(output, form)).hexdigest()))
        rows = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])
        return rows.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    run.__annotations__ = {"texts": pd.Series, "ids": pd.Series, "return": pd.DataFrame}
    made = F.pandas_udf(run, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    return docs.select(F.col("doc_id").cast("long"), made(F.col("text"), F.col("doc_id").cast("string")).alias("f")).select("doc_id", "f.*")


def oracle_sql(docs: str = "documents") -> str:
    """The rows of digests() in DuckDB SQL."""
    cut = "('0x' || h[{0}:{1}])::BIGINT"
    units = r"regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"
    return f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {docs}),
n AS (SELECT *, {units} AS u, {cut.format(1, 8)} AS h1, {cut.format(9, 16)} AS h2, {cut.format(17, 24)} AS h3, {cut.format(25, 32)} AS h4 FROM u),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
