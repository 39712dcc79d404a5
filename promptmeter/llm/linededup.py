"""Line deduplication by content-defined chunks of lines, in DataFrame operations only.

A rolling hash over the hashes of two adjacent lines chooses where a chunk may end: after a line whose rolling hash
is 0 modulo `divisor`, if that of the line before it isn't and more than one line follows. So every chunk has two
lines at least (four on average with divisor 2), if the text has so many, and the boundaries inside a passage depend
on its own lines from its third line on, wherever it stands. A chunk of several lines with at least `min_chars`
characters that stands byte for byte at an earlier place (by doc_id, text hash and line number) is removed.

The lines at a passage's edges share their chunk with lines that aren't repeated. So lines with at least `min_chars`
characters (long ones) are compared likewise one by one, and so are the chunks that end at long lines: runs of short
lines, and a long line with the short ones after or before it. The first place of a chunk or line is never removed.

Only hashes, SHA-256 digests and places are grouped; texts stay where they are, until the lines to remove are joined
with them once. Bytes count as equal if their digests are. What stands in very many places is dealt to as many parts as
its count asks for.

Edge cases: a null text stays null and an empty one empty; rows whose doc_id is null are left as they are;
rows with one doc_id and one text are one place; a text whose lines are all removed becomes empty; equal hashes of
different bytes cost nothing but the comparison of their digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import unused, written

DIVISOR, MIN_CHARS = 2, 40
#: Places of one chunk that a part takes, and the parts in which places look for their first.
PART, PARTS = 1000, 16


def _once(value):
    """The value as a generator's only row: it is evaluated once, however often its column is used after it."""
    return F.explode_outer(F.array(value))


def unit_hash(text):
    return F.xxhash64(text)


def _units(texts: DataFrame, divisor: int, min_chars: int) -> DataFrame:
    """doc_id, row, and of each chunk of several lines and each long line: at (its first line, from 1), n (lines), h, d (digest)."""
    rows = texts.select("doc_id", "row", _once(F.split("text", "\n")).alias("lines"))
    short = F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))
    rows = rows.select("doc_id", "row", "lines", _once(short).alias("hs"))
    stop = F.transform("hs", lambda h, i: (i > 0) & ((h + F.get("hs", i - 1) * 31) % divisor == 0))
    rows = rows.select("doc_id", "row", "lines", _once(stop).alias("stop"))
    ends = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == F.size("lines")) | (i + 1 < F.size("lines")) & (F.get("stop", i - 1) & ~F.coalesce(F.get("stop", i - 2), F.lit(False))))
    rows = rows.select("doc_id", "row", "lines", _once(ends).alias("ends"))
    spans = F.transform("ends", lambda e, i: _span(F.coalesce(F.get("ends", i - 1), F.lit(0)) + 1, e))
    edges = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.length(F.get("lines", i - 1)) >= min_chars), F.array(F.size("lines") + 1))
    rows = rows.select("doc_id", "row", "lines", _once(spans).alias("spans"), edges.alias("edges")).select("doc_id", "row", "lines", "spans", _once("edges").alias("edges"))
    # between two long lines (a before, z after; 0 and the number of lines and 1 are none): the short ones, these with a, these with z
    short = F.transform(F.slice("edges", 1, F.size("edges") - 1), lambda a, i: F.struct(a.alias("a"), F.get("edges", i + 1).alias("z")))
    short = F.transform(F.filter(short, lambda r: r["z"] > r["a"] + 1), lambda r: F.array(_span(r["a"] + 1, r["z"] - 1), _span(r["a"], r["z"] - 1), _span(r["a"] + 1, r["z"])))
    spans = F.filter(F.array_distinct(F.concat("spans", F.flatten(short))), lambda s: (s["at"] > 0) & (s["e"] > s["at"]) & (s["e"] <= F.size("lines")))
    rows = rows.select("doc_id", "row", "lines", _once(spans).alias("spans"))
    chunks = F.transform("spans", lambda s: F.struct(s["at"].alias("at"), (s["e"] - s["at"] + 1).alias("n"), F.array_join(F.slice("lines", s["at"], s["e"] - s["at"] + 1), "\n").alias("x")))
    lines = F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), F.lit(1).alias("n"), x.alias("x")))
    both = F.filter(F.concat(chunks, lines), lambda u: F.length(u["x"]) >= min_chars)
    rows = rows.select("doc_id", "row", F.explode(F.transform(both, lambda u: F.struct(u["at"].alias("at"), u["n"].alias("n"), unit_hash(u["x"]).alias("h"), F.unhex(F.sha2(u["x"], 256)).alias("d")))).alias("u"))
    return rows.select("doc_id", "row", "u.*")


def _span(at, end):
    return F.struct(at.alias("at"), end.alias("e"))


def _parts(count):
    return (count / PART).cast("int") + 1


def _repeated(texts: DataFrame, divisor: int, min_chars: int) -> DataFrame:
    """doc_id, row, units (at, n) that stand elsewhere before, byte for byte (by digest)."""
    units = written(_units(texts.select("doc_id", "row", "text"), divisor, min_chars), "lines-units")
    many = units.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    dealt = F.pmod(F.xxhash64("doc_id", "row", "at"), F.lit(PARTS)).cast("int")
    some = units.withColumn("part", dealt).join(many.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["h", "part"])
    some = some.select(F.struct("doc_id", "row", "at").alias("place"), "n", "h", "c", "d")
    held = written(some.withColumn("part", F.pmod(F.xxhash64("place"), _parts(F.col("c"))).cast("int")), "lines-held")
    first = held.groupBy("h", "part", "d").agg(F.min("place").alias("first"), F.max("c").alias("c")).groupBy("h", "d").agg(F.min("first").alias("first"), F.max("c").alias("c"))
    first = first.select("h", "d", "first", F.explode(F.sequence(F.lit(0), _parts(F.col("c")) - 1)).alias("part"))
    again = held.select("place", "n", "h", "part", "d").join(first, ["h", "part", "d"]).where("place <> first")
    return again.groupBy("place.doc_id", "place.row").agg(F.collect_list(F.struct("place.at", "n")).alias("units"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, divisor: int = DIVISOR, names: tuple[str, str] = ("__removed", "__lines_removed")) -> DataFrame:
    """All columns of docs with the text cleaned, and two counts, called `names`: removed chunks of several lines, and removed lines.

    Columns of docs with these names are replaced.
    """
    cols = [c for c in docs.columns if c.lower() not in names]
    text = next(c for c in cols if c.lower() == "text")
    row, key, known, lines, gone = (unused(docs, x) for x in ("row", "key", "known", "lines", "gone"))
    able = "doc_id is not null and text <> ''"
    full = docs.select(*cols).where(able).withColumn(row, F.xxhash64("text"))
    units = _repeated(full.select("doc_id", F.col(row).alias("row"), "text"), divisor, min_chars)
    units = units.select(F.col("doc_id").alias(key), F.col("row").alias(f"{key}r"), F.col("units").alias(known))
    own = full.join(units, (full["doc_id"] == units[key]) & (full[row] == units[f"{key}r"]), "left").drop(row, key, f"{key}r")
    touched = own.where(F.col(known).isNotNull()).select(*cols, known, _once(F.split("text", "\n")).alias(lines))
    numbers = F.array_distinct(F.flatten(F.transform(known, lambda u: F.sequence(u["at"], u["at"] + u["n"] - 1))))
    touched = touched.select(*cols, known, lines, _once(numbers).alias(gone))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), gone), lambda k: F.element_at(lines, k))
    out = [F.array_join(kept, "\n").alias(text) if c == text else F.col(c) for c in cols]
    chunks = F.size(F.filter(known, lambda u: u["n"] > 1)).cast("long")
    cleaned = touched.select(*out, chunks.alias(names[0]), F.size(gone).cast("long").alias(names[1]))
    none = [F.lit(0).cast("long").alias(c) for c in names]
    rest = docs.where(~F.coalesce(F.expr(able), F.lit(False)))
    return cleaned.union(own.where(F.col(known).isNull()).select(*cols, *none)).union(rest.select(*cols, *none))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated lines removed; documents of which nothing is left go."""
    names = unused(docs, "removed"), unused(docs, "lines_removed")
    return dedup_lines(docs, names=names).where((F.col(names[1]) == 0) | (F.col("text") != "")).select(*docs.columns)


def oracle_sql(docs: str = "documents", divisor: int = DIVISOR, min_chars: int = MIN_CHARS) -> str:
    """doc_id, text, removed_chunks, removed_lines in DuckDB SQL, for unique ids."""
    return f"""WITH l AS (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs} WHERE text <> '')),
b AS (SELECT *, coalesce((h + lag(h) OVER d * 31) % {divisor} = 0, false) AS stop, i + 1 < max(i) OVER (PARTITION BY doc_id) AS inner_line FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, stop AND inner_line AND NOT coalesce(lag(stop) OVER d, false) AS last FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(CASE WHEN last THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
  length(line) >= {min_chars} AS long, sum(CASE WHEN length(line) >= {min_chars} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g, max(i) OVER (PARTITION BY doc_id) AS m FROM e),
q AS (SELECT doc_id, min(i) AS a, max(i) AS z, min(m) AS m FROM k WHERE NOT long GROUP BY doc_id, g),
p AS (SELECT doc_id, min(i) AS a, max(i) AS z FROM k GROUP BY doc_id, k UNION SELECT doc_id, a, z FROM q UNION SELECT doc_id, a - 1, z FROM q WHERE a > 1 UNION SELECT doc_id, a, z + 1 FROM q WHERE z < m),
c AS (SELECT p.doc_id, a, z, string_agg(line, chr(10) ORDER BY i) AS chunk FROM p JOIN l ON p.doc_id = l.doc_id AND i BETWEEN a AND z WHERE z > a GROUP BY p.doc_id, a, z),
f AS (SELECT doc_id, a, z FROM c WHERE length(chunk) >= {min_chars} QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) > 1),
s AS (SELECT doc_id, i AS a, i AS z FROM l WHERE length(line) >= {min_chars} QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1),
x AS (SELECT doc_id, unnest(generate_series(a, z)) AS i FROM (FROM f UNION ALL FROM s)),
n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id),
r AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE x.i IS NULL) AS text, count(x.i) AS m FROM l LEFT JOIN (SELECT DISTINCT doc_id, i FROM x) x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, CAST(coalesce(n, 0) AS BIGINT) AS removed_chunks, CAST(coalesce(m, 0) AS BIGINT) AS removed_lines
FROM {docs} d LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)"""
