"""Mixing sources to target weights without sorting: hash-threshold histograms, in DataFrame operations only.

Every row has a 60-bit hash. A source's budget is met by whole copies and by the rows whose hash lies under a
threshold: sizes are summed by source and hash bucket, the bucket in which the running sum passes the budget is
found, and only that bucket is refined by further bits of the hash. What a threshold leaves of the budget is
offered to the smaller rows that were not taken, `phases` times.

All that a row needs to know is one row for its source: its target, and the room and threshold of each phase. That
table is as large as there are sources; documents are never shuffled with their texts.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; equal rows share their
hash and are taken together; sources of size 0 have target 0; an empty table gives none. Targets are found by two
windows over one row a source, so sources may be millions, not billions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import count_words, unused, written

BITS, STEP = 60, 12
WEIGHTS = (3, 1, 2)


def source_key(col="source"):
    """Orders as the source by code point, null last."""
    return F.when(F.col(col).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(col)))


def row_hash():
    """60 bits of a hash of doc_id and text; the same in any SQL with md5."""
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """src, source_size, target: `share` of all sizes by weight, none above `most` times its source, the excess reshared."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("level", left / rest)
    ratio = F.col("cap") / F.col("w")
    level = F.min(F.when(ratio >= F.col("level"), F.struct(ratio.alias("ratio"), "src", "level"))).over(every)["level"]
    return per.select("src", "source_size", F.least("cap", F.coalesce(F.col("w") * level, F.col("cap"))).alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """src, theta: the rows (src, h, size) with h < theta are the longest prefix by hash that the budget u holds."""
    state = budgets.select("src", "u", F.lit(0).cast("long").alias("low"))
    for used in range(STEP, BITS + 1, STEP):
        shift = BITS - used
        inside = rows.join(state, "src")
        if used > STEP:
            inside = inside.where((F.shiftright("h", shift + STEP) == F.shiftright("low", shift + STEP)) & F.col("open"))
        hist = inside.groupBy("src", "u", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        run = F.sum("s").over(Window.partitionBy("src").orderBy("b"))
        over = hist.withColumn("run", run).where("run > u")
        edge = over.groupBy("src").agg(F.min_by(F.struct("b", (F.col("u") - F.col("run") + F.col("s")).alias("u"), "h0", "h1"), "b").alias("e"))
        step = edge.select("src", "e.u", F.when(F.col("e.h0") == F.col("e.h1"), F.col("e.h0")).otherwise(F.shiftleft("e.b", shift)).alias("low"), (F.col("e.h0") < F.col("e.h1")).alias("open"))
        if used > STEP:
            step = state.where(~F.col("open")).unionByName(step)
        state = written(step, "mixing-edge")
        if state.where("open").isEmpty():
            break
    return state.select("src", F.col("low").alias("theta"))


def _taken(size: str, h: str):
    """Whether a row of that size and hash was taken in one of the phases done."""
    return F.exists("done", lambda d: (F.col(size) <= d["room"]) & (F.col(h) < d["theta"]))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, phases: int = 4) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, src, h, size) of docs, and one row a source: src, source_size, target, whole (copies of every row), done (room, theta)."""
    rows = written(docs.select("doc_id", source_key().alias("src"), row_hash().alias("h"), count_words("text").alias("size")), "mixing-rows")
    goal = targets(rows, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("u", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    state = written(goal.withColumn("room", F.col("u")).withColumn("done", F.array().cast("array<struct<room:bigint,theta:bigint>>")), "mixing-state")
    for k in range(phases):
        free = rows.join(state.select("src", "room", "done"), "src").where((F.col("size") <= F.col("room")) & ~_taken("size", "h")).select("src", "h", "size")
        theta = _thresholds(free, state.select("src", F.col("room").alias("u")))
        step = F.struct("room", F.coalesce("theta", F.lit((1 << BITS) + 1)).alias("theta"))
        after = state.join(theta, "src", "left").withColumn("done", F.concat("done", F.array(step))).drop("theta")
        if k + 1 < phases:
            after = written(after, "mixing-state")
            spent = rows.join(after.select("src", "done"), "src").groupBy("src").agg(F.sum(F.when(_taken("size", "h"), F.col("size")).otherwise(0)).alias("spent"))
            after = after.drop("room").join(spent, "src").withColumn("room", F.col("u") - F.col("spent")).drop("spent")
        state = written(after, "mixing-state")
    return rows, state.select("src", "source_size", "target", "whole", "done")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, phases: int = 4) -> DataFrame:
    """doc_id, src, h, size, source_size, target, copies, taken of every row of docs (doc_id, text, source)."""
    rows, state = plan(docs, weights, share, most, phases)
    out = rows.join(state, "src").withColumn("copies", F.col("whole") + _taken("size", "h").cast("long"))
    return out.select("doc_id", "src", "h", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs with every row as often as it is taken."""
    rows, state = plan(docs, **options)
    src, h, size, n = (unused(docs, x) for x in ("src", "h", "size", "n"))
    own = docs.withColumns({src: source_key(), h: row_hash(), size: count_words("text")})
    names = {c: unused(own, f"of_{c}") for c in state.columns}
    state = state.withColumnsRenamed(names)
    taken = F.exists(names["done"], lambda d: (F.col(size) <= d["room"]) & (F.col(h) < d["theta"]))
    own = own.join(state, F.col(src) == F.col(names["src"])).withColumn(n, (F.col(names["whole"]) + taken.cast("long")).cast("int"))
    return own.where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def oracle_sql(docs: str = "documents", phases: int = 4) -> str:
    """The mix in DuckDB SQL, with running sums over sorted rows in place of the histograms."""
    sql = f"""WITH r AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS src,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
p AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY src) - 1) % 3 AS INT) + 1] AS w FROM r GROUP BY src),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM p),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM c WINDOW b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, source_size, least(cap, coalesce(w * (min(CASE WHEN cap / w >= level THEN {{'a': cap / w, 'b': src, 'c': level}} END) OVER ()).c, cap)) AS target FROM l),
g0 AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
g AS (SELECT *, CAST(floor(target - whole * source_size) AS BIGINT) AS u FROM g0),
m0 AS (SELECT r.*, g.u, 0 AS extra FROM r JOIN g USING (src))"""
    for k in range(phases):
        sql += f""",
f{k} AS (SELECT rid, sum(size) OVER (PARTITION BY src ORDER BY h) <= u AS fits FROM m{k} WHERE extra = 0 AND size <= u),
n{k} AS (SELECT m.* EXCLUDE (extra), CASE WHEN extra = 1 OR coalesce(fits, false) THEN 1 ELSE 0 END AS extra, coalesce(fits, false) AS now FROM m{k} m LEFT JOIN f{k} USING (rid)),
m{k + 1} AS (SELECT rid, doc_id, src, h, size, CAST(u - sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY src) AS BIGINT) AS u, extra FROM n{k})"""
    return sql + f"""
SELECT doc_id, src, h, size, source_size, target, CAST(whole + extra AS BIGINT) AS copies, CAST(size * (whole + extra) AS BIGINT) AS taken
FROM m{phases} JOIN g USING (src)"""
