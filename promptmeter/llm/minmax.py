"""Near-duplicate detection by min-max hashing.

Each of `perms` hash functions gives two values of a signature, the minimum and the maximum over the document's
shingles, so a signature of 2 x perms values costs perms evaluations a shingle. The values are dealt to bands;
documents that share a band are candidates, and every link is confirmed on the full shingle sets.

With 10 values a band and 100 bands a pair at similarity 0.8 is missed with probability (1 - 0.8^10)^100 = 1e-5 if
bands were independent; as they share values, 600 in all, with about 8e-5 (simulated).

How buckets of any size stay whole without listing their pairs: equal sets are one class with one
representative; in each bucket of the first bands every representative is tested against one hub; of all bands,
buckets whose documents are one component by then are settled; while many pairs lie between the components of the
others, these get other hubs, of their largest component, up to `hub_rounds` times. At last the pairs between different
components of a bucket are looked at in blocks: a bucket is dealt to parts of about PART documents, each two parts meet
in one task (but not parts of its largest component), and only pairs whose sizes and sketches allow the similarity
leave it. So no task's work grows with a bucket. A bucket
of n documents no two of which are near still costs n^2 / 2 comparisons of sketches, spread over (n / PART)^2 / 2
blocks; leaving any out could lose a link.
Components come from alternating stars; links found later are looked at between components only.

Before full sets are compared, pairs that cannot reach the similarity are left out by odd sketches: bit i of a
sketch is the parity of the number of shingles whose hash falls on i, so two sketches differ in at most as many bits
as the sets have shingles not in common. That bound is exact: it costs no link. Long sets differ in more shingles
than a sketch has bits; their pairs all go on to the full comparison.

Edge cases: a text without words (or null) has an empty set and is linked with nothing; rows with one doc_id are
one node, however many texts they have; rows whose doc_id is null are linked with nothing, have a null component and
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slices import column, slices
from .shared import discard, mix64, shingles, unused, written

PERMS, ROWS, BANDS = 300, 10, 100
#: Bands that the first round looks at.
FIRST_BANDS = 8
#: 64-bit words of an odd sketch.
SKETCH = 16
#: Documents of a bucket that meet those of another part in one task.
PART = 2000
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, PERMS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)[:, None]
#: The values of each band: all values dealt once to disjoint bands, then again in another order.
_PICK = np.concatenate([_rng.permutation(2 * PERMS) for _ in range(2)])[: BANDS * ROWS].reshape(BANDS, ROWS)
_MULT = mix64(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima, then maxima, under each hash function."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMS, 0xFFFFFFFF, np.uint32), np.zeros(PERMS, np.uint32)
    for at in range(0, len(x), 512):
        h = _A * x[at : at + 512] + _B
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate((low, high))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Unbiased estimate of the Jaccard similarity from two signatures."""
    return float((a == b).mean())


def bands(sig: np.ndarray) -> np.ndarray:
    """A key for each band, whose values are minima of some functions and maxima of others."""
    rows = sig[_PICK].astype(np.uint64)
    return mix64((rows * _MULT).sum(1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes that fall on each of SKETCH x 64 bits."""
    bits = 64 * SKETCH
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_reach(su, sv, n, percent: int):
    """Whether sets of n shingles together may reach the similarity: d shingles not in common need d (100 + percent) <= n (100 - percent)."""
    differ = F.lit(0)
    for k in range(SKETCH):
        differ = differ + F.bit_count(su[k].bitwiseXOR(sv[k]))
    return differ * (100 + percent) <= n * (100 - percent)


_SIGNATURE = pa.struct({"n": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "bands": pa.list_(pa.int64()), "sketch": pa.list_(pa.int64())})


def _signatures(texts, width: int):
    def of(text: str | None) -> dict:
        h = shingles(text, width)
        if not len(h):
            return {"n": 0, "d1": 0, "d2": 0, "bands": None, "sketch": None}
        weight = mix64(np.arange(1, len(h) + 1, dtype=np.uint64))
        d = np.array([(h * (weight | np.uint64(1))).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(h + weight))]).view(np.int64)
        return {"n": len(h), "d1": int(d[0]), "d2": int(d[1]), "bands": bands(signature(h)), "sketch": odd_sketch(h)}

    return column(texts, lambda: of, "n long, d1 long, d2 long, bands array<long>, sketch array<long>", _SIGNATURE, pinned=True)


def _sets(texts, width: int):
    """The sorted shingle hashes, 8 bytes each."""
    return column(texts, lambda: lambda text: shingles(text, width).tobytes(), "binary", pinned=True)


def _common(a, b):
    """How many hashes two sets have in common."""

    def common(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, last_set = None, None
        for left, right in batches:
            at = 0
            for part in slices(left):
                out = []
                for x, y in zip(part.to_pylist(), right.slice(at, len(part)).to_pylist(), strict=True):
                    if last is None or y != last:
                        last, last_set = y, np.frombuffer(y, np.uint64)
                    out.append(len(np.intersect1d(np.frombuffer(x, np.uint64), last_set, assume_unique=True)))
                at += len(part)
                yield pa.array(out, pa.int64())

    return F.arrow_udf(common, "long").asNondeterministic()(a, b)


def components(edges: DataFrame, tag: str) -> DataFrame:
    """node, component (its smallest reachable node) of the undirected edges (u, v), by alternating large and small stars; a node that is its own component has no row."""
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), tag)
    while not _stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = written(small.where("u <> v").distinct(), tag)
        discard(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every u of the distinct edges u > v has one v, which is no u itself: then v is its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("reached")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("reached").alias("reached")).where("out > 1 or (out > 0 and reached > 0)").isEmpty()


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (node, component) after the links found, whose ends stand for their components: only these are searched for stars."""
    known = labels.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    ends = found.join(known, "u", "left").join(known.toDF("v", "cv"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    moved = components(ends, "minmax-stars")
    after = labels.join(moved.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(after.union(moved), "minmax-labels")


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (u, v) those whose full sets reach the similarity. A document's set is made once as u and once as v."""
    text = docs.select(F.col("doc_id").alias("u"), "text")
    left = text.join(pairs.groupBy("u").agg(F.collect_list("v").alias("vs")), "u").select("u", "vs", _sets("text", width).alias("su"))
    left = left.select("u", F.explode("vs").alias("v"), "su")
    hubs = text.join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("v"), _sets("text", width).alias("sv"))
    tested = left.join(hubs, "v").select("u", "v", _common("su", "sv").alias("c"), ((F.length("su") + F.length("sv")) / 8).cast("long").alias("n"))
    return tested.where(F.col("c") * 100 >= (F.col("n") - F.col("c")) * percent).select("u", "v").distinct()


def _able(percent: int):
    """Whether the set sizes of (u, nu, v, nv) allow the similarity."""
    return (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent) & (F.col("u") != F.col("v"))


def _pairs(rows: DataFrame, tested: DataFrame | None, percent: int, sketches: DataFrame | None = None) -> DataFrame:
    """Distinct pairs u > v of rows (u, nu, v, nv) whose set sizes, and sketches (doc_id, sketch) where given, allow the similarity and that are not tested yet."""
    rows = rows.where(_able(percent)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("nu") + F.col("nv")).alias("n")).distinct()
    if tested is not None:
        rows = rows.join(tested, ["u", "v"], "left_anti")
    if sketches is not None:
        for x in "uv":
            rows = rows.join(sketches.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"s{x}")), x)
        rows = rows.where(_may_reach(F.col("su"), F.col("sv"), F.col("n"), percent))
    return written(rows.select("u", "v"), "minmax-pairs")


def _across(named: DataFrame, percent: int) -> DataFrame:
    """u, nu, v, nv of the pairs between components of one bucket that sizes and sketches allow, looked at in blocks.

    A bucket's largest component has no pairs within itself, so its documents are dealt to parts of their own, which
    meet only the parts of the other documents; those also meet each other. A part holds about PART documents.
    """
    parts = named.groupBy("band", "c").agg(F.count("*").alias("m"))
    sizes = parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.max(F.struct("m", "c")).alias("top")).where("parts > 1")
    number = lambda m: (F.floor(m / PART) + 1).cast("int")
    sizes = sizes.select("band", F.col("top.c").alias("top"), number(F.col("m") - F.col("top.m")).alias("others"), number(F.col("top.m")).alias("tops"))
    top, at = F.col("c") == F.col("top"), F.xxhash64(F.lit(3), "doc_id")
    dealt = named.join(sizes, "band").withColumn("part", F.when(top, F.col("others") + F.pmod(at, "tops")).otherwise(F.pmod(at, "others")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(top, 0).otherwise(F.col("tops")))))
    dealt = dealt.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    a, b = (dealt.select("band", "low", "high", F.col("part").alias(f"p{x}"), F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"), F.col("sketch").alias(f"s{x}")) for x in "uv")
    # within a part each pair is met once by the order of components, between two parts by the order of parts
    once = F.when(F.col("low") == F.col("high"), F.col("cu") > F.col("cv")).otherwise((F.col("cu") != F.col("cv")) & (F.col("pu") > F.col("pv")))
    # the optimizer makes the filter part of the join
    met = a.join(b, ["band", "low", "high"]).where(once & _able(percent) & _may_reach(F.col("su"), F.col("sv"), F.col("nu") + F.col("nv"), percent))
    return met.select("u", "nu", "v", "nv")


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with c, the component of doc_id so far."""
    return rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, hub_rounds: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sig = written(docs.withColumn("s", _signatures("text", width)).select("doc_id", "s.*"), "minmax-sig")
    full = sig.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "minmax-classes")
    member = full.join(classes, ["n", "d1", "d2"])
    # rows of one doc_id with several texts: every representative is linked with the smallest
    several = member.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("w > v").select("doc_id", "v")
    again = member.select("doc_id", F.col("rep").alias("u")).join(several, "doc_id").where("u > v").select("u", "v").distinct()
    reps = written(member.where("doc_id = rep").select("doc_id", "n", "bands", "sketch"), "minmax-reps")
    # First a few bands alone: they join most copies, whose buckets then need no second look.
    rows = reps.select("doc_id", "n", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("band"))
    shared = rows.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min(F.struct("doc_id", "n")).alias("hub")).where("first < last")
    rows = rows.join(shared.select("band", "hub"), "band")
    pairs = _pairs(rows.select(F.col("doc_id").alias("u"), F.col("n").alias("nu"), F.col("hub.doc_id").alias("v"), F.col("hub.n").alias("nv")), None, percent)
    tested, found = pairs, written(_verified(docs, pairs, width, percent).union(again), "minmax-links")
    labels = written(components(found, "minmax-stars"), "minmax-labels")
    # Then all bands, of which only the buckets with several components count; those of one component are settled.
    rows = _named(reps, labels).select("doc_id", "n", "c", F.explode("bands").alias("band"))
    several = rows.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("band")
    # rows keep the component they have now; where components join later, that is looked up a component, not a row
    bucket, size, k = written(rows.join(several, "band"), "minmax-buckets"), None, 0
    while k <= hub_rounds:
        k += 1
        order = lambda doc: F.xxhash64(F.lit(k), doc)  # noqa: B023, E731
        held = bucket.groupBy("band", "c").agg(F.count("*").alias("m"), F.min_by(F.struct("doc_id", "n"), order("doc_id")).alias("hub"))
        held = held.join(labels.select(F.col("node").alias("c"), F.col("component").alias("now")), "c", "left").withColumn("now", F.coalesce("now", "c"))
        held = written(held, "minmax-held")
        parts = held.groupBy("band", "now").agg(F.sum("m").alias("m"), F.min_by("hub", order("hub.doc_id")).alias("hub"))
        # the hub of a bucket is one of its largest component, so only the others are tested against it
        mixed = parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.max(F.struct("m", order("hub.doc_id").alias("order"), "hub", "now")).alias("h"))
        mixed = written(mixed.where("parts > 1"), "minmax-mixed")
        left, across = mixed.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("mm")) / 2)).first()
        if not left:
            break
        size = size or left
        k = hub_rounds + 1 if across <= 4 * size else k
        if k <= hub_rounds:
            rows = bucket.join(held.join(mixed.select("band", "h"), "band").where("now <> h.now").select("band", "c", "h.hub"), ["band", "c"])
            rows = rows.select(F.col("doc_id").alias("u"), F.col("n").alias("nu"), F.col("hub.doc_id").alias("v"), F.col("hub.n").alias("nv"))
            pairs = _pairs(rows, tested, percent, reps)
        else:  # the pairs that are left between components of one bucket
            rows = bucket.join(held.join(mixed.select("band"), "band").select("band", "c", "now"), ["band", "c"])
            pairs = _pairs(_across(rows.select("band", "doc_id", "n", F.col("now").alias("c")).join(reps.select("doc_id", "sketch"), "doc_id"), percent), tested, percent)
        found = written(_verified(docs, pairs, width, percent), "minmax-links")
        if found.isEmpty():
            k = max(k, hub_rounds)
            tested = tested.union(pairs)
            continue
        tested, labels = tested.union(pairs), _joined(labels, found)
    final = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = sig.join(final, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _nodes(docs: DataFrame, node: str) -> DataFrame:
    """docs with a number for each doc_id and text: the first text of an id has the id, others have numbers that no id has."""
    of = lambda d: (F.col("doc_id").cast("long").alias("i"), F.struct(F.xxhash64(F.lit(1), F.col("text")).alias("a"), F.xxhash64(F.lit(2), F.col("text")).alias("b")).alias("d"))
    digests = docs.where("doc_id is not null").select(*of(docs))
    many = digests.groupBy("i").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first <> last")
    others = written(digests.join(many, "i").where("d <> first").select("i", "d").distinct(), "minmax-others")
    own = F.col("doc_id").cast("long")
    if others.isEmpty():
        return docs.withColumn(node, own)
    low, high = docs.agg(F.min(own), F.max(own)).first()
    # row numbers of the written table are below 2^62 where it has fewer than 2^28 partitions
    place = F.monotonically_increasing_id()
    numbered = written(others.select("i", "d", (place + (high + 1) if high < 1 << 62 else F.lit(low - 1) - place).alias(node)), "minmax-nodes")
    keys = unused(docs, "i"), unused(docs, "d")
    out = docs.withColumns(dict(zip(keys, of(docs), strict=True)))
    extra = numbered.withColumnsRenamed({"i": f"{keys[0]}x", "d": f"{keys[1]}x", node: f"{node}x"})
    out = out.join(extra, (F.col(keys[0]) == F.col(f"{keys[0]}x")) & (F.col(keys[1]) == F.col(f"{keys[1]}x")), "left")
    return out.withColumn(node, F.coalesce(f"{node}x", own)).select(*docs.columns, node)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates: that with the smallest doc_id.

    Here a doc_id with several texts stands for several documents, so a row goes only if a near duplicate of its own
    text stays; of one id's texts the first by digest counts as its document, the others come after all ids. Of rows
    with one id and one text one stays. Rows without doc_id stay.
    """
    node, keep = unused(docs, "node"), unused(docs, "keep")
    known = _nodes(docs, node)
    result = near_duplicates(known.where("doc_id is not null").select(F.col(node).alias("doc_id"), "text"), width, percent)
    kept = written(result.where("kept").groupBy(F.col("doc_id").alias(keep)).agg(F.count("*").alias("n")), "minmax-kept")
    out = known.join(kept.where("n = 1"), F.col(node) == F.col(keep), "left_semi").select(*docs.columns)
    if not kept.where("n > 1").isEmpty():
        rows = known.join(kept.where("n > 1"), F.col(node) == F.col(keep), "left_semi")
        order = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))  # rows are combined before they are shuffled
        one = rows.groupBy(node).agg(F.min_by(F.struct(*docs.columns), order).alias(keep))
        out = out.union(one.select(f"{keep}.*").select(*docs.columns))
    return out.union(docs.where("doc_id is null"))
