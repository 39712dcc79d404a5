"""Prices in bands of size and prices that change with time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_bands(rows: DataFrame, bands: DataFrame, size: str = "tokens", key: str = "model") -> DataFrame:
    """rows with the columns of the band (key, above, ...) that their size falls into: that with the greatest `above` below the size.

    The bands of a key become one row before the join, so rows are neither multiplied nor compared with each band of a
    range join; a key without fitting band has nulls. The number of bands of a key is bounded by its price list.
    """
    own = [c for c in bands.columns if c not in (key, "above")]
    lists = bands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("above", *own))).alias("__bands"))
    held = rows.join(lists, key, "left")
    fit = F.filter("__bands", lambda b: b["above"] < F.col(size))
    held = held.withColumn("__band", F.get(fit, F.size(fit) - 1))
    return held.select(*rows.columns, *(F.col(f"__band.{c}").alias(c) for c in own))


def as_of(rows: DataFrame, history: DataFrame, key: str, time: str, since: str, bucket_seconds: int = 86_400) -> DataFrame:
    """rows with the other columns of history (key, since, ...) as they were at the row's time: the last entry at or before it.

    Both sides may be of any size, and one key may hold most rows: rows meet entries of their own time bucket only; what
    held when a bucket began comes from a pass over one row a key and bucket that has entries or rows. Rows before
    the first entry, and rows without key or time, have nulls; of entries of one time the one with the greatest values counts.
    """
    values = [c for c in history.columns if c not in (key, since)]
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_seconds)
    entries = history.where(F.col(key).isNotNull() & F.col(since).isNotNull())
    entries = entries.groupBy(F.col(key).alias("__k"), F.col(since).alias("__t")).agg(F.max(F.struct(*values)).alias("__v")).withColumn("__b", bucket("__t"))
    known = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    # a row a key and bucket: what held at its begin
    ends = entries.groupBy("__k", "__b").agg(F.max_by("__v", "__t").alias("__v"))
    asked = known.select(F.col(key).alias("__k"), bucket(time).alias("__b")).distinct()
    every = ends.unionByName(asked, allowMissingColumns=True).groupBy("__k", "__b").agg(F.max("__v").alias("__v"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = every.select("__k", "__b", F.last("__v", ignorenulls=True).over(before).alias("__start"))
    # inside a bucket, entries stand before rows of their time
    left = known.select(F.col(key).alias("__k"), F.col(time).alias("__t"), bucket(time).alias("__b"), F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__row"))
    both = left.unionByName(entries.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy("__k", "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__last", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1").drop("__v")
    met = met.join(starts, ["__k", "__b"], "left").withColumn("__v", F.coalesce("__last", "__start"))
    out = met.select("__row.*", *(F.col(f"__v.{c}").alias(c) for c in values))
    kinds = dict(history.dtypes)
    rest = rows.where(F.col(key).isNull() | F.col(time).isNull())
    return out.unionByName(rest.select(*rows.columns, *(F.lit(None).cast(kinds[c]).alias(c) for c in values)))
