"""Tokenization fairness: fertility and parity by language, their spread, and the language that fares worst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approximate_tokens, byte_length, fertility, parity, words


def by_language(texts: DataFrame, text: str = "content", lang: str = "lang", tokens: Column | None = None, n_words: Column | None = None) -> DataFrame:
    """lang, tokens, words, bytes, fertility of texts without null language."""
    sums = texts.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(
        F.sum(approximate_tokens(text) if tokens is None else tokens).alias("tokens"),
        F.sum(words(text) if n_words is None else n_words).alias("words"),
        F.sum(byte_length(text)).alias("bytes"),
    )
    return sums.withColumn("fertility", fertility("tokens", "words"))


def with_parity(stats: DataFrame, baseline: str) -> DataFrame:
    """stats (lang, fertility) with parity_ratio to the baseline language; stats are one row a language."""
    base = stats.where(F.col("lang") == baseline).agg(F.max("fertility").alias("__base"))
    return stats.join(F.broadcast(base)).withColumn("parity_ratio", F.when(F.col("__base").isNull(), 0.0).otherwise(parity("fertility", "__base"))).drop("__base")


def gini(values: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """One row gini of a column of any number of values, nulls left out: mean absolute difference over twice the mean.

    Equal values are counted first. The distinct ones are dealt to ranges at `parts` quantiles; ranks are what the
    ranges before hold and what stands before inside the range, so no task takes all values.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("c"))
    edges = counts.agg(F.percentile_approx("x", [k / parts for k in range(1, parts)], 10_000).alias("e")).first()["e"] or []
    held = F.array(*(F.lit(e) for e in sorted(set(edges)))) if edges else F.array(F.lit(0.0))
    dealt = counts.withColumn("part", F.size(F.filter(held, lambda e: e < F.col("x"))))
    sums = dealt.groupBy("part").agg(F.sum("c").alias("n"))  # a row a range
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("c").over(Window.partitionBy("part").orderBy("x")) - F.col("c")
    ranked = dealt.withColumn("less", inside).join(before, "part").withColumn("less", F.col("less") + F.col("before"))
    # c equal values have the ranks less + 1 to less + c
    weighted = (F.col("c") * F.col("less") + F.col("c") * (F.col("c") + 1) / 2) * F.col("x")
    n, total = F.sum("c"), F.sum(F.col("c") * F.col("x"))
    spread = F.sum(weighted) * 2 / (n * total) - (n + 1) / n
    return ranked.agg(F.when(n.isNull() | (n <= 1) | (total == 0), 0.0).otherwise(spread).alias("gini"))


def worst(parities: DataFrame, baseline: str) -> DataFrame:
    """max_parity and the language that has it; the baseline where none is above 0; ties go to the first by name."""
    top = parities.agg(F.max(F.struct(F.col("parity_ratio"), F.lit(0))).getField("parity_ratio").alias("m"))
    named = parities.join(F.broadcast(top), F.col("parity_ratio") == F.col("m")).agg(F.min("lang").alias("lang"), F.max("m").alias("m"))
    return named.select(F.coalesce(F.when(F.col("m") > 0, F.col("m")), F.lit(0.0)).alias("max_parity"), F.when(F.col("m") > 0, F.col("lang")).otherwise(baseline).alias("worst_lang"))
