"""Token and cost rows of texts, and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import token_cost
from ..functions.text import approximate_tokens, byte_length, compression, fertility, words


def with_prices(rows: DataFrame, prices: DataFrame, missing: str = "error") -> DataFrame:
    """rows (model, ...) with their prices; a model without price is an error, dropped, or priced 0 (zero).

    No hint is given: a table of a thousand models is broadcast by its size, one of any size is joined as such.
    """
    if missing == "drop":
        return rows.join(prices, "model")
    out = rows.join(prices.withColumn("__known", F.lit(True)), "model", "left")
    if missing == "error":
        stop = F.raise_error(F.concat(F.lit("no price for model "), F.coalesce("model", F.lit("null"))))
        return out.where(F.when(F.col("__known").isNull(), stop.cast("boolean")).otherwise(True)).drop("__known")
    return out.drop("__known")


def model_of(kind: str, prompt="model", default="default_model", given: str | None = None) -> Column:
    """Which model counts: check_manifest, check_file, export, diff or estimate."""
    g, p, d, last = F.lit(given).cast("string"), F.col(prompt), F.col(default) if default else F.lit(None), F.lit("gpt-4o")
    return {
        "check_manifest": lambda: F.coalesce(p, d, g, last),
        "check_file": lambda: F.coalesce(g, d, last),
        "export": lambda: F.coalesce(p, d, last),
        "diff": lambda: F.coalesce(p, last),
        "estimate": lambda: F.coalesce(g, last),
    }[kind]()


def text_costs(texts: DataFrame, prices: DataFrame, text: str = "content", tokens: Column | None = None, missing: str = "error") -> DataFrame:
    """texts (model, ...) with tokens and cost of the text as input."""
    counted = texts.withColumn("tokens", approximate_tokens(text) if tokens is None else tokens)
    priced = with_prices(counted, prices, missing)
    zero = F.lit(0).cast("long")
    return priced.withColumn("cost", token_cost("tokens", zero, zero)).drop("provider", "input_price", "output_price", "reasoning_price")


def report(texts: DataFrame, input_price: float, text: str = "content") -> DataFrame:
    """One row: bytes, tokens, words, cost, fertility and compression of a corpus."""
    sums = texts.agg(F.sum(byte_length(text)).alias("bytes"), F.sum(approximate_tokens(text)).alias("tokens"), F.sum(words(text)).alias("words"))
    return sums.select("bytes", "tokens", "words", (F.lit(input_price) / 1e6 * F.col("tokens")).alias("cost"), fertility("tokens", "words").alias("fertility"), compression("bytes", "tokens").alias("bytes_per_token"))


def estimate_json(rows: DataFrame) -> DataFrame:
    """One row `json`: prompts (resource_id, model, tokens, cost) by resource_id, and their total; for manifests, not corpora."""
    item = F.struct("resource_id", "model", F.col("tokens").alias("input_tokens"), F.round("cost", 6).alias("cost_usd"))
    whole = rows.agg(F.array_sort(F.collect_list(item)).alias("prompts"), F.round(F.sum("cost"), 6).alias("total"))
    return whole.select(F.to_json(F.struct("prompts", F.struct(F.col("total").alias("total_cost_usd")).alias("summary"))).alias("json"))


def percentile(values, p: int) -> Column:
    """Nearest-rank percentile of an array: the element at n p / 100, rounded down, at most the last."""
    n = F.size(values)
    return F.element_at(F.array_sort(values), F.least(F.floor(n * p / 100), n - 1).cast("int") + 1)


def latency_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, min, max, mean, population deviation (whole), p50, p95, p99 of whole numbers.

    The percentiles come from counts of each value, so a group is as large as its distinct values, not its rows.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(value)))
    total = F.sum("c")
    sums = counts.groupBy(*by).agg(total.alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.floor(F.sum(F.col(value) * F.col("c")) / total).cast("long").alias("mean"))
    joined = run.join(sums, list(by))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col(value)))
    spread = F.floor(F.sqrt(F.floor(F.sum((F.col(value) - F.col("mean")) * (F.col(value) - F.col("mean")) * F.col("c")) / F.first("n")))).cast("long")
    return joined.groupBy(*by, "n", "min", "max", "mean").agg(spread.alias("stddev"), at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"))


def top_pieces(texts: DataFrame, pieces: Column, k: int = 10) -> DataFrame:
    """The k most frequent pieces, ties by piece."""
    return texts.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "piece").limit(k)
