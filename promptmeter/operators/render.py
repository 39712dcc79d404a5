"""What people read: reports, model lists, estimates and fairness as text and JSON, one row or one line a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from .usage import json_number


def _text(template: str, *cols) -> Column:
    return F.format_string(template, *cols).alias("text")


def report_text(stats: DataFrame, model: str) -> DataFrame:
    """text of a report row (bytes, tokens, words, cost, fertility, bytes_per_token)."""
    head = f"\n=== Tokenizer Report: {model} ===\n".replace("%", "%%")
    body = "Corpus Size:    %d bytes\nWord Count:     %d words\nToken Count:    %d tokens\nEst. Cost:      $%.6f\n"
    tail = "\n--- Efficiency Metrics ---\nCompression:    %.2f bytes/token  (Higher is better)\nFertility:      %.2f tokens/word  (Lower is better)\n"
    return stats.select(_text(head + body + tail, "bytes", "words", "tokens", "cost", "bytes_per_token", "fertility"))


def report_json(stats: DataFrame, model: str) -> DataFrame:
    """The same as JSON, ratios with two decimals and cost with six."""
    template = '{\n  "model": %s,\n  "stats": {\n    "bytes": %d,\n    "tokens": %d,\n    "words": %d,\n    "cost_usd": %.6f\n  },\n  "metrics": {\n    "bytes_per_token": %.2f,\n    "tokens_per_word": %.2f\n  }\n}\n'
    return stats.select(_text(template, quoted(F.lit(model)), "bytes", "tokens", "words", "cost", "bytes_per_token", "fertility"))


def models_json(models: DataFrame) -> DataFrame:
    """The list of models (id, input_price, output_price, reasoning_price), by id, as one JSON text; reasoning prices above 0 only."""
    reasoning = F.when(F.col("reasoning_price") > 0, F.concat(F.lit(',\n    "cost_reasoning": '), json_number(F.col("reasoning_price")))).otherwise("")
    item = F.concat(F.lit('  {\n    "id": '), quoted("id"), F.lit(',\n    "cost_in": '), json_number(F.col("input_price")), F.lit(',\n    "cost_out": '), json_number(F.col("output_price")), reasoning, F.lit("\n  }"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("item")))), lambda x: x["item"])
    return models.agg(F.concat(F.lit("[\n"), F.concat_ws(",\n", items), F.lit("\n]\n")).alias("text"))


def models_text(models: DataFrame) -> DataFrame:
    """The same as a table, with the number of models."""
    usd = lambda c: F.concat(F.lit("$"), F.format_string("%.2f", c))
    reasoning = F.when(F.col("reasoning_price") > 0, usd("reasoning_price")).otherwise("-")
    row = F.format_string("%-20s %-15s %-15s %-14s", "id", usd("input_price"), usd("output_price"), reasoning)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", row.alias("row")))), lambda x: x["row"])
    head = f"{'MODEL':<20} {'INPUT ($/1M)':<15} {'OUTPUT ($/1M)':<15} {'REAS ($/1M)':<15}\n{'-' * 20} {'-' * 15} {'-' * 15} {'-' * 15}\n"
    return models.agg(F.concat(F.lit(head), F.concat_ws("\n", lines), F.format_string("\n\nTotal models: %d\n", F.count("*"))).alias("text"))


def estimate_lines(rows: DataFrame, scan: bool = True) -> DataFrame:
    """rows (path, tokens, cost, resource_id, id_source) with text: one line of a scan, or the block of a single file."""
    if scan:
        return rows.withColumn("text", F.format_string("%s: $%.6f (%s)", "path", "cost", "resource_id"))
    block = "File:        %s\nTokens In:   %d\nCost (est):  $%.6f\nResource ID: %s (%s)\n"
    return rows.withColumn("text", F.format_string(block, "path", "tokens", "cost", "resource_id", "id_source"))


def estimate_total(rows: DataFrame) -> DataFrame:
    """The last line of an estimate; costs are summed as whole pico-dollars, so their order doesn't matter."""
    total = F.coalesce(F.sum(F.round(F.col("cost") * 1e12).cast("decimal(38,0)")), F.lit(0)).cast("double") / 1e12
    return rows.agg(F.format_string("Total Cost:  $%.6f", total).alias("text"))


def _global(parities: DataFrame, baseline: str) -> DataFrame:
    from .fairness import gini, worst

    return gini(parities, "parity_ratio").crossJoin(worst(parities, baseline))  # one row each


def fairness_json(parities: DataFrame, model: str, encoding: str, baseline: str) -> DataFrame:
    """One JSON text of meta, global_metrics and languages (by code) of parities (lang, tokens, words, bytes, fertility, parity_ratio); one row a language."""
    own = F.concat(quoted("lang"), F.format_string(':{"tokens":%d,"words":%d,"bytes":%d,"fertility":', "tokens", "words", "bytes"), json_number(F.col("fertility")), F.lit(',"parity_ratio":'), json_number(F.col("parity_ratio")), F.lit("}"))
    langs = parities.agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("lang", own.alias("x")))), lambda x: x["x"])).alias("langs"))
    meta = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(encoding).alias("encoding"), F.lit(baseline).alias("baseline")))
    whole = F.concat(F.lit('{"meta":'), meta, F.lit(',"global_metrics":{"gini_coefficient":'), json_number(F.col("gini")), F.lit(',"max_parity_ratio":'), json_number(F.col("max_parity")), F.lit(',"worst_language":'), quoted("worst_lang"), F.lit('},"languages":{'), "langs", F.lit("}}"))
    return _global(parities, baseline).crossJoin(langs).select(whole.alias("text"))


def fairness_text(parities: DataFrame, model: str, encoding: str, baseline: str) -> DataFrame:
    """The same as a text."""
    head = f"Fairness Analysis Report\n========================\n\nModel: {model}\nEncoding: {encoding}\nBaseline: {baseline}\n\nGlobal Metrics:\n".replace("%", "%%")
    table = "Per-Language Stats:\n" + " ".join(x.rjust(w) for x, w in zip(("Lang", "Tokens", "Words", "Bytes", "Fertility", "Parity"), (6, 10, 10, 10, 12, 12))) + "\n" + " ".join("-" * w for w in (6, 10, 10, 10, 12, 12)) + "\n"
    row = F.format_string("%6s %10d %10d %10d %12.2f %11.2fx", "lang", "tokens", "words", "bytes", "fertility", "parity_ratio")
    lines = parities.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("lang", row.alias("x")))), lambda x: x["x"])).alias("lines"))
    body = head + "  Gini Coefficient: %.4f\n  Max Parity Ratio: %.2fx\n  Most Taxed: %s\n\n" + table + "%s\n"
    return _global(parities, baseline).crossJoin(lines).select(_text(body, "gini", "max_parity", "worst_lang", "lines"))
