"""Prices of models: the packaged table, price files of two layouts, staleness and source selection."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "model string, provider string, input_price double, output_price double, reasoning_price double"
STALE_AFTER_DAYS = 90
MOST_BYTES, MOST_MODELS = 10 * 1024 * 1024, 1000

# US dollars a million tokens.
PRICES = [
    ("gpt-5", "OpenAI", 1.25, 10.00, None),
    ("gpt-5-mini", "OpenAI", 0.25, 2.00, None),
    ("gpt-5-nano", "OpenAI", 0.05, 0.40, None),
    ("gpt-4o", "OpenAI", 5.00, 20.00, None),
    ("gpt-4o-mini", "OpenAI", 0.60, 2.40, None),
    ("gemini-2.5-pro", "Google", 1.25, 10.00, None),
    ("gemini-2.5-flash", "Google", 0.15, 0.60, 3.50),
    ("claude-opus-4.1", "Anthropic", 15.00, 75.00, None),
    ("claude-sonnet-4", "Anthropic", 3.00, 15.00, None),
    ("claude-haiku-3.5", "Anthropic", 0.80, 4.00, None),
    ("grok-3", "xAI", 3.00, 15.00, None),
    ("grok-3-mini", "xAI", 0.30, 0.50, None),
    ("deepseek-v3.2-exp", "DeepSeek", 0.28, 0.42, None),
]


def prices_sql(columns: str = "model, provider, input_price, output_price, reasoning_price") -> str:
    """The packaged table as a VALUES query, for Spark and for other SQL."""
    rows = ", ".join(f"('{m}', '{p}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE), CAST({'NULL' if r is None else r} AS DOUBLE))" for m, p, i, o, r in PRICES)
    return f"SELECT {columns} FROM (VALUES {rows}) AS t(model, provider, input_price, output_price, reasoning_price)"


def packaged_prices(spark: SparkSession) -> DataFrame:
    return spark.sql(prices_sql())


def _number(entry: dict, *names: str) -> float | None:
    return next((float(entry[n]) for n in names if isinstance(entry.get(n), int | float)), None)


def parse_prices(text: str) -> list[tuple]:
    """Rows of a price file {model: {...}} or {models: {model: {...}}}; entries that aren't objects are skipped.

    Prices that are absent or not above 0 fall back to the older cost fields, a missing provider is Unknown.
    """
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("price file too large")
    root = json.loads(text)
    if not isinstance(root, dict):
        raise ValueError("a price file is a JSON object")
    models = root["models"] if isinstance(root.get("models"), dict) else root
    out = []
    for model, entry in models.items():
        if isinstance(entry, dict):
            price_in, price_out = _number(entry, "input_price_per_mtok") or _number(entry, "input_cost_per_mtok") or 0.0, _number(entry, "output_price_per_mtok") or _number(entry, "output_cost_per_mtok") or 0.0
            out.append((model, entry.get("provider", "Unknown"), price_in, price_out, _number(entry, "output_reasoning_price_per_mtok")))
    if len(out) > MOST_MODELS:
        raise ValueError("too many models")
    return out


def prices_of_texts(files: DataFrame, text: str) -> DataFrame:
    """files with a row for each model of the price files in a column of JSON texts, by the rules of parse_prices().

    Columns of the file, then model, provider, input_price, output_price, reasoning_price; a text that is no JSON object has no row.
    """
    whole = F.from_json(text, "map<string,variant>")
    inner = F.from_json(F.to_json(whole["models"]), "map<string,variant>")
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    rows = files.withColumn("__models", F.when(is_object(whole["models"]), inner).otherwise(whole))
    rows = rows.select(*files.columns, F.explode("__models").alias("model", "__entry")).where(is_object(F.col("__entry")))

    def number(*names):
        found = []
        for name in names:
            kind = F.schema_of_variant(F.try_variant_get("__entry", f"$.{name}", "variant"))
            value = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get("__entry", f"$.{name}", "double"))
            found.append(F.nullif(value, F.lit(0.0)) if len(names) > 1 else value)
        return F.coalesce(*found)

    price = lambda side: F.coalesce(number(f"{side}_price_per_mtok", f"{side}_cost_per_mtok"), F.lit(0.0))
    provider = F.coalesce(F.try_variant_get("__entry", "$.provider", "string"), F.lit("Unknown"))
    return rows.select(*files.columns, "model", provider.alias("provider"), price("input").alias("input_price"), price("output").alias("output_price"), number("output_reasoning_price_per_mtok").alias("reasoning_price"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A price file as a table; only the driver reads it, its size is bounded."""
    return spark.createDataFrame(parse_prices(_read(spark, path)), SCHEMA)


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def staleness(valid_until, now) -> Column:
    """Fresh, Warning (past valid_until) or Critical (no date, or 90 days past), of times in epoch seconds."""
    end, now = F.coalesce(valid_until, F.lit(0)), F.lit(now) if isinstance(now, int) else now
    return F.when((end == 0) | (now > end + STALE_AFTER_DAYS * 86400), "Critical").when(now > end, "Warning").otherwise("Fresh")


def stale_state(valid_until: int | None, now: float) -> str:
    end = valid_until or 0
    if not end or now > end + STALE_AFTER_DAYS * 86400:
        return "Critical"
    return "Warning" if now > end else "Fresh"


class Prices(NamedTuple):
    """Prices, where they come from (cache or packaged), and why a given cache isn't used."""

    prices: DataFrame
    source: str
    reason: str | None


def load_prices(spark: SparkSession, cached: str | None = None, verify: Callable[[bytes], bool] | None = None, sha256: str | None = None, now: float | None = None) -> Prices:
    """Prices of a cached file that is verified first and not critically stale, else the packaged table.

    `verify` is any signature check over the file's bytes; without one the file's SHA-256 must be the given one.
    """
    reason = None
    if cached:
        try:
            text = _read(spark, cached)
            data = text.encode()
            if not (verify(data) if verify else sha256 is not None and hashlib.sha256(data).hexdigest() == sha256):
                return Prices(packaged_prices(spark), "packaged", "not verified")
            end = json.loads(text).get("valid_until")
            if stale_state(end if isinstance(end, int) else None, now or time.time()) == "Critical":
                return Prices(packaged_prices(spark), "packaged", "stale")
            return Prices(spark.createDataFrame(parse_prices(text), SCHEMA), "cache", None)
        except Exception as e:  # any fault of the cache falls back to the packaged table, with its reason
            reason = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return Prices(packaged_prices(spark), "packaged", reason)
