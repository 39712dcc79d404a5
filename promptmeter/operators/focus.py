"""Billing export in the FinOps FOCUS columns, with tags as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed_point, quoted

COLUMNS = ["ChargePeriodStart", "ChargeCategory", "BilledCost", "ResourceId", "ResourceType", "RegionId", "ServiceCategory", "ServiceName", "ConsumedQuantity", "ConsumedUnit", "Tags"]
# Tag keys that users can't set. The key of the export's own type is a parameter (see tags_json).
RESERVED = ["focus-version", "focus-target", "provider", "model", "effective-cost", "resource-name", "x-token-count-input", "x-token-count-output", "x-cache-hit-ratio", "x-content-hash"]


def canonical_json(encoded: Column) -> Column:
    """A map of keys to encoded values as JSON: keys in byte order, no blanks."""
    entries = F.array_sort(F.map_entries(encoded))
    return F.concat(F.lit("{"), F.concat_ws(",", F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))), F.lit("}"))


def tags_json(rows_cost: Column, user_tags: Column, type_key: str = "cost-type", cache_hit_ratio: float | None = None, content_hash: Column | None = None, target: str = "vantage") -> Column:
    """Tags of a row with columns provider, model, path, tokens_in and tokens_out."""
    fixed = {
        type_key: quoted(F.lit("estimate")),
        "focus-version": quoted(F.lit("1.0")),
        "focus-target": quoted(F.lit(target)),
        "provider": quoted(F.col("provider")),
        "model": quoted(F.col("model")),
        "effective-cost": quoted(rows_cost),
        "resource-name": quoted(F.col("path")),
        "x-content-hash": quoted(F.lit("todo-hash") if content_hash is None else content_hash),
        "x-token-count-input": F.col("tokens_in").cast("string"),
        "x-token-count-output": F.col("tokens_out").cast("string"),
    }
    if cache_hit_ratio is not None:
        fixed["x-cache-hit-ratio"] = F.lit(f"{cache_hit_ratio:.2f}")
    own = F.map_filter(F.coalesce(user_tags, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin([type_key, *RESERVED]))
    own = F.transform_values(own, lambda k, v: quoted(v))
    return canonical_json(F.map_concat(F.create_map(*(x for k, v in fixed.items() for x in (F.lit(k), v))), own))


def export(rows: DataFrame, day: Column | None = None, **tag_options) -> DataFrame:
    """FOCUS rows of rows (resource_id, path, provider, model, tokens_in, tokens_out, cost, tags); day defaults to today, UTC."""
    cost = fixed_point("cost")
    when = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd") if day is None else day
    values = [when, F.lit("Usage"), cost.cast("decimal(38,12)"), F.col("resource_id"), F.lit("LLM"), F.lit(""), F.lit("AI and Machine Learning"), F.lit("LLM Inference"), (F.col("tokens_in") + F.col("tokens_out")).cast("long"), F.lit("Tokens"), tags_json(cost, F.col("tags"), **tag_options)]
    return rows.select(*(v.alias(c) for v, c in zip(values, COLUMNS, strict=True)))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header; quotes only where needed, doubled inside."""
    rows.write.csv(path, header=True, quote='"', escape='"', emptyValue="", mode="overwrite")
