"""Usage lines: JSON logs, JSON objects with a text field, and raw text become token counts and costs; quotas stop them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import token_cost
from ..functions.text import approximate_tokens, pico, quoted

_RECORD = "usage struct<prompt_tokens string, completion_tokens string, total_tokens string, completion_tokens_details struct<reasoning_tokens string>>, input_tokens string, output_tokens string"
_WHOLE = "^[0-9]{1,19}$"
#: Slices of a running total, whose sums one task takes.
SLICES = 10_000


def classify(lines: DataFrame, mode: str = "auto", json_field: str = "content", tokens: Column | None = None) -> DataFrame:
    """lines (value, maybe error) with kind, input, output, reasoning and error.

    kind: usage (counts in the line), object or raw (text counted, by `tokens` of column __text or as words), error.
    mode: auto, json_field (a line that isn't JSON is an error) or raw. A count that isn't a whole number voids the record.
    """
    r = F.col("__r")
    numbers = [r["usage"]["prompt_tokens"], r["usage"]["completion_tokens"], r["usage"]["total_tokens"], r["usage"]["completion_tokens_details"]["reasoning_tokens"], r["input_tokens"], r["output_tokens"]]
    sound = F.lit(True)
    for n in numbers:
        sound = sound & (n.isNull() | n.rlike(_WHOLE))
    count = lambda x: F.coalesce(F.expr(f"try_cast({x} AS BIGINT)"), F.lit(0)).cast("long")
    given = lines if "error" in lines.columns else lines.withColumn("error", F.lit(None).cast("string"))
    rows = given.withColumn("__r", F.from_json("value", _RECORD)).withColumn("__v", F.try_parse_json("value"))
    has_usage = r["usage"].isNotNull()
    member = F.schema_of_variant(F.try_variant_get("__v", "$.usage", "variant"))
    sound = sound & F.coalesce(member.startswith("OBJECT") | (member == "VOID"), F.lit(True))
    is_log = sound & (has_usage | r["input_tokens"].isNotNull() | r["output_tokens"].isNotNull())
    field = F.try_variant_get("__v", f"$.{json_field}", "variant")
    in_object = F.schema_of_variant("__v").startswith("OBJECT") & (F.schema_of_variant(field) == "STRING")
    text = F.when(F.lit(mode == "raw"), F.col("value")).when(in_object, F.try_variant_get("__v", f"$.{json_field}", "string")).otherwise(F.col("value"))
    kind = F.when(F.col("error").isNotNull(), "error").when(is_log, "usage")
    if mode == "json_field":
        kind = kind.when(F.col("__v").isNull(), "error")
    if mode != "raw":
        kind = kind.when(F.schema_of_variant("__v").startswith("OBJECT"), "object")
    rows = rows.withColumn("kind", kind.otherwise("raw")).withColumn("__text", text)
    log = F.col("kind") == "usage"
    counted = approximate_tokens("__text") if tokens is None else tokens
    pick = lambda a, b: F.when(has_usage, count(a)).otherwise(count(b))
    zero = F.lit(0).cast("long")
    return rows.select(
        *[c for c in given.columns if c != "error"],
        "kind",
        F.when(log, pick("__r.usage.prompt_tokens", "__r.input_tokens")).when(F.col("kind") == "error", zero).otherwise(counted).alias("input"),
        F.when(log, pick("__r.usage.completion_tokens", "__r.output_tokens")).otherwise(zero).alias("output"),
        F.when(log & has_usage, count("__r.usage.completion_tokens_details.reasoning_tokens")).otherwise(zero).alias("reasoning"),
        F.coalesce("error", F.when(F.col("kind") == "error", "Processing error")).alias("error"),
    )


def with_cost(rows: DataFrame, price: tuple[float, float, float | None]) -> DataFrame:
    """rows with their cost at one model's prices (input, output, reasoning)."""
    return rows.withColumn("cost", F.when(F.col("error").isNull(), token_cost("input", "output", "reasoning", *(F.lit(p).cast("double") for p in price))))


def as_json(rows: DataFrame) -> Column:
    """The output line: counts and cost of a log, the object with its usage, tokens and cost of raw text, or the error."""
    six = lambda c: F.format_string("%.6f", c)
    log = F.concat(F.lit('{"input":'), "input", F.lit(',"output":'), "output", F.lit(',"reasoning":'), "reasoning", F.lit(',"cost":'), six(F.col("cost")), F.lit("}"))
    raw = F.concat(F.lit('{"tokens":'), "input", F.lit(',"cost":'), six(F.col("cost")), F.lit("}"))
    usage = F.concat(F.lit('{"input_tokens":'), "input", F.lit(',"cost_usd":'), json_number(F.col("cost")), F.lit("}"))
    # an object keeps its members, with their types and in their order; usage is set where it stands or at the end
    members = F.map_entries(F.from_json("value", "map<string,variant>"))
    written = F.transform(members, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.when(e["key"] == "usage", usage).otherwise(F.coalesce(F.to_json(e["value"]), F.lit("null")))))
    own = F.when(F.exists(members, lambda e: e["key"] == "usage"), written).otherwise(F.concat(written, F.array(F.concat(F.lit('"usage":'), usage))))
    enriched = F.concat(F.lit("{"), F.concat_ws(",", own), F.lit("}"))
    error = F.to_json(F.struct("error"))
    return F.when(F.col("kind") == "usage", log).when(F.col("kind") == "object", enriched).when(F.col("kind") == "error", error).otherwise(raw)


def json_number(x: Column) -> Column:
    """A double in its shortest decimal form, with a small e: 2.68e-4, 3e-7, 0.5, 0."""
    return F.lower(F.regexp_replace(x.cast("string"), r"\.0(E|$)", "$1"))


def summary_text(sums: DataFrame) -> DataFrame:
    """The summary block of totals() as one text: lines, tokens, cost with six decimals."""
    return sums.select(F.format_string("Lines: %d\nTokens: %d\nCost: $%.6f", "lines", "tokens", F.col("cost_pico").cast("double") / 1e12).alias("text"))


def totals(rows: DataFrame) -> DataFrame:
    """Lines, tokens (input and output) and cost of the rows without error."""
    good = rows.where("error IS NULL")
    return good.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.col("input") + F.col("output")), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.sum(pico("cost")), F.lit(0)).cast("decimal(38,0)").alias("cost_pico"))


def until_quota(rows: DataFrame, order: str, max_tokens: int | None = None, max_cost_pico: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """rows in `order` (whole numbers) up to and with the one at which a running total reaches its limit.

    Running totals in two steps: totals of slices of the order, then sums inside each slice, so no task takes all rows.
    Without a given size, slices are as large as keeps their number at SLICES at most, and have 100,000 numbers at least.
    """
    if slice_rows is None:
        low, high = rows.agg(F.min(order), F.max(order)).first()
        slice_rows = max(100_000, (int(high) - int(low)) // SLICES + 1) if low is not None else 100_000
    piece = F.floor(F.col(order) / slice_rows)
    each = rows.withColumn("__s", piece).withColumn("__ok", F.col("error").isNull())
    each = each.withColumn("__t", F.when(F.col("__ok"), F.col("input") + F.col("output")).otherwise(0).cast("decimal(38,0)")).withColumn("__c", F.when(F.col("__ok"), pico("cost")).otherwise(0).cast("decimal(38,0)"))
    sums = each.groupBy("__s").agg(F.sum("__t").alias("st"), F.sum("__c").alias("sc"), F.sum(F.col("__ok").cast("long")).alias("sn"))
    before = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__s", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in ("st", "sc", "sn")))
    # slices behind the limit are left out before their rows are moved
    within = [F.col(c) < limit for limit, c in ((max_tokens, "bst"), (max_cost_pico, "bsc")) if limit is not None]
    starts = starts.where((F.col("bsn") == 0) | reduce(lambda a, b: a & b, within, F.lit(True)))
    inside = Window.partitionBy("__s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda base, c: F.col(base) + F.coalesce(F.sum(c).over(inside), F.lit(0))
    out = each.join(starts, "__s").select(*rows.columns, prior("bst", "__t").alias("__pt"), prior("bsc", "__c").alias("__pc"), prior("bsn", F.col("__ok").cast("long")).alias("__pn"))
    keep = F.lit(True)
    for limit, total in ((max_tokens, "__pt"), (max_cost_pico, "__pc")):
        if limit is not None:
            keep = keep & (F.col(total) < limit)
    return out.where((F.col("__pn") == 0) | keep).select(*rows.columns)
