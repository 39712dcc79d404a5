"""Models: which encoding they use, what a name resolves to, what tokens cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ordered prefixes of model names and their encodings.
PREFIXES = [("gpt-4o", "o200k_base"), ("o1", "o200k_base"), ("o3", "o200k_base"), ("gpt-4", "cl100k_base"), ("gpt-3.5", "cl100k_base"), ("text-embedding", "cl100k_base"), ("claude", "cl100k_base")]
CANONICAL = {"gpt-4o": ("o200k_base", "gpt4"), "gpt-4o-mini": ("o200k_base", "gpt4"), "gpt-4-turbo": ("cl100k_base", "gpt4"), "gpt-3.5-turbo": ("cl100k_base", "gpt3")}
PROVIDER_FAMILIES = {"openai": "gpt4", "meta": "llama3", "mistral": "mistral"}
PROVIDERS = ["OpenAI", "Google", "Anthropic", "xAI", "DeepSeek", "Meta", "Mistral"]
DEFAULT_MODEL = "gpt-4o"
CI_VARIABLES = ["CI", "GITHUB_ACTIONS", "GITLAB_CI", "CIRCLECI", "TRAVIS", "JENKINS_URL", "BUILDKITE", "TF_BUILD"]


def encoding_of(model) -> Column:
    """Name of the model's encoding, null where no prefix fits."""
    model = F.col(model) if isinstance(model, str) else model
    out = F.when(F.lit(False), "")
    for prefix, name in PREFIXES:
        out = out.when(model.startswith(prefix), name)
    return out


def resolve_model(model) -> Column:
    """struct(provider, name, canonical, encoding, family, accuracy, has_pricing) of a short or provider/name."""
    model = F.col(model) if isinstance(model, str) else model
    spaced = model.contains("/")
    space, short = F.substring_index(model, "/", 1), F.regexp_replace(model, "^[^/]*/", "")
    known = F.when(~spaced, F.concat(F.lit("openai/"), model)).otherwise(model)
    table = F.create_map(*(F.lit(x) for k, v in CANONICAL.items() for x in (f"openai/{k}", "|".join(v))))
    hit = table[known]
    guess = F.create_map(*(F.lit(x) for kv in PROVIDER_FAMILIES.items() for x in kv))
    exact = hit.isNotNull()
    return F.struct(
        F.when(exact, "openai").when(spaced & guess[space].isNotNull(), space).otherwise("generic").alias("provider"),
        short.alias("name"),
        F.when(exact, known).otherwise(model).alias("canonical"),
        F.when(exact, F.substring_index(hit, "|", 1)).alias("encoding"),
        F.when(exact, F.substring_index(hit, "|", -1)).otherwise(F.coalesce(F.when(spaced, guess[space]), F.lit("unknown"))).alias("family"),
        F.when(exact, "exact").otherwise("heuristic").alias("accuracy"),
        exact.alias("has_pricing"),
    )


def provider_name(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.isin(PROVIDERS), name).otherwise("Unknown")


def token_cost(prompt, completion, reasoning, price_in="input_price", price_out="output_price", price_reasoning="reasoning_price") -> Column:
    """Dollars: (price / 1e6) x tokens for input, output without reasoning, and reasoning, summed in this order.

    Reasoning tokens cost the output price where no own price is given; more reasoning than output leaves output 0.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    prompt, completion, reasoning, out = c(prompt), c(completion), c(reasoning), F.coalesce(c(price_out), F.lit(0.0))
    own = F.coalesce(c(price_reasoning), F.lit(0.0))
    rate = F.when(own > 0, own).otherwise(out)
    return F.coalesce(c(price_in), F.lit(0.0)) / 1e6 * prompt + out / 1e6 * F.greatest(completion - reasoning, F.lit(0)) + rate / 1e6 * reasoning


def kind_cost(tokens, kind: str, prices: dict[str, float | None]) -> float:
    """Dollars of one kind of tokens, multiplied first; cache and reasoning kinds fall back to input and output prices."""
    back = {"Input": "input", "Output": "output", "Reasoning": "output", "CacheRead": "input", "CacheWrite": "input"}
    own = {"Input": "input", "Output": "output", "Reasoning": "reasoning", "CacheRead": "cache_read", "CacheWrite": "cache_write"}[kind]
    price = prices.get(own)
    return tokens * (price if price is not None else prices.get(back[kind]) or 0.0) / 1e6


def rounded_cents(cost) -> Column:
    return F.round((F.col(cost) if isinstance(cost, str) else cost) * 100).cast("long")


def in_ci(env: dict[str, str]) -> bool:
    return any(k in env for k in CI_VARIABLES)


def models_list(prices: DataFrame) -> DataFrame:
    """id, provider, encoding, prices of all priced models, by id."""
    return prices.select(F.col("model").alias("id"), "provider", encoding_of("model").alias("encoding"), "input_price", "output_price", "reasoning_price").orderBy("id")


def special_tokens(spark: SparkSession) -> DataFrame:
    from .bpe import ENCODINGS

    rows = [(e.name, t, i) for e in ENCODINGS.values() for t, i in e.specials.items()]
    return spark.createDataFrame(rows, "encoding string, token string, id int")
