"""Registered queries of the analytics operators, and equivalent DuckDB SQL."""

from __future__ import annotations

import base64
import uuid

from pyspark.sql import functions as F

from ..functions import bpe, models, pretok, signatures, text, utf8
from ..operators import costs, encoding, fairness, focus, governance, render, tariffs, usage
from ..sources import config, pricing
from ..sources.cut import shared_dir
from ..sources.files import is_prompt_path, lines_of, ranks_of, read_tiktoken
from ..sources.pricing import packaged_prices, prices_sql, staleness
from ..streaming import windows

GPT_4O = (5.00, 20.00, None)
FLASH = (0.15, 0.60, 3.50)


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    """Documents as prompt files."""
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), "lang", "source")


_DOCS = "(SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text AS content, lang, source FROM documents)"
_WORDS = "CAST(len(regexp_extract_all({0}, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT)"


def _tokens(x):
    n = _WORDS.format(x)
    return f"(CASE WHEN {n} = 0 AND strlen({x}) > 0 THEN 1 ELSE {n} END)"


_COST = "coalesce(input_price, 0.0::DOUBLE) / 1000000.0::DOUBLE * {0} + coalesce(output_price, 0.0::DOUBLE) / 1000000.0::DOUBLE * greatest({1} - {2}, 0) + (CASE WHEN coalesce(reasoning_price, 0.0::DOUBLE) > 0 THEN reasoning_price ELSE coalesce(output_price, 0.0::DOUBLE) END) / 1000000.0::DOUBLE * {2}"
_PICO = "CAST(round(({0}) * 1000000000000.0::DOUBLE) AS DECIMAL(38,0))"
_ENC = "CASE " + " ".join(f"WHEN starts_with({{0}}, '{p}') THEN '{e}'" for p, e in models.PREFIXES) + " END"


def _used_prices(spark, sf_dir):
    """Prices of the models that prompts use."""
    return packaged_prices(spark).join(_prompts(spark, sf_dir).select("model").distinct(), "model", "left_semi")


def q_models(spark, sf_dir):
    return models.models_list(_used_prices(spark, sf_dir))


def q_cost_by_lang_model(spark, sf_dir):
    """Tokens and cost of each language at every model's price; texts are counted once, then priced by language."""
    by_lang = fairness.by_language(_docs(spark, sf_dir)).select("lang", "tokens")
    prices = packaged_prices(spark)
    priced = by_lang.withColumn("model", F.explode(F.array(*[F.lit(p[0]) for p in _price_rows()])))
    rows = costs.with_prices(priced, prices)
    zero = F.lit(0).cast("long")
    return rows.select("lang", "model", "tokens", text.pico(models.token_cost("tokens", zero, zero)).cast("long").alias("cost_pico"))


def _price_rows():
    from ..sources.pricing import PRICES

    return PRICES


def q_encoding_map(spark, sf_dir):
    """The encoding of each model that prompts use, and its prompts."""
    used = _prompts(spark, sf_dir).groupBy("model").agg(F.count("*").alias("prompts"))
    return used.select("model", models.encoding_of("model").alias("encoding"), "prompts")


def q_slug(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("r", text.resource_id(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("id-"), F.col("doc_id").cast("string"))), "path"))
    return d.select("doc_id", text.slugify("path").alias("slug"), F.col("r.value").alias("resource_id"), F.col("r.source").alias("id_source"))


def q_words_modes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *(text.word_count("content", m).alias(m) for m in ("whitespace", "character", "heuristic")), text.words_narrow("content").alias("narrow"), text.byte_length("content").alias("bytes"), text.approximate_tokens("content").alias("tokens"))


def q_report(spark, sf_dir):
    return costs.report(_docs(spark, sf_dir), 5.0)


_LINE = """CASE event_id % 8
 WHEN 0 THEN '{"usage":{"prompt_tokens":' || CAST(event_id % 1000 AS {s}) || ',"completion_tokens":' || CAST(event_id % 300 AS {s}) || ',"completion_tokens_details":{"reasoning_tokens":' || CAST(event_id % 50 AS {s}) || '}}}'
 WHEN 1 THEN '{"input_tokens":' || CAST(event_id % 777 AS {s}) || ',"output_tokens":' || CAST(event_id % 99 AS {s}) || ',"id":"x"}'
 WHEN 2 THEN '{"content":"some words about ' || event_type || '","n":1}'
 WHEN 3 THEN '{"other":[1,2]}'
 WHEN 4 THEN event_type || ' not json ' || CAST(event_id AS {s})
 WHEN 5 THEN '[1, 2, 3]'
 WHEN 6 THEN ''
 ELSE '{"input_tokens":-5,"output_tokens":1}' END"""


def _lines(spark, sf_dir):
    """Usage lines made from events."""
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.expr(_LINE.replace("{s}", "STRING")).alias("value"))


_LINES = f"(SELECT event_id AS line_no, event_id % 8 AS k, event_type, {_LINE.replace('{s}', 'VARCHAR')} AS value FROM events)"
_FLASH = "(SELECT 0.15::DOUBLE AS input_price, 0.60::DOUBLE AS output_price, 3.50::DOUBLE AS reasoning_price)"


def _classified_sql(mode: str) -> str:
    """What the lines mean, read with DuckDB's own JSON functions."""
    num = lambda p: f"TRY_CAST(json_extract_string(j, '{p}') AS BIGINT)"
    bad = f"'{{\"error\":true}}'" if mode == "json_field" else None
    text_ = "coalesce(CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.content') = 'VARCHAR' THEN json_extract_string(j, '$.content') END, value)"
    error = "NOT v" if bad else "false"
    return f"""(SELECT line_no, CASE WHEN is_log THEN 'usage' WHEN {error} THEN 'error' WHEN json_type(j) = 'OBJECT' THEN 'object' ELSE 'raw' END AS kind,
 CASE WHEN is_log THEN coalesce({num('$.usage.prompt_tokens')}, {num('$.input_tokens')}, 0) WHEN {error} THEN 0 ELSE {_tokens(text_)} END AS input,
 CASE WHEN is_log THEN coalesce({num('$.usage.completion_tokens')}, {num('$.output_tokens')}, 0) ELSE 0 END AS output,
 CASE WHEN is_log THEN coalesce({num('$.usage.completion_tokens_details.reasoning_tokens')}, 0) ELSE 0 END AS reasoning,
 CASE WHEN {error} THEN 'Processing error' END AS error
 FROM (SELECT *, v AND coalesce(json_type(j) = 'OBJECT' AND (json_type(j, '$.usage') = 'OBJECT' OR {num('$.input_tokens')} >= 0 OR ({num('$.output_tokens')} >= 0 AND coalesce({num('$.input_tokens')} >= 0, true))), false) AS is_log
  FROM (SELECT *, json_valid(value) AS v, CASE WHEN json_valid(value) THEN value::JSON END AS j FROM {_LINES})))"""


def _usage_sql(mode="auto"):
    return f"(SELECT c.*, CASE WHEN error IS NULL THEN {_COST.format('input', 'output', 'reasoning')} END AS cost FROM {_classified_sql(mode)} c, {_FLASH})"


def q_pipe_mixed(spark, sf_dir):
    rows = usage.with_cost(usage.classify(_lines(spark, sf_dir)), FLASH)
    return rows.select("line_no", "kind", "input", "output", "reasoning", text.pico("cost").cast("long").alias("cost_pico"), "error")


def q_pipe_json_field(spark, sf_dir):
    rows = usage.with_cost(usage.classify(_lines(spark, sf_dir), "json_field"), FLASH)
    return rows.select("line_no", "kind", "input", "output", "reasoning", text.pico("cost").cast("long").alias("cost_pico"), "error")


def q_pipe_output(spark, sf_dir):
    """The output lines themselves."""
    rows = usage.with_cost(usage.classify(_lines(spark, sf_dir)), FLASH)
    return rows.select("line_no", usage.as_json(rows).alias("json"))


def q_pipe_summary(spark, sf_dir):
    rows = usage.with_cost(usage.classify(_lines(spark, sf_dir), "json_field"), FLASH)
    return usage.totals(rows).select("lines", "tokens", F.col("cost_pico").cast("long").alias("cost_pico"))


def q_usage_cost(spark, sf_dir):
    """Conversations as usage: what users write is input, what assistants write output."""
    c = _t(spark, sf_dir, "conversations").withColumn("n", text.approximate_tokens("text"))
    rows = c.groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "assistant", 0).otherwise(F.col("n"))).alias("input"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("output"))
    rows = rows.withColumn("reasoning", F.lit(0).cast("long")).withColumn("error", F.lit(None).cast("string"))
    return usage.with_cost(rows, GPT_4O).select("conv_id", "input", "output", text.pico("cost").cast("long").alias("cost_pico"))


def q_quota_tokens(spark, sf_dir):
    rows = usage.with_cost(usage.classify(_lines(spark, sf_dir), "json_field"), FLASH)
    return usage.until_quota(rows, "line_no", max_tokens=100_000, slice_rows=1000).select("line_no", "kind", "input", "output")


def q_quota_cost(spark, sf_dir):
    rows = usage.with_cost(usage.classify(_lines(spark, sf_dir), "json_field"), FLASH)
    return usage.until_quota(rows, "line_no", max_cost_pico=50_000_000_000, slice_rows=1000).select("line_no", "kind", "input", "output")


def _quota_sql(total, limit):
    each = "CASE WHEN error IS NULL THEN input + output ELSE 0 END" if total == "tokens" else f"CASE WHEN error IS NULL THEN {_PICO.format('cost')} ELSE 0 END"
    return f"""SELECT line_no, kind, input, output FROM (SELECT *, coalesce(sum({each}) OVER b, 0) AS prior, coalesce(sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) OVER b, 0) AS good
 FROM {_usage_sql('json_field')} WINDOW b AS (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE good = 0 OR prior < {limit}"""


def _prompts(spark, sf_dir):
    """Documents as prompts, with models dealt by id."""
    names = F.array(*[F.lit(p[0]) for p in _price_rows()], F.lit("unknown-model"))
    return _docs(spark, sf_dir).withColumn("model", F.element_at(names, (F.col("doc_id") % 14 + 1).cast("int")))


_PROMPTS = f"(SELECT *, [{', '.join(repr(p[0]) for p in _price_rows())}, 'unknown-model'][CAST(doc_id % 14 + 1 AS INT)] AS model FROM {_DOCS})"
ALLOWED = ["gpt-4o", "gpt-4o-mini", "claude-sonnet-4"]


def q_policy_violations(spark, sf_dir):
    return governance.violations(_prompts(spark, sf_dir), ALLOWED).groupBy("model").agg(F.count("*").alias("prompts"), F.min("path").alias("first_path"))


def q_budget_gate(spark, sf_dir):
    rows = costs.text_costs(_prompts(spark, sf_dir), packaged_prices(spark), missing="zero").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    sums = rows.groupBy("source").agg(F.count("*").alias("prompts"), F.sum(text.pico("cost")).alias("pico"))
    over = governance.budget(F.col("pico").cast("double"), 2e10)
    return sums.select("source", "prompts", F.col("pico").cast("long").alias("total_pico"), F.when(over["over"], governance.OVER_BUDGET).otherwise(governance.OK).alias("exit_code"))


def q_estimate(spark, sf_dir):
    """Cost of each prompt, models without price left out."""
    rows = costs.text_costs(_prompts(spark, sf_dir), packaged_prices(spark), missing="drop")
    return rows.select(text.slugify("path").alias("resource_id"), "model", "tokens", text.pico("cost").cast("long").alias("cost_pico"))


def _snapshots(spark, sf_dir):
    """Two snapshots that leave out different documents, so that each stands in one at least."""
    rows = costs.text_costs(_prompts(spark, sf_dir).withColumn("model", F.lit("gpt-4o")), packaged_prices(spark))
    rows = rows.select("doc_id", "path", F.col("path").alias("resource_id"), text.pico("cost").alias("cost"))
    base = rows.where("doc_id % 5 <> 0").select("path", "resource_id", "cost")
    head = rows.where("doc_id % 5 <> 1").select("path", "resource_id", (F.col("cost") * F.when(F.col("doc_id") % 3 == 0, 2).when(F.col("doc_id") % 3 == 1, 1).otherwise(0)).alias("cost"))
    return governance.deltas(base, head)


_COSTED = f"(SELECT doc_id, path, {_PICO.format('5.0::DOUBLE / 1000000.0::DOUBLE * ' + _tokens('content') + ' + 20.0::DOUBLE / 1000000.0::DOUBLE * 0 + 20.0::DOUBLE / 1000000.0::DOUBLE * 0')} AS cost FROM {_DOCS})"
_DELTAS = f"""(SELECT path, path AS resource_id, a AS base_cost, b AS head_cost, coalesce(b, 0) - coalesce(a, 0) AS delta,
 CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN b > a THEN 'increased' WHEN b < a THEN 'decreased' ELSE 'unchanged' END AS status
 FROM (SELECT path, cost AS a FROM {_COSTED} WHERE doc_id % 5 <> 0) FULL JOIN (SELECT path, cost * CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS b FROM {_COSTED} WHERE doc_id % 5 <> 1) USING (path))"""


def q_delta(spark, sf_dir):
    return governance.ordered(_snapshots(spark, sf_dir)).select("resource_id", "path", F.col("base_cost").cast("long").alias("base_pico"), F.col("head_cost").cast("long").alias("head_pico"), F.col("delta").cast("long").alias("delta_pico"), "status", "priority")


def q_delta_sum(spark, sf_dir):
    s = _snapshots(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("delta").alias("d"))
    return s.select("status", "n", F.col("d").cast("long").alias("delta_pico"), governance.gate(F.lit(0.0), None, F.col("d"), True).alias("exit_code"))


def q_focus(spark, sf_dir):
    rows = costs.with_prices(_prompts(spark, sf_dir).withColumn("tokens_in", text.approximate_tokens("content")), packaged_prices(spark), "drop")
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("tokens_out", zero).withColumn("cost", models.token_cost("tokens_in", zero, zero))
    rows = rows.withColumn("resource_id", text.slugify("path")).withColumn("tags", F.create_map(F.lit("team"), F.col("source"), F.lit("provider"), F.lit("me")))
    out = focus.export(rows, F.lit("2025-01-31"), cache_hit_ratio=0.5)
    return out.withColumn("BilledCost", F.col("BilledCost").cast("string"))


def _focus_sql():
    cost = _COST.format(_tokens("content"), "0", "0")
    return f"""SELECT '2025-01-31' AS "ChargePeriodStart", 'Usage' AS "ChargeCategory", billed AS "BilledCost", slug AS "ResourceId", 'LLM' AS "ResourceType", '' AS "RegionId", 'AI and Machine Learning' AS "ServiceCategory", 'LLM Inference' AS "ServiceName", tokens AS "ConsumedQuantity", 'Tokens' AS "ConsumedUnit",
 '{{"cost-type":"estimate","effective-cost":"' || billed || '","focus-target":"vantage","focus-version":"1.0","model":"' || model || '","provider":"' || provider || '","resource-name":"' || path || '","team":"' || source || '","x-cache-hit-ratio":0.50,"x-content-hash":"todo-hash","x-token-count-input":' || CAST(tokens AS VARCHAR) || ',"x-token-count-output":0}}' AS "Tags"
 FROM (SELECT *, CAST(CAST(pico / 1000000000000 AS BIGINT) AS VARCHAR) AS x, CAST(pico // 1000000000000 AS VARCHAR) || '.' || lpad(CAST(pico % 1000000000000 AS VARCHAR), 12, '0') AS billed FROM (
  SELECT d.*, p.provider, {_tokens('content')} AS tokens, CAST({_PICO.format(cost)} AS BIGINT) AS pico, {_SLUG.format('path')} AS slug FROM {_PROMPTS} d JOIN ({prices_sql()}) p USING (model)))"""


_SLUG = "regexp_replace(lower(regexp_replace(regexp_replace({0}, '[^a-zA-Z0-9/\\\\._ ]', '', 'g'), '[/\\\\._ ]+', '-', 'g')), '^-+|-+$', '', 'g')"


def q_fairness_lang(spark, sf_dir):
    return fairness.with_parity(fairness.by_language(_docs(spark, sf_dir), n_words=text.words("content"), tokens=text.byte_length("content")), "en")


_LANGS = f"""(SELECT *, f / (SELECT f FROM l WHERE lang = 'en') AS parity_ratio FROM l)"""
_WITH_LANGS = f"WITH l AS (SELECT lang, CAST(sum(strlen(content)) AS BIGINT) AS tokens, CAST(sum({_WORDS.format('content')}) AS BIGINT) AS words, CAST(sum(strlen(content)) AS BIGINT) AS bytes, sum(strlen(content))::DOUBLE / sum({_WORDS.format('content')}) AS f FROM {_DOCS} GROUP BY lang)"


def q_gini(spark, sf_dir):
    return fairness.gini(q_fairness_lang(spark, sf_dir), "parity_ratio").select(F.round("gini", 9).alias("gini"))


def q_worst(spark, sf_dir):
    return fairness.worst(q_fairness_lang(spark, sf_dir), "en").select("worst_lang", F.round("max_parity", 9).alias("max_parity"))


def q_special_tokens(spark, sf_dir):
    odd = F.concat("content", F.element_at(F.array(F.lit("<|endoftext|>"), F.lit("<|fim_prefix|> <|endoftext|>"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int")))
    d = _docs(spark, sf_dir).withColumn("t", odd)
    listed = list(bpe.CL100K.specials)
    return d.select("doc_id", text.first_special("t", listed).alias("strict"), text.first_special("t", listed, "allow_list", ["<|endoftext|>"]).alias("listed"))


def _special_sql(tokens):
    at = lambda t: f"CASE WHEN contains(t, '{t}') THEN strlen(substr(t, 1, instr(t, '{t}') - 1)) END"
    return f"CAST(coalesce({', '.join(map(at, tokens))}) AS BIGINT)"


def q_pretok_spaces(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(pretok.pieces_sql("content", "spaces")).cast("long").alias("pieces"))


def q_pretok_cl100k(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", pretok.piece_count("content", "cl100k").alias("pieces"))


def q_pretok_o200k(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", pretok.piece_count("content", "o200k").alias("pieces"))


def q_top_pieces(spark, sf_dir):
    return costs.top_pieces(_docs(spark, sf_dir), pretok.pieces_sql("content", "spaces"), 20)


def _public_encoding(spark):
    import public_tokenizers

    return bpe.Encoding("byte_bpe_50k", "cl100k", ranks_of(read_tiktoken(spark, "file://" + public_tokenizers.path("byte_bpe_50k.tiktoken"))))


def q_bpe_count(spark, sf_dir):
    """Exact token counts with a public vocabulary."""
    d = _docs(spark, sf_dir).withColumn("c", bpe.count_tokens("content", _public_encoding(spark)))
    return d.select("doc_id", "c.tokens", "c.approximate")


def q_bpe_encode(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", bpe.encode("content", _public_encoding(spark)).alias("ids"))


def q_content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.content_hash("content").alias("hash"))


def q_lines(spark, sf_dir):
    return lines_of(_docs(spark, sf_dir), "doc_id", "content").groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(text.approximate_tokens("value")).alias("tokens"))


def q_percentiles(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("v", F.floor(F.coalesce("value", F.lit(0.0))).cast("long"))
    return costs.latency_stats(e, "v", "event_type")


def q_staleness(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 200) * 86400).alias("until"))
    return e.groupBy(staleness(F.col("until"), 150 * 86400).alias("state")).agg(F.count("*").alias("n"))


NAMES = ["gpt-4o", "openai/gpt-4o", "openai/new", "meta/llama-3-8b", "mistral/large", "other/x", "gpt-3.5-turbo", "plain"]


def q_resolve_models(spark, sf_dir):
    """What is known of the model names that documents are dealt, and how many documents have each."""
    dealt = _docs(spark, sf_dir).select(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int")).alias("model"))
    used = dealt.groupBy("model").agg(F.count("*").alias("prompts"))
    return used.select("model", "prompts", models.resolve_model("model").alias("r")).select("model", "prompts", "r.provider", "r.name", "r.encoding", "r.family", "r.accuracy")


def q_cost_rollup(spark, sf_dir):
    rows = costs.with_prices(_prompts(spark, sf_dir).withColumn("tokens", text.approximate_tokens("content")), packaged_prices(spark), "drop")
    zero = F.lit(0).cast("long")
    return rows.withColumn("pico", text.pico(models.token_cost("tokens", zero, zero))).rollup("provider", "model").agg(F.sum("tokens").alias("tokens"), F.sum("pico").cast("long").alias("cost_pico"))


def q_report_text(spark, sf_dir):
    return render.report_text(costs.report(_docs(spark, sf_dir), 5.0), "gpt-4o")


def q_report_json(spark, sf_dir):
    return render.report_json(costs.report(_docs(spark, sf_dir), 5.0), "gpt-4o")


def q_models_json(spark, sf_dir):
    return render.models_json(q_models(spark, sf_dir))


def q_models_text(spark, sf_dir):
    return render.models_text(q_models(spark, sf_dir))


def _estimated(spark, sf_dir):
    rows = costs.text_costs(_docs(spark, sf_dir).withColumn("model", F.lit("gpt-4o")), packaged_prices(spark))
    rows = rows.withColumn("r", text.resource_id(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("id-"), F.col("doc_id").cast("string"))), "path"))
    return rows.withColumns({"resource_id": F.col("r.value"), "id_source": F.col("r.source")})


def q_estimate_scan(spark, sf_dir):
    """The lines of an estimate over a manifest."""
    return render.estimate_lines(_estimated(spark, sf_dir)).select("path", "text")


def q_estimate_files(spark, sf_dir):
    """The blocks of an estimate over files."""
    return render.estimate_lines(_estimated(spark, sf_dir), scan=False).select("path", "text")


def q_estimate_total(spark, sf_dir):
    return render.estimate_total(_estimated(spark, sf_dir))


def q_fairness_json(spark, sf_dir):
    return render.fairness_json(q_fairness_words(spark, sf_dir), "gpt-4o", "o200k_base", "en")


def q_fairness_text(spark, sf_dir):
    return render.fairness_text(q_fairness_words(spark, sf_dir), "gpt-4o", "o200k_base", "en")


#: Word counts given for a language, and how the words of others are counted.
GIVEN_WORDS, WORD_MODES = {"fr": 100_000}, {"de": "character", "es": "heuristic"}


def q_fairness_words(spark, sf_dir):
    """Word modes by language and given word counts, on blank-separated pieces as tokens, which SQL can count too."""
    d = _docs(spark, sf_dir)
    mode = F.coalesce(F.create_map(*(F.lit(x) for kv in WORD_MODES.items() for x in kv))[F.col("lang")], F.lit("whitespace"))
    rows = fairness.by_language(d, n_words=text.word_count_by("content", mode), tokens=F.size(pretok.pieces_sql("content", "spaces")).cast("long"))
    given = F.create_map(*(F.lit(x) for k, n in GIVEN_WORDS.items() for x in (k, n)))[F.col("lang")].cast("long")
    rows = rows.withColumn("words", F.coalesce(given, "words")).withColumn("fertility", text.fertility("tokens", "words"))
    return fairness.with_parity(rows, "en")


def q_fairness_exact(spark, sf_dir):
    """Fertility and parity on exact byte-pair counts of a public vocabulary."""
    tokens = bpe.count_tokens("content", _public_encoding(spark))
    counted = _docs(spark, sf_dir).withColumn("n", tokens["tokens"])
    return fairness.with_parity(fairness.by_language(counted, n_words=text.words("content"), tokens=F.col("n")), "en")


def q_bpe_decode(spark, sf_dir):
    """Whether decoding the ids of a text gives its bytes back."""
    encoding = _public_encoding(spark)
    vocabulary = spark.createDataFrame([(bytearray(t), r) for t, r in encoding.ranks.items()], "token binary, rank int")
    rows = _docs(spark, sf_dir).select("doc_id", "content", bpe.encode("content", encoding).alias("ids"))
    return bpe.decode(rows, "ids", vocabulary).select("doc_id", (F.col("bytes") == F.col("content").cast("binary")).alias("same"), F.octet_length("bytes").cast("long").alias("n_bytes"))


def _manifest(n: int = 30) -> str:
    head = '[budget]\nmax_cost_usd = 0.05  # US dollars\nwarn_threshold = 0.5\n[policy]\nallowed_models = ["gpt-4o", "gpt-4o-mini"]\n[defaults]\nmodel = "gpt-4o"\n[other]\nx = 1\n'
    models_ = ["", 'model = "gpt-4o-mini"\n', 'model = "claude-sonnet-4"\n']
    return head + "".join(f'[[prompts]]\npath = "doc-{k}.txt"\nprompt_id = "p{k}"\n{models_[k % 3 if k % 5 == 0 else 0]}tags = {{ team = "t{k % 4}", n = "{k}" }}\n' for k in range(n))


def _manifest_costs(spark, sf_dir):
    """A parsed manifest's prompts with the cost of their documents; paths that no document has are dropped."""
    policy = config.parse_manifest(_manifest())
    prompts = config.prompts_table(spark, policy).withColumn("default_model", F.lit(policy.default_model))
    prompts = prompts.withColumn("model", costs.model_of("check_manifest"))
    found = _docs(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "content")
    return policy, costs.text_costs(prompts.join(found, "path"), packaged_prices(spark), missing="zero").withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def q_manifest_prompts(spark, sf_dir):
    _, rows = _manifest_costs(spark, sf_dir)
    return rows.select("place", "path", "prompt_id", "model", F.col("tags")["team"].alias("team"), "tokens", text.pico("cost").cast("long").alias("cost_pico"))


def q_check_manifest(spark, sf_dir):
    """The whole check: manifest, files, prices, policy and budget."""
    policy, rows = _manifest_costs(spark, sf_dir)
    rows = rows.withColumn("cost", text.pico("cost").cast("double") / 1e12)
    out = governance.check(rows, policy.allowed_models, policy.max_cost_usd)
    return out.select("prompts", F.round("total", 9).alias("total"), F.round("percent", 6).alias("percent"), "exit_code")


def q_ci_gate(spark, sf_dir):
    """The whole gate of a pull request: snapshots, deltas, budget, exit code, whether to comment."""
    s = _snapshots(spark, sf_dir).agg(F.sum("head_cost").alias("head"), F.sum("delta").alias("delta"))
    head, delta = F.col("head").cast("double") / 1e12, F.col("delta").cast("double") / 1e12
    return s.select(F.col("head").cast("long").alias("head_pico"), F.col("delta").cast("long").alias("delta_pico"), governance.gate(head, 0.5, delta, False).alias("budget_code"), governance.gate(head, None, delta, True).alias("increase_code"), governance.wants_comment(delta, 1e-3).alias("comment"))


def q_sticky_comment(spark, sf_dir):
    """Turns of conversations as comments: which one is to be updated."""
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("body"))
    parts = [governance.comment_action(c, m).withColumn("marker", F.lit(m)) for m in ("the", "no such marker at all")]
    return parts[0].union(parts[1])


def q_last_by_path(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("source").alias("path"), F.col("doc_id").alias("place"), F.length("content").alias("n"))
    last, first = governance.last_by_path(rows), governance.last_by_path(rows, first=True)
    return last.select("path", "place", "n", F.lit("last").alias("which")).union(first.select("path", "place", "n", F.lit("first").alias("which")))


def q_work_list(spark, sf_dir):
    d = _prompts(spark, sf_dir).select("path", "model", F.col("doc_id").alias("place"))
    return governance.work_list(d, d.where("place % 4 = 0"))


def q_model_of(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit("own")).alias("model"), F.when(F.col("doc_id") % 3 == 0, F.lit("default")).alias("default_model"))
    kinds = ("check_manifest", "check_file", "export", "diff", "estimate")
    return d.select("doc_id", *(costs.model_of(k, given=g).alias(f"{k}_{g or 'none'}") for k in kinds for g in (None, "given")))


def q_formats(spark, sf_dir):
    """Byte sizes, throughput, ratios and signed amounts as they are printed."""
    d = _docs(spark, sf_dir).select("doc_id", text.byte_length("content").alias("n")).withColumn("big", F.col("n") * F.col("n") * 37)
    cost = (F.col("n") - 2000) / 1e6
    return d.select("doc_id", text.format_bytes("n").alias("size"), text.format_bytes("big").alias("large"), text.fixed_point(cost).alias("amount"), text.throughput_mb("n", F.lit(0.25)).alias("mb_s"), text.compression("n", F.col("doc_id") % 3).alias("ratio"))


def q_budget_percent(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return d.select("o_orderkey", *(governance.budget(F.col("o_totalprice"), x)[part].alias(f"{part}_{name}") for name, x in (("some", 150_000.0), ("none", None), ("zero", 0.0)) for part in ("percent", "over")))


_FILE = """CASE p_partkey % 5
 WHEN 0 THEN '{"version":1,"models":{"m' || CAST(p_partkey AS {s}) || '":{"provider":"' || p_brand || '","input_price_per_mtok":' || CAST(p_size AS {s}) || ',"output_price_per_mtok":2.5},"skipped":7}}'
 WHEN 1 THEN '{"a":{"input_cost_per_mtok":' || CAST(p_size AS {s}) || ',"output_cost_per_mtok":4.25,"output_reasoning_price_per_mtok":5},"b":{"provider":"Q","input_price_per_mtok":0,"input_cost_per_mtok":7,"output_price_per_mtok":0.5}}'
 WHEN 2 THEN '{"models":{"c":{"input_price_per_mtok":"9","output_reasoning_price_per_mtok":0}}}'
 WHEN 3 THEN '[1, 2]'
 ELSE 'no JSON' END"""


def q_price_file(spark, sf_dir):
    """Price files, a JSON text a part, with older cost fields, faulty entries, missing providers and texts that are none."""
    files = _t(spark, sf_dir, "part").select("p_partkey", F.expr(_FILE.replace("{s}", "STRING")).alias("file"))
    return pricing.prices_of_texts(files, "file").drop("file")


def _price_file_sql():
    entry = lambda k, model, *values: f"SELECT p_partkey, {model} AS model, {', '.join(values)} FROM part WHERE p_partkey % 5 = {k}"
    return " UNION ALL ".join((
        entry(0, "'m' || CAST(p_partkey AS VARCHAR)", "p_brand AS provider", "CAST(p_size AS DOUBLE) AS input_price", "2.5::DOUBLE AS output_price", "CAST(NULL AS DOUBLE) AS reasoning_price"),
        entry(1, "'a'", "'Unknown'", "CAST(p_size AS DOUBLE)", "4.25::DOUBLE", "5.0::DOUBLE"),
        entry(1, "'b'", "'Q'", "7.0::DOUBLE", "0.5::DOUBLE", "NULL"),
        entry(2, "'c'", "'Unknown'", "0.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE"),
    ))


def q_piece_table(spark, sf_dir):
    """The distinct pieces of all documents, with their occurrences and documents."""
    return encoding.PieceTable(_docs(spark, sf_dir), "doc_id", "content", bpe.Encoding("words", "spaces")).pieces()


def q_bpe_pieces(spark, sf_dir):
    """Exact token counts; each distinct piece is merged once."""
    return encoding.PieceTable(_docs(spark, sf_dir), "doc_id", "content", _public_encoding(spark)).counts()


def q_vocabulary_use(spark, sf_dir):
    """How much of a public vocabulary the documents of each language use, and how much of that is rare."""
    encoding_, out = _public_encoding(spark), None
    for lang in ("en", "fr", "de", "es"):
        own = _docs(spark, sf_dir).where(F.col("lang") == lang)
        row = encoding.PieceTable(own, "doc_id", "content", encoding_).utilisation().withColumn("lang", F.lit(lang))
        out = row if out is None else out.union(row)
    return out


def q_pretok_digits(spark, sf_dir):
    """The pieces of digits of both public pre-tokenizers: a run of digits falls into threes."""
    d = _docs(spark, sf_dir)
    digits = lambda kind: pretok.piece_count("content", kind, "[0-9]+")
    return d.select("doc_id", digits("cl100k").alias("cl100k"), digits("o200k").alias("o200k"))


def q_bytes_text(spark, sf_dir):
    """Documents as raw bytes between broken sequences: each faulty byte is one replacement sign."""
    payload = F.concat(F.unhex(F.lit("E282")), F.col("content").cast("binary"), F.unhex(F.lit("F09F98ED")))
    d = _docs(spark, sf_dir).select("doc_id", utf8.as_text(payload).alias("t"))
    return d.select("doc_id", F.md5("t").alias("md5"), F.length("t").cast("long").alias("chars"))


#: The tables' times have no zone; they count as UTC, whatever the session's zone.
_INSTANT = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts))"


def _timed(spark, sf_dir, events=None):
    """Events as usage lines with their times."""
    events = _t(spark, sf_dir, "events") if events is None else events
    lines = events.select(F.col("event_id").alias("line_no"), F.expr(_INSTANT).alias("ts"), "user_id", "event_type", F.expr(_LINE.replace("{s}", "STRING")).alias("value"))
    return usage.with_cost(usage.classify(lines, "json_field"), FLASH)


def _shown(w, *by):
    return w.select(F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), *by, "lines", "tokens", F.col("cost_pico").cast("long").alias("cost_pico"))


def q_cost_windows(spark, sf_dir):
    return _shown(windows.tumbling(_timed(spark, sf_dir), "ts", "6 hours", "event_type"), "event_type")


def q_cost_sessions(spark, sf_dir):
    sums = windows.sessions(_timed(spark, sf_dir), "ts", "2 days", "user_id")
    return _shown(sums, "user_id")


def q_stream_windows(spark, sf_dir):
    """The windows of q_cost_windows as a stream over the same table makes them."""
    path, folder = f"{sf_dir}/events.parquet", f"{shared_dir(spark)}/promptmeter/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may be a file, a plain path must be a folder
    sums, sink = windows.tumbling(_timed(spark, sf_dir, stream), "ts", "6 hours", "event_type", delay="3650 days"), windows.Upserts(f"{folder}/out")
    sums.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _shown(sink.last(spark, "start", "event_type"), "event_type")


_SUMS = f"CAST(count(*) FILTER (error IS NULL) AS BIGINT) AS lines, CAST(coalesce(sum(CASE WHEN error IS NULL THEN input + output END), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(CASE WHEN error IS NULL THEN {_PICO.format('cost')} END), 0) AS BIGINT) AS cost_pico"


def _windows_sql():
    return f"""SELECT w AS start, w + 21600 AS "end", event_type, {_SUMS} FROM (SELECT u.*, e.event_type, CAST(floor(epoch(e.ts) / 21600) * 21600 AS BIGINT) AS w FROM {_usage_sql('json_field')} u JOIN events e ON e.event_id = u.line_no) GROUP BY w, event_type"""


def _sessions_sql():
    return f"""SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) + 172800 AS BIGINT) AS "end", user_id, {_SUMS} FROM (
 SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, line_no) AS s
 FROM (SELECT u.*, e.user_id, e.ts, lag(e.ts) OVER (PARTITION BY e.user_id ORDER BY e.ts, u.line_no) AS before FROM {_usage_sql('json_field')} u JOIN events e ON e.event_id = u.line_no)) GROUP BY user_id, s"""


def q_price_bands(spark, sf_dir):
    """Prompts priced by size: above 300 tokens at twice the price."""
    p = packaged_prices(spark).select("model", "input_price")
    bands = p.select("model", F.lit(0).alias("above"), F.col("input_price").alias("price")).union(p.select("model", F.lit(300), F.col("input_price") * 2))
    rows = tariffs.with_bands(_prompts(spark, sf_dir).select("doc_id", "model", text.approximate_tokens("content").alias("tokens")), bands)
    return rows.select("doc_id", "model", "tokens", "price", text.pico(F.col("price") / 1e6 * F.col("tokens")).cast("long").alias("cost_pico"))


def q_price_as_of(spark, sf_dir):
    """Events as usage at the price of their time; purchases are the changes of prices."""
    e = _t(spark, sf_dir, "events").withColumn("ts", F.expr(_INSTANT)).withColumn("model", F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")))
    history = e.where("event_type = 'purchase'").select("model", F.col("ts").alias("since"), F.col("value").alias("price"))
    return tariffs.as_of(e.select("event_id", "model", "ts"), history, "model", "ts", "since").select("event_id", "model", "price")


def q_gini_documents(spark, sf_dir):
    """The spread of the documents' lengths in words."""
    return fairness.gini(_docs(spark, sf_dir).select(text.words("content").alias("n")), "n").select(F.round("gini", 9).alias("gini"))


def q_discovered(spark, sf_dir):
    """Which paths are prompts."""
    names = F.array(*map(F.lit, ["a.txt", "b.md", "c.prompt", "d.py", ".hidden.txt", "x/.git/y.txt", "deep/er/z.txt", "txt"]))
    d = _docs(spark, sf_dir).select("doc_id", F.element_at(names, (F.col("doc_id") % 8 + 1).cast("int")).alias("path"))
    return d.where(is_prompt_path("path")).groupBy("path").agg(F.count("*").alias("n"))


def q_signed_files(spark, sf_dir):
    """What the signatures of files say: of every four one is sound, one of other bytes, one's comment was changed, one is of another key."""
    seed, key_id = b"\1" * 32, b"promptme"
    key = base64.b64encode(b"Ed" + key_id + signatures.public_key(seed)).decode()
    k, data = F.col("doc_id") % 4, F.col("content").cast("binary")
    d = _docs(spark, sf_dir).withColumn("mine", signatures.signature_files(data, seed, key_id, "prices"))
    other = F.replace("mine", F.lit("\nRURwc"), F.lit("\nRURwA"))  # the record's first bytes with another key id
    changed = F.when(k == 3, other).when(k == 2, F.replace("mine", F.lit("\ntrusted comment: "), F.lit("\ntrusted comment: my "))).otherwise(F.col("mine"))
    d = d.select("doc_id", F.when(k == 1, F.concat("content", F.lit(" "))).otherwise(F.col("content")).cast("binary").alias("data"), changed.alias("signature"))
    return d.select("doc_id", signatures.signature_state(F.col("data"), F.col("signature"), key).alias("state"))


def q_sorted_json(spark, sf_dir):
    """Nested JSON with keys in byte order at all depths; the last of two values of a key stays."""
    raw = F.format_string('{"z": {"b": %d, "a": [1.50, {"y": null, "x": true}]}, "é": "%s", "Z": -0.0, "a": "old", "a": "%s", "lang": {}}', "doc_id", F.md5("content"), "source")
    return _docs(spark, sf_dir).select("doc_id", text.sorted_json(raw).alias("json"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    p = prices_sql()
    usage_columns = f"line_no, kind, input, output, reasoning, CAST({_PICO.format('cost')} AS BIGINT) AS cost_pico, error"
    cjk = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"
    words, specials = _WORDS.format("content"), list(bpe.CL100K.specials)
    costed = _COST.format(_tokens("content"), "0", "0")
    number = lambda x: f"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '\\.0(e|$)', '\\1'), 'e-0', 'e-')"
    report = f"SELECT bytes, tokens, words, 5.0::DOUBLE / 1000000.0::DOUBLE * tokens AS cost, tokens::DOUBLE / words AS fertility, bytes::DOUBLE / tokens AS ratio FROM (SELECT CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(sum({_tokens('content')}) AS BIGINT) AS tokens, CAST(sum({words}) AS BIGINT) AS words FROM {_DOCS})"
    estimated = f"(SELECT doc_id, path, {_tokens('content')} AS tokens, 5.0::DOUBLE / 1000000.0::DOUBLE * {_tokens('content')} AS cost, CASE WHEN doc_id % 3 = 0 THEN 'id-' || CAST(doc_id AS VARCHAR) ELSE {_SLUG.format('path')} END AS id, CASE WHEN doc_id % 3 = 0 THEN 'manifest' ELSE 'path_slug' END AS src FROM {_DOCS})"
    heuristic = f"CASE WHEN (length(content) - length(regexp_replace(content, '{cjk}', '', 'g'))) * 100 // greatest(length(content), 1) > 30 THEN length(content) ELSE {words} END"
    langs = f"""WITH l AS (SELECT *, tokens::DOUBLE / words AS fertility FROM (SELECT lang, CAST(sum(len(regexp_extract_all(content, '[^ ]+| '))) AS BIGINT) AS tokens,
 CASE WHEN lang = 'fr' THEN 100000 ELSE CAST(sum(CASE lang WHEN 'de' THEN length(content) WHEN 'es' THEN {heuristic} ELSE {words} END) AS BIGINT) END AS words, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM {_DOCS} WHERE lang IS NOT NULL GROUP BY lang)),
 p AS (SELECT *, fertility / (SELECT fertility FROM l WHERE lang = 'en') AS parity_ratio FROM l),
 r AS (SELECT parity_ratio AS x, row_number() OVER (ORDER BY parity_ratio) AS i FROM p),
 g AS (SELECT sum(i * x) * 2 / (count(*) * sum(x)) - (count(*) + 1)::DOUBLE / count(*) AS gini FROM r),
 w AS (SELECT lang AS worst, parity_ratio AS most FROM p ORDER BY parity_ratio DESC, lang LIMIT 1)"""
    manifest = f"(SELECT d.doc_id AS place, 'doc-' || d.doc_id || '.txt' AS path, 'p' || d.doc_id AS prompt_id, CASE WHEN d.doc_id % 5 = 0 AND d.doc_id % 3 = 1 THEN 'gpt-4o-mini' WHEN d.doc_id % 5 = 0 AND d.doc_id % 3 = 2 THEN 'claude-sonnet-4' ELSE 'gpt-4o' END AS model, content FROM {_DOCS} d WHERE doc_id < 30)"
    manifest = f"(SELECT m.*, {_tokens('content')} AS tokens, coalesce(CAST({_PICO.format(costed)} AS BIGINT), 0) AS pico FROM {manifest} m LEFT JOIN ({p}) USING (model))"
    sized = f"(SELECT doc_id, CAST(strlen(content) AS BIGINT) AS n, CAST(strlen(content) AS BIGINT) * strlen(content) * 37 AS big FROM {_DOCS})"
    # printed decimals round the shortest form of a double half up, printf of DuckDB its binary value
    fixed = lambda x, n: f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,{n})) AS VARCHAR)"
    unit = lambda x: f"CASE WHEN {x} < 1024 THEN printf('%d B', {x}) WHEN {x} < 1048576 THEN {fixed(f'({x} / 1024.0::DOUBLE)', 2)} || ' KB' WHEN {x} < 1073741824 THEN {fixed(f'({x} / 1048576.0::DOUBLE)', 2)} || ' MB' ELSE {fixed(f'({x} / 1073741824.0::DOUBLE)', 2)} || ' GB' END"
    everything, p = p, f"SELECT * FROM ({p}) WHERE model IN (SELECT model FROM {_PROMPTS})"
    used, p = p, everything
    return {
        "q_report_text": f"SELECT printf(replace('@=== Tokenizer Report: gpt-4o ===@Corpus Size:    %d bytes@Word Count:     %d words@Token Count:    %d tokens@Est. Cost:      $%.6f@@--- Efficiency Metrics ---@Compression:    %.2f bytes/token  (Higher is better)@Fertility:      %.2f tokens/word  (Lower is better)@', '@', chr(10)), bytes, words, tokens, cost, ratio, fertility) AS text FROM ({report})",
        "q_report_json": f"SELECT printf(replace('{{@  \"model\": \"gpt-4o\",@  \"stats\": {{@    \"bytes\": %d,@    \"tokens\": %d,@    \"words\": %d,@    \"cost_usd\": %.6f@  }},@  \"metrics\": {{@    \"bytes_per_token\": %.2f,@    \"tokens_per_word\": %.2f@  }}@}}@', '@', chr(10)), bytes, tokens, words, cost, ratio, fertility) AS text FROM ({report})",
        "q_models_json": f"SELECT '[' || chr(10) || string_agg(replace('  {{@    \"id\": \"', '@', chr(10)) || model || replace('\",@    \"cost_in\": ', '@', chr(10)) || {number('input_price')} || replace(',@    \"cost_out\": ', '@', chr(10)) || {number('output_price')} || CASE WHEN reasoning_price > 0 THEN replace(',@    \"cost_reasoning\": ', '@', chr(10)) || {number('reasoning_price')} ELSE '' END || chr(10) || '  }}', ',' || chr(10) ORDER BY model) || chr(10) || ']' || chr(10) AS text FROM ({used})",
        "q_models_text": f"SELECT rpad('MODEL', 20, ' ') || ' ' || rpad('INPUT ($/1M)', 15, ' ') || ' ' || rpad('OUTPUT ($/1M)', 15, ' ') || ' ' || rpad('REAS ($/1M)', 15, ' ') || chr(10) || repeat('-', 20) || ' ' || repeat('-', 15) || ' ' || repeat('-', 15) || ' ' || repeat('-', 15) || chr(10) || string_agg(printf('%-20s %-15s %-15s %-14s', model, '$' || printf('%.2f', input_price), '$' || printf('%.2f', output_price), CASE WHEN reasoning_price > 0 THEN '$' || printf('%.2f', reasoning_price) ELSE '-' END), chr(10) ORDER BY model) || chr(10) || chr(10) || 'Total models: ' || count(*) || chr(10) AS text FROM ({used})",
        "q_estimate_scan": f"SELECT path, printf('%s: $%.6f (%s)', path, cost, id) AS text FROM {estimated}",
        "q_estimate_files": f"SELECT path, printf(replace('File:        %s@Tokens In:   %d@Cost (est):  $%.6f@Resource ID: %s (%s)@', '@', chr(10)), path, tokens, cost, id, src) AS text FROM {estimated}",
        "q_estimate_total": f"SELECT printf('Total Cost:  $%.6f', CAST(sum({_PICO.format('cost')}) AS DOUBLE) / 1000000000000.0::DOUBLE) AS text FROM {estimated}",
        "q_fairness_words": f"{langs} SELECT lang, tokens, words, bytes, fertility, parity_ratio FROM p",
        "q_fairness_text": f"{langs} SELECT replace('Fairness Analysis Report@========================@@Model: gpt-4o@Encoding: o200k_base@Baseline: en@@Global Metrics:@', '@', chr(10)) || printf(replace('  Gini Coefficient: %.4f@  Max Parity Ratio: %.2fx@  Most Taxed: %s@@Per-Language Stats:@', '@', chr(10)), gini, most, worst) || printf('%6s %10s %10s %10s %12s %12s', 'Lang', 'Tokens', 'Words', 'Bytes', 'Fertility', 'Parity') || chr(10) || repeat('-', 6) || ' ' || repeat('-', 10) || ' ' || repeat('-', 10) || ' ' || repeat('-', 10) || ' ' || repeat('-', 12) || ' ' || repeat('-', 12) || chr(10) || (SELECT string_agg(printf('%6s %10d %10d %10d %12.2f %11.2fx', lang, tokens, words, bytes, fertility, parity_ratio), chr(10) ORDER BY lang) FROM p) || chr(10) AS text FROM g, w",
        "q_manifest_prompts": f"SELECT CAST(place AS INT) AS place, path, prompt_id, model, 't' || CAST(place % 4 AS VARCHAR) AS team, tokens, pico AS cost_pico FROM {manifest}",
        "q_check_manifest": f"SELECT count(*) AS prompts, round(sum(pico)::DOUBLE / 1000000000000.0::DOUBLE, 9) AS total, round(sum(pico)::DOUBLE / 1000000000000.0::DOUBLE / 0.05::DOUBLE * 100, 6) AS percent, CAST(CASE WHEN bool_or(model NOT IN ('gpt-4o', 'gpt-4o-mini')) THEN 3 WHEN sum(pico) > 50000000000 THEN 2 ELSE 0 END AS INT) AS exit_code FROM {manifest}",
        "q_ci_gate": f"SELECT CAST(sum(head_cost) AS BIGINT) AS head_pico, CAST(sum(delta) AS BIGINT) AS delta_pico, CAST(CASE WHEN sum(head_cost) > 500000000000 THEN 2 ELSE 0 END AS INT) AS budget_code, CAST(CASE WHEN sum(delta) > 0 THEN 2 ELSE 0 END AS INT) AS increase_code, abs(sum(delta)) >= 1000000000 AS comment FROM {_DELTAS}",
        "q_sticky_comment": " UNION ALL ".join(f"SELECT CASE WHEN max(id) IS NULL THEN 'create' ELSE 'update' END AS action, max(id) AS id, '{m}' AS marker FROM (SELECT * FROM (SELECT conv_id * 1000 + turn AS id, text AS body FROM conversations ORDER BY id LIMIT 1000)) WHERE contains(body, '{m}')" for m in ("the", "no such marker at all")),
        "q_last_by_path": f"SELECT source AS path, max(doc_id) AS place, CAST(arg_max(length(content), doc_id) AS INT) AS n, 'last' AS which FROM {_DOCS} GROUP BY source UNION ALL SELECT source, min(doc_id), CAST(arg_min(length(content), doc_id) AS INT), 'first' FROM {_DOCS} GROUP BY source",
        "q_work_list": f"SELECT path, model, doc_id AS place, 0 AS origin FROM {_PROMPTS} UNION ALL SELECT path, model, doc_id, 1 FROM {_PROMPTS} WHERE doc_id % 4 = 0",
        "q_model_of": f"SELECT doc_id, coalesce(m, d, 'gpt-4o') AS check_manifest_none, coalesce(m, d, 'given') AS check_manifest_given, coalesce(d, 'gpt-4o') AS check_file_none, 'given' AS check_file_given, coalesce(m, d, 'gpt-4o') AS export_none, coalesce(m, d, 'gpt-4o') AS export_given, coalesce(m, 'gpt-4o') AS diff_none, coalesce(m, 'gpt-4o') AS diff_given, 'gpt-4o' AS estimate_none, 'given' AS estimate_given FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own' END AS m, CASE WHEN doc_id % 3 = 0 THEN 'default' END AS d FROM {_DOCS})",
        "q_formats": f"SELECT doc_id, {unit('n')} AS size, {unit('big')} AS large, CASE WHEN a < 0 THEN '-' ELSE '' END || CAST(abs(a) // 1000000000000 AS VARCHAR) || '.' || lpad(CAST(abs(a) % 1000000000000 AS VARCHAR), 12, '0') AS amount, n / 1000000.0::DOUBLE / 0.25::DOUBLE AS mb_s, CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE n::DOUBLE / (doc_id % 3) END AS ratio FROM (SELECT *, CAST(round((n - 2000) / 1000000.0::DOUBLE * 1000000000000.0::DOUBLE) AS BIGINT) AS a FROM {sized})",
        "q_budget_percent": "SELECT o_orderkey, o_totalprice / 150000.0::DOUBLE * 100 AS percent_some, o_totalprice > 150000.0::DOUBLE AS over_some, CAST(NULL AS DOUBLE) AS percent_none, false AS over_none, CAST(NULL AS DOUBLE) AS percent_zero, o_totalprice > 0 AS over_zero FROM orders",
        "q_price_file": _price_file_sql(),
        "q_signed_files": f"SELECT doc_id, ['valid', 'invalid signature', 'valid, comment not verified', 'key mismatch'][CAST(doc_id % 4 + 1 AS INT)] AS state FROM {_DOCS}",
        "q_sorted_json": f"""SELECT doc_id, '{{"Z":-0.0,"a":"' || source || '","lang":{{}},"z":{{"a":[1.50,{{"x":true,"y":null}}],"b":' || doc_id || '}},"é":"' || md5(content) || '"}}' AS json FROM {_DOCS}""",
        "q_piece_table": f"SELECT piece, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(content, '[^ ]+| ')) AS piece FROM {_DOCS}) GROUP BY piece",
        "q_pretok_digits": f"SELECT doc_id, n AS cl100k, n AS o200k FROM (SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(content, '[0-9]+'), lambda x: (length(x) + 2) // 3)), 0) AS BIGINT) AS n FROM {_DOCS})",
        "q_bytes_text": f"SELECT doc_id, md5(t) AS md5, length(t) AS chars FROM (SELECT doc_id, repeat(chr(65533), 2) || content || repeat(chr(65533), 4) AS t FROM {_DOCS})",
        "q_cost_windows": _windows_sql(),
        "q_stream_windows": _windows_sql(),
        "q_cost_sessions": _sessions_sql(),
        "q_price_bands": f"SELECT doc_id, model, tokens, price, CAST({_PICO.format('price / 1000000.0::DOUBLE * tokens')} AS BIGINT) AS cost_pico FROM (SELECT doc_id, d.model, {_tokens('content')} AS tokens, CASE WHEN {_tokens('content')} > 300 THEN input_price * 2 WHEN {_tokens('content')} > 0 THEN input_price END AS price FROM {_PROMPTS} d LEFT JOIN ({p}) p ON d.model = p.model)",
        "q_price_as_of": "WITH e AS (SELECT event_id, 'm' || CAST(user_id % 5 AS VARCHAR) AS model, ts, event_type, value FROM events), h AS (SELECT model, ts AS since, max(value) AS price FROM e WHERE event_type = 'purchase' GROUP BY ALL) SELECT event_id, e.model, price FROM e ASOF LEFT JOIN h ON e.model = h.model AND e.ts >= h.since",
        "q_gini_documents": f"SELECT round(sum(i * x) * 2 / (count(*) * sum(x)) - (count(*) + 1)::DOUBLE / count(*), 9) AS gini FROM (SELECT {words}::DOUBLE AS x, row_number() OVER (ORDER BY {words}) AS i FROM {_DOCS})",
        "q_discovered": f"SELECT path, count(*) AS n FROM (SELECT ['a.txt', 'b.md', 'c.prompt', 'd.py', '.hidden.txt', 'x/.git/y.txt', 'deep/er/z.txt', 'txt'][CAST(doc_id % 8 + 1 AS INT)] AS path FROM {_DOCS}) WHERE regexp_matches(path, '\\.(txt|md|prompt)$') AND NOT starts_with(path, '.') AND NOT contains(path, '.git') GROUP BY path",
        "q_bpe_decode": f"SELECT doc_id, true AS same, CAST(strlen(content) AS BIGINT) AS n_bytes FROM {_DOCS}",
        "q_pipe_output": f"""SELECT line_no, CASE kind WHEN 'usage' THEN printf('{{"input":%d,"output":%d,"reasoning":%d,"cost":%s}}', input, output, reasoning, {fixed('cost', 6)}) WHEN 'error' THEN '{{"error":"' || error || '"}}'
 WHEN 'raw' THEN printf('{{"tokens":%d,"cost":%s}}', input, {fixed('cost', 6)}) ELSE left(value, length(value) - 1) || ',"usage":{{"input_tokens":' || input || ',"cost_usd":' || {number('cost')} || '}}}}' END AS json
 FROM {_usage_sql()} JOIN {_LINES} l USING (line_no)""",
        "q_models": f"SELECT model AS id, provider, {_ENC.format('model')} AS encoding, input_price, output_price, reasoning_price FROM ({used})",
        "q_encoding_map": f"SELECT model, {_ENC.format('model')} AS encoding, count(*) AS prompts FROM {_PROMPTS} GROUP BY model",
        "q_cost_by_lang_model": f"SELECT lang, model, tokens, CAST({_PICO.format(_COST.format('tokens', '0', '0'))} AS BIGINT) AS cost_pico FROM (SELECT lang, CAST(sum({_tokens('content')}) AS BIGINT) AS tokens FROM {_DOCS} WHERE lang IS NOT NULL GROUP BY lang), ({p})",
        "q_slug": f"SELECT doc_id, {_SLUG.format('path')} AS slug, CASE WHEN doc_id % 3 = 0 THEN 'id-' || CAST(doc_id AS VARCHAR) ELSE {_SLUG.format('path')} END AS resource_id, CASE WHEN doc_id % 3 = 0 THEN 'manifest' ELSE 'path_slug' END AS id_source FROM {_DOCS}",
        "q_words_modes": f"SELECT doc_id, {words} AS whitespace, length(content) AS character, CASE WHEN length(content) > 0 AND (length(content) - length(regexp_replace(content, '{cjk}', '', 'g'))) * 100 // greatest(length(content), 1) > 30 THEN length(content) ELSE {words} END AS heuristic, CAST(len(regexp_extract_all(content, '[^ \\t\\n\\r]+')) AS BIGINT) AS narrow, CAST(strlen(content) AS BIGINT) AS bytes, {_tokens('content')} AS tokens FROM {_DOCS}",
        "q_report": f"SELECT bytes, tokens, words, 5.0::DOUBLE / 1000000.0::DOUBLE * tokens AS cost, tokens::DOUBLE / words AS fertility, bytes::DOUBLE / tokens AS bytes_per_token FROM (SELECT CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(sum({_tokens('content')}) AS BIGINT) AS tokens, CAST(sum({words}) AS BIGINT) AS words FROM {_DOCS})",
        "q_pipe_mixed": f"SELECT {usage_columns} FROM {_usage_sql()}",
        "q_pipe_json_field": f"SELECT {usage_columns} FROM {_usage_sql('json_field')}",
        "q_pipe_summary": f"SELECT count(*) AS lines, CAST(sum(input + output) AS BIGINT) AS tokens, CAST(sum({_PICO.format('cost')}) AS BIGINT) AS cost_pico FROM {_usage_sql('json_field')} WHERE error IS NULL",
        "q_usage_cost": f"SELECT conv_id, input, output, CAST({_PICO.format('5.0::DOUBLE / 1000000.0::DOUBLE * input + 20.0::DOUBLE / 1000000.0::DOUBLE * output + 20.0::DOUBLE / 1000000.0::DOUBLE * 0')} AS BIGINT) AS cost_pico FROM (SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE {_tokens('text')} END) AS BIGINT) AS input, CAST(sum(CASE WHEN role = 'assistant' THEN {_tokens('text')} ELSE 0 END) AS BIGINT) AS output FROM conversations GROUP BY conv_id)",
        "q_quota_tokens": _quota_sql("tokens", 100_000),
        "q_quota_cost": _quota_sql("cost", 50_000_000_000),
        "q_policy_violations": f"SELECT model, count(*) AS prompts, min(path) AS first_path FROM {_PROMPTS} WHERE model NOT IN ({', '.join(map(repr, ALLOWED))}) GROUP BY model",
        "q_budget_gate": f"SELECT source, count(*) AS prompts, CAST(sum(c) AS BIGINT) AS total_pico, CAST(CASE WHEN sum(c) > 20000000000 THEN 2 ELSE 0 END AS INT) AS exit_code FROM (SELECT source, coalesce({_PICO.format(costed)}, 0) AS c FROM {_PROMPTS} d LEFT JOIN ({p}) USING (model)) GROUP BY source",
        "q_estimate": f"SELECT {_SLUG.format('path')} AS resource_id, model, {_tokens('content')} AS tokens, CAST({_PICO.format(costed)} AS BIGINT) AS cost_pico FROM {_PROMPTS} JOIN ({p}) USING (model)",
        "q_delta": f"SELECT resource_id, path, CAST(base_cost AS BIGINT) AS base_pico, CAST(head_cost AS BIGINT) AS head_pico, CAST(delta AS BIGINT) AS delta_pico, status, CAST(list_position(['increased', 'added', 'decreased', 'removed', 'unchanged'], status) AS INT) AS priority FROM {_DELTAS}",
        "q_delta_sum": f"SELECT status, count(*) AS n, CAST(sum(delta) AS BIGINT) AS delta_pico, CAST(CASE WHEN sum(delta) > 0 THEN 2 ELSE 0 END AS INT) AS exit_code FROM {_DELTAS} GROUP BY status",
        "q_focus": _focus_sql(),
        "q_fairness_lang": f"{_WITH_LANGS} SELECT lang, tokens, words, bytes, f AS fertility, parity_ratio FROM {_LANGS}",
        "q_gini": f"{_WITH_LANGS}, r AS (SELECT parity_ratio AS x FROM {_LANGS}) SELECT round((SELECT sum(abs(a.x - b.x)) FROM r a, r b) / (2.0::DOUBLE * count(*) * count(*) * avg(x)), 9) AS gini FROM r",
        "q_worst": f"{_WITH_LANGS} SELECT lang AS worst_lang, round(parity_ratio, 9) AS max_parity FROM {_LANGS} ORDER BY parity_ratio DESC, lang LIMIT 1",
        "q_special_tokens": f"SELECT doc_id, {_special_sql(specials)} AS strict, {_special_sql(specials[1:])} AS listed FROM (SELECT doc_id, content || ['<|endoftext|>', '<|fim_prefix|> <|endoftext|>', ''][CAST(doc_id % 3 + 1 AS INT)] AS t FROM {_DOCS})",
        "q_pretok_spaces": f"SELECT doc_id, CAST(len(regexp_extract_all(content, '[^ ]+| ')) AS BIGINT) AS pieces FROM {_DOCS}",
        "q_top_pieces": f"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '[^ ]+| ')) AS piece FROM {_DOCS}) GROUP BY piece ORDER BY n DESC, piece LIMIT 20",
        "q_lines": f"SELECT doc_id, count(*) AS lines, CAST(sum({_tokens('value')}) AS BIGINT) AS tokens FROM (SELECT doc_id, unnest(string_split(content, chr(10))) AS value FROM {_DOCS}) GROUP BY doc_id",
        "q_percentiles": "SELECT event_type, count(*) AS n, min(v) AS min, max(v) AS max, CAST(sum(v) // count(*) AS BIGINT) AS mean, CAST(floor(sqrt(floor(sum((v - m) * (v - m)) / count(*)))) AS BIGINT) AS stddev, " + ", ".join(f"list_sort(list(v))[CAST(least(count(*) * {k} // 100, count(*) - 1) AS INT) + 1] AS p{k}" for k in (50, 95, 99)) + " FROM (SELECT *, CAST(sum(v) OVER (PARTITION BY event_type) // count(*) OVER (PARTITION BY event_type) AS BIGINT) AS m FROM (SELECT event_type, CAST(floor(coalesce(value, 0)) AS BIGINT) AS v FROM events)) GROUP BY event_type",
        "q_staleness": "SELECT CASE WHEN u = 0 OR 150 > u + 90 THEN 'Critical' WHEN 150 > u THEN 'Warning' ELSE 'Fresh' END AS state, count(*) AS n FROM (SELECT event_id % 200 AS u FROM events) GROUP BY 1",
        "q_resolve_models": f"SELECT t.*, prompts FROM (VALUES ('gpt-4o', 'openai', 'gpt-4o', 'o200k_base', 'gpt4', 'exact'), ('openai/gpt-4o', 'openai', 'gpt-4o', 'o200k_base', 'gpt4', 'exact'), ('openai/new', 'openai', 'new', NULL, 'gpt4', 'heuristic'), ('meta/llama-3-8b', 'meta', 'llama-3-8b', NULL, 'llama3', 'heuristic'), ('mistral/large', 'mistral', 'large', NULL, 'mistral', 'heuristic'), ('other/x', 'generic', 'x', NULL, 'unknown', 'heuristic'), ('gpt-3.5-turbo', 'openai', 'gpt-3.5-turbo', 'cl100k_base', 'gpt3', 'exact'), ('plain', 'generic', 'plain', NULL, 'unknown', 'heuristic')) t(model, provider, name, encoding, family, accuracy) JOIN (SELECT {NAMES}[CAST(doc_id % {len(NAMES)} + 1 AS INT)] AS model, count(*) AS prompts FROM documents GROUP BY 1) USING (model)",
        "q_cost_rollup": f"SELECT provider, model, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(c) AS BIGINT) AS cost_pico FROM (SELECT provider, model, {_tokens('content')} AS tokens, {_PICO.format(costed)} AS c FROM {_PROMPTS} JOIN ({p}) USING (model)) GROUP BY ROLLUP (provider, model)",
    }
