import json

import pytest
from pyspark.sql import functions as F

from promptmeter.operators import costs, fairness, focus, governance, usage
from promptmeter.sources import config, files, pricing
from promptmeter.streaming.pipe import QuotaSink, cost_stream

FLASH = (0.15, 0.60, 3.50)


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "n long, value string")


def test_lines_are_told_apart(spark):
    given = lines(spark, '{"usage":{"prompt_tokens":5,"completion_tokens":2}}', '{"input_tokens":3}', '{"content":"a b"}', '{"x":1}', "[1]", "plain text", "", '{"usage":"bad","input_tokens":1}', '{"input_tokens":-1}')
    got = {r["n"]: (r["kind"], r["input"], r["output"]) for r in usage.classify(given).collect()}
    assert got == {0: ("usage", 5, 2), 1: ("usage", 3, 0), 2: ("object", 2, 0), 3: ("object", 1, 0), 4: ("raw", 1, 0), 5: ("raw", 2, 0), 6: ("raw", 0, 0), 7: ("object", 1, 0), 8: ("object", 1, 0)}
    strict = {r["n"]: r["kind"] for r in usage.classify(given, "json_field").collect()}
    assert strict[5] == strict[6] == "error" and strict[4] == "raw"


def test_output_lines(spark):
    rows = usage.with_cost(usage.classify(lines(spark, '{"usage":{"prompt_tokens":1000,"completion_tokens":100,"completion_tokens_details":{"reasoning_tokens":20}}}', '{"content":"a b","k":[1,{"z":null}],"usage":3}'[:-1] + "}", "x y")), FLASH)
    got = [r[0] for r in rows.orderBy("n").select(usage.as_json(rows)).collect()]
    assert got[0] == '{"input":1000,"output":100,"reasoning":20,"cost":0.000268}'
    assert got[1] == '{"content":"a b","k":[1,{"z":null}],"usage":{"input_tokens":2,"cost_usd":3e-7}}'
    assert got[2] == '{"tokens":2,"cost":0.000000}'


def test_objects_keep_their_types_and_order(spark):
    given = '{"content":"a b","id":"123","flag":"true","s":"null","q":"say \\"x\\"","n":7,"f":1.5,"b":false,"z":null,"a":["1",2],"o":{"y":"5","x":5}}'
    rows = usage.with_cost(usage.classify(lines(spark, given, '{"usage":3,"z":"1"}', "{}")), FLASH)
    got = [json.loads(r[0]) for r in rows.orderBy("n").select(usage.as_json(rows)).collect()]
    assert got[0] == json.loads(given) | {"usage": {"input_tokens": 2, "cost_usd": 3e-7}} and list(got[0])[:-1] == list(json.loads(given))
    assert list(got[1]) == ["usage", "z"] and got[1]["z"] == "1" and got[2] == {"usage": {"input_tokens": 1, "cost_usd": 1.5e-7}}


def brute_quota(rows, limit):
    out, total = [], 0
    for n, tokens, error in rows:
        out.append(n)
        if error is None:
            total += tokens
            if total >= limit:
                break
    return out


@pytest.mark.parametrize("limit", [0, 1, 7, 10, 1000])
def test_quota_keeps_the_row_that_reaches_it(spark, limit):
    data = [(n, (n * 7) % 5, "e" if n % 4 == 1 else None) for n in range(40)]
    d = spark.createDataFrame(data, "n long, input long, error string").withColumns({"output": F.lit(0).cast("long"), "cost": F.lit(0.0)})
    got = sorted(r["n"] for r in usage.until_quota(d, "n", max_tokens=limit, slice_rows=7).collect())
    assert got == brute_quota(data, limit)


def test_deltas_and_their_order(spark):
    s = "path string, resource_id string, cost long"
    base = spark.createDataFrame([("a", "a", 100), ("c", "c", 100), ("d", "d", 100), ("e", "e", 100), ("z", "z", 0), ("g", "g", 5)], s)
    head = spark.createDataFrame([("a", "a", 200), ("b", "b", 50), ("c", "c", 50), ("d", "d", 100), ("e", "e", 300), ("z", "z", 0)], s)
    got = [(r["path"], r["status"]) for r in governance.ordered(governance.deltas(base, head)).collect()]
    assert got == [("e", "increased"), ("a", "increased"), ("b", "added"), ("c", "decreased"), ("g", "removed"), ("d", "unchanged"), ("z", "unchanged")]
    assert governance.changes_table(governance.deltas(base, head), "markdown").count("\n") == 8


def test_gates(spark):
    d = spark.createDataFrame([("gpt-4o", 2.0), ("x", 1.0)], "model string, cost double")
    assert governance.check(d, ["gpt-4o"], None).first()["exit_code"] == 3
    assert governance.check(d, None, 2.9).first()["exit_code"] == 2
    assert governance.check(d, None, 3.0).first()["exit_code"] == 0
    assert governance.violations(d, ["gpt-4o"]).count() == 1
    c = spark.createDataFrame([(1, "no"), (2, "m x"), (5, "m y")], "id long, body string")
    assert governance.sticky_comment(c, "m ").first()["id"] == 5 and governance.sticky_comment(c, "zz").count() == 0


def test_prices(spark):
    rows = pricing.parse_prices('{"models": {"m": {"provider": "P", "input_price_per_mtok": 0, "input_cost_per_mtok": 2.5}, "no": 3}}')
    assert rows == [("m", "P", 2.5, 0.0, None)]
    d = spark.createDataFrame([("gpt-4o",), ("none",)], "model string")
    assert costs.with_prices(d, pricing.packaged_prices(spark), "drop").count() == 1
    assert costs.with_prices(d, pricing.packaged_prices(spark), "zero").count() == 2
    with pytest.raises(Exception, match="no price"):
        costs.with_prices(d, pricing.packaged_prices(spark)).collect()
    assert pricing.load_prices(spark, "/nowhere")[1] == "packaged"
    assert [pricing.stale_state(x, 100 * 86400) for x in (0, 5 * 86400, 50 * 86400, 100 * 86400)] == ["Critical", "Critical", "Warning", "Fresh"]


def test_manifest():
    p = config.parse_manifest('[budget]\nmax_cost_usd = 5.5 # c\nwarn_threshold = x\n[policy]\nallowed_models = ["a", "b"]\n[defaults]\nmodel = "a"\n[[prompts]]\npath = "p"\ntags = { k = "1", k = "2" }\n[odd]\npath = "q"\n')
    assert (p.max_cost_usd, p.warn_threshold, p.allowed_models, p.default_model) == (5.5, 0.8, ["a", "b"], "a")
    assert [(x.path, x.tags) for x in p.prompts] == [("p", {"k": "2"})]
    assert config.unique_slugs(["x", "x", "x-1", "x"]) == ["x", "x-1", "x-1-1", "x-2"]
    again = config.parse_manifest(config.manifest_text([("i", "p.txt")]))
    assert again.prompts[0].prompt_id == "i"


def test_corpus_and_event():
    base, langs = config.parse_corpus('{"config":{"baseline_lang":"en"},"languages":{"en":{"name":"E","path":"e.txt","mode":"odd"}}}')
    assert base == "en" and langs[0].mode == "whitespace"
    with pytest.raises(ValueError, match="baseline"):
        config.parse_corpus('{"config":{"baseline_lang":"fr"},"languages":{"en":{"name":"E","path":"e"}}}')
    assert config.parse_event('{"repository":{"full_name":"a/b/c"},"number":7}') == ("a", "b/c", 7)
    with pytest.raises(ValueError, match="unknown option"):
        config.parse_options(["--x"], {})


def test_fairness(spark):
    d = spark.createDataFrame([("en", "a b"), ("de", "a b c"), (None, "x")], "lang string, content string")
    stats = fairness.with_parity(fairness.by_language(d, tokens=F.length("content").cast("long")), "en")
    assert {r["lang"]: round(r["parity_ratio"], 4) for r in stats.collect()} == {"en": 1.0, "de": round((5 / 3) / 1.5, 4)}
    assert fairness.worst(stats, "en").first()["worst_lang"] == "de"
    for values, least, most in [([1.0] * 4, 0, 0), ([1.0, 1.0, 1.0, 100.0], 0.5, 1), ([], 0, 0), ([5.0], 0, 0)]:
        g = fairness.gini(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()["gini"]
        assert least <= g + 1e-12 and g <= most + 1e-12


def test_export_row(spark):
    d = spark.createDataFrame([("r", "p,1", "OpenAI", "gpt-4o", 1000, 0, 0.005, {"team": 'a"b', "model": "no"})], "resource_id string, path string, provider string, model string, tokens_in long, tokens_out long, cost double, tags map<string,string>")
    r = focus.export(d, F.lit("2025-01-01"), cache_hit_ratio=0.5).first()
    assert str(r["BilledCost"]) == "0.005000000000" and r["ConsumedQuantity"] == 1000
    assert r["Tags"] == '{"cost-type":"estimate","effective-cost":"0.005000000000","focus-target":"vantage","focus-version":"1.0","model":"gpt-4o","provider":"OpenAI","resource-name":"p,1","team":"a\\"b","x-cache-hit-ratio":0.50,"x-content-hash":"todo-hash","x-token-count-input":1000,"x-token-count-output":0}'


def test_vocabularies(tmp_path, spark):
    ranks = {b"a": 0, b"\xff": 2, b"ab": 5}
    assert files.unpack_vocabulary(files.pack_vocabulary(ranks)) == ranks
    for data, what in [(b"x", "truncated"), (b"NOPE" + bytes(64), "magic"), (files.pack_vocabulary(ranks)[:-1], "truncated")]:
        with pytest.raises(ValueError, match=what):
            files.unpack_vocabulary(data)
    (tmp_path / "v.tiktoken").write_text(files.tiktoken_lines(ranks))
    assert files.ranks_of(files.read_tiktoken(spark, str(tmp_path / "v.tiktoken"))) == ranks


def test_files(tmp_path, spark):
    (tmp_path / "sub").mkdir()
    for name in ("a.txt", "sub/b.md", "c.bin", ".h.txt"):
        (tmp_path / name).write_text("x")
    assert {r["path"] for r in files.discover_prompts(spark, f"file:{tmp_path}").collect()} == {"a.txt", "sub/b.md"}
    assert [files.valid_path(p) for p in ("a/b", "", "/a", "~a", "a/../b", "a:b")] == [True] + [False] * 5
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first()["content"] == "x"


def test_stream_stops_at_its_quota(tmp_path, spark):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("\n".join(f"{k} b c" for k in range(10)))
    rows = cost_stream(spark.readStream.text(str(tmp_path / "in")), FLASH).withColumn("n", F.split("value", " ")[0].cast("long"))
    taken = []
    sink = QuotaSink(lambda d, e: taken.extend(d.collect()), "n", max_tokens=7)
    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert len(taken) == 3 and sink.reached and sink.tokens == 9


def test_percentiles(spark):
    d = spark.createDataFrame([(k,) for k in (5, 1, 3, 3)], "v long")
    r = costs.latency_stats(d.withColumn("g", F.lit(1)), "v", "g").first()
    assert (r["n"], r["p50"], r["p99"], r["mean"], r["stddev"]) == (4, 3, 5, 3, 1)


def test_special_tokens_are_searched_in_whole_texts(spark, tmp_path):
    from promptmeter.plans import queries

    rows = [(0, "x" * 50 + "<|endoftext|> tail", "en", "s"), (2, "y" * 300 + "<|fim_prefix|>", "en", "s"), (5, "z" * 40, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["strict"], r["listed"]) for r in queries.q_special_tokens(spark, str(tmp_path)).collect()}
    assert got == {0: (50, None), 2: (300, 300), 5: (None, None)}


def test_amounts_have_their_sign(spark):
    from promptmeter.functions.text import fixed_point

    d = spark.createDataFrame([(-0.005,), (0.0,), (12.5,), (-3.25,)], "c double")
    assert [r[0] for r in d.select(fixed_point("c")).collect()] == ["-0.005000000000", "0.000000000000", "12.500000000000", "-3.250000000000"]


def test_texts_above_the_limit_are_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 50)
    assert files.read_texts(spark, f"file://{tmp_path}", most=50).count() == 1
    with pytest.raises(Exception, match="file too large"):
        files.read_texts(spark, f"file://{tmp_path}", most=49).collect()


def test_native_merges_are_those_of_the_plain_form(spark):
    import public_tokenizers

    from promptmeter.functions import bpe

    ranks = files.ranks_of(files.read_tiktoken(spark, "file://" + public_tokenizers.path("byte_bpe_50k.tiktoken")))
    e = bpe.Encoding("x", "cl100k", ranks)
    fast, plain = bpe.Encoder(e, most=50), bpe.Encoder(e, native=False)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ["日本語 don't  \n\n x" + "a" * 500, "", None]
    for t in texts:
        assert fast.ids(t) == plain.ids(t) and fast.count(t) == len(plain.ids(t))
    cases = spark.createDataFrame([("x", "some text", plain.ids("some text")), ("x", "some text", [1]), ("y", "a", [1])], "encoding string, text string, tokens array<int>")
    assert tuple(bpe.parity_counts(cases, {"x": e, "y": bpe.CL100K}).first()) == (1, 1, 1)
    d = spark.createDataFrame([(plain.ids("日本 x"),), ([10**6],), (None,)], "ids array<int>")
    vocabulary = spark.createDataFrame([(bytearray(t), r) for t, r in ranks.items()], "token binary, rank int")
    assert [bytes(r["bytes"]) for r in bpe.decode(d, "ids", vocabulary).collect()] == ["日本 x".encode(), b"", b""]


def test_exact_fairness_counts(spark):
    import __spark_entry__ as entry

    got = {r["lang"]: r["tokens"] for r in entry.queries()["q_fairness_exact"](spark, "/root/testdata/sf0.001").collect()}
    from promptmeter.functions import bpe
    from promptmeter.plans.queries import _public_encoding

    plain, expected = bpe.Encoder(_public_encoding(spark), native=False), {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null").collect():
        expected[r["lang"]] = expected.get(r["lang"], 0) + len(plain.ids(r["text"]))
    assert got == expected


def test_rendered_fairness_is_json(spark):
    import __spark_entry__ as entry

    got = json.loads(entry.queries()["q_fairness_json"](spark, "/root/testdata/sf0.001").first()[0])
    assert list(got) == ["meta", "global_metrics", "languages"] and got["languages"]["en"]["parity_ratio"] == 1
    assert got["global_metrics"]["worst_language"] in got["languages"] and got["meta"] == {"model": "gpt-4o", "encoding": "o200k_base", "baseline": "en"}


def test_summary_and_comments(spark):
    rows = usage.with_cost(usage.classify(lines(spark, "a b", "c")), FLASH)
    assert usage.summary_text(usage.totals(rows)).first()[0] == "Lines: 2\nTokens: 3\nCost: $0.000000"
    d = spark.createDataFrame([(k, "mark" if k in (3, 7, 1500) else "") for k in range(2000)], "id long, body string")
    assert tuple(governance.comment_action(d, "mark").first()) == ("update", 7) and tuple(governance.comment_action(d, "none").first()) == ("create", None)
