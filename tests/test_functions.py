import tiktoken
from pyspark.sql import functions as F

from promptmeter.functions import bpe, models, pretok, text


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*columns).first())


def test_slug_keeps_letters_and_digits(spark):
    for given, slug in [("prompts/search.txt", "prompts-search-txt"), ("Src/Auth/Login V2.txt", "src-auth-login-v2-txt"), ("___crazy___name___", "crazy-name"), ("my-prompt.txt", "myprompt-txt"), ("", "")]:
        assert one(spark, given, text.slugify("x")) == (slug,)


def test_counts_of_words_points_and_bytes(spark):
    f = [text.words("x"), text.code_points("x"), text.byte_length("x"), text.approximate_tokens("x"), text.heuristic_words("x")]
    assert one(spark, "a b\x0bc  d", *f) == (4, 8, 8, 4, 4)
    assert one(spark, "   ", *f) == (0, 3, 3, 1, 0)
    assert one(spark, "", *f) == (0, 0, 0, 0, 0)
    assert one(spark, None, *f) == (0, 0, 0, 0, 0)
    assert one(spark, "日本語 text", text.heuristic_words("x")) == (8,)


def test_fixed_point_and_cents(spark):
    assert one(spark, "1e-5", text.fixed_point(F.col("x").cast("double")), models.rounded_cents(F.lit(1.236))) == ("0.000010000000", 124)
    assert one(spark, "12345.5", text.fixed_point(F.col("x").cast("double"))) == ("12345.500000000000",)


def test_special_tokens_go_by_listed_order(spark):
    listed = ["<|b|>", "<|a|>"]
    assert one(spark, "é<|a|> <|b|>", text.first_special("x", listed)) == (8,)
    assert one(spark, "é<|a|> <|b|>", text.first_special("x", listed, "allow_list", ["<|b|>"])) == (2,)
    assert one(spark, "<|a|>", text.first_special("x", listed, "ordinary")) == (None,)


def test_pieces():
    assert pretok.split(" don't I'll", "cl100k") == [" don", "'t", " I", "'ll"]
    assert pretok.split("h3ll0", "cl100k") == ["h", "3", "ll", "0"]
    assert pretok.split("12345", "cl100k") == ["123", "45"]
    assert pretok.split("! ...", "cl100k") == ["!", " ..."]
    assert pretok.split(" \n ", "cl100k") == [" \n", " "]
    assert pretok.split("  \n  ", "o200k") == ["  \n", "  "]
    assert pretok.split("a \r\n b", "o200k") == ["a", " \r\n", " b"]
    assert pretok.split("a  b", "spaces") == ["a", " ", " ", "b"]
    assert pretok.split(None, "o200k") == []


def test_both_forms_of_the_pretokenizers_agree(spark):
    texts = ["Hello  World's 1234\r\n x/y", "é̂ ÀB ς  x", "日本 テスト ﾞ", "don't WE'LL\n\n  z", "́a Áb"]
    d = spark.createDataFrame([(t,) for t in texts], "x string")
    for kind in pretok.KINDS:
        assert all(a == b for a, b in d.select(pretok.pieces("x", kind), pretok.pieces_sql("x", kind)).collect())


RANKS = {bytes([b]): b for b in range(256)} | {x: 256 + k for k, x in enumerate([b"ab", b"bc", b"abc", b"aa", b" a", b" ab", b"aaa"])}


def test_merging_agrees_with_a_reference_encoder(spark):
    e = bpe.Encoding("micro", "cl100k", RANKS)
    other = tiktoken.Encoding("micro", pat_str=r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+", mergeable_ranks=RANKS, special_tokens={})
    for t in ["", "abc", "abcabc aaaa", "a" * 300, "xaby éab", " ab abc\n"]:
        assert bpe.Encoder(e).ids(t) == other.encode_ordinary(t)


def test_lowest_rank_merges_first():
    ranks = {b"a": 10, b"b": 11, b"c": 12, b"ab": 20, b"bc": 21, b"abc": 30}
    assert bpe.merge(b"abc", ranks) == [30]
    assert bpe.merge(b"z", ranks) == [0]


def test_counts_without_vocabulary_are_marked(spark):
    assert one(spark, "a b c", bpe.count_tokens("x", bpe.O200K).alias("c")) == ((3, True),)
    e = bpe.Encoding("micro", "cl100k", RANKS)
    assert one(spark, "abc", bpe.count_tokens("x", e).alias("c"), bpe.encode("x", e)) == ((1, False), [258])


def test_ids_decode_to_their_bytes(spark):
    vocabulary = spark.createDataFrame([(bytearray(t), r) for t, r in RANKS.items()], "token binary, rank int")
    d = spark.createDataFrame([([258, 32],), ([9999],), ([],)], "ids array<int>")
    assert sorted(bytes(r["bytes"]) for r in bpe.decode(d, "ids", vocabulary).collect()) == [b"", b"", b"abc "]


def test_costs_and_models(spark):
    d = spark.createDataFrame([(1000, 100, 20)], "a long, b long, c long")
    cost = d.select(models.token_cost("a", "b", "c", F.lit(0.15), F.lit(0.60), F.lit(3.50))).first()[0]
    assert round(cost, 9) == 0.000268
    assert models.kind_cost(1_000_000, "CacheRead", {"input": 2.0}) == 2.0
    for name, e in [("gpt-4o-x", "o200k_base"), ("o1-mini", "o200k_base"), ("gpt-4.1", "cl100k_base"), ("claude-x", "cl100k_base"), ("gpt-5", None)]:
        assert one(spark, name, models.encoding_of("x")) == (e,)
    assert one(spark, "abc", text.content_hash("x"))[0] == __import__("hashlib").blake2b(b"abc", digest_size=32).hexdigest()[:8]
