"""Column functions on texts, paths and counts."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode_classes import CJK, in_class

WORD = r"[^ \t\n\x0B\f\r]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """Runs of bytes that aren't ASCII white space."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(WORD)), F.lit(0)).cast("long")


def words_narrow(text) -> Column:
    """Words between blanks, tabs and line ends only."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def code_points(text) -> Column:
    return F.coalesce(F.length(_c(text)), F.lit(0)).cast("long")


def byte_length(text) -> Column:
    return F.coalesce(F.octet_length(_c(text)), F.lit(0)).cast("long")


def approximate_tokens(text) -> Column:
    """Words; a text of white space only counts 1."""
    n = words(text)
    return F.when((n == 0) & (byte_length(text) > 0), F.lit(1).cast("long")).otherwise(n)


def heuristic_words(text) -> Column:
    """Code points where over 30 % (whole per cent) of them are CJK, else words."""
    total = code_points(text)
    cjk = total - code_points(F.regexp_replace(_c(text), f"[{in_class(CJK)}]", ""))
    return F.when((total > 0) & (F.floor(cjk * 100 / F.greatest(total, F.lit(1))) > 30), total).otherwise(words(text))


def word_count(text, mode: str) -> Column:
    modes = {"whitespace": words, "character": code_points, "heuristic": heuristic_words}
    return modes.get(mode, words)(text)


def word_count_by(text, mode) -> Column:
    """As word_count, with the mode in a column."""
    return F.when(_c(mode) == "character", code_points(text)).when(_c(mode) == "heuristic", heuristic_words(text)).otherwise(words(text))


def slugify(path) -> Column:
    """Lower case; separators (/ \\ . _ blank) become single dashes, other signs and a literal dash go, no dash at the ends."""
    kept = F.regexp_replace(_c(path), r"[^a-zA-Z0-9/\\._ ]", "")
    return F.regexp_replace(F.lower(F.regexp_replace(kept, r"[/\\._ ]+", "-")), "^-+|-+$", "")


def content_hash(content) -> Column:
    """First 8 hex digits of BLAKE2b-256, which the JVM functions lack."""

    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else hashlib.blake2b(t.encode("utf-8", "replace") if isinstance(t, str) else bytes(t), digest_size=32).hexdigest()[:8])

    digest.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(digest, "string")(content)


def resource_id(prompt_id, path, content=None) -> Column:
    """struct(value, source): the manifest's id, else the path's slug, else the content's hash."""
    slug = F.nullif(slugify(path), F.lit(""))
    made = content_hash(content) if content is not None else F.lit(None).cast("string")
    source = F.when(_c(prompt_id).isNotNull(), "manifest").when(slug.isNotNull(), "path_slug").when(made.isNotNull(), "content_hash")
    return F.struct(F.coalesce(_c(prompt_id), slug, made).alias("value"), source.alias("source"))


def first_special(text, specials, mode: str = "strict", allowed=()) -> Column:
    """Byte offset of the first special token, in listed order, that the mode forbids; null if none.

    Modes: strict forbids all, ordinary none, allow_list those that aren't allowed.
    """
    if mode == "ordinary":
        return F.lit(None).cast("long")
    found = []
    for token in specials:
        if mode == "strict" or token not in allowed:
            at = F.instr(_c(text), F.lit(token))
            found.append(F.when(at > 0, F.octet_length(F.substring(_c(text), F.lit(1), at - 1))))
    return F.coalesce(*found, F.lit(None)).cast("long") if found else F.lit(None).cast("long")


def fertility(tokens, n_words) -> Column:
    return F.when(_c(n_words) == 0, 0.0).otherwise(_c(tokens) / _c(n_words))


def compression(n_bytes, tokens) -> Column:
    return F.when(_c(tokens) == 0, 0.0).otherwise(_c(n_bytes) / _c(tokens))


def parity(own, base) -> Column:
    return F.when(_c(base) == 0, 0.0).otherwise(_c(own) / _c(base))


def format_bytes(n) -> Column:
    n = _c(n)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024**2, F.format_string("%.2f KB", n / 1024)).when(n < 1024**3, F.format_string("%.2f MB", n / 1024**2)).otherwise(F.format_string("%.2f GB", n / 1024**3))


def throughput_mb(n_bytes, seconds) -> Column:
    return _c(n_bytes) / 1e6 / _c(seconds)


def pico(cost) -> Column:
    """US dollars as whole pico-dollars."""
    return F.round(_c(cost) * 1e12).cast("decimal(38,0)")


def fixed_point(cost) -> Column:
    """US dollars with twelve decimals, as text."""
    whole = pico(cost)
    digits = F.abs(whole).cast("string")
    digits = F.when(F.length(digits) < 13, F.lpad(digits, 13, "0")).otherwise(digits)
    return F.concat(F.when(whole < 0, "-").otherwise(""), digits.substr(F.lit(1), F.length(digits) - 12), F.lit("."), F.right(digits, F.lit(12)))


def quoted(text) -> Column:
    """A JSON string."""
    whole = F.to_json(F.array(_c(text)))
    return whole.substr(F.lit(2), F.length(whole) - 2)


class _Number(str):
    """A number as it was written."""


def _plain_json(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_plain_json(k)}:{_plain_json(v)}" for k, v in sorted(value.items(), key=lambda x: x[0].encode("utf-8", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_plain_json, value)) + "]"
    return value if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def plain_json(text: str | None) -> str | None:
    """A JSON text with the keys of all its objects in byte order, the last value of a repeated key and no blanks.

    Numbers stay as they are written; null where the text is no JSON, is nested too deeply to be read, or names
    half of a surrogate pair.
    """
    try:
        out = None if text is None else _plain_json(json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse))
        return out and out.encode().decode()
    except (ValueError, RecursionError):
        return None


def _refuse(name: str):
    raise ValueError(f"no JSON: {name}")


def sorted_json(text) -> Column:
    """`plain_json` of a column."""

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([plain_json(t) for t in texts], dtype=object)

    return F.pandas_udf(each, "string")(_c(text))
