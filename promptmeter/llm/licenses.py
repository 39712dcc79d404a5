"""License scans: passages compared to license templates by the Dice coefficient over word bigrams.

A passage is a line, a paragraph (lines between empty ones) or the whole text, in lower case with everything but
letters and digits as single blanks. Its size is its number of word bigrams, the size of a template likewise; the
coefficient is twice the number of common bigrams over the sum of both sizes, and a bigram that both hold several times
is common as often as the one that holds it less often does: a text has 1 against itself. A template can reach the
threshold t only with passages between a t / (2 - t) and a (2 - t) / t bigrams, so others are never compared.
DataFrame operations only.

Edge cases: null and empty texts have no passage; of equal coefficients the first template by name counts; a
paragraph of one line and a text of one paragraph are reported once, as the smaller unit.

A notice inside a longer line, or wrapped over lines that others adjoin, is a window: a run of words of the text that
begins and ends with bigrams of one template and reaches the threshold. Its number is that of its first word. Of
windows that overlap the one with the greatest coefficient counts, then the longest; windows inside a line, paragraph
or text that reaches the threshold itself are not reported again. Equal rows have theirs each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .shared import written

THRESHOLD = 0.8
#: Short forms in which public licenses are declared or begin, then their texts or defining paragraphs.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
} | TEXTS


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def bounds(size: int, t: float) -> tuple[int, int]:
    """Least and greatest number of bigrams with which a passage can reach t."""
    return int(-(-size * t // (2 - t))), int(size * (2 - t) / t)


def least_common(b: list[str], lo: int, t: float) -> int:
    """How many bigrams a passage that reaches t has in common with a template at least."""
    return math.ceil(t * (len(b) + lo) / 2 - 1e-9)


def least_distinct(b: list[str], lo: int, t: float) -> int:
    """How many different ones of them, as only the template's repeated bigrams can be common twice."""
    return max(1, least_common(b, lo, t) - len(b) + len(set(b)))


def clue_words(templates: dict[str, tuple[list[str], int]], t: float) -> list[str]:
    """Words of which every passage that reaches the threshold holds one.

    A passage needs so many of a template's d distinct bigrams (see `least_distinct`), so one of any d - that + 1 of
    them. Words are chosen, long ones first, until so many bigrams of each template have one of them.
    """
    need = {k: len(set(b)) - least_distinct(b, lo, t) + 1 for k, (b, lo) in templates.items()}
    has: dict[str, dict[str, set[str]]] = {}
    for k, (b, _) in templates.items():
        for pair in b:
            for w in pair.split():
                has.setdefault(w, {}).setdefault(k, set()).add(pair)
    covered: dict[str, set[str]] = {k: set() for k in templates}
    long = {w: x for w, x in has.items() if len(w) > 4}  # short words stand in most texts
    reach = {k: len(set().union(*(x.get(k, set()) for x in long.values()))) for k in templates}
    words, chosen = sorted(long if all(reach[k] >= n for k, n in need.items()) else has), []

    def gain(word: str) -> float:
        return sum(min(max(0, need[k] - len(covered[k])), len(pairs - covered[k])) for k, pairs in has[word].items()) * len(word) ** 2

    while any(len(covered[k]) < n for k, n in need.items()):
        chosen.append(max(words, key=gain))
        for k, pairs in has[chosen[-1]].items():
            covered[k] |= pairs
    return chosen


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit, unit_no, license, dice of every passage that reaches the threshold, with its best template."""
    sizes = {k: (bigrams(v), bounds(len(bigrams(v)), threshold)) for k, v in sorted(templates.items())}
    known = _known(sizes)
    least, most = min(lo for _, (lo, _) in sizes.values()), max(hi for _, (_, hi) in sizes.values())
    lower, clues = F.lower("text"), clue_words({k: (b, lo) for k, (b, (lo, _)) in sizes.items()}, threshold)
    hinted = lambda c: reduce(lambda a, b: a | b, (c.contains(w) for w in clues))
    clean = F.trim(F.regexp_replace(F.regexp_replace(lower, r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", "\n"))
    # a generator is evaluated once, however often its column is used after it; texts without a clue word are read once, and
    # put into lower case once
    texts = written(docs.where(F.exists(F.array(lower), hinted)).select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode(F.array(clean)).alias("clean")), "license-texts")
    units = {"line": F.split("clean", "\n"), "paragraph": F.split("clean", "\n\n+"), "text": F.array("clean")}
    blank = {"line": lambda x: F.lit(True), "paragraph": lambda x: x.contains("\n"), "text": lambda x: x.contains("\n\n")}

    def passages(unit: str):
        every = F.transform(units[unit], lambda x, i: F.struct(F.lit(unit).alias("unit"), (i + 1).cast("long").alias("unit_no"), x.alias("p")))
        # a passage of n bigrams has at least 2 n + 1 characters
        return F.filter(every, lambda s: (F.length(s["p"]) > 2 * least) & blank[unit](s["p"]) & hinted(s["p"]))

    rows = texts.select("doc_id", F.explode(F.concat(*map(passages, units))).alias("s"))
    rows = rows.select("doc_id", "s.unit", "s.unit_no", F.explode(F.array(F.split(F.trim(F.regexp_replace("s.p", "\n+", " ")), " "))).alias("w"))
    rows = rows.withColumn("n", F.size("w") - 1).where(F.col("n").between(least, most))
    rows = rows.select("doc_id", "unit", "unit_no", "n", F.explode(F.array(_pairs("w"))).alias("b"))
    able = F.filter(known, lambda t: (F.col("n") >= t["lo"]) & (F.col("n") <= t["hi"]))
    scored = F.transform(able, lambda t: F.struct(_coefficient(t, F.col("b"), F.col("n"), threshold).alias("dice"), t["license"].alias("license")))
    hits = F.filter(scored, lambda x: x["dice"] >= threshold)
    # the greatest coefficient, and of equal ones the first name
    best = F.array_min(F.transform(hits, lambda x: F.struct((-x["dice"]).alias("less"), x["license"].alias("license"))))
    rows = rows.select("doc_id", "unit", "unit_no", F.explode(F.array(best)).alias("best")).where("best is not null")
    rows = rows.select("doc_id", "unit", "unit_no", "best.license", (-F.col("best.less")).alias("dice"))
    return rows.union(_windows(texts, sizes, known, threshold))


def _bound(value, use):
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _known(sizes: dict):
    """The templates as an array: their distinct bigrams, how often each stands in it, and the repeated ones."""
    rows = []
    for k, (b, (lo, hi)) in sizes.items():
        count = sorted(Counter(b).items())
        again = [f"{x}|{m}" for x, m in count if m > 1]
        texts = lambda xs: F.filter(F.split(F.lit("#".join(xs)), "#"), lambda x: x != "")
        repeated = F.transform(texts(again), lambda x: F.struct(F.split(x, r"\|")[0].alias("x"), F.split(x, r"\|")[1].cast("int").alias("m")))
        times = F.transform(texts([str(m) for _, m in count]), lambda x: x.cast("int"))
        rows.append(F.struct(F.lit(k).alias("license"), F.lit(len(b)).alias("size"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), texts([x for x, _ in count]).alias("set"), times.alias("times"), repeated.alias("again")))
    return F.array(*rows)


def _pairs(words):
    """The bigrams of an array of words, in order."""
    w = F.col(words) if isinstance(words, str) else words
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.element_at(w, i + 2)))


def _coefficient(t, b, n, threshold: float):
    """The Dice coefficient of template t and a passage of the n bigrams b; 0 where it can't reach the threshold.

    The common distinct bigrams come first; only where those and all repeats would do, the repeats are counted.
    """
    repeats = F.aggregate(t["again"], F.lit(0), lambda s, y: s + F.greatest(F.least(y["m"], F.size(F.filter(b, lambda x: x == y["x"]))) - 1, F.lit(0)))
    exact = lambda c: (c + repeats) * 2.0 / (t["size"] + n)
    most = lambda c: (c + t["size"] - F.size(t["set"])) * 2.0 / (t["size"] + n)
    return _bound(F.size(F.array_intersect(t["set"], b)), lambda c: F.when(most(c) >= threshold, exact(c)).otherwise(0.0))


def _dice(known, words, threshold: float):
    """Whether the words as one passage reach the threshold with any template."""

    def any_of(w):
        n = F.size(w) - 1
        able = F.filter(known, lambda t: n.between(t["lo"], t["hi"]))
        return _bound(F.when(F.size(able) > 0, _pairs(w)), lambda b: F.exists(able, lambda t: _coefficient(t, b, n, threshold) >= threshold))

    return _bound(words, any_of)


def _windows(texts: DataFrame, sizes: dict, known, threshold: float) -> DataFrame:
    """The rows of windows of texts (doc_id, row, clean); texts are not shuffled, only places of windows are."""
    every = F.split(F.lit("|".join(sorted({x for b, _ in sizes.values() for x in b}))), r"\|")
    needs, distinct = (F.create_map(*(F.lit(x) for k, (b, (lo, _)) in sizes.items() for x in (k, f(b, lo, threshold)))) for f in (least_common, least_distinct))
    # words with the number of their line and paragraph
    lines = F.split("clean", "\n")
    rows = texts.select(F.struct("doc_id", "row").alias("key"), F.explode(F.array(lines)).alias("lines"))
    numbered = F.flatten(F.transform("lines", lambda x, i: F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), i.alias("line")))))
    rows = rows.select("key", "lines", F.explode(F.array(numbered)).alias("ws"))
    pairs = F.transform(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x["w"], F.element_at("ws", i + 2)["w"]))
    rows = rows.select("key", "lines", "ws", F.explode(F.array(pairs)).alias("b"))
    rows = rows.select("key", "lines", "ws", "b", F.explode(F.array(F.array_intersect(every, "b"))).alias("seen"))
    able = F.filter(known, lambda t: F.size(F.array_intersect(t["set"], F.col("seen"))) >= distinct[t["license"]])
    rows = rows.select("key", "lines", "ws", "b", F.explode(F.array(able)).alias("able")).where(F.size("able") > 0)
    rows = rows.select("key", "lines", "ws", "b", F.posexplode("able").alias("k", "t"))
    places = F.filter(F.transform("b", lambda x, i: F.struct((i + 1).alias("at"), F.array_position(F.col("t.set"), x).cast("int").alias("id"))), lambda h: h["id"] > 0)
    rows = rows.select("key", "lines", "ws", "k", "t", F.explode(F.array(places)).alias("hits"))
    # for each hit the place of the same bigram as many times before it as the template holds it, in reach of a window
    # (0: none): a window that begins after that place counts the hit
    before = lambda h, i: F.slice(F.col("hits"), F.greatest(i + 1 - F.col("t.hi"), F.lit(1)), F.least(i, F.col("t.hi")))
    same = lambda h, i: F.transform(F.filter(before(h, i), lambda g: g["id"] == h["id"]), lambda g: g["at"])
    full = lambda h, i: _bound(same(h, i), lambda xs: F.get(xs, F.size(xs) - F.element_at(F.col("t.times"), h["id"])))
    last = F.transform("hits", lambda h, i: F.struct(h["at"].alias("at"), F.coalesce(full(h, i), F.lit(0)).alias("before")))
    rows = rows.select("key", "lines", "ws", "k", "t", F.explode(F.array(last)).alias("hits"))
    # a window begins where enough hits follow within its greatest length
    least = needs[F.col("t.license")]
    dense = F.filter(F.sequence(F.lit(1), F.size("hits")), lambda j: (j + least - 1 <= F.size("hits")) & (F.get("hits", j + least - 2)["at"] - F.get("hits", j - 1)["at"] < F.col("t.hi")))
    rows = rows.select("key", "lines", "ws", "t", "hits", F.explode(F.array(F.when(F.size("hits") >= least, dense).otherwise(F.array().cast("array<int>")))).alias("dense")).where(F.size("dense") > 0)
    rows = rows.select("key", "lines", "ws", "t", "hits", F.explode("dense").alias("j"))
    at = F.get("hits", F.col("j") - 1)["at"]
    start = F.struct(F.lit(0).alias("c"), F.lit(0.0).alias("dice"), F.lit(0).alias("n"))

    def step(s, h):
        c, n = s["c"] + F.when(h["before"] < F.col("at"), 1).otherwise(0), h["at"] - F.col("at") + 1
        dice = c * 2.0 / (F.col("t.size") + n)
        better = (dice >= s["dice"]) & n.between(F.col("t.lo"), F.col("t.hi"))
        return F.struct(c.alias("c"), F.when(better, dice).otherwise(s["dice"]).alias("dice"), F.when(better, n).otherwise(s["n"]).alias("n"))

    rows = rows.withColumn("at", at)
    best = F.aggregate(F.slice("hits", F.col("j"), F.least(F.col("t.hi"), F.size("hits"))), start, step)
    rows = rows.select("key", "lines", "ws", "t.license", "at", F.explode(F.array(best)).alias("best")).where(F.col("best.dice") >= threshold)
    # the line, paragraph and text around a window
    rows = rows.select("key", "lines", "ws", "license", "best", F.col("at").alias("a"), (F.col("at") + F.col("best.n")).alias("z"))
    rows = rows.withColumns({"p": F.element_at("ws", F.col("a"))["line"], "q": F.element_at("ws", F.col("z"))["line"]})
    blank = F.filter(F.transform("lines", lambda l, i: F.when(l == "", i)), lambda i: i.isNotNull())
    cols = ["key", "ws", "license", "best", "a", "z", "p", "q"]
    rows = rows.select(*cols, F.explode(F.array(blank)).alias("blank"))
    lo = F.coalesce(F.array_max(F.filter("blank", lambda i: i < F.col("p"))), F.lit(-1))
    hi = F.coalesce(F.array_min(F.filter("blank", lambda i: i > F.col("p"))), F.lit(2**31 - 1))
    rows = rows.select(*cols, lo.alias("lo"), hi.alias("hi"))
    part = lambda ok: F.transform(F.filter("ws", ok), lambda w: w["w"])
    shown = (F.col("p") == F.col("q")) & _dice(known, part(lambda w: w["line"] == F.col("p")), threshold)
    shown = shown | ((F.col("q") < F.col("hi")) & _dice(known, part(lambda w: (w["line"] > F.col("lo")) & (w["line"] < F.col("hi"))), threshold))
    shown = F.coalesce(shown | _dice(known, F.transform("ws", lambda w: w["w"]), threshold), F.lit(False))
    rows = rows.select("key", F.struct((-F.col("best.dice")).alias("less"), (-F.col("best.n")).alias("short"), "license", "a", "z", shown.alias("shown")).alias("x"))
    # what overlaps a better one goes; the windows of one row meet here
    rows = rows.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    apart = F.aggregate("xs", F.slice("xs", 1, 0), lambda s, x: F.when(F.exists(s, lambda y: (x["a"] <= y["z"]) & (y["a"] <= x["z"])), s).otherwise(F.concat(s, F.array(x))))
    rows = rows.select("key", F.explode(apart).alias("x")).where(~F.col("x.shown"))
    return rows.select("key.doc_id", F.lit("window").alias("unit"), F.col("x.a").cast("long").alias("unit_no"), F.col("x.license").alias("license"), (-F.col("x.less")).alias("dice"))


def oracle_sql(docs: str = "documents", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan in DuckDB SQL, windows included."""
    rows, grams = [], []
    for k, v in sorted(templates.items()):
        b = bigrams(v)
        lo, hi = bounds(len(b), threshold)
        rows.append(f"('{k}', {len(b)}, {lo}, {hi}, {least_common(b, lo, threshold)})")
        grams += [f"('{k}', {x!r}, {m})" for x, m in sorted(Counter(b).items())]
    parts = {
        "line": ("string_split(clean, chr(10))", "true"),
        "paragraph": ("regexp_split_to_array(clean, '\\n\\n+')", "contains(p, chr(10))"),
        "text": ("[clean]", "contains(p, chr(10) || chr(10))"),
    }
    units = " UNION ALL ".join(
        f"SELECT doc_id, row, '{u}' AS unit, CAST(i AS BIGINT) AS unit_no, p FROM (SELECT doc_id, row, unnest({a}) AS p, generate_subscripts({a}, 1) AS i FROM c) WHERE {w}" for u, (a, w) in parts.items()
    )
    # passages of every unit around a window: its line, what stands between empty lines, and the text
    inside = "len(list_filter(blank, lambda i: i BETWEEN p AND q)) = 0 AND"
    around = {
        "p = q": "line = p",
        f"{inside} true": "line > coalesce(list_max(list_filter(blank, lambda i: i < p)), -1) AND line < coalesce(list_min(list_filter(blank, lambda i: i > p)), 2147483647)",
        "true": "true",
    }
    shown = " UNION ALL ".join(
        f"SELECT row, license, a, z, {k} AS k, list(w.w ORDER BY w.i) AS w FROM edge JOIN w USING (row) WHERE {ok} AND {holds} GROUP BY ALL" for k, (ok, holds) in enumerate(around.items())
    )
    return f"""WITH t(license, size, lo, hi, need) AS MATERIALIZED (VALUES {', '.join(rows)}),
g(license, b, m) AS MATERIALIZED (VALUES {', '.join(grams)}),
c AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ') AS clean FROM {docs} WHERE text IS NOT NULL),
u AS (SELECT row_number() OVER () AS id, doc_id, unit, unit_no, string_split(trim(regexp_replace(p, '\\n+', ' ', 'g'), ' '), ' ') AS w FROM ({units})),
n AS MATERIALIZED (SELECT id, doc_id, unit, unit_no, len(w) - 1 AS n, w FROM u WHERE len(w) BETWEEN (SELECT min(lo) FROM t) + 1 AND (SELECT max(hi) FROM t) + 1),
nb AS (SELECT id, n, b, count(*) AS m FROM (SELECT id, n, unnest([w[i] || ' ' || w[i + 1] for i in generate_series(1, len(w) - 1)]) AS b FROM n) WHERE b IN (SELECT b FROM g) GROUP BY ALL),
s AS (SELECT id, license, CAST(sum(least(nb.m, g.m)) AS BIGINT) * 2.0::DOUBLE / (any_value(size) + any_value(n)) AS dice FROM nb JOIN g USING (b) JOIN t USING (license) WHERE n BETWEEN lo AND hi GROUP BY id, license),
k AS (SELECT doc_id, unit, unit_no, license, dice FROM s JOIN n USING (id) WHERE dice >= {threshold}::DOUBLE QUALIFY row_number() OVER (PARTITION BY id ORDER BY dice DESC, license) = 1),
l AS MATERIALIZED (SELECT row, i - 1 AS line, x FROM (SELECT row, unnest(string_split(clean, chr(10))) AS x, generate_subscripts(string_split(clean, chr(10)), 1) AS i FROM c)),
w AS MATERIALIZED (SELECT row, line, w, row_number() OVER (PARTITION BY row ORDER BY line, j) AS i FROM (SELECT row, line, unnest(string_split(x, ' ')) AS w, generate_subscripts(string_split(x, ' '), 1) AS j FROM l) WHERE w <> ''),
h AS MATERIALIZED (SELECT row, license, b, g.m, i AS at, row_number() OVER (PARTITION BY row, license, b ORDER BY i) AS r, row_number() OVER (PARTITION BY row, license ORDER BY i) AS o
 FROM (SELECT row, i, w || ' ' || lead(w) OVER (PARTITION BY row ORDER BY i) AS b FROM w) JOIN g USING (b)),
f AS MATERIALIZED (SELECT h.row, h.license, h.at, h.o, coalesce(e.at, 0) AS before FROM h LEFT JOIN h e ON e.row = h.row AND e.license = h.license AND e.b = h.b AND e.r = h.r - h.m),
d AS (SELECT f.row, license, f.at AS a, f.o, size, lo, hi FROM f JOIN t USING (license) JOIN f y ON y.row = f.row AND y.license = f.license AND y.o = f.o + need - 1 AND y.at - f.at < hi),
v AS (SELECT d.row, d.license, a, f.at + 1 AS z, f.at - a + 1 AS n, lo, size, CAST(sum(CASE WHEN before < a THEN 1 ELSE 0 END) OVER (PARTITION BY d.row, d.license, a ORDER BY f.at) AS BIGINT) AS common
 FROM d JOIN f ON f.row = d.row AND f.license = d.license AND f.o >= d.o AND f.at - a < hi),
x AS (SELECT row, license, a, z, n, common * 2.0::DOUBLE / (size + n) AS dice FROM v WHERE n >= lo AND common * 2.0::DOUBLE / (size + n) >= {threshold}::DOUBLE QUALIFY row_number() OVER (PARTITION BY row, license, a ORDER BY dice DESC, n DESC) = 1),
xs AS (SELECT row, list_reduce(list([{{'a': a, 'z': z, 'license': license, 'dice': dice}}] ORDER BY dice DESC, n DESC, license, a), lambda s, y: CASE WHEN len(list_filter(s, lambda k: k.a <= y[1].z AND y[1].a <= k.z)) > 0 THEN s ELSE s || y END) AS xs FROM x GROUP BY row),
one AS (SELECT row, y.a AS a, y.z AS z, y.license AS license, y.dice AS dice FROM (SELECT row, unnest(xs) AS y FROM xs)),
e AS (SELECT row AS own, coalesce(list(line) FILTER (WHERE x = ''), []) AS blank FROM l GROUP BY row),
edge AS (SELECT one.*, p.line AS p, q.line AS q, blank FROM one JOIN w p ON p.row = one.row AND p.i = a JOIN w q ON q.row = one.row AND q.i = z JOIN e ON own = one.row),
ab AS (SELECT row, a, k, n, b, count(*) AS m FROM (SELECT row, a, k, len(w) - 1 AS n, unnest([w[i] || ' ' || w[i + 1] for i in generate_series(1, len(w) - 1)]) AS b FROM ({shown})) WHERE b IN (SELECT b FROM g) GROUP BY ALL),
gone AS (SELECT DISTINCT row, a FROM (SELECT row, a, k, license, sum(least(ab.m, g.m)) * 2.0::DOUBLE / (any_value(size) + any_value(n)) AS dice FROM ab JOIN g USING (b) JOIN t USING (license) WHERE n BETWEEN lo AND hi GROUP BY ALL) WHERE dice >= {threshold}::DOUBLE)
SELECT doc_id, unit, unit_no, license, dice FROM k
UNION ALL SELECT doc_id, 'window', CAST(a AS BIGINT), license, dice FROM one JOIN c USING (row) WHERE NOT EXISTS (FROM gone WHERE gone.row = one.row AND gone.a = one.a)"""
