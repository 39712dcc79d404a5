"""License scans against their definition and their SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from promptmeter.llm import licenses

SMALL = {
    "Alpha": "you may use and use and share the work under the alpha license of the group",
    "Beta": "the beta license lets you copy the work and copy the work again and again",
    "Short": "under the alpha license",
}


def dice(a, b):
    return sum((Counter(a) & Counter(b)).values()) * 2.0 / (len(a) + len(b))


def pairs(words):
    return [f"{x} {y}" for x, y in zip(words, words[1:])]


def by_definition(text, templates, t=licenses.THRESHOLD):
    """unit, unit_no, license, dice of one text, without any pruning but the size bounds."""
    bags = {k: licenses.bigrams(v) for k, v in sorted(templates.items())}
    clean = re.sub(r" ?\n ?", "\n", re.sub(r"[^\w\n]+|_+", " ", text.lower())).strip(" ")

    def best(words):
        b = pairs(words)
        found = [(-dice(b, bag), k) for k, bag in bags.items() if licenses.bounds(len(bag), t)[0] <= len(b) <= licenses.bounds(len(bag), t)[1]]
        found = [x for x in found if -x[0] >= t]
        return min(found) if found else None

    units = [("line", k, x) for k, x in enumerate(clean.split("\n"), 1)]
    units += [("paragraph", k, x) for k, x in enumerate(re.split("\n\n+", clean), 1) if "\n" in x]
    units += [("text", 1, clean)] if "\n\n" in clean else []
    out = []
    for unit, no, x in units:
        hit = best(x.split())
        if hit:
            out.append((unit, no, hit[1], round(-hit[0], 9)))
    lines = clean.split("\n")
    words = [(w, k) for k, x in enumerate(lines) for w in x.split()]
    all_pairs = pairs([w for w, _ in words])
    found = []
    for k, bag in bags.items():
        lo, hi = licenses.bounds(len(bag), t)
        at = [i for i, b in enumerate(all_pairs) if b in bag]
        for a in at:
            ends = [(dice(all_pairs[a : z + 1], bag), z - a + 1) for z in at if lo <= z - a + 1 <= hi]
            if ends and max(ends)[0] >= t:
                d, n = max(ends)
                found.append((-d, -n, k, a, a + n))
    kept = []
    for x in sorted(found):
        if all(x[3] > y[4] or y[3] > x[4] for y in kept):
            kept.append(x)
    for d, _, k, a, z in kept:
        p, q = words[a][1], words[z][1]
        lo = max([i for i, x in enumerate(lines) if not x and i < p], default=-1)
        hi = min([i for i, x in enumerate(lines) if not x and i > p], default=len(lines))
        around = [[w for w, i in words if i == p]] if p == q else []
        around += [[w for w, i in words if lo < i < hi]] if q < hi else []
        around.append([w for w, _ in words])
        if not any(map(best, around)):
            out.append(("window", a + 1, k, round(-d, 9)))
    return out


def some_texts(rng, templates, n):
    """Templates whole and with words left out, put in or changed, wrapped and joined with other words."""
    other = "some words of another kind that say the and of you may work license".split()
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            words = rng.choice(list(templates.values())).split()
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = [rng.choice(other)] if rng.random() < 0.5 else []
            gap = [rng.choice(other) for _ in range(rng.choice([0, 0, 1, 5, 30]))]
            parts.append("".join(w + rng.choice([" "] * 9 + ["\n", ", "]) for w in gap + words))
        texts.append(rng.choice(["\n", " ", "\n\n", ".\n \n"]).join(parts))
    return texts


def scanned(spark, rows, templates):
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    return sorted((r["doc_id"], r["unit"], r["unit_no"], r["license"], round(r["dice"], 9)) for r in got)


def by_sql(rows, templates):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted((*r[:4], round(r[4], 9)) for r in con.execute(licenses.oracle_sql(templates=templates)).fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_is_its_definition_and_its_sql(spark, seed):
    rng = random.Random(seed)
    rows = list(enumerate(some_texts(rng, SMALL, 120)))
    rows += [(k, t) for k, t in rows[:20]] + [(500, None), (501, ""), (502, "the"), (503, "\n\n")]
    want = sorted((k, *r) for k, t in rows if t for r in by_definition(t, SMALL))
    assert {u for _, u, *_ in want} == {"line", "paragraph", "text", "window"}
    assert scanned(spark, rows, SMALL) == want
    assert by_sql(rows, SMALL) == want


def test_every_template_is_whole_against_itself_and_found_inside_a_text(spark):
    names = sorted(licenses.TEMPLATES)
    rows = [(k, licenses.TEMPLATES[n].replace("\n", " ")) for k, n in enumerate(names)]
    rows += [(1000 + k, f"{'many other words come first ' * 70} {t} {'and others follow it here ' * 70}") for k, t in rows[:]]
    got = scanned(spark, rows, licenses.TEMPLATES)
    whole = {k: d for k, u, _, _, d in got if u == "line"}
    assert whole == {k: 1.0 for k in range(len(names))}
    assert {k for k, u, _, _, d in got if u == "window" and d == 1.0} == {1000 + k for k in range(len(names))}
    assert by_sql(rows, licenses.TEMPLATES) == got
