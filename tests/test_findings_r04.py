"""Inputs on which queries failed or did not scale, in small."""

import random
import re

import pytest
from pyspark.sql import functions as F

from placeloom.functions import text
from placeloom.operators import curation, lookup, search


def test_many_queries_are_not_broadcast_with_their_forms(spark, tmp_path):
    """Files of like rows are small, so Spark broadcast the forms of all queries, which took more memory than the driver has."""
    q = spark.range(60_000).select(F.col("id").alias("query_id"), F.concat(F.lit("tim pho "), "id").alias("query"), F.when(F.col("id") % 2 == 0, "Hue").alias("locality"))
    s = spark.createDataFrame([("pho", f"mon {i:02d} {'x' * 40}") for i in range(30)], "canon string, form string")
    for name, df in (("q", q), ("s", s)):
        df.write.parquet(f"{tmp_path}/{name}")
    out = lookup.expand_queries(spark.read.parquet(f"{tmp_path}/q"), spark.read.parquet(f"{tmp_path}/s"), 3)
    got = {(r.query_id, r.i): r.variant for r in out.filter("query_id < 2 OR query_id > 59997").collect()}
    form = "mon 00 " + "x" * 40
    want = {}
    for i in (0, 1, 59998, 59999):
        shown = [f"tim pho {i}", f"tim pho {i} hue", f"tim {form} {i} hue"] if i % 2 == 0 else [f"tim pho {i}", f"tim {form} {i}", f"tim mon 01 {'x' * 40} {i}"]
        want |= {(i, k): v for k, v in enumerate(shown)}
    assert got == want
    assert out.filter("i = 0").count() == 60_000
    out.collect()
    assert not re.findall(r"BroadcastHashJoin \[(?:query_id|n)#", out._jdf.queryExecution().executedPlan().toString())


def test_equal_queries_are_expanded_once_and_all_returned(spark):
    q = spark.createDataFrame([(1, "Phở ngon", "Hue"), (2, "pho NGON", "Hue"), (2, "pho NGON", "Hue"), (3, "", "Hue"), (4, None, None), (None, "pho ngon", None)], "query_id long, query string, locality string")
    s = spark.createDataFrame([("pho", "noodle"), ("pho", None), (None, "x")], "canon string, form string")
    got = sorted(((r.query_id or 0, r.i, r.variant) for r in lookup.expand_queries(q, s).collect()))
    full = ["pho ngon", "pho ngon hue", "noodle ngon hue", "noodle ngon"]
    want = [(i, k, v) for i in (1, 2, 2) for k, v in enumerate(full)] + [(3, 1, " hue")] + [(0, 0, "pho ngon"), (0, 1, "noodle ngon")]
    assert got == sorted(want)


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def allowed(n):
    return 0 if n < 5 else 1 if n <= 8 else 2 if n <= 14 else 3


def edited(rng, w):
    for _ in range(rng.randint(0, 4)):
        at = rng.randint(1, len(w))
        w = rng.choice([w[:at] + rng.choice("ab") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("ab") + w[at + 1 :]])
    return w


def place_scores(names, asked, top):
    def score(name, q):
        qw, pw = list(dict.fromkeys(q.split())), set(name.split())
        typo = sum(w not in pw and any(w[0] == x[0] and brute_edits(w, x) <= allowed(len(w)) for x in pw) for w in qw)
        return 8.0 * (name == q) + 4.0 * (f" {q} " in f" {name} ") + 3 * sum(w in pw for w in qw) / len(qw) + 2 * typo / len(qw)

    want = {}
    for i, q in enumerate(asked):
        ranked = sorted((-round(s, 9), k) for k, n in enumerate(names) if (s := score(n, q)) > 0)[:top]
        want |= {(i, k): (-s, r) for r, (s, k) in enumerate(ranked, 1)}
    return want


def found_places(spark, names, asked, top, common):
    table = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, name string")
    got = curation.place_text_search(table(names, "place_id"), table(asked, "query_id"), top, common).collect()
    return {(r.query_id, r.place_id): (round(r.score, 9), r["rank"]) for r in got}


@pytest.mark.parametrize("top", [1, 3])
def test_nearest_terms_equal_brute_force(spark, top):
    """Words of all allowances, of two letters only, so that many are near in more than one way."""
    rng = random.Random(4)
    stem = ["x" + "".join(rng.choice("ab") for _ in range(n - 1)) for n in (1, 3, 5, 6, 8, 9, 10, 13, 14, 15, 16, 20)]
    terms = sorted({edited(rng, rng.choice(stem)) for _ in range(250)} | {"y" + w[1:] for w in stem})
    words = sorted({edited(rng, rng.choice(stem)) for _ in range(120)})
    rows = [(t, None if (i + j) % 3 == 2 else (i + j) % 3, 1000 * rng.randrange(1000) + i) for i, t in enumerate(terms) for j in range(2)]
    got = {}
    for r in search.nearest(spark.createDataFrame(rows, "term string, kind long, first long"), spark.createDataFrame([(w,) for w in words], "word string"), text.edit_allowance, top).collect():
        got.setdefault((r.word, r.kind), []).append(r["first"])
    want = {}
    for w in words:
        for t, kind, first in rows:
            if allowed(len(w)) and w[0] == t[0] and brute_edits(w, t) <= allowed(len(w)):
                want.setdefault((w, kind), set()).add(first)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:top] for k, v in want.items()} and len(want) > 200


@pytest.mark.parametrize("common", [2, 20, 1000])
def test_names_with_several_typos_equal_brute_force(spark, common):
    """Two words of a query may be near to two words of a name, or to the same one."""
    rng = random.Random(9)
    stem = ["restaurant", "abbabaabb", "abbabaab", "xabab", "pho", "ha", "abbaabbaabbaabba"]
    word = lambda: edited(rng, rng.choice(stem))
    names = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(150)] + ["restaurant abbabaabb"] * 3
    asked = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["restaurant abbabaabb", "rastaurant rectaurant", "rastaurant abbabaabbb"]
    assert found_places(spark, names, asked, 3, common) == place_scores(names, asked, 3)


def test_near_numbers_are_not_listed_as_pairs(spark, monkeypatch):
    """Numbers of nine digits are near to hundreds of others each; a query needs the few smallest places of these."""
    listed = []

    def fuzzy(*args, **kw):
        found = plain(*args, **kw)
        listed.append(found.count())
        return found

    plain = search.fuzzy
    for module in (search, curation):
        monkeypatch.setattr(module, "fuzzy", fuzzy)
    names = [f"customer {i:09d} {'abc'[i % 3] * 6}" for i in range(0, 900, 3)]
    asked = [f"customar {i:09d}" for i in range(0, 900, 20)] + [f"customer {i:09d} bbbbbb" for i in range(0, 900, 90)]
    assert found_places(spark, names, asked, 5, 50) == place_scores(names, asked, 5)
    assert sum(listed) < 100
