"""Fuzzy assignment, typos in names, long canons and components against sequential or brute-force versions."""

import random

import pytest

from placeloom.operators import curation, lookup
from placeloom.plans.graph import components


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def allowed(n):
    return 0 if n < 5 else 1 if n <= 8 else 2 if n <= 14 else 3


def in_turn(words, terms, most_words, exact, most):
    """The rule item by item: runs by letters, each takes the nearest term whose target is free."""
    runs = []
    for n in range(most_words, 0, -1):
        runs += [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    out, used = [], set()
    for run in sorted([r for r in runs if len(r) >= 5], key=lambda r: -len(r)):
        if run in used or most is not None and len(out) >= most:
            continue
        near = [(d, target, term) for term, target in terms if len(term) >= 5 and target not in {o[2] for o in out} and (d := edits(run, term)) <= allowed(max(len(run), len(term))) and (exact or d)]
        if near:
            d, target, term = min(near)
            out.append((run, term, target, d))
            used |= {r for r in runs if r in run}
    return set(out)


@pytest.mark.parametrize(("exact", "most"), [(True, None), (False, 2)])
def test_fuzzy_mentions_equal_the_sequential_rule(spark, exact, most):
    rng = random.Random(5)
    names = ["yen dung", "ba ria vung tau", "bac giang", "bac ninh", "giang", "vung tau", "hai phong", "yen dung bac giang", "hue", "ho chi minh", "chi minh city"]
    terms = [(n, k // 2) for k, n in enumerate(names)] + [("yendung", 77)]

    def spoilt(w):
        w = list(w)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["x"], [w[k], w[k]]])
        return "".join(w)

    queries = [(i, [x for n in rng.sample(names, 3) for x in spoilt(n).split()] + ["quan"]) for i in range(60)] + [(900, []), (901, None), (902, ["ba", "ria", "vung", "tao"]), (903, ["yen", "dung", "yen", "dung"])]
    q = spark.createDataFrame(queries, "query_id long, words array<string>").repartition(3)
    got = {}
    for r in lookup.fuzzy_mentions(q, spark.createDataFrame(terms, "term string, target long"), exact=exact, most=most).collect():
        got.setdefault(r.query_id, set()).add((r.gram, r.term, r.target, r.edits))
    want = {i: w for i, words in queries if (w := in_turn(words or [], terms, 4, exact, most))}
    assert got == want and ("ba ria vung tao", "ba ria vung tau", 0, 1) in got[902]


def test_long_canons_are_expanded(spark):
    q = spark.createDataFrame([(1, "tim mon bun bo hue gia truyen ngon", None)], "query_id long, query string, locality string")
    s = spark.createDataFrame([("bun bo hue gia truyen", "bbh")], "canon string, form string")
    assert {r.variant for r in lookup.expand_queries(q, s).collect()} == {"tim mon bun bo hue gia truyen ngon", "tim mon bbh ngon"}


def test_place_text_search_equals_brute_force(spark):
    names = ["restaurant pho", "pho thin", "pho", "thin pho", "rsstaurant", "cafe giang", "cafe", None, "", "pho pho thin", "restaurants"]
    asked = ["rsstaurant", "pho thin", "restaurant", "cafe giangg", "reztaurant pho", "xestaurant", None, "", "pho pho"]

    def score(name, q):
        qw, pw = list(dict.fromkeys(q.split())), set(name.split())
        typo = sum(w not in pw and any(w[0] == x[0] and edits(w, x) <= allowed(len(w)) for x in pw) for w in qw)
        return 8.0 * (name == q) + 4.0 * (f" {q} " in f" {name} ") + 3 * sum(w in pw for w in qw) / len(qw) + 2 * typo / len(qw)

    want = {(i, k): round(s, 9) for i, q in enumerate(asked) if q for k, n in enumerate(names) if n and (s := score(n, q)) > 0}
    p = spark.createDataFrame(list(enumerate(names)), "place_id long, name string")
    got = curation.place_text_search(p, spark.createDataFrame(list(enumerate(asked)), "query_id long, name string"), 100).collect()
    assert {(r.query_id, r.place_id): round(r.score, 9) for r in got} == want and want[0, 0] == 2.0
    best = curation.place_text_search(p, spark.createDataFrame(list(enumerate(asked)), "query_id long, name string"), 2).collect()
    assert all(r["rank"] <= 2 for r in best) and len(best) < len(got)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_any_ids(spark, kind):
    rng = random.Random(1)
    name = (lambda x: x) if kind == "long" else (lambda x: f"n{x:05d}")
    links = [(i, i + 1) for i in range(120)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(5, 5), (7, 6)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    rows = [(name(u), name(v)) for u, v in links] + [(None, name(1)), (name(1), None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, f"u {kind}, v {kind}").repartition(3)).collect()}
    assert got == {name(x): name(find(x)) for x in root}
    assert components(spark.createDataFrame([], f"u {kind}, v {kind}")).count() == 0
