"""Items that join leaders in order, by rounds, against taking them one by one."""

import random

from placeloom.operators import curation
from placeloom.plans.graph import leaders


def in_turn(nodes, score):
    led, out = [], {}
    for v in nodes:
        near = [(-score[u, v], u) for u in led if (u, v) in score]
        out[v] = min(near)[1] if near else v
        if not near:
            led.append(v)
    return out


def test_rounds_equal_the_sequential_rule(spark):
    rng = random.Random(2)
    score = {}
    for _ in range(900):
        u, v = sorted(rng.sample(range(300), 2))
        score[u, v] = rng.choice([0.5, 0.7, 0.9])
    score |= {(1000 + i, 1001 + i): 0.5 for i in range(9)}  # a chain: every other one leads
    score |= {(2000, 2000 + i): 0.5 for i in range(1, 80)}  # a hub
    nodes = sorted({x for p in score for x in p})
    rows = [(u, v, s) for (u, v), s in score.items()] + [(7, 7, 1.0)]
    got = {r.node: r.leader for r in leaders(spark.createDataFrame(rows, "u long, v long, score double").repartition(3)).collect()}
    assert got == in_turn(nodes, score)
    assert leaders(spark.createDataFrame([], "u long, v long, score double")).count() == 0


def test_sources_join_first_sources_only(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for pack in range(12):
        base = [rng.choice(words) for _ in range(24)]
        for k in range(10):
            cut = rng.randint(0, 18)
            texts.append((pack, len(texts), base[cut : cut + rng.randint(1, 12)] + [rng.choice(words) for _ in range(rng.randint(0, 6))]))
    texts += [(50, 9000, ["a", "b"]), (50, 9001, ["a", "b"]), (50, 9002, []), (51, 9003, ["a", "b"])]
    grams = {i: {" ".join(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {" ".join(w)} for _, i, w in texts}
    want = {}
    for pack in {t[0] for t in texts}:
        mine = [i for p, i, _ in texts if p == pack]
        share = {(u, v): len(grams[u] & grams[v]) / min(len(grams[u]), len(grams[v])) for u in mine for v in mine if u < v}
        want |= in_turn(mine, {k: s for k, s in share.items() if s >= 0.25})
    got = curation.independent_sources(spark.createDataFrame(texts, "pack long, source_id long, words array<string>")).collect()
    assert {r.source_id: r.cluster_id for r in got} == want and len(got) == len(texts)
