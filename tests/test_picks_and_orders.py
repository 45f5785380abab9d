"""Picks and orders of a great many small groups, against plain versions."""

import random
from collections import defaultdict

from quillstone.operators import graph as G
from quillstone.operators import windows as W


def test_spaced_topk_takes_one_sort(spark, rows):
    """As the plain greedy pick, with null and NaN values, and by windows: a source costs no Python call."""
    rng = random.Random(5)
    data = [(i % 40, i, float(rng.sample(range(1, 2000), 1)[0]) + i / 1000, rng.choice([0, 3, 7, None])) for i in range(1500)]
    data += [(50, 5000, None, 9), (50, 5001, 1.0, 3), (51, 5002, float("nan"), 3), (51, 5003, 4.0, 3), (52, 5004, None, None), (None, 5005, 1.0, 1), (None, 5006, 700.0, 0)]
    want = set()
    for key in {r[0] for r in data}:
        kept = []
        for r in sorted((r for r in data if r[0] == key), key=lambda r: (r[3] is None, -(r[3] or 0), r[2] is None, r[2] != r[2], r[2] or 0)):
            if len(kept) < 3 and all(r[2] is not None and k[2] is not None and abs(r[2] - k[2]) >= 180 for k in kept):
                kept.append(r)
        want |= {(key, r[1]) for r in kept}
    df = spark.createDataFrame(data, "k long, i long, t double, r int").repartition(7)
    out = W.spaced_topk(df, "k", "t", "r", 3, 180.0)
    assert {(r.k, r.i) for r in out.collect()} == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_orders_of_many_components(spark):
    """As plain Kahn with the smallest key first; all components of a partition share one Python call."""
    rng = random.Random(6)
    size = lambda c: 1 + c % 7
    nodes = [(c, c * 10 + i, rng.randint(0, 4)) for c in range(3000) for i in range(size(c))]
    edges = [(c, c * 10 + rng.randrange(size(c)), c * 10 + rng.randrange(size(c)), rng.random() < 0.5) for c in range(3000) for _ in range(c % 5)] + [(0, 0, 99999, False)]

    def kahn(keys, arcs):
        out = []
        while free := [(keys[n], n) for n in keys if n not in out and not any(b == n and a not in out for a, b in arcs)]:
            out.append(min(free)[1])
        return out if len(out) == len(keys) else None

    keys, arcs, want = defaultdict(dict), defaultdict(set), set()
    for c, n, k in nodes:
        keys[c][n] = k
    for c, a, b, w in edges:
        if a != b and a in keys[c] and b in keys[c]:
            arcs[c].add((a, b, w))
    for c, ks in keys.items():
        order, state = kahn(ks, {(a, b) for a, b, _ in arcs[c]}), "ok"
        if order is None:
            order, state = kahn(ks, {(a, b) for a, b, w in arcs[c] if not w}), "weak_dropped"
        if order is None:
            order, state = sorted(ks, key=lambda n: (ks[n], n)), "cycle"
        want |= {(c, n, i, state) for i, n in enumerate(order, 1)}
    out = G.topological_order(spark.createDataFrame(nodes, "c long, node long, key int").repartition(5), spark.createDataFrame(edges, "c long, a long, b long, weak boolean").repartition(3), "c", "key")
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan
