"""Operators that work in rounds: nearest sets and chains, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import graph as G
from quillstone.operators import joins as J


def plain_nearest(left, right, k, least):
    out = set()
    for a, x in left:
        x = set(x or [])
        found = []
        for b, y in right:
            y = set(y or [])
            if a != b and x & y:
                s = round(len(x & y) / len(x | y) + 1e-12, 6)
                if s >= least:
                    found.append((-s, b))
        out |= {(a, b, round(-s, 4)) for s, b in sorted(found)[:k]}
    return out


@pytest.mark.parametrize("seed, k, least", [(1, 3, 0.0), (2, 1, 0.2), (3, 4, 0.5)])
def test_nearest_sets(spark, seed, k, least):
    rng = random.Random(seed)
    # a few words nearly everywhere, many rare ones, copies, empty and null sets
    word = lambda: rng.choice(["the", "a", "of"]) if rng.random() < 0.4 else f"w{int(rng.expovariate(0.03))}"
    rows = [(i, [word() for _ in range(rng.randint(0, 25))]) for i in range(90)]
    rows += [(100 + i, list(w)) for i, (_, w) in enumerate(rows[:20])] + [(200, None)]
    df = spark.createDataFrame(rows, "key long, words array<string>")
    got = J.nearest_sets(df, df, "key", "words", "words", k, least).where("score > 0").collect()
    assert {(r["me"], r["you"], round(r["score"], 4)) for r in got} == plain_nearest(rows, rows, k, least)
    assert all(r["rank"] <= k for r in got)


def test_frequent_words_are_not_probed(spark):
    """Pairs of copies settle on their rare words; the word that all share meets nobody."""
    rows = [(i, ["all", *(f"p{i // 2}x{j}" for j in range(30))]) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, words array<string>")
    got = J.nearest_sets(df, df, "key", "words", "words", 1, first=4)
    assert {(r["me"], r["you"]) for r in got.collect()} == {(i, i ^ 1) for i in range(400)}


def test_mutual_best_of_sets_equals_all_pairs(spark, rows):
    rng = random.Random(9)
    frag = [(i, [f"h{rng.randint(0, 30)}" for _ in range(4)], [f"h{rng.randint(0, 30)}" for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(frag, "k long, head array<string>, tail array<string>")
    score = lambda x, y: round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)
    pairs = [(a, b, score(t, h)) for a, _, t in frag for b, h, _ in frag if a != b and set(t) & set(h)]
    all_ = J.mutual_best(spark.createDataFrame(pairs, "a long, b long, score double"), 0.05, 0.005)
    assert rows(J.mutual_best_sets(df, "k", 0.05, 0.005)) == rows(all_)


def plain_chains(edges):
    to = dict(edges)
    out, seen = set(), set()
    for start in [*sorted(set(to) - set(to.values())), *sorted(to)]:
        if start in seen:
            continue
        path, n = [], start
        while n is not None and n not in seen:
            seen.add(n)
            path.append(n)
            n = to.get(n)
        out |= {(min(path), n, i) for i, n in enumerate(path, 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_rings(spark, seed):
    rng = random.Random(seed)
    nodes = rng.sample(range(1000), 300)
    edges, at = [], 0
    for size in (1, 2, 3, 7, 60, 90, 120):
        part = nodes[at : at + size]
        at += size
        edges += list(zip(part, part[1:]))
        if size in (1, 2, 7, 60):
            edges.append((part[-1], part[0]))
    got = {tuple(r) for r in G.chain_walk(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_chains(edges)


def test_a_long_chain(spark):
    n = 20_000
    edges = spark.range(n).select(((F.col("id") * 7919) % n).alias("x"), "id").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(8)
    got = G.chain_walk(edges)
    assert got.where("chain = 0 AND position = node + 1").count() == n + 1 == got.count()


def test_no_edges(spark):
    assert G.chain_walk(spark.createDataFrame([], "a long, b long")).count() == 0
    empty = spark.createDataFrame([], "key long, words array<string>")
    assert J.nearest_sets(empty, empty, "key", "words", "words", 3).count() == 0
