"""Pairs of fragments in blocks, against all pairs in plain Python."""

import random

import numpy as np
import pytest

from quillstone.operators import graph as G
from quillstone.operators import joins as J
from quillstone.operators import overlaps


def fragments(spark, seed, n=150, spare=True):
    rng = random.Random(seed)
    # some words nearly everywhere, many rare ones, copies, empty and null sets
    word = lambda: f"f{rng.randint(0, 12)}" if rng.random() < 0.5 else f"w{int(rng.expovariate(0.02))}"
    some = lambda most: sorted({word() for _ in range(rng.randint(0, most))})
    rows = []
    for i in range(n):
        words = some(40)
        edge = lambda: rng.sample(words, min(len(words), rng.randint(0, 6))) + (some(1) if spare else [])
        rows.append((i, words, sorted(set(edge())), sorted(set(edge()))))
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:15])] + [(2000, None, None, None), (2001, [], ["f1"], ["f2"])]
    return rows, spark.createDataFrame(rows, "key long, keywords array<string>, head array<string>, tail array<string>").repartition(5)


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 0.0


def plain(rows):
    sets = [(k, *(set(x or []) for x in s)) for k, *s in sorted(rows)]
    for i, (a, ka, ha, ta) in enumerate(sets):
        for b, kb, hb, tb in sets[i + 1 :]:
            if (ka | ha | ta) & (kb | hb | tb):
                yield a, b, jaccard(ka, kb), jaccard(ta, hb), jaccard(tb, ha), len(ka & kb)


@pytest.mark.parametrize("tile, at_once, wide", [(1024, 1 << 23, 2048), (7, 50, 5), (16, 1, 0)])
def test_counts_by_tiles(monkeypatch, tile, at_once, wide):
    monkeypatch.setattr(overlaps, "TILE", tile)
    monkeypatch.setattr(overlaps, "AT_ONCE", at_once)
    monkeypatch.setattr(overlaps, "WIDE", wide)
    rng = np.random.default_rng(tile)
    x, y = (rng.random((n, 60)) < np.linspace(0, 0.6, 60) for n in (45, 31))
    count = overlaps._counter(np.nonzero(x), np.nonzero(y), 45, 31, 60)
    for i in range(0, 45, tile):
        for j in range(0, 31, tile):
            assert (count(i, j) == (x.astype(int) @ y.T.astype(int))[i : i + tile, j : j + tile]).all()


@pytest.mark.parametrize("seed, size", [(1, 16384), (2, 10)])
def test_pair_scores(spark, seed, size):
    rows, df = fragments(spark, seed)
    want = set(plain(rows))
    assert {tuple(r) for r in overlaps.scored(df, "key", size=size).collect()} == want and want
    got = {tuple(r) for r in overlaps.scored(df, "key", (0.3, 0.2, 2), size=size).collect()}
    assert got == {r for r in want if r[5] >= 2 and (r[2] >= 0.3 or max(r[3:5]) >= 0.2)} and got


def test_pairs_are_not_shuffled(spark):
    """A thousand rows that share a word: half a million pairs, and what moves is rows times blocks."""
    df = spark.range(1000).selectExpr("id AS key", "array('all', concat('w', id)) AS keywords", "array('all') AS head", "array('all') AS tail")
    out = J.pair_scores(df, "key")
    assert out.count() == 1000 * 999 // 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert G.fallback_judge(out).where("relation = 'same_continuous'").isEmpty()


def test_nearest_pairs(spark, rows):
    """As the best of all pairs; what moves are rows and each block's best, not the pairs that share a word."""
    data, df = fragments(spark, 4, spare=False)
    pairs = spark.createDataFrame([(a, b, round(s + 1e-12, 6)) for a, b, s, *_ in plain(data) if s], "a long, b long, score double")
    out = J.nearest_pairs(df, "key", 3)
    assert rows(out) == rows(J.neighbor_cap(pairs, 3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_halves_are_rounded_up(spark):
    """1 of 640 is 0.0015625, 0.001563 in six digits."""
    df = spark.createDataFrame([(1, ["x", *(f"a{i}" for i in range(320))]), (2, ["x", *(f"b{i}" for i in range(319))])], "key string, keywords array<string>")
    assert [tuple(r) for r in J.nearest_pairs(df, "key", 1).collect()] == [("1", "2", 0.001563)]


def test_mutual_best_takes_one_pass(spark, rows, monkeypatch):
    """Tails against heads and back from one pass over the blocks, without rounds."""
    kept = []
    monkeypatch.setattr(J, "keep", lambda df, keep=J.keep: kept.append(1) or keep(df))
    data, df = fragments(spark, 4, spare=False)
    directed = [(a, b, round(x + 1e-12, 6)) for a, b, _, x, _, _ in plain(data)] + [(b, a, round(x + 1e-12, 6)) for a, b, _, _, x, _ in plain(data)]
    assert rows(J.mutual_best_sets(df, "key", 0.05, 0.005)) == rows(J.mutual_best(spark.createDataFrame(directed, "a long, b long, score double"), 0.05, 0.005))
    assert len(kept) == 1
