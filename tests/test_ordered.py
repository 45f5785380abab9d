"""State along an order, with one key spread over many parts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import joins as J
from quillstone.operators import ordered
from quillstone.operators import windows as W


@pytest.fixture
def many_parts(spark):
    """So many range partitions that a key reaches over several."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def plain_paragraphs(rows, soft, hard):
    out = set()
    for k in {r[0] for r in rows}:
        part, size, number = [], 0, 0
        ordered_rows = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for _, o, t in [*ordered_rows, (k, None, None)]:
            t = (t or "").strip()
            if t:
                part.append((o, t))
                size += len("".join(t.split()))
                proper = t[-1] in W._TERMINAL and t.rstrip(W._TERMINAL).split(" ")[-1].lower() not in W._CONNECT
            if part and (o is None or t and (size >= soft and proper or size >= hard)):
                out.add((k, number, part[0][0], part[-1][0], " ".join(x for _, x in part)))
                part, size, number = [], 0, number + 1
    return out


@pytest.mark.parametrize("seed, soft, hard", [(1, 20, 45), (2, 5, 9), (3, 180, 360), (4, 1, 1)])
def test_paragraphs_of_a_hot_source(spark, many_parts, seed, soft, hard):
    rng = random.Random(seed)
    said = lambda: " ".join(rng.choice(["one", "two", "and", "longer words", "é"]) for _ in range(rng.randint(0, 6))) + rng.choice([".", "", "!", "?!", ". "])
    rows = [(1, i, said()) for i in range(260)] + [(k, i, said()) for k in range(2, 30) for i in range(rng.randint(0, 5))] + [(None, i, said()) for i in range(40)] + [(99, 0, None), (98, 0, "  ")]
    got = W.paragraphs(spark.createDataFrame(rows, "k long, n long, t string"), "k", "n", "t", soft, hard).collect()
    assert {tuple(r) for r in got} == plain_paragraphs(rows, soft, hard) and len(got) == len({tuple(r) for r in got})


def test_one_source_is_spread(spark, many_parts):
    rows = spark.range(4000).select(F.lit("only").alias("k"), F.col("id").alias("n"), F.lit("some words here.").alias("t"))
    out = W.paragraphs(rows, "k", "n", "t", 180, 360)
    assert out.count() == 308 and out.agg(F.sum(F.size(F.split("text", r"\.")) - 1)).first()[0] == 4000
    part = ordered.placed(rows, "k", [F.col("n")]).groupBy("__part").count().collect()
    assert len(part) == 13 and max(r["count"] for r in part) < 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_asof_with_a_hot_key(spark, many_parts, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 5 + ["a", "b", None])
    records = [(key(), rng.randint(0, 60) if rng.random() < 0.3 else rng.random() * 200, i) for i in range(150)]
    probes = [(key(), float(rng.randint(0, 220)), i) for i in range(200)] + [("none", 5.0, 900)]
    r = spark.createDataFrame([(k, float(t), i) for k, t, i in records], "k string, t double, rid long")
    got = J.asof(spark.createDataFrame(probes, "k string, t double, p long"), r, "k", "t", "t", "rid", ["p"]).collect()
    plain = {(k, p, max(((float(t), i) for k2, t, i in records if k2 == k and t <= at), default=(0, None))[1]) for k, at, p in probes}
    assert {tuple(x) for x in got} == plain and len(got) == len(probes)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, n long, t string")
    assert W.paragraphs(none, "k", "n", "t").count() == 0
    assert J.asof(none.select("k", "n", F.col("n").alias("p")), none.select("k", "n", F.col("n").alias("rid")), "k", "n", "n", "rid", ["p"]).count() == 0
