"""The stored index against searches that read the texts, and against plain counts."""

import math
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import retrieval as R
from quillstone.operators.fulltext import PART, TextIndex, packed, source_mark

WORDS = ["budget", "bud", "get", "aaaa", "aaa", "zebra", "会议记录", "Straße", "é", "o'k", "a_b", "100%"]


def tables(spark, n=120, seed=3):
    rng = random.Random(seed)
    said = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))
    units = [(f"U{i:03d}", rng.choice(["a", "a", "a", "b"]), said(3), None if i % 17 == 0 else said(30), rng.choice(["high", "medium", "low"])) for i in range(n)]
    records = [(f"R{i:03d}", rng.choice(["a", "b"]), said(9)) for i in range(n)]
    u = spark.createDataFrame(units, "unit_id string, event string, topic string, claim string, certainty string")
    return u, spark.createDataFrame(records, "record_id string, event string, clean_literal string")


def build(spark, path, units, records, **more):
    return TextIndex.build(spark, str(path), {"unit": (units, "unit_id", ["topic", "claim"]), "record": (records, "record_id", ["clean_literal"])}, **more)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    units, records = tables(spark)
    # chunks of some rows, so that words are matched over many of them
    return units, records, build(spark, tmp_path_factory.mktemp("index"), units, records, chars_at_once=400)


def test_packing_keeps_code_points():
    assert packed("ab").size == 0 and packed("").size == 0
    assert [(int(g) >> 42, int(g) >> 21 & (1 << 21) - 1, int(g) & (1 << 21) - 1) for g in packed("a\U0010ffffé漢")] == [(97, 0x10FFFF, 0xE9), (0x10FFFF, 0xE9, ord("漢"))]


@pytest.mark.parametrize("word", ["budget", "aaa", "aaaa", "get", "会议记", "straße", "zebra budget", "o'k", "qqq", "t b", "udg"])
def test_counts_of_words(made, word):
    units, _, index = made
    words = [w for w in dict.fromkeys(word.split()) if len(w) >= 3] or [word]
    got = {r["id"]: list(r["tf"]) for r in index.seats(index.match("unit", words), "unit").collect()}
    times = lambda text, w: sum(text.startswith(w, i) for i in range(len(text)))
    plain = {r["unit_id"]: [times(PART.join(((r["topic"] or "").lower(), (r["claim"] or "").lower())), w) for w in words] for r in units.collect()}
    assert got == {k: v for k, v in plain.items() if any(v)}


@pytest.mark.parametrize("token", ["budget", "aaa", "zebra budget", "会议", "bud", "qqq", "a_b", "100%", "et b", "o'k aaaa", "straße"])
@pytest.mark.parametrize("limit", [3, 500])
def test_token_search_equals_the_scan(made, token, limit):
    units, records, index = made
    scan = {(r["tier"], r["id"], r["rank"]): r["text"] for r in R.search_token(units, records, token, limit).collect()}
    found = {(r["tier"], r["id"], r["rank"]): r["text"] for r in R.search_token(None, None, token, limit, index=index).collect()}
    assert found == scan


@pytest.mark.parametrize("query", ["budget zebra", "aaa", "qqq 会议", "会议记录", "ud zebra", "nothing at_all"])
def test_search_equals_the_scan(made, query):
    units, records, index = made
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(R.search(None, None, query, limit=7, index=index)) == rows(R.search(units, records, query, limit=7))


def test_one_word_stops_early_with_the_same_result(spark, tmp_path):
    """Of forty chunks, one has rows in which the word stands often; the others are not matched."""
    rows = [(f"U{i:03d}", "a", "t", "budget " * (30 if i < 10 else 1) + "filler words " * 20) for i in range(400)]
    units = spark.createDataFrame(rows, "unit_id string, event string, topic string, claim string")
    index = build(spark, tmp_path / "i", units, spark.createDataFrame([], "record_id string, event string, clean_literal string"), chars_at_once=3000)
    top = lambda hits: index.seats(hits, "unit").orderBy(F.col("score").desc(), "id").limit(3).collect()
    few = index.best("unit", ["budget"], 3, first=1)
    assert top(few) == top(index.best("unit", ["budget"], 10**6))
    assert few.count() < 60 and index.best("unit", ["budget"], 10**6).count() == 400


def test_bounds_hold(made):
    index = made[2]
    for b in index.blocks.limit(400).collect():
        assert b["most_tf"] == max(b["tfs"]) and b["least_size"] == min(b["sizes"]) and b["n_docs"] == len(b["gaps"]) == len(b["tfs"])
        assert np.all(np.diff(np.cumsum(b["gaps"])) > 0) and sum(b["tfs"]) == len(b["places"])


def test_the_index_answers_without_the_tables(spark, tmp_path):
    units, records = tables(spark, 30)
    root = tmp_path / "whole"
    build(spark, root, units, records)
    assert TextIndex.whole(spark, str(root)) and not TextIndex.whole(spark, str(tmp_path / "none"))
    again = TextIndex(spark, str(root))
    assert R.search_token(None, None, "budget", index=again).count() > 0
    shutil.rmtree(root / "stats")
    assert not TextIndex.whole(spark, str(root))


def test_a_query_opens_its_grams_alone(spark, tmp_path):
    """Bytes that a query reads of the blocks don't grow with texts that have none of its trigrams."""
    base = [(f"U{i:05d}", "a", "t", "needle " * 3) for i in range(20)]
    more = [(f"V{i:05d}", "a", "t", " ".join(f"x{i}y{j}" for j in range(60))) for i in range(1500)]
    read = []
    for n, rows in enumerate((base, base + more)):
        units = spark.createDataFrame(rows, "unit_id string, event string, topic string, claim string")
        records = spark.createDataFrame([], "record_id string, event string, clean_literal string")
        index = build(spark, tmp_path / str(n), units, records, group_bytes=1 << 14)
        hits = index._blocks_of("unit", ["needle"])
        assert hits.count() == 4
        assert "PushedFilters" in hits._jdf.queryExecution().toString() and "In(gram" in hits._jdf.queryExecution().toString()
        read.append(index.blocks.count())
    assert read[1] > 20 * read[0]


def test_empty_tables_and_null_events(spark, tmp_path):
    units, records = tables(spark, 10)
    index = build(spark, tmp_path / "e", units.limit(0), records.limit(0))
    assert R.search_token(None, None, "budget", index=index).count() == 0
    assert R.search(None, None, "budget zebra", index=index).count() == 0
    one = spark.createDataFrame([("U1", None, None, "budget"), ("U1", None, None, "budget")], "unit_id string, event string, topic string, claim string")
    index = build(spark, tmp_path / "n", one, records.limit(0))
    assert [r["id"] for r in R.search_token(None, None, "budget", index=index).collect()] == ["U1", "U1"]


def test_mean_and_weights(made):
    """BM25 by hand for two words."""
    units, _, index = made
    words = ["budget", "zebra"]
    rows = [(r["unit_id"], (r["topic"] or "").lower(), (r["claim"] or "").lower()) for r in units.collect()]
    size = {k: sum(max(len(f) - 2, 0) for f in fs) for k, *fs in rows}
    tf = {k: [sum(f.count(w) for f in fs) for w in words] for k, *fs in rows}
    mean, n = sum(size.values()) / len(rows), len(rows)
    idf = [max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) for d in (sum(t[i] > 0 for t in tf.values()) for i in range(2))]
    plain = {k: sum(i * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[k] / mean)) for i, x in zip(idf, t)) for k, t in tf.items() if all(t)}
    got = {r["id"]: r["score"] for r in index.seats(index.best("unit", words, 10), "unit").collect()}
    assert got == pytest.approx(plain)


def test_marks_change_with_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    first = source_mark(spark, [str(tmp_path / "t")])
    assert first == source_mark(spark, [str(tmp_path / "t")])
    spark.range(4).write.mode("append").parquet(str(tmp_path / "t"))
    assert source_mark(spark, [str(tmp_path / "t")]) != first
