"""Near-duplicates against brute force, models against held-out labels, and the pipeline."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import neardup, quality, toxicity
from quillstone.llm.common import shingle_hashes


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def plain_components(docs, percent):
    sets = {k: shingles(t) for k, t in docs}
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {k: (len(sets[k]), top(k)) for k in keys}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += ["", None, "  \n ", "one", "ONE", "one two", "É é", "é É"]
    rng.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("block", [2048, 4])
def test_near_duplicates_equal_brute_force(spark, block):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("component", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, percent=85, block=block, block_shingles=200).collect()}
    want = plain_components(docs, 85)
    assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}


def test_near_duplicate_edges(spark):
    same = "a b c d e f g"
    df = spark.createDataFrame([(None, same), (4, same), (4, same), (2, same), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, 2, True), (2, 2, True), (4, 2, False), (4, 2, False), (9, 9, True)]
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(2)
    a, b = neardup._family(100)
    x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    y = np.concatenate([x[:1700], rng.integers(0, 2**63, 300, dtype=np.uint64)])
    mx, my = (neardup.minima(np.unique(s), a, b) for s in (x, y))
    px, py = (np.frombuffer(neardup.pack(m), dtype=np.uint64) for m in (mx, my))
    differ = int(neardup.unequal(px, py))
    assert differ == int(((mx & np.uint64(15)) != (my & np.uint64(15))).sum())
    true = 1700 / 2300
    assert abs(float(neardup.corrected(100 - differ, 100)) - true) < 0.15
    assert neardup.least_equal(0.85, 100) < 85
    p = 0.85 + 0.15 / 16
    tail = sum(math.comb(112, k) * p**k * (1 - p) ** (112 - k) for k in range(neardup.least_equal(0.85, 112)))
    assert 0 < tail <= 1e-7


def test_shingle_hashes_depend_on_order_and_count():
    w = [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert len(shingle_hashes(w)) == 2 and len(shingle_hashes([])) == 0 and len(shingle_hashes(w[:3])) == 1
    assert shingle_hashes(w[:5])[0] != shingle_hashes([b"b", b"a", b"c", b"d", b"e"])[0]
    assert shingle_hashes([b"a b"])[0] != shingle_hashes([b"a", b"b"])[0]


def slow_segments(scores):
    """All maximal segments by definition: recursively the best segment, then both sides."""
    out = []

    def go(a, b):
        best = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += scores[j]
                if s > 1e-12 and (best is None or s > best[0] + 1e-12 or abs(s - best[0]) < 1e-12 and j + 1 - i < best[2] - best[1]):
                    best = (s, i, j + 1)
        if best:
            go(a, best[1])
            out.append((best[1], best[2]))
            go(best[2], b)

    go(0, len(scores))
    return out


def test_segments_equal_the_definition():
    rng = random.Random(4)
    for _ in range(80):
        s = np.array([rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 7 for _ in range(rng.randint(0, 14))])
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == slow_segments(s)


def labelled_corpus(n=400):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(w))
            w[at:at] = ["Idiot", "moron", "clown"]
        low = i % 3 == 0
        docs.append((i, " ".join(x + "$$$" for x in w) if low else " ".join(w)))
        labels.append((i, 0 if low else 1, int(bad)))
    return docs, labels


def test_models_hold_on_unseen_documents(spark):
    docs, labels = labelled_corpus()
    df = spark.createDataFrame(docs + [(1000, None), (1001, ""), (None, "v1 v2"), (0, docs[0][1])], "doc_id long, text string").withColumn("toxic_score", F.lit("clash")).withColumn("y", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(None, 1, 1), (2000, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    train = lambda k: k % 2 == 0
    tox = toxicity.score(df, toxicity.fit(df, lab, train=train))
    assert tox.columns == ["doc_id", "text", "y", "toxic_score", "toxic_passages"] and tox.count() == len(docs) + 4
    got = {r.doc_id: r for r in tox.collect()}
    odd = [(k, t) for k, _, t in labels if k % 2 == 1]
    even = [(k, t) for k, _, t in labels if k % 2 == 0]
    assert np.mean([(got[k].toxic_score >= 0.5) == bool(t) for k, t in odd + even]) > 0.97
    assert got[1000].toxic_score < 0.5 and got[1001].toxic_score < 0.5
    texts = dict(docs)
    p = got[4].toxic_passages[0]
    assert "moron" in texts[4][p.start : p.end]
    good = {r.doc_id: r.quality_score for r in quality.score(df, quality.fit(df, lab, train=train, rounds=20)).collect()}
    assert np.mean([(good[k] >= 0.5) == bool(q) for k, q, _ in labels if k % 2 == 1]) > 0.95


def test_models_without_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (none, one):
        assert toxicity.score(df, toxicity.fit(df, lab)).count() == 2
        assert quality.score(df, quality.fit(df, lab)).count() == 2
    assert toxicity.score(df.where("false"), toxicity.fit(df.where("false"), none)).count() == 0
    assert quality.score(df.where("false"), quality.fit(df.where("false"), none)).count() == 0


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled_corpus(240)
    leak = " ".join(f"b{i}" for i in range(30))
    docs += [(900, "v1 v2 v3 " + leak), (901, docs[1][1]), (902, None), (903, "")]
    d = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, d)
        if i < 4:
            assert after.columns == now.columns, name
        after.write.parquet(f"{d}/out{i}")
        after = spark.read.parquet(f"{d}/out{i}")
        seen.append((name, ids(now) - ids(after)))
        now = after
    gone = dict(seen)
    assert 0 in gone["quality"] and 4 in gone["toxicity"] and 901 in gone["near_duplicates"] and gone["decontamination"] == {900} and not gone["sentencepiece"]
    assert ids(corpus_pipeline.run(spark, d)) == ids(now)
