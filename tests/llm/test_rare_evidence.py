"""Evidence counts however rare it is among all tokens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import toxicity


def test_rare_words_are_kept_among_many_frequent_ones(spark):
    """66,000 words are in more documents than the one that tells."""
    common = " ".join(f"w{i}" for i in range(66_000))
    docs = [(i, common) for i in range(12)] + [(100 + i, "plain scum talk") for i in range(8)] + [(200 + i, "plain talk") for i in range(40)]
    labels = [(k, int(100 <= k < 200)) for k, _ in docs]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    assert b"scum" in model.score
    got = {r.doc_id: r.toxic_score for r in toxicity.score(df, model, spans=False).collect()}
    assert min(got[100 + i] for i in range(8)) > max(got[200 + i] for i in range(40))


def test_bounds_equal_the_formula(spark, tmp_path):
    docs = [(i, "bad Badword x" if i % 3 == 0 else "fine x words") for i in range(30)] + [(99, "unseen bad")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id long, toxic int")
    sample = toxicity.labelled(df, lab, "toxic", lambda k: F.lit(True), 100)
    got = {bytes(r.token): r for r in toxicity.evidence(sample, df, toxicity.Scratch(spark, "t"), 1000.0, 0.5, 2.33).collect()}
    bad, good = {b"bad": 10, b"badword": 10, b"badwor*": 10, b"x": 10}, {b"fine": 20, b"x": 20, b"words": 20}
    n = {b"bad": 11, b"badword": 10, b"badwor*": 10, b"x": 30, b"fine": 20, b"words": 20}
    total = sum(n.values()) + 1
    assert got.keys() == n.keys()
    for w in n:
        a = 1000.0 * n[w] / (total + 1) + 0.5
        y, g = bad.get(w, 0), good.get(w, 0)
        want = np.log((y + a) / (40 + 1000 - y - a)) - np.log((g + a) / (60 + 1000 - g - a)) - 2.33 * np.sqrt(1 / (y + a) + 1 / (g + a))
        assert got[w].bound == pytest.approx(want) and got[w].share == pytest.approx((g + a) / 1060)
