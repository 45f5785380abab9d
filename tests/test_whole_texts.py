"""Queries read whole texts: what lies beyond a text's beginning counts."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import retrieval as R
from quillstone.plans import catalog
from quillstone.plans.domain import Tables

LONG = "plain words go on here. " * 40


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(1, LONG + "thatnd"), (2, LONG), (3, LONG + "thatnd")]
    spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_claims_are_whole_texts(spark, folder):
    assert all(r.claim == r.text for r in Tables(spark, folder).units().join(Tables(spark, folder).raw("documents"), F.col("ordinal") == F.col("doc_id")).collect())
    assert {r.key for r in catalog.QUERIES["search_bm25"](spark, folder).where("query = 'thatnd'").collect()} == {"U000001", "U000003"}
    assert [(r.tier, r.id) for r in catalog.QUERIES["search_token"](spark, folder).orderBy("id").collect()] == [(1, "U000001"), (1, "U000003")]
    assert {(r.kind, r.id) for r in catalog.QUERIES["search_meetings"](spark, folder).collect()} == {("unit", "U000001"), ("unit", "U000003")}


def test_postings_of_asked_grams_score_alike(spark, rows):
    docs = spark.createDataFrame([("a", "abcabc"), ("b", "ABCx"), ("c", "zzzz"), ("d", "y"), ("e", None), ("f", r"a\\Eb.c"), ("zz", "zzzzzz")], "k string, t string")
    asked = spark.createDataFrame([("ABC",), ("bcx",), ("zzz",), (r"\\Eb",), ("b.c",)], "query string")
    some = R.bm25(R.trigram_postings(docs, "k", "t", asked), asked, sizes=R.trigram_sizes(docs, "k", "t"))
    assert rows(some, "query", "key", "score") == rows(R.bm25(R.trigram_postings(docs, "k", "t"), asked), "query", "key", "score")


def test_repairs_lose_details_anywhere(spark, tmp_path):
    text = "." * 410 + "zebra" + "." * 395
    spark.createDataFrame([(0, text), (1, text), (2, text), (5, "zebra" + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.keeps for r in catalog.QUERIES["repair_guard"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: False, 2: False, 5: True}, "only what stands nowhere else is lost"


def test_short_and_mixed_tokens_get_corrections(spark, tmp_path, rows):
    spark.createDataFrame([(1, "cta v2x 123 kubernetis the 会仪")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "cat cut 124 v2y thx 会议"), (8, "kubernetes cuta 我们")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(catalog.QUERIES["ocr_fuzzy"](spark, str(tmp_path)), "original", "suggested", "page")
    assert got == [("cta", "cuta", 8), ("kubernetis", "kubernetes", 8), ("the", "thx", 7), ("v2x", "v2y", 7), ("会仪", "会议", 7)]


def test_routes_are_whole_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    spark.createDataFrame([(1, " ".join(words)), (2, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.item_id, r.engine + r.route): r.text for r in catalog._candidates(Tables(spark, str(tmp_path))).collect()}
    assert len(got) == 18 and got[1, "cnorm"] == " ".join(words[:8] + words[9:]) and got[2, "cnorm"] == "one two" and got[2, "afirst"] == "two"
    for name in ("route_select", "route_medoid", "support_metrics"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 2
    best = catalog.QUERIES["route_medoid"](spark, str(tmp_path)).where("item_id = 1").first()
    assert best.min_similarity > 0.9, "versions of a long text differ in a word"
