"""The rules of op3_url_filter are those of its contract."""

from quillstone.llm import queries


def test_verdicts_of_the_contract(spark, tmp_path):
    urls = [("http://a.org/x", "allow"), ("http://a.example.org/es/1", "block"), ("https://example.org/en/1", "block"), ("x://www.Example.org/en/12?q", "block"), ("x://example.org/en/2", "allow"), ("x://shop.com/fr/", "allow"), ("x://shop.com/de/1", "block")]
    rows = [(i, u, "") for i, (u, _) in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op3_url_filter(spark, str(tmp_path)).collect()}
    rules = ["org/", "example.org/es/", "example.org/en/1", "example.org/en/1", "org/", "com/fr/", "com/de/"]
    assert [got[i] for i in range(len(urls))] == [(r, v) for r, (_, v) in zip(rules, urls)]
