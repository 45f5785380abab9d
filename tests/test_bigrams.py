"""2-grams of the compact form against a plain version."""

from pyspark.sql import functions as F

from quillstone.functions import text as X


def test_char_bigrams(spark):
    texts = ["", None, "a", "A b", "aaaa", "Ab-cd\nEF", "漢字 kanji", "é!", "x🙂y🙂z", "123 456 123"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.g for r in df.select("k", X.char_bigrams("t").alias("g")).collect()}
    for k, t in enumerate(texts):
        c = "".join(x for x in t or "" if x.isascii() and x.isalnum() or "㐀" <= x <= "鿿").lower()
        assert got[k] == ([c] if len(c) == 1 else list(dict.fromkeys(c[i : i + 2] for i in range(len(c) - 1)))), t
    plan = df.select(F.size(X.char_bigrams("t")).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert "sequence" not in plan, "no array of characters is made on the way"
