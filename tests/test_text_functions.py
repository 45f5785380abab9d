"""Text functions on literal strings, Chinese among them."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X


@pytest.fixture(scope="module")
def one(spark):
    def get(expr, **values):
        df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["z"])
        return df.select(expr.alias("r")).first()["r"]

    return get


@pytest.mark.parametrize(("text", "want"), [("ab c", ["ab", "bc"]), ("a", ["a"]), ("", []), ("!!", []), ("会议 Ab", ["会议", "议a", "ab"]), ("aaaa", ["aa"])])
def test_char_bigrams(one, text, want):
    assert one(X.char_bigrams("t"), t=text) == want


def test_words_bridge_latin_gaps_but_shingles_do_not(one):
    assert one(X.words("t"), t="会A议 It's") == ["会议", "a", "it's"]
    assert one(X.cjk_shingles("t"), t="会A议记录 x") == ["议记", "记录"]
    assert one(X.cjk_shingles("t"), t="abc 会") == []


def test_keywords_drop_stop_words_and_letters(one):
    assert one(X.keywords("t"), t="The cat a x sat") == ["cat", "sat"]


def test_jaccard_and_containment_guard_empty_sets(one):
    empty = F.array().cast("array<string>")
    two = F.array(F.lit("a"), F.lit("b"))
    assert one(X.jaccard(empty, empty)) == 0.0 and one(X.containment(empty, two)) == 0.0
    assert one(X.jaccard(two, F.array(F.lit("b")))) == 0.5 and one(X.containment(two, F.array(F.lit("b")))) == 1.0


def test_edit_distance_counts_characters(one):
    assert one(X.edit_similarity(F.lit("é"), F.lit("e"))) == 0.0
    assert one(X.within_one_edit(F.lit("abc"), F.lit("abd"))) and not one(X.within_one_edit(F.lit("abc"), F.lit("xyz")))


def test_sequence_ratio_is_not_an_edit_distance(spark):
    df = spark.createDataFrame([("ab cd", "abcd"), ("abcd", "bcde"), ("", None)], "a string, b string")
    assert [round(r[0], 3) for r in df.select(X.sequence_ratio("a", "b")).collect()] == [1.0, 0.75, 1.0]


@pytest.mark.parametrize(("text", "want"), [("00:01:02,500", 62.5), ("01:02", 62.0), ("7", 7.0), ("x", None), (None, None)])
def test_timestamps(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.parse_timestamp("t")).first()[0] == want


def test_clocks(spark):
    df = spark.createDataFrame([(3723.6,), (None,)], "s double")
    assert [r[0] for r in df.select(X.clock("s")).collect()] == ["01:02:04", "?"]
    assert [r[0] for r in df.select(X.minutes("s")).collect()] == ["62:03", "?"]


def test_nfkc_compaction(spark):
    assert spark.createDataFrame([("Ｔe-st １",), (None,)], "t string").select(X.compact_nfkc("t")).collect()[0][0] == "Test1"


def test_json_objects_in_chatty_text(spark):
    said = ['<think>[1]</think> ok:\n```json\n[{"a": 1}, 3]\n```', "no json", '{"b": 2} trailing', None]
    got = [list(r[0]) for r in spark.createDataFrame([(s,) for s in said], "t string").select(X.json_objects("t")).collect()]
    assert got == [['{"a": 1}'], [], ['{"b": 2}'], []]


def test_nested_text_at_any_depth(spark):
    j = '{"a": [{"text": "x", "b": {"text": "y"}}], "text": "z"}'
    assert spark.createDataFrame([(j,), ("broken",)], "t string").select(X.nested_text("t")).collect()[0][0] == "x\ny\nz"


def test_terms_windows_details_filler(one):
    assert one(X.ocr_terms("t"), t="会议 the GPU4 12345 一二三四五六七") == ["会议", "GPU4"]
    assert one(X.cjk_windows("t", 2), t="会议记 a") == ["会议", "议记"]
    assert one(X.key_details("t"), t="Pay 3.5 to Bob 12 ok") == ["12", "3.5", "bob", "pay"]
    got = one(X.strip_filler("t", ["um", "嗯"]), t="um, well")
    assert got["text"] == "well" and got["edits"][0]["removed_text"] == "um, "
    assert one(X.latin_ratio("t"), t="ab会议") == 0.5 and one(X.latin_ratio("t"), t="") == 0.0


def test_hamming_uses_all_bits(one):
    assert one(X.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64


def test_compact_nfkc(spark):
    import unicodedata

    texts = ["", None, "ﬁne Ｗｉｄｅ①²", "a-b c_d", "é́x", "漢字、かな。ｶﾞ", "Ⅷ ½", "\U0001d400\U0001f600z", "١٢٣"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.compact_nfkc("t").alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t) if c.isalnum()) for i, t in enumerate(texts)}
