"""Ties, types, names and sizes that operators meet at their edges."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import bpe_count, chat, components, decontam, fingerprint, neardup, piece_codec, quality, toxicity, urlgraph, warc
from quillstone.llm.common import Scratch, few, shared_root


def test_layouts_ignore_further_fields_and_take_parts(spark):
    data = [
        (1, '{"messages": [{"role": "user", "content": "q"}], "id": 7}'), (2, '{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, "b"]}, {"role": "assistant", "content": "c", "name": "n"}]}'),
        (3, '{"prompt": "p", "response": "r", "system": "s", "meta": {"source": ["x"]}}'), (4, '{"prompt": "p", "response": "r", "question": "q", "answer": "a"}'), (5, '{"conversations": [{"from": "human", "value": null}, {"from": "gpt", "value": "v"}]}'),
        (6, '{"messages": []}'), (7, '[1, {"messages": 2}]'), (8, '{"instruction": "do", "response": "done", "odd `name`": {"a<b>": [[1]]}}'),
    ]
    by = {}
    for r in chat.turns_from_json(spark.createDataFrame(data, "conv_id long, json string")).orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    assert by == {
        1: [("user", "q")], 2: [("user", "ab"), ("assistant", "c")], 3: [("system", "s"), ("user", "p"), ("assistant", "r")], 4: [(None, None)], 5: [("user", ""), ("assistant", "v")],
        6: [(None, None)], 7: [(None, None)], 8: [("user", "do"), ("assistant", "done")],
    }
    found = spark.createDataFrame([(data[7][1],)], "j string").select(chat.row_paths(F.try_parse_json("j")).alias("p")).first().p
    assert found == ["instruction", "odd `name`.a<b>[][]", "response"]
    digests = [d for x in chat.LAYOUTS for d in x.digests()]
    assert len(digests) == len(set(digests)), "no two layouts share a fingerprint"
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([], "conv_id long, turn int, role string, text string, conversation_id long, index int, content string"))


def test_the_first_of_equal_rules_decides(spark):
    rules = [("a.com", "/", "block"), ("a.com", "/", "allow"), ("com", "/x/a", "allow")]
    df = spark.createDataFrame([("a.com", "/"), ("b.com", "/x/ab"), ("b.org", "/")], "host string, path string")
    rule, verdict = urlgraph.apply_rules(F.col("host"), F.col("path"), rules)
    assert [tuple(r) for r in df.select(rule, verdict).collect()] == [("a.com/", "block"), ("com/x/a", "allow"), (None, None)]


def test_links_to_oneself_hold_no_rank(spark):
    pages = spark.createDataFrame([("a.net", '<a href="/x"><a href="http://a.net/y"><a href="http://b.net/"><a href="mailto:x@c.net">'), ("b.net", None), ("", '<a href="http://a.net/">')], "host string, html string")
    assert [tuple(r) for r in urlgraph.host_links(pages).collect()] == [("a.net", "b.net", 1)]


def test_bundles_are_plain_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", chr(65 + i % 26) * 150) for i in range(40)], "page_id long, url string, html string").repartition(3)
    path = Scratch(spark, "t").path("b")
    warc.write_bundles(pages, path, frame_bytes=500, bundle_bytes=300)
    files = warc.export_bundles(spark, path, str(tmp_path / "out")).collect()
    assert len(files) > 3 and all(os.path.getsize(r.file) > 0 and r.file.endswith(".warc.zst") for r in files)
    index = {r.bundle_id: r["index"] for r in spark.read.parquet(path).collect()}
    seen = set()
    for r in files:
        data = open(r.file, "rb").read()
        for p in index[r.bundle_id]:
            got = warc.fetch(data, p.frame, p.offset, p.length)
            seen.add(int(got["record_id"]))
            assert got["kind"] == "revisit" or got["payload"] == (chr(65 + int(p.record_id) % 26) * 150).encode()
    assert seen == set(range(40))
    plain = Scratch(spark, "t").path("p")
    warc.write_bundles(pages, plain, most_repeated=0)
    same = lambda p: sorted(map(tuple, warc.read_bundles(spark, p).collect()))
    assert same(plain) == same(path), "the shuffled way gives the same records"


def test_short_items_and_other_ids(spark):
    docs = spark.createDataFrame([("x", "so yes we can!"), ("y", "yes, can we"), (None, "YES we can go"), ("z", "can")], "doc_id string, text string")
    bench = spark.createDataFrame([("i", "Yes we can"), ("j", "can"), ("k", "!!"), ("i", "Yes we can")], "item_id string, text string")
    got = sorted(((r.doc_id or "", r.item_id, r.coverage, r.n_tiles, r.longest) for r in decontam.leaks(docs, bench).collect()))
    assert got == [("", "i", 1.0, 1, 3), ("", "j", 1.0, 1, 1), ("x", "i", 1.0, 1, 3), ("x", "j", 1.0, 1, 1), ("y", "j", 1.0, 1, 1), ("z", "j", 1.0, 1, 1)]
    blocks = decontam.leaks(docs, bench, block_words=2)
    assert sorted((r.doc_id or "", r.item_id) for r in blocks.collect()) == [x[:2] for x in got]
    kept = decontam.clean(docs, bench.where("item_id = 'i'"), most_ids=0)
    assert sorted(r.doc_id or "" for r in kept.collect()) == ["", "y", "z"], "a null id stays"


def test_ids_of_other_types(spark):
    docs = [(f"d{i:03d}", f"text number {i} " + "word " * (i % 7)) for i in range(60)] + [(None, "no id")]
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(4)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, rows_per_part=5).collect()}
    order = sorted((k for k, _ in docs if k), reverse=True) + [None]
    texts = dict(docs)
    assert got == {k: texts[order[(i + 1) % len(order)]] for i, k in enumerate(order)}
    labels = spark.createDataFrame([(f"d{i:03d}", i % 2, i % 2) for i in range(60)], "doc_id string, quality int, toxic int")
    assert quality.score(df, quality.fit(df, labels)).count() == toxicity.score(df, toxicity.fit(df, labels)).count() == 61
    assert bpe_count.count_tokens(df).schema["doc_id"].dataType.simpleString() == piece_codec.encode_decode(df).schema["doc_id"].dataType.simpleString() == "string"
    with pytest.raises(ValueError):
        neardup.near_duplicates(df)


def test_null_ids_alone_go_round(spark):
    df = spark.createDataFrame([(None, t) for t in ("c", "a", "b", "b")], "doc_id long, text string").repartition(3)
    assert sorted((r.text, r.next_text) for r in fingerprint.with_next(df).collect()) == [("a", "b"), ("b", "b"), ("b", "c"), ("c", "a")]


def test_full_case_folding(spark):
    df = spark.createDataFrame([(1, "straße"), (2, "STRASSE"), (3, "ΟΔΟΣ"), (4, "οδοσ"), (5, "οδος"), (6, "İ")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.exact_groups(df).collect()}
    assert got[1] == got[2] and got[3] == got[4] == got[5] and len(set(got.values())) == 3


def test_samples_hold_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(30)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = toxicity.labelled(docs, labels, "quality", lambda k: F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.y, r.text) for r in got) == [(1, 1, "text 0"), (2, 0, "")]


def test_words_of_text_in_any_slices():
    import re

    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice(["ab", "Z", " ", "\n", "!!", "é", "9", "世", "#", "\x00"]) for _ in range(rng.randint(0, 60)))
        raw = text.encode()
        at, found = quality.words(raw)
        marks = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x20\x7f0-9A-Za-z\x80-\xff]+", raw))
        assert at.tolist() == [m.start() for m in marks]
        for step in (1, 3, 8):
            a, b = quality.words(raw, step)
            assert a.tolist() == at.tolist() and b.tolist() == found.tolist()
        alone = [int(quality.words(m[0])[1][0]) for m in marks]
        assert alone == found.tolist(), "a word's bucket depends on the word alone"


def test_pooling_of_one_long_text_equals_its_definition():
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(quality.WORDS, quality.DIM)).astype(np.float32)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 50, n)) for n in (0, 1, 2, 5, 40_000)]
    got = quality.pooled(v, iter([*texts, None]))
    for t, x in zip(texts, got):
        w = v[quality.words(t.encode())[1]].astype(float)
        want = np.concatenate([w.mean(0), w.std(0), (w[1:] * w[:-1]).sum(0) / len(w)]) if len(w) else np.zeros(3 * quality.DIM)
        assert np.allclose(x, want, atol=2e-3), "sums of squares are of single precision"
    assert not got[-1].any()


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_of_near_copies(spark, seed):
    """Parts of four: most members hang together at once, others only by one member of another part."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    docs, chain = [], list(base)
    for i in range(90):
        t = list(base)
        t[rng.randrange(60)] = f"x{i}"
        docs.append(" ".join(t))
    for i in range(25):  # each near the one before only
        chain = chain[2:] + [f"c{i}a", f"c{i}b"]
        docs.append(" ".join(chain))
    rng.shuffle(docs)
    rows = [(i, t) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    want = {k: top(k) for k in sets}
    for block in (4, 16):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, block=block, block_shingles=300, most_ids=block).collect()}
        assert got == want


def test_components_of_stars_chains_and_nothing(spark):
    def some(edges):
        df = spark.createDataFrame(edges, "u long, v long")
        got = [sorted(map(tuple, components.components(df, Scratch(spark, "t"), most_edges=most).collect())) for most in (500_000, 0)]
        assert got[0] == got[1], "with and without broadcasts"
        return got[0]

    assert some([(5, 1), (4, 1), (None, 2), (3, 3)]) == [(1, 1), (4, 1), (5, 1)]
    assert some([(i, i + 1) for i in range(40)]) == [(i, 0) for i in range(41)]
    assert some([]) == []


def test_what_is_broadcast_is_counted_first(spark):
    df = spark.range(10)
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString() or "broadcast" in x._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(few(df, 10)) and not hinted(few(df, 9))
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
