"""Operators whose result is fixed by a library, a round trip or a plain version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import bpe_count, chat, decontam, fingerprint, piece_codec, urlgraph, warc
from quillstone.llm.common import Scratch

ODD = ["", " ", "  ", "a", "\n", "The  cat\n\nsat ", "<|endoftext|> x <|endoftext|>", "é世界 ½² x", "aaaaaaaaaa", "▁x▁ y", "\x00\x1c\x85", "word " * 3000, "x" * 5000, "🙂 ok"]


def texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "ab", "the", "'s", "é", "世", "12", "..", "<|endoftext|>", "▁", "🙂", "Zz"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(200)]


def test_token_counts_equal_the_library(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    all_ = texts()
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(all_)] + [(None, None, "z"), (0, all_[0], "z")], "doc_id long, text string, n_tokens string")
    got = bpe_count.count_tokens(df)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got.where("doc_id IS NOT NULL").collect():
        assert r.n_tokens == len(tok.encode(all_[r.doc_id], add_special_tokens=False).ids), all_[r.doc_id]
        assert r.n_bytes == len(all_[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 512)
    assert got.where("doc_id IS NULL").first().n_tokens == 0
    assert got.where("doc_id = 0").count() == 2
    assert bpe_count.count_tokens(df.where("false")).count() == 0


def test_merging_is_batch_independent():
    m = bpe_count.RankMerger(bpe_count.default_path())
    words = [w.encode() for w in ("aaaa", "abababab", "the", "hello", "x" * 99)]
    assert m.merge(words).tolist() == [int(m.merge([w])[0]) for w in words]


def test_pieces_equal_the_library_and_round_trip(spark):
    pytest.importorskip("public_tokenizers")
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_path())
    all_ = texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(all_)] + [(None, None, 1)], "doc_id long, text string, ids int")
    got = piece_codec.encode_decode(df)
    for r in got.where("doc_id IS NOT NULL").collect():
        ids = lib.encode(all_[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids), repr(all_[r.doc_id])
    empty = got.where("doc_id IS NULL").first()
    assert (empty.n_tokens, empty.decoded) == (0, "")
    d = piece_codec.encode_decode(df, digests=True).where("doc_id = 5").first()
    assert d.ids == hashlib.sha256(",".join(map(str, lib.encode(all_[5]))).encode()).hexdigest()


def test_the_heap_and_the_list_agendas_agree():
    c = piece_codec.Codec(piece_codec.default_path())
    for s in (" internationalisation", " aaaaaaa", " thethethethe"):
        parts = c._long(s)
        assert [c.ids[p] for p in parts] == c.agenda(s)


def page_rows():
    big = "x" * 200
    return [(5, "http://a/", big), (3, "http://b/", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (7, "u é", None), (8, "u", ""), (10, "u", "é" * 60), (11, "u", "é" * 60), (3, "http://b/", big), (None, "u", "y" * 300)]


def test_warc_round_trip_and_revisits(spark, rows):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    path = Scratch(spark, "t").path("b")
    warc.write_bundles(df.drop("digest"), path, frame_bytes=400, bundle_bytes=2000)
    got = warc.read_bundles(spark, path, payloads=True)
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r)
    assert len(by[3]) == 2 and all(r.record_type == "response" for r in by[3])
    assert [by[k][0].refers_to for k in (5, 9, 11)] == [3, 3, 10] and by[5][0].record_type == "revisit"
    assert all(by[k][0].record_type == "response" for k in (1, 2, 7, 8, 10, None))
    for k, _, html in page_rows():
        body = (html or "").encode()
        assert by[k][0].payload_bytes == len(body) and by[k][0].payload_digest == hashlib.sha256(body).hexdigest()
        if by[k][0].record_type == "response":
            assert bytes(by[k][0].payload) == body
    bundle = spark.read.parquet(path).first()
    for p in bundle["index"]:
        assert warc.fetch(bytes(bundle.archive), p.frame, p.offset, p.length)["record_id"] == p.record_id
    ask = spark.createDataFrame([(10,), (1,)], "page_id long")
    assert {r.page_id: bytes(r.payload) for r in warc.fetch_records(spark, path, ask).collect()} == {10: ("é" * 60).encode(), 1: b"small"}
    empty = Scratch(spark, "t").path("e")
    warc.write_bundles(df.drop("digest").where("false"), empty)
    assert warc.read_bundles(spark, empty).count() == 0


def test_frames_decompress_alone():
    import zstandard

    w = warc.BundleWriter(100, 3)
    for i in range(10):
        w.add(str(i), bytes([65 + i]) * 60)
    archive, index = w.finish()
    assert len(warc.seek_table(archive)) == 10
    assert zstandard.ZstdDecompressor().decompressobj().decompress(archive)[:60] == b"A" * 60
    assert warc.read_frame(archive, warc.seek_table(archive)[7]) == b"H" * 60


def test_chat_reads_back_what_was_said(spark):
    turns = [(1, 1, "assistant", "b<|im_end|>\n<|im_start|>user\nx"), (1, 0, "user", "a\\p \\b <|"), (2, 0, "us<|er\nx\\n", None), (2, 1, "assistant", ""), (3, 0, None, "only"), (None, 0, "user", "n"), (1, 1, "assistant", "b<|im_end|>\n<|im_start|>user\nx")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(df.withColumn("extra", F.lit(1))))).collect()}
    for k in (1, 2, 3, None):
        said = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == k), key=lambda z: z)
        assert [(t.role, t.text) for t in got[k].turns] == [(r, x) for _, r, x in said]
        assert list(got[k].loss_texts) == [x for _, r, x in said if r == "assistant"]
    assert chat.format_turns(df.where("false")).count() == 0


def test_layouts_are_known_by_their_paths(spark, rows):
    data = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}'), (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
        (3, '{"output": "a", "instruction": "do", "input": "with"}'), (4, '{"prompt": "q", "response": "a"}'), (5, '{"strange": 1}'), (6, None), (7, "broken"),
    ]
    got = chat.turns_from_json(spark.createDataFrame(data, "conv_id long, json string"))
    by = {}
    for r in got.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert sorted(by[1]) == sorted(by[2]) == [(0, "user", "q"), (1, "assistant", "a")]
    assert sorted(by[3]) == [(0, "user", "do\n\nwith"), (1, "assistant", "a")] and sorted(by[4])[1][2] == "a"
    assert by[5] == by[6] == by[7] == [(None, None, None)]


def test_url_parts_rules_and_trust(spark):
    pages = [
        (1, "http://WWW.Example.ORG/es/x?q", None), (2, "https://example.org/en/12#f", ""), (3, "x://a.com/fr/", '<a href="http://Friend.net/y">'), (4, "http://b.com/de/", '<a href="//c.net/">'), (5, "nourl", None), (6, None, None),
        (7, "http://friend.net/p", ""), (8, "http://spam.net/?x", '<a href="http://b.com/z">'), (9, "http://example.org", ""), (10, "http://lonely.net/", '<a href="/x">'), (10, "http://lonely.net/", '<a href="/x">'),
    ]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "allow"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("trust", F.lit("clash"))
    got = {r.page_id: r for r in urlgraph.judge(df, rules, rounds=6).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2].rule, got[2].verdict, got[2].path) == ("example.org/en/1", "allow", "/en/12")
    assert got[3].rule == "com/fr/" and got[4].rule == "com/de/" and got[5].host == got[6].host == "" and got[5].verdict == "allow"
    assert got[9].rule is None and got[9].path == ""
    assert got[7].verdict == "allow" and got[7].trust > 0, "a trusted host links there"
    assert got[8].verdict == "block" and got[8].distrust > 0, "it links to a blocked host"
    assert urlgraph.judge(df, rules, rounds=3).count() == len(pages)
    assert urlgraph.judge(df.where("false"), rules, rounds=2).count() == 0


def test_propagation_equals_dense_iteration(spark):
    import numpy as np

    edges = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 1), ("d", "c", 2)]
    names = sorted({x for e in edges for x in e[:2]})
    m = np.zeros((4, 4))
    for s, t, n in edges:
        m[names.index(t), names.index(s)] = n
    m /= np.maximum(m.sum(axis=0), 1)
    seed = np.array([0.5, 0, 0, 0.5])
    r = seed.copy()
    for _ in range(5):
        moved = m @ r
        r = 0.85 * moved + seed * (1 - 0.85 * moved.sum())
    got = urlgraph.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("a", 2.0), ("d", 2.0)], "host string, weight double"), Scratch(spark, "t"), rounds=5)
    by = {x.host: x["rank"] for x in got.collect()}
    assert all(abs(by.get(n, 0) - v) < 1e-9 for n, v in zip(names, r))


def plain_canon(t):
    import re
    import unicodedata

    n = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", n(n(t or "").lower())).strip()


def test_fingerprints_follow_canonical_text(spark):
    docs = [(1, "ﬁne  Ｔext"), (2, "fine text "), (3, "e\u0301 x"), (4, "É\tx"), (5, None), (6, ""), (7, " \n"), (8, "other"), (8, "other"), (None, "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit(1)).drop("bucket")
    got = fingerprint.exact_groups(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert len(got) == len(docs)
    for a in by:
        for b in by:
            same = plain_canon(dict(docs)[a]) == plain_canon(dict(docs)[b])
            assert same == (by[a].fingerprint == by[b].fingerprint)
    assert by[2].copy_of == 1 and by[7].copy_of == 5 and by[None].copy_of == 8 and by[8].n_copies == 3
    assert fingerprint.exact_groups(df.where("false")).count() == 0


def test_colliding_hashes_are_told_apart(spark):
    rows = spark.createDataFrame([(1, "same", "one"), (2, "same", "two"), (3, "same", "one")], "doc_id long, bucket string, canon string")
    found = fingerprint.classes(rows)
    got = {r.doc_id: r for r in fingerprint.join_classes(rows.withColumn("strong", F.sha2("canon", 256)).drop("canon"), found).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint and got[2].copy_of == 2


@pytest.mark.parametrize("n", [0, 1, 2, 50, 400])
def test_next_document_goes_round(spark, n):
    rng = random.Random(n)
    ids = sorted(rng.sample(range(10_000), n), reverse=True)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, rows_per_part=20).collect()}
    assert got == {i: f"t{ids[(k + 1) % n]}" for k, i in enumerate(ids)}


def slow_tiles(item, doc, least):
    used_i, used_d, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                k = 0
                while a + k < len(item) and b + k < len(doc) and item[a + k] == doc[b + k] and a + k not in used_i and b + k not in used_d:
                    k += 1
                if k > best[0]:
                    best = (k, a, b)
        if best[0] < least:
            return out
        k, a, b = best
        used_i |= set(range(a, a + k))
        used_d |= set(range(b, b + k))
        out += k


def test_tiling_equals_a_plain_search():
    import numpy as np

    rng = random.Random(5)
    for _ in range(60):
        item = np.array([rng.randint(1, 4) for _ in range(rng.randint(0, 18))], dtype=np.int64)
        doc = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 30))], dtype=np.int64)
        tiles = decontam.tile(item, doc, 3)
        for a, b, k in tiles:
            assert (item[a : a + k] == doc[b : b + k]).all()
        assert sum(k for *_, k in tiles) == slow_tiles(item.tolist(), doc.tolist(), 3)


def test_leaks_are_found_in_any_order(spark, rows):
    words = [f"w{i}" for i in range(40)]
    first, second = " ".join(words[:20]), " ".join(words[20:])
    docs = [(1, f"before. {first} {second} after"), (2, f"{second.upper()}!\n some text between, {first}"), (3, " ".join(words[:8]) + " nothing else"), (4, None), (5, ""), (None, f"{first} {second}"), (1, f"before. {first} {second} after")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(7, f"{first} {second}"), (8, "two words"), (9, None), (10, "")], "item_id long, text string")
    got = rows(decontam.leaks(df, bench), "doc_id", "item_id")
    assert got == [(1, 7), (1, 7), (2, 7), (None, 7)]
    assert rows(decontam.leaks(df, bench, block_words=10), "doc_id", "item_id") == got
    kept = decontam.clean(df, bench)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 4, 5] and kept.columns == df.columns
    assert decontam.leaks(df, bench.where("false")).count() == 0 and decontam.leaks(df.where("false"), bench).count() == 0
