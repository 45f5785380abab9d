"""Packing against the tokenizer's own ids, and plans against what any plan must hold."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import packing, queries


def held(plan, counts, size):
    """Sequences of a plan as lists of (offset, length), each piece placed once."""
    length = np.repeat(np.arange(size + 1), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    at, offset = plan.place(length, rank)
    out = {}
    for s, o, n in zip(at.tolist(), offset.tolist(), length.tolist()):
        out.setdefault(s, []).append((o, n))
    return out


def gapless(rows, size):
    end = 0
    for o, n in sorted(rows):
        assert o == end
        end += n
    assert end <= size
    return end


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.data())
def test_any_plan_places_each_piece_once_without_gaps(size, data):
    counts = np.array([0, *data.draw(st.lists(st.integers(0, 30), min_size=size, max_size=size))])
    plan = packing.make_plan(counts, size)
    found = held(plan, counts, size)
    assert sorted(found) == list(range(plan.sequences))
    full = [gapless(rows, size) for rows in found.values()]
    tokens = int((counts * np.arange(size + 1)).sum())
    assert sum(full) == tokens and plan.sequences >= -(-tokens // size)
    # best fit never leaves two sequences at most half full
    assert sum(2 * n <= size for n in full) <= 1


def test_complements_of_one_two_and_three_fill_exactly():
    size = 100
    counts = np.zeros(size + 1, dtype=np.int64)
    for n, c in ((100, 2), (70, 5), (30, 5), (90, 3), (4, 3), (6, 3), (80, 2), (11, 2), (7, 2), (2, 2)):
        counts[n] += c
    plan = packing.make_plan(counts, size)
    assert plan.sequences == 2 + 5 + 3 + 2
    assert all(gapless(r, size) == size for r in held(plan, counts, size).values())


def test_a_length_complements_itself_only_if_there_twice():
    counts = np.zeros(11, dtype=np.int64)
    counts[5] = 3
    assert packing.make_plan(counts, 10).sequences == 2
    counts[5] = 1
    assert packing.make_plan(counts, 10).sequences == 1
    assert packing.make_plan(np.zeros(11, dtype=np.int64), 10).sequences == 0


def test_plans_of_many_pieces_cost_no_more_than_of_few():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 2049, 4000), minlength=2049)
    plan = packing.make_plan(counts * 10**9, 2048)
    tokens = int((counts * np.arange(2049)).sum()) * 10**9
    assert len(plan.length) < 20_000
    assert plan.sequences < 1.02 * -(-tokens // 2048)


def library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


ODD = ["", None, "a", " a", "a ", "a  b", "x\ty z", "one\n two", "end\t", "tab\t next", "<|endoftext|> and <|endoftext|>", " ", "it's it 's", "é ü 漢字 かな", "word " * 900, "long" * 5000, "  x", "a 　 b", "line\nline two", "a\x1c b", "\x85 c d"]


def test_ids_are_the_librarys(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    rows = packing.pack(docs, size=64).collect()
    said = library(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], list(r["ids"])))
    for i, ids in enumerate(said):
        pieces = sorted(by[i])
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert [x for p in pieces for x in p[3]] == ids
        assert [p[1] for p in pieces] == np.cumsum([0, *(p[2] for p in pieces)]).tolist()[:-1]
        assert all(p[2] == 64 for p in pieces[1:]) and 1 <= pieces[0][2] <= 64


def test_rows_of_any_kind(spark):
    rows = [(None, "null key"), (None, "null key"), (7, "twice"), (7, "twice"), (8, None)]
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, piece int, length int, ids int")
    out = packing.pack(docs)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == {None: 2, 7: 2, 8: 1}
    assert {r["sequence_id"] for r in got} == {0}
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, size=0)
    named = spark.createDataFrame([("x", "some text")], "name string, body string")
    assert packing.pack(named, key="name", text="body").first()["name"] == "x"


def test_sequences_hold_their_pieces(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 7)) for i in range(60)], "doc_id long, text string")
    packed = packing.pack(docs, size=32)
    pieces = {(r["doc_id"], r["piece"]): r for r in packed.collect()}
    seen = 0
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) <= 32
        for s in r["spans"]:
            p = pieces[s["doc_id"], s["piece"]]
            assert list(r["ids"])[s["offset"] : s["offset"] + s["length"]] == list(p["ids"]) and p["sequence_id"] == r["sequence_id"]
            seen += 1
    assert seen == len(pieces)


def test_op11_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    said = dict(zip(docs, library(docs.values())))
    rows = queries.op11_best_fit_packing(spark, folder).collect()
    sequences, covered = {}, Counter()
    for r in rows:
        ids = said[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered[r["doc_id"]] += r["length"]
    assert covered == {k: len(v) for k, v in said.items()}
    total = sum(gapless(s, 2048) for s in sequences.values())
    assert len(sequences) <= -(-total // 2048) + 1
