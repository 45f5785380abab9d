"""Snapshot difference and prefix trie against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.llm import convtrie, queries, snapdiff

COLUMNS = ("text", "lang", "source")


def plain_difference(before, after):
    """Rows are (key, text, lang, source); keys unique on each side."""
    old, new = {r[0]: r for r in before}, {r[0]: r for r in after}
    out = []
    for k in old.keys() & new.keys():
        changed = [c for c, x, y in zip(COLUMNS, old[k][1:], new[k][1:]) if x != y]
        out.append((k, k, "update" if changed else "same", ",".join(changed)))
    sides = []
    for rows, other in ((old, new), (new, old)):
        by = defaultdict(list)
        for k in sorted(rows.keys() - other.keys(), key=lambda k: (k is not None, k)):
            by[rows[k][1]].append(rows[k])
        sides.append(by)
    for text in sides[0].keys() | sides[1].keys():
        a, b = sides[0][text], sides[1][text]
        for x, y in zip(a, b):
            out.append((y[0], x[0], "rekey", ",".join(c for c, p, q in zip(COLUMNS, x[1:], y[1:]) if p != q)))
        out += [(x[0], x[0], "delete", "") for x in a[len(b) :]] + [(y[0], None, "insert", "") for y in b[len(a) :]]
    return Counter(out)


def both(spark, before, after, **more):
    kind = "doc_id long, text string, lang string, source string"
    rows = snapdiff.difference(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind), **more).collect()
    return Counter((r["key"], r["old_key"], r["op"], r["changed"]) for r in rows)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("rows_per_part", [3, 500_000])
def test_difference_with_a_hot_text(spark, seed, rows_per_part):
    rng = random.Random(seed)
    word = lambda: rng.choice(["hot"] * 6 + [None, "", "a", "b", "c~", f"w{rng.random()}"])
    rows = lambda keys: [(k, word(), rng.choice([None, "en", "fr"]), rng.choice([None, "s", "t"])) for k in keys]
    before = rows([None, *rng.sample(range(-200, 200), 90)])
    kept = [r for r in before if rng.random() < 0.4]
    after = kept + rows([k for k in rng.sample(range(-400, 400), 120) if k not in {r[0] for r in kept}])
    assert both(spark, before, after, rows_per_part=rows_per_part) == plain_difference(before, after)


def test_difference_of_empty_and_equal_tables(spark):
    rows = [(1, "a", "en", "s"), (2, None, None, None), (None, "", "en", "s")]
    assert both(spark, [], []) == Counter()
    assert both(spark, rows, rows) == Counter((k, k, "same", "") for k, *_ in rows)
    assert both(spark, rows, []) == Counter((k, k, "delete", "") for k, *_ in rows)
    assert both(spark, [], rows) == Counter((k, None, "insert", "") for k, *_ in rows)


@pytest.mark.parametrize("rows_per_part", [4, 500_000])
def test_repeated_keys_pair_once_each(spark, rows_per_part):
    one = (5, "same", "en", "s")
    got = both(spark, [one] * 40 + [(6, "x", "en", "s")], [one] * 55, rows_per_part=rows_per_part)
    assert got == Counter({(5, 5, "same", ""): 40, (5, None, "insert", ""): 15, (6, 6, "delete", ""): 1})


def test_other_keys_columns_and_clashing_names(spark):
    a = spark.createDataFrame([("k1", "t", 1, 9), ("k2", "u", 2, 9)], "id string, body string, n int, rid int")
    b = spark.createDataFrame([("k1", "t", 3, 8), ("k9", "u", 2, 8)], "id string, body string, n int, rid int")
    got = snapdiff.difference(a, b, key="id", columns=("body", "n"), content=("body", "n"), also={"rank": F.col("n") + 1}).collect()
    assert {tuple(r) for r in got} == {("k1", "k1", "update", "n", 4), ("k9", "k2", "rekey", "", 3)}
    with pytest.raises(ValueError):
        snapdiff.difference(a, b, key="id", columns=("n",), content=("body",))


def test_op13_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    before = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", *COLUMNS).collect()]
    after = []
    for k, text, lang, source in before:
        m = zlib.crc32(str(k).encode()) % 16
        if m == 0:
            continue
        if m == 1:
            text = (text or "") + "+"
        if m == 2:
            lang, source = source, lang
        if m == 4:
            source = None
        after.append((-1 - k if m in (3, 4) else k, text, lang, source))
        if m == 5:
            after.append((-1 - k, text, lang, source))
    rows = queries.op13_snapshot_difference(spark, folder).collect()
    assert Counter((r["key"], r["old_key"], r["op"], r["changed"]) for r in rows) == plain_difference(before, after)
    said = {r[0]: hashlib.sha256("\n".join("~" if x is None else x for x in r[1:]).encode()).hexdigest() for r in after}
    assert all(r["row_sha256"] == (None if r["op"] == "delete" else said[r["key"]]) for r in rows)


def plain_trie(rows, borrow):
    convs = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs[c].append((role or "", text or ""))
    built = {}
    for c, own in convs.items():
        if borrow and c is not None:
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        else:
            built[c] = tuple(own)
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    least = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c in m if len(built[c]) == len(p)), key=lambda c: (c is not None, c or 0)))
        out.append((least[p], len(p), least[p[:-1]] if p else None, len(m), kids(p), sum(not kids(q) for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def trie(spark, rows, borrow):
    found = convtrie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), borrow).drop("digest")
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("borrow", [False, True])
def test_trie(spark, seed, borrow):
    rng = random.Random(seed)
    rows = []
    for c in [None, *rng.sample(range(60), 25)]:
        for turn in [None, *range(rng.randint(0, 6))]:
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hé", "ho", "", None])))
        if rng.random() < 0.3:
            rows.append(rows[-1])
    assert trie(spark, rows, borrow) == plain_trie(rows, borrow)


def test_copies_and_long_conversations(spark):
    long = [(c, i, "user", f"t{i}") for c in (5, 6, 7) for i in range(300)]
    rows = long + [(8, i, "user", f"t{i}") for i in range(120)] + [(9, 0, "user", "t0" * 200_000)]
    assert trie(spark, rows, False) == plain_trie(rows, False)


def test_an_empty_table_has_no_root(spark):
    assert trie(spark, [], True) == Counter()


def test_further_columns_are_not_read(spark):
    table = spark.createDataFrame([(1, 0, "user", "x", "y", 3)], "conv_id long, turn long, role string, text string, digest string, depth int")
    assert sorted(r["depth"] for r in convtrie.trie(table).collect()) == [0, 1]


def test_roles_and_texts_part(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc")]
    assert trie(spark, rows, False) == plain_trie(rows, False)


def test_op12_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.op12_prefix_trie(spark, folder).collect()) == plain_trie(rows, True)
