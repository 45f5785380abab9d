"""Each registered corpus query, on a small folder with odd rows, against a plain version of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillstone.llm import decontam, queries

LEAK = "the capital of france is a city that lies on the river seine and has many bridges over it"
WORDS = [f"{a}{b}" for a in "ka lo mi nu re sa to vi".split() for b in "ben dor fil gus hal".split()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def made_documents():
    rng = random.Random(11)
    talk = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = []
    for i in range(260):
        t = talk(rng.randint(12, 90))
        if i % 5 == 0:
            t = " ".join(w + "###" for w in t.split())
        if i % 7 == 0:
            t += " you idiot moron clown " + talk(9)
        docs.append(t)
    docs += [docs[1], docs[2] + " more", docs[3].upper(), "Straße ﬁne Ｔext", "STRASSE  fine text", "ΟΔΟΣ x", "οδοσ X", "", None, "   \n", "one", "ONE", "e\u0301 a", "É A"]
    half = LEAK.split()
    docs += [talk(20) + " " + LEAK + " " + talk(5), " ".join(half[9:]).upper() + "! " + talk(12) + " " + " ".join(half[:9]), " ".join(half[:4]) + " " + talk(9), talk(60) + " yes we can " + talk(4)]
    docs.append(" ".join(["long"] * 60_000) + " end")
    return list(zip(rng.sample(range(-50, 5000), len(docs)), docs))


def made_pages():
    page = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links) + "z" * 100
    pages = [
        ("http://good.org/a", page("http://friend.net/", "/self", "//good.org/b")), ("http://friend.net/x", page("https://far.net/q?x#y")), ("http://far.net/", ""), ("http://shop.com/de/1", page("http://other.net/")),
        ("http://spam.net/", page("http://shop.com/de/1")), ("http://spam2.net/", page("HTTP://SPAM.NET/z", "http://good.org/")), ("http://alone.net/p?q", "tiny"), (None, None), ("no url", "tiny"), ("x://EXAMPLE.org/es/1", "y" * 150),
        ("x://a.example.org/en/12", "y" * 150), ("x://shop.com/fr/", "é" * 99), ("x://shop.com", "é" * 99), ("x://notorg/", ""), ("ftp://example.org:80/es/", "y" * 150),
    ]
    return [(i * 3 + 1, u, h) for i, (u, h) in enumerate(pages)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("made"))
    docs, pages = made_documents(), made_pages()
    labels = [(k, 0 if t and "###" in t else 1, int("idiot" in (t or ""))) for k, t in docs if t]
    bench = [(1, LEAK), (2, "yes we can"), (3, "a b c d e f g h"), (4, ""), (5, None), (6, LEAK)]
    talks = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yo\\p"), (2, 0, "system", None), (2, 1, "assistant", ""), (2, 2, "assistant", "é🙂"), (3, 0, "user", "x" * 9000)]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame(talks, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return {"dir": d, "docs": docs, "pages": pages, "bench": bench, "talks": talks}


def by(df, key):
    rows = df.collect()
    got = {r[key]: r for r in rows}
    assert len(got) == len(rows), "one row a key"
    return got


def test_op1(spark, made):
    df = queries.op1_warc_seekable_bundles(spark, made["dir"])
    assert df.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got, first = by(df, "page_id"), {}
    for k, _, h in made["pages"]:
        body = (h or "").encode()
        again = first.setdefault(body, k) if len(body) >= 100 else k
        r = got[k]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha256(body).hexdigest(), "response" if again == k else "revisit", None if again == k else again)


def test_op2(spark, made):
    got = by(queries.op2_chat_formatting(spark, made["dir"]), "conv_id")
    talks = made["talks"] + [(-1, 0, "user", queries.TRAP), (-1, 1, "assistant", queries.TRAP)]
    assert set(got) == {c for c, *_ in talks}
    for c, r in got.items():
        turns = [(who, said or "") for k, _, who, said in talks if k == c]
        learnt = "".join(t for who, t in turns if who == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learnt), sha(learnt))
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in turns)


def plain_split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def plain_walk(edges, seeds):
    """Dense personalised PageRank until nothing changes."""
    names = sorted({x for e in edges for x in e} | set(seeds))
    out = {n: [b for a, b in edges if a == n] for n in names}
    p = {n: seeds.get(n, 0) / sum(seeds.values()) for n in names}
    r = dict(p)
    for _ in range(400):
        moved = dict.fromkeys(names, 0.0)
        for a in names:
            for b in out[a]:
                moved[b] += r[a] / len(out[a])
        lost = sum(moved.values())
        r = {n: 0.85 * moved[n] + p[n] * (1 - 0.85 * lost) for n in names}
    return r


def test_op3(spark, made):
    got = by(queries.op3_url_filter(spark, made["dir"]), "page_id")
    links, good, bad, ruled = [], {}, {}, {}
    for k, url, html in made["pages"]:
        host, path = plain_split(url)
        fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        ruled[k] = max(fits, key=lambda f: f[0])[1:] if fits else (None, None)
        if host and ruled[k][1]:
            side = good if ruled[k][1] == "allow" else bad
            side[host] = side.get(host, 0) + 1
        for to in re.findall('href="([^"]+)"', html or ""):
            to = "http:" + to if to.startswith("//") else to
            dst = plain_split(to)[0] if to.lower().startswith("http") else ""
            if host and dst and dst != host:
                links.append((host, dst))
    trust, distrust = plain_walk(links, good), plain_walk([(b, a) for a, b in links], bad)
    g, b = sum(good.values()), sum(bad.values())
    trust, distrust = {h: t * g / (g + b) for h, t in trust.items()}, {h: d * b / (g + b) for h, d in distrust.items()}
    verdicts = set()
    for k, url, _ in made["pages"]:
        host, path = plain_split(url)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        want = ruled[k][1] or ("block" if host and d > t else "allow")
        r = got[k]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, ruled[k][0], want), url
        assert r.trust == pytest.approx(t, rel=1e-3) and r.distrust == pytest.approx(d, rel=1e-3)
        verdicts.add((ruled[k][0] is None, want))
    assert len(verdicts) == 4, "allowed and blocked, by rules and by the walks"


def test_op4_and_op5(spark, made):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts, pieces = by(queries.op4_token_counts(spark, made["dir"]), "doc_id"), by(queries.op5_sentencepiece(spark, made["dir"]), "doc_id")
    assert len(counts) == len(pieces) == len(made["docs"])
    for k, t in made["docs"]:
        t = t or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (counts[k].n_bytes, counts[k].n_tokens, counts[k].over_limit) == (len(t.encode()), n, n > 512)
        ids = sp.encode(t)
        assert (pieces[k].n_tokens, pieces[k].ids_sha256, pieces[k].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


@pytest.mark.parametrize("name, folds, held, label", [("op6_toxicity", 5, 0, lambda t: "idiot" in t), ("op7_quality", 3, 1, lambda t: "###" not in t)])
def test_op6_and_op7(spark, made, name, folds, held, label):
    got = by(queries.QUERIES[name](spark, made["dir"]), "doc_id")
    assert len(got) == len(made["docs"])
    right = []
    for k, t in made["docs"]:
        r = got[k]
        assert r.held_out == (zlib.crc32(str(k).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if t and r.held_out and len(t.split()) > 10:
            right.append(r.predicted == int(label(t)))
    assert len(right) > 30 and np.mean(right) > 0.95


def plain_words(t):
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).split()


def plain_tiles(item, doc, least):
    """(covered, tiles, longest) by trying every pair of places, the longest match first."""
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and free_i[a + n] and free_d[b + n] and item[a + n] == doc[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least or n == 0:
            return sum(tiles), len(tiles), max(tiles, default=0)
        tiles.append(n)
        free_i[a : a + n] = free_d[b : b + n] = [False] * n


def test_op8(spark, made):
    rows = queries.op8_decontamination(spark, made["dir"]).collect()
    got = {(r.doc_id, r.item_id): (round(r.coverage, 9), r.n_tiles, r.longest) for r in rows}
    want = {}
    for item, text in made["bench"]:
        seq = plain_words(text)
        for k, t in made["docs"]:
            doc = plain_words(t)
            if not seq or len(doc) > 5000 or not set(seq) & set(doc):
                continue
            covered, n, longest = plain_tiles(seq, doc, min(5, len(seq)))
            if n and covered >= 0.5 * len(seq):
                want[k, item] = (round(covered / len(seq), 9), n, longest)
    assert got == want and len(rows) == len(got) and {item for _, item in got} == {1, 2, 6}


def plain_canon(t):
    import unicodedata

    n = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", n(n(t or "").casefold())).strip()


def test_op9(spark, made):
    got = by(queries.op9_fingerprint(spark, made["dir"]), "doc_id")
    docs = sorted(((k, t or "") for k, t in made["docs"]), reverse=True)
    prints = {}
    for i, (k, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        size = len(t) // 3
        edited = t[: len(t) - size] + after[:size]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == sha(edited)
        assert r.near_edited == float(plain_canon(t) == plain_canon(edited)) and r.near_next == float(plain_canon(t) == plain_canon(after))
        for text, mark in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(plain_canon(text), mark) == mark
    assert len(set(prints.values())) == len(prints), "unlike texts, unlike marks"
    assert any(r.near_edited for r in got.values()) and plain_canon("Straße") == plain_canon("STRASSE")


def plain_sets(docs):
    out = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[k] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return out


def plain_classes(sets, percent):
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
    return {k: top(k) for k in keys}


def test_op10(spark, made):
    got = by(queries.op10_minhash_near_dedup(spark, made["dir"]), "doc_id")
    sets = plain_sets(made["docs"])
    want = plain_classes(sets, 85)
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), c, k == c) for k, c in want.items()}


def test_the_pipeline_stage_by_stage(spark, made):
    """Near copies, leaks and ids by plain versions on what the stage before kept; the classifiers' decisions by the documents' making."""
    import sentencepiece

    import corpus_pipeline
    from quillstone.llm import piece_codec

    docs = dict(made["docs"])
    now = spark.read.parquet(f"{made['dir']}/documents.parquet")
    columns, kept = now.columns, set(docs)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, made["dir"])
        rows = now.collect()
        left = {r.doc_id for r in rows}
        assert left <= kept and len(left) == len(rows)
        gone = {k: docs[k] or "" for k in kept - left}
        if name == "quality":
            low = [k for k in kept if "###" in (docs[k] or "")]
            assert np.mean([k in gone for k in low]) > 0.95 and sum("###" not in t for t in gone.values() if len(t.split()) > 10) <= 3
        elif name == "toxicity":
            bad = [k for k in kept if "idiot" in (docs[k] or "")]
            assert np.mean([k in gone for k in bad]) > 0.95 and sum("idiot" not in t for t in gone.values()) <= 3
        elif name == "near_duplicates":
            classes = plain_classes(plain_sets([(k, docs[k]) for k in kept]), 80)
            assert left == {k for k, c in classes.items() if k == c}
        elif name == "decontamination":
            items = [plain_words(t) for _, t in made["bench"]]
            holds = lambda t, s: bool(s) and plain_tiles(s, t, min(5, len(s)))[0] >= 0.5 * len(s)
            assert set(gone) == {k for k in kept if len(docs[k] or "") < 50_000 and any(holds(plain_words(docs[k]), s) for s in items if set(s) & set(plain_words(docs[k])))} and gone
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_path())
            assert left == kept and all(list(r.ids) == sp.encode(docs[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in rows)
        assert i == 4 or now.columns == columns
        now = spark.createDataFrame(rows, now.schema)
        kept = left
    assert {r.doc_id for r in corpus_pipeline.run(spark, made["dir"]).collect()} == kept


def test_the_pipeline_with_odd_tables(spark, tmp_path):
    """Clashing names, null ids, repeated rows, a long text, then no rows at all."""
    import corpus_pipeline

    docs = [(1, "plain words here now then", 5), (1, "plain words here now then", 5), (None, "null id", 1), (None, None, 2), (2, None, 3), (3, "", 4), (4, "word " * 50_000, 6), (5, LEAK, 7)]
    schema = "doc_id long, text string, gone long, leaked string, k string, quality_score string, n int, set string, key string, block int, toxic_passages int"
    rows = [(a, b, c, "x", "y", "z", 1, "s", "q", 2, 3) for a, b, c in docs]
    for name, some in (("odd", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, LEAK), (None, None)] if some else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        assert bool(out) == bool(some) and 5 not in {r.doc_id for r in out}
        now = spark.read.parquet(f"{d}/documents.parquet")
        for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.drop_leaks):
            after = stage(spark, now, d)
            # classifiers replace columns of their results' names, which then are no part of documents
            assert after.columns == now.columns
            left = [r.doc_id for r in after.collect()]
            assert left.count(None) == 2 * bool(some)


def test_tiles_of_texts_that_repeat(spark):
    """One word a hundred thousand times costs memory in proportion; tiles don't overlap."""
    item, doc = np.array([1, 1, 1, 1, 1, 2, 1, 1, 1, 1, 1]), np.ones(100_000, dtype=np.int64)
    assert decontam.tile(item, doc, 5) == [(0, 0, 5), (6, 5, 5)]
