"""Operators on small tables, with the cases that fix their meaning."""

import math

import pytest
from pyspark.sql import functions as F

from quillstone.operators import aggregates as A
from quillstone.operators import expectations as E
from quillstone.operators import graph as G
from quillstone.operators import joins as J
from quillstone.operators import model_boundary as M
from quillstone.operators import projections as P
from quillstone.operators import retrieval as R
from quillstone.operators import windows as W


def test_closed_intervals_meet_at_their_ends(spark, rows):
    points = spark.createDataFrame([("R1", 9.0, 10.0), ("R2", 20.001, 29.999), ("R3", 15.0, 35.0), ("R4", 5.0, 4.0), ("R5", 40.0, 90.0)], "id string, s double, e double")
    ranges = spark.createDataFrame([(1, 10.0, 20.0), (2, 30.0, 40.0), (3, None, 5.0)], "r int, s double, e double")
    for bucket in (3.0, 1000.0):
        assert rows(J.interval_overlap(points, ranges, "s", "e", "s", "e", bucket, ["id"], ["r"])) == [("R1", 1), ("R3", 1), ("R3", 2), ("R5", 2)]


def test_hallucination_cases(spark):
    same = [("loop", "thank you")] * 8
    clear = [("clear", f"sentence number {i}") for i in range(5)]
    df = spark.createDataFrame([*same, *clear, ("blank", " "), ("blank", None)], "k string, t string")
    got = {r.k: r.score for r in A.hallucination_score(df, "k", "t", ["thanks for watching"]).collect()}
    assert got["loop"] == 1.0 and got["blank"] == 1.0 and got["clear"] < 0.5


def test_slide_windows_have_no_extra_tail(spark):
    df = spark.createDataFrame([("a", 20.0), ("b", 35.0), ("c", 36.0), ("d", 5.0), ("e", 0.0)], "k string, d double")
    got = {}
    for r in W.slide_windows(df, "k", "d").collect():
        got.setdefault(r.k, []).append((r.start_seconds, r.end_seconds))
    assert {k: len(v) for k, v in got.items()} == {"a": 1, "b": 2, "c": 3, "d": 1} and max(got["c"])[1] == 36.0


def test_overlap_dedup_forms_differ(spark, rows):
    data = [("t", 1, "hello big world"), ("t", 2, "big world again now"), ("t", 3, "world again now then"), ("u", 1, "again now then")]
    df = spark.createDataFrame(data, "k string, n int, x string")
    assert rows(W.overlap_dedup(df, "k", "n", "x"), "k", "n", "matched", "cut_text") == [("t", 1, 0, "hello big world"), ("t", 2, 8, "again now"), ("t", 3, 13, "then"), ("u", 1, 0, "again now then")]
    assert rows(W.overlap_dedup_running(df, "k", "n", "x"), "k", "n", "matched", "cut_text") == [("t", 1, 0, "hello big world"), ("t", 2, 8, "again now"), ("t", 3, 0, "world again now then"), ("u", 1, 0, "again now then")]


def test_sentences_keep_their_marks(spark, rows):
    df = spark.createDataFrame([(1, "好。是吗？yes! "), (2, "")], "k int, x string")
    assert rows(W.split_sentences(df, "x"), "k", "sentence_index", "sentence") == [(1, 0, "好。"), (1, 1, "是吗？"), (1, 2, "yes!")]


@pytest.mark.parametrize("parts", [1, 7, 20])
def test_ids_follow_the_total_order_in_any_partitioning(spark, parts):
    df = spark.createDataFrame([(f"s{i % 5}", i) for i in range(40)], "s string, n int").repartition(parts)
    got = sorted(W.assign_ids(df, "s", ["n"]).collect(), key=lambda r: r.evidence_id)
    assert [(r.s, r.n) for r in got] == sorted((f"s{i % 5}", i) for i in range(40)) and got[0].evidence_id == "E000001"


def test_zone_needs_two_readings(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 9, 1, 9, 9, 1, 1])], "k string, n int, v int")
    assert [r.zone for r in W.zone_hysteresis(df, "k", ["n"], "v", 5).orderBy("n").collect()] == ["low", "low", "low", "low", "high", "high", "low"]


def test_spaced_picks_and_paragraphs(spark):
    df = spark.createDataFrame([("a", float(t), r) for t, r in [(0, 5), (100, 9), (300, 7), (310, 8), (900, 1)]], "k string, t double, r int")
    assert sorted(r.t for r in W.spaced_topk(df, "k", "t", "r", 3, 180.0).collect()) == [100.0, 310.0, 900.0]
    long = spark.createDataFrame([("a", i, "x" * 100 + ("." if i % 2 else " and")) for i in range(6)], "k string, n int, t string")
    assert [(r["first"], r["last"]) for r in W.paragraphs(long, "k", "n", "t").orderBy("paragraph").collect()] == [(0, 1), (2, 3), (4, 5)]


def test_natural_and_guarded_order(spark):
    df = spark.createDataFrame([("P10",), ("P2",), ("P1",)], "p string")
    assert [r.p for r in df.orderBy(*W.natural_order("p")).collect()] == ["P1", "P2", "P10"]
    rows_ = spark.createDataFrame([("e", "a"), ("e", "b"), ("f", "a"), ("f", "b")], "k string, v string")
    orders = spark.createDataFrame([("e", "b", 1), ("e", "a", 2), ("f", "b", 1)], "k string, v string, ordinal int")
    got = {(r.k, r.v): r.position for r in W.guarded_order(rows_, orders, "k", "v").collect()}
    assert got == {("e", "b"): 1, ("e", "a"): 2, ("f", "a"): 1, ("f", "b"): 2}


def test_fuzzy_terms(spark, rows):
    records = spark.createDataFrame([("R1", ["kubernetis", "Docker", "会仪"]), ("R2", ["docker", "会"])], "record_id string, tokens array<string>")
    terms = spark.createDataFrame([(3, "kubernetes"), (1, "kubernetes"), (2, "DOCKER"), (4, "会议"), (5, "会议记")], "page int, term string")
    got = rows(J.fuzzy_terms(records, terms), "record_id", "original", "suggested", "page")
    assert got == [("R1", "kubernetis", "kubernetes", 1), ("R1", "会仪", "会议", 4)]
    many = spark.createDataFrame([("R", ["abcdef"])], "record_id string, tokens array<string>")
    near = spark.createDataFrame([(i, "abcde" + c) for i, c in enumerate("ghijklmn")], "page int, term string")
    assert [r.page for r in J.fuzzy_terms(many, near).orderBy("page").collect()] == [0, 1, 2, 3, 4]


def test_ties_go_where_they_should(spark):
    grams = "id int, grams array<string>"
    notes, recs = spark.createDataFrame([(1, ["aa", "bb"])], grams), spark.createDataFrame([(5, ["aa"]), (7, ["bb"]), (6, ["zz"])], "rid int, grams array<string>")
    assert [r.rid for r in J.lexical_topk(notes, recs, "id", "rid").orderBy("rank").collect()] == [5, 7]
    assert J.best_document(notes.withColumnRenamed("id", "n"), recs, "n", "rid").first().rid == 7
    alone = J.lexical_topk(spark.createDataFrame([(9, [])], grams), recs, "id", "rid").collect()
    assert [(r.id, r.rid) for r in alone] == [(9, None)]


def test_neighbor_cap_ignores_input_order(spark, rows):
    pairs = [(a, b, 1.0 / (a + b)) for a in range(8) for b in range(a + 1, 8)]
    one = spark.createDataFrame(pairs, "a int, b int, score double")
    assert rows(J.neighbor_cap(one, 2)) == rows(J.neighbor_cap(one.orderBy(F.rand(3)).repartition(7), 2))


def test_asof_prefixes_resume_upsert(spark, rows):
    recs = spark.createDataFrame([("k", 1.0, 10), ("k", 5.0, 11), ("j", 2.0, 12)], "k string, t double, rid int")
    probes = spark.createDataFrame([("k", 0.5, "a"), ("k", 5.0, "b"), ("k", 9.0, "c"), ("m", 9.0, "d")], "k string, t double, p string")
    assert rows(J.asof(probes, recs, "k", "t", "t", "rid", ["p"]), "p", "rid") == [("a", None), ("b", 11), ("c", 11), ("d", None)]
    files = spark.createDataFrame([("alpha_1.txt",), ("beta",)], "f string")
    stems = spark.createDataFrame([("alpha_1", 2), ("alpha", 1)], "stem string, o int")
    assert rows(J.prefix_first(files, stems, "f", "stem", "o")) == [("alpha_1.txt", "alpha")]
    done = spark.createDataFrame([(1, "x", None), (2, " ", "complete"), (3, None, "empty")], "id int, text string, status string")
    assert rows(J.resume_pending(spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int"), done, "id")) == [(2,), (4,)]


def test_lookup_raises_on_a_missing_key(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert J.lookup(left, right, "k", ["v"], required=False).count() == 2
    with pytest.raises(Exception, match="no row for"):
        J.lookup(left, right, "k", ["v"]).collect()


@pytest.mark.parametrize("shuffle", [1, 9])
def test_components_and_orders(spark, shuffle):
    nodes = spark.createDataFrame([(i,) for i in range(30)], "n long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(20, 25), (25, 20), (3, 3)], "a long, b long").repartition(shuffle)
    got = {r.n: r.component for r in G.components(nodes, edges, "n", "a", "b").collect()}
    assert all(got[i] == 0 for i in range(12)) and got[25] == 20 and got[15] == 15
    comp = spark.createDataFrame([("c", n, k) for n, k in [("x", "3"), ("y", "1"), ("z", "2")]] + [("d", "p", "1"), ("d", "q", "0")], "component string, node string, key string")
    arcs = spark.createDataFrame([("c", "x", "y", False), ("c", "y", "x", True), ("d", "p", "q", False), ("d", "q", "p", False)], "component string, a string, b string, weak boolean")
    order = {}
    for r in G.topological_order(comp, arcs, "component", "key").orderBy("position").collect():
        order.setdefault((r.component, r.state), []).append(r.node)
    assert order == {("c", "weak_dropped"): ["z", "x", "y"], ("d", "cycle"): ["q", "p"]}


def test_chain_walk(spark):
    edges = spark.createDataFrame([(5, 2), (2, 9), (7, 8)], "a long, b long")
    got = {}
    for r in G.chain_walk(edges).orderBy("position").collect():
        got.setdefault(r.chain, []).append(r.node)
    assert got == {2: [5, 2, 9], 7: [7, 8]}


def search_tables(spark):
    units = spark.createDataFrame([("e", f"U{i}", t, c, z, [f"E{i}"]) for i, (t, c, z) in enumerate([("budget", "The launch budget grew", "high"), ("budget", "budget again", "low"), ("people", "hiring plan", "medium"), ("会议", "会议记录已经完成", "high")])], "event string, unit_id string, topic string, claim string, certainty string, evidence_ids array<string>")
    records = spark.createDataFrame([("e", "R1", "we spoke about rockets", 9.0, 14.0), ("e", "R2", "budget", 20.0, 21.0)], "event string, record_id string, clean_literal string, start_seconds double, end_seconds double")
    return units, records


def test_search_tiers(spark):
    units, records = search_tables(spark)
    first = R.search_token(units, records, "budget").collect()
    assert {(r.tier, r.id) for r in first} == {(1, "U0"), (1, "U1")}
    assert [(r.tier, r.id) for r in R.search_token(units, records, "会议").collect()] == [(2, "U3")]
    assert [(r.tier, r.id) for r in R.search_token(units, records, "ROCKET").collect()] == [(3, "R1")]


def test_search_falls_apart_into_words_and_shingles(spark):
    units, records = search_tables(spark)
    hits = R.search(units, records, "launch hiring").orderBy("rank").collect()
    assert [h.id for h in hits] == ["U0", "U2"]
    assert [h.id for h in R.search(units, records, "关于会议记录").collect()] == ["U3"]
    cited = R.cite(R.search(units, records, "rockets"), units, records).first()
    assert cited.id == "R1" and cited["at"] == "00:09-00:14"


def test_bm25_by_hand(spark):
    rows_ = spark.createDataFrame([("a", "abcabc"), ("b", "abcx"), ("c", "zzzz"), ("d", "yyyy")], "k string, t string")
    got = {r.key: r.score for r in R.bm25(R.trigram_postings(rows_, "k", "t"), spark.createDataFrame([("ABC",), ("ab",)], "query string")).collect()}
    sizes, n = {"a": 4, "b": 2, "c": 2, "d": 2}, 4
    mean = sum(sizes.values()) / n
    idf = max(math.log((n - 2 + 0.5) / (2 + 0.5)), 1e-6)
    want = {k: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[k] / mean)) for k, tf in (("a", 2), ("b", 1))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_private_events_are_hidden(spark, rows):
    df = spark.createDataFrame([("a",), ("b_private",)], "event string")
    assert rows(P.hide_private(df)) == [("a",)]


def test_routing_tables(spark):
    df = spark.createDataFrame([("only latin", "latin too", 0.0, 0.9), ("会议", None, 0.0, 0.0), ("会议", "会议", 0.9, 0.1), ("会议", "记录", 0.1, 0.1)], "a string, b string, x double, y double")
    assert [r[0] for r in df.select(P.engine_route(*map(F.col, ("a", "b", "x", "y")))).collect()] == ["first", "first", "second", "arbiter"]
    rules = spark.createDataFrame([(" OK, thanks ",), ("ok " + "x" * 60,), ("see the calendar",), ("",), (None,)], "text string")
    got = [list(r.rules) for r in P.relevance_candidates(rules).collect()]
    assert got == [["acknowledgment"], [], ["scheduling"], [], []]


def test_model_boundary(spark, rows):
    ok = lambda o, r, p: spark.range(1).select(M.repair_guard(F.lit(o), F.lit(r), F.lit(p))).first()[0]
    assert ok("pay 12 euro", "pay 12", "12") and not ok("pay 12 euro", "pay", "pay 12") and ok("pay 12", "pay", "nothing")
    rel = spark.createDataFrame([("conflict", []), ("conflict", ["R"]), ("supports", None)], "relation string, matched array<string>")
    assert sorted(r.relation for r in M.absence_not_conflict(rel).collect()) == ["conflict", "supports", "unknown"]
    reports = spark.createDataFrame([(1, "see U000001"), (2, "U000009"), (3, None)], "k int, t string")
    units = spark.createDataFrame([("U000001",)], "unit_id string")
    assert rows(M.report_references(reports, units, "k", "t"), "k", "valid") == [(1, True), (2, False), (3, False)]


def test_gate_and_checks(spark):
    evidence = spark.createDataFrame([("E1", "image"), ("E2", "audio")], "evidence_id string, kind string")
    records = spark.createDataFrame([("R1", "x", 0.0, 1.0), ("R1", "", 2.0, 1.0)], "record_id string, clean_literal string, start_seconds double, end_seconds double")
    units = spark.createDataFrame([("U1", "claim", ["E1", "E9"]), ("U2", " ", [])], "unit_id string, claim string, evidence_ids array<string>")
    disp = spark.createDataFrame([("E1", "covered"), ("E7", "accepted")], "evidence_id string, status string")
    found = E.package_checks(evidence, records, units, disp)
    assert {r.rule for r in found.collect()} == {"record_id_unique", "disposition_missing", "disposition_orphan", "unit_cites_unknown", "unit_without_evidence", "unit_without_claim", "record_without_text", "record_times"}
    assert A.gate(found).first().status == "FAIL" and A.gate(found.where("false")).first().status == "PASS"
    assert A.gate(found.where("severity = 'warning'")).first().status == "WARN"


def test_full_text_scores_by_hand(spark):
    """Counts and the mean size are of all units, whatever the filter; a word is one phrase; occurrences may overlap."""
    texts = {"U0": "aaaa zebra zebra", "U1": "zebra crossing", "U2": "nothing here", "U3": "aaa", "U4": "other words", "U5": "more words here"}
    units = spark.createDataFrame([("e", k, "t", v, "high", ["E"]) for k, v in texts.items()], "event string, unit_id string, topic string, claim string, certainty string, evidence_ids array<string>")
    size = {k: len(v) - 2 for k, v in texts.items()}
    mean = sum(size.values()) / len(size)

    def score(counts, k):
        out = 0.0
        for word in counts:
            df = sum(1 for c in counts[word].values() if c)
            idf = max(math.log((6 - df + 0.5) / (df + 0.5)), 1e-6)
            out += idf * counts[word][k] * 2.2 / (counts[word][k] + 1.2 * (0.25 + 0.75 * size[k] / mean))
        return out

    got = R.match(units, ["zebra", "aaa"], ["event"], "topic", "claim").select("unit_id", R.bm25_of([0]).alias("z"), R.bm25_of([0, 1]).alias("both")).collect()
    counts = {"zebra": {"U0": 2, "U1": 1, "U3": 0}, "aaa": {"U0": 2, "U1": 0, "U3": 1}}
    by = {r.unit_id: r for r in got}
    assert set(by) == {"U0", "U1", "U3"}
    assert by["U0"].z == pytest.approx(score({"zebra": counts["zebra"]}, "U0")) and by["U1"].z == pytest.approx(score({"zebra": counts["zebra"]}, "U1")) and by["U3"].z is None
    assert by["U0"].both == pytest.approx(score(counts, "U0")) and by["U1"].both is None
    first = R.search_token(units, spark.createDataFrame([], "record_id string, clean_literal string"), "zebra aaa").collect()
    assert [(r.tier, r.id) for r in first] == [(1, "U0")]
    assert R.phrases_of("To be or NOT") == ["not"]


def test_search_without_hits_names_the_first_event(spark):
    units, records = search_tables(spark)
    out = R.response(R.search(units, records, "qqqq"), units.select("event")).collect()
    assert [(r.event, r.units, r.evidence) for r in out] == [("e", [], [])]
    out = R.response(R.search(units, records, "launch hiring"), units.select("event")).first()
    assert (out.event, out.units, out.evidence) == ("e", ["U0", "U2"], [])
    packet = R.packet(units, spark.createDataFrame([("E1", "s", "audio", "spoken zzz"), ("E9", "s", "image", "qqqq here")], "evidence_id string, source_id string, kind string, literal_text string"), "qqqq").collect()
    assert [(r.tier, r.id, r.evidence) for r in packet] == [(3, "E9", None)]


def test_context_by_record_and_by_time(spark):
    records = spark.createDataFrame([("e", f"R{i}", float(i * 10), f"said {i}", "logistics" if i == 3 else "content") for i in range(8)], "event string, record_id string, start_seconds double, clean_literal string, label string")
    asks = spark.createDataFrame([("a", "e", "R2", None), ("b", "e", None, 65.0), ("c", "e", None, -1.0), ("d", "nowhere", "R2", None), ("f", "e", "R99", None)], "ask string, event string, record_id string, around_seconds double")
    got = {}
    for r in R.transcript_context(records, asks, context=1).orderBy("ask", "position").collect():
        got.setdefault(r.ask, []).append(r.line)
    assert got == {"a": ["  R1 [00:00:10] said 1", "→ R2 [00:00:20] said 2", "  R3 [00:00:30] said 3 [logistics]"], "b": ["  R5 [00:00:50] said 5", "→ R6 [00:01:00] said 6", "  R7 [00:01:10] said 7"]}


def test_components_raise_rather_than_stop_early(spark):
    nodes = spark.range(64).withColumnRenamed("id", "n")
    edges = spark.range(63).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = G.components(nodes, edges, "n", "a", "b")
    assert got.select("component").distinct().collect()[0].component == 0 and got.count() == 64
    with pytest.raises(RuntimeError):
        G.components(nodes, edges, "n", "a", "b", rounds=2)
    odd = spark.createDataFrame([("x", None), (None, "x"), ("x", "x"), ("y", "z"), ("y", "z")], "a string, b string")
    assert sorted(map(tuple, G.components(spark.createDataFrame([("x",), ("y",), ("z",)], "n string"), odd, "n", "a", "b").collect())) == [("x", "x"), ("y", "y"), ("z", "y")]


def test_places_in_a_global_order(spark):
    from quillstone.operators.scratch import ranked

    rows_ = [(i * 7919 % 1000, "k" if i % 3 else "hot") for i in range(1000)]
    got = ranked(spark.createDataFrame(rows_, "v long, g string").repartition(7), ["g", "v"], "place").collect()
    want = {(g, v): i + 1 for i, (g, v) in enumerate(sorted((g, v) for v, g in rows_))}
    assert {(r.g, r.v): r.place for r in got} == want


def test_terms_that_sound_alike(spark, rows):
    records = spark.createDataFrame([(1, ["会以", "会议", "x"]), (2, ["记路"])], "record_id long, tokens array<string>")
    terms = spark.createDataFrame([(3, "会议"), (1, "记录"), (2, "绘艺")], "page long, term string")
    readings = spark.createDataFrame([("会", "hui"), ("以", "yi"), ("议", "yi"), ("绘", "hui"), ("艺", "yi"), ("记", "ji"), ("路", "lu"), ("录", "lu")], "character string, reading string")
    assert rows(J.reading_keys(terms, "term", readings)) == [("会议", "hui yi"), ("绘艺", "hui yi"), ("记录", "ji lu")]
    plain = rows(J.fuzzy_terms(records, terms), "record_id", "original", "suggested")
    assert plain == [(1, "会以", "会议"), (2, "记路", "记录")]
    both = rows(J.fuzzy_terms(records, terms, readings=readings), "record_id", "original", "suggested", "page")
    assert both == [(1, "会以", "会议", 3), (1, "会以", "绘艺", 2), (1, "会议", "绘艺", 2), (2, "记路", "记录", 1)]


def test_the_gate_waits_while_red(spark, rows):
    from quillstone.operators import resources

    calm, busy = (4000.0, 8000.0, 1.0, 8.0, 0.0), (100.0, 8000.0, 1.0, 8.0, 0.0)
    track = [(0.0, calm), (5.0, busy), (10.0, calm), (20.0, busy), (25.0, busy), (40.0, calm), (45.0, calm), (100.0, busy), (105.0, busy)]
    samples = spark.createDataFrame([("m", t, *v) for t, v in track], "k string, ts double, free_mb double, total_mb double, load1 double, cores double, swap_used_mb double")
    zoned = resources.zones(samples, "k", "ts")
    assert [r.zone for r in zoned.orderBy("ts").collect()] == ["green"] * 4 + ["red", "red", "green", "green", "red"]
    asks = spark.createDataFrame([(1, "m", 6.0), (2, "m", 26.0), (3, "m", 110.0), (4, "m", -5.0), (5, "none", 0.0)], "request int, k string, a double")
    got = {r.request: (r.waited, r.action) for r in resources.gate(asks, zoned, "request", "k", "a", "ts").collect()}
    assert got == {1: (0.0, "pass"), 2: (22.0, "resume"), 3: (302.0, "timeout_pass"), 4: (0.0, "bypass"), 5: (0.0, "bypass")}


def test_similarity_to_stated_queries_in_blocks(spark, rows):
    import random

    rng = random.Random(3)
    sets = lambda n: [sorted({rng.choice("abcdefghij") + rng.choice("abcdef") for _ in range(rng.randint(0, 12))}) for _ in range(n)]
    queries, records = list(enumerate(sets(9))), [(f"r{i:02d}", g) for i, g in enumerate(sets(40))]
    q, r = spark.createDataFrame(queries, "q int, grams array<string>"), spark.createDataFrame([*records, (None, ["ab"]), ("zz", None)], "r string, grams array<string>").repartition(3)
    score = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = []
    for i, g in queries:
        best = sorted(((-score(g, h), k) for k, h in records if set(g) & set(h) and score(g, h) >= 0.1))[:3]
        want += [(i, k, round(-s, 9), n + 1) for n, (s, k) in enumerate(best)] or [(i, None, None, None)]
    key = lambda t: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in (t[0], t[3]))
    got = [(x.q, x.r, x.score and round(x.score, 9), x["rank"]) for x in J.lexical_topk(q, r, "q", "r", k=3, least=0.1).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    parts = J.top_k(J._scored(r, q, "r", "q", "jaccard", 0.1, 3, block_grams=15), "__q", 3, [F.col("score").desc(), F.col("__r")])
    assert sorted((x["__q"], x["__r"], x["rank"]) for x in parts.collect()) == sorted((a, b, d) for a, b, _, d in want if b)
