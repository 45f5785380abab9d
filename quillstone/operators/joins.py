"""Lookups, coverage laws, interval, as-of and similarity joins.

Similarity against a stated query set (slides, notes) reads the rows once with the queries' postings at hand and moves the best of each
partition; interval joins meet on time buckets. Neither plans a nested loop. Strategy and skew are left to adaptive execution; nothing here forces a broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.functions import text as X
from quillstone.operators import overlaps
from quillstone.operators.ordered import last_before
from quillstone.operators.scratch import drop, keep, ranked


def lookup(left: DataFrame, right: DataFrame, key: str, values: list[str], required: bool = True) -> DataFrame:
    """``right``'s values by key. With ``required`` a missing key stops the job when the row is read."""
    r = right.select(F.col(key).alias("__k"), *values)
    out = left.join(r, F.col(key) == F.col("__k"), "left")
    if required:
        out = out.where(F.coalesce(F.assert_true(F.col("__k").isNotNull(), F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("boolean"), F.lit(True)))
    return out.drop("__k")


def topic_index(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """(topic, record_id, n_units): the records of each topic path, through the units' evidence ids, and how many of its units cite each. A row a record, so a topic of any size is no row of its own."""
    path = F.array_join("topic_path", " / ")
    e = evidence.select(F.col("evidence_id").alias("__e"), "record_id")
    rows = units.select(path.alias("topic"), "unit_id", F.explode("evidence_ids").alias("evidence_id")).join(e, F.col("evidence_id") == F.col("__e"))
    return rows.groupBy("topic", "record_id").agg(F.count_distinct("unit_id").alias("n_units"))


def alignment_check(records: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """One row: ids without evidence, evidence without a record, and ids that repeat, in one aggregation over the union."""
    both = records.select(F.col(key).alias("k"), F.lit(1).alias("r"), F.lit(0).alias("e")).unionAll(evidence.select(F.col(key).alias("k"), F.lit(0).alias("r"), F.lit(1).alias("e")))
    per = both.groupBy("k").agg(F.sum("r").alias("r"), F.sum("e").alias("e"))
    return per.agg(F.count_if((F.col("r") > 0) & (F.col("e") == 0)).alias("missing"), F.count_if((F.col("e") > 0) & (F.col("r") == 0)).alias("orphan"), F.count_if((F.col("r") > 1) | (F.col("e") > 1)).alias("repeated"))


def coverage_check(evidence: DataFrame, dispositions: DataFrame, relations: DataFrame) -> DataFrame:
    """Laws of coverage as (law, n_left_only, n_right_only, holds): every evidence id has a disposition, every image a relation row."""

    def law(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
        rows = left.select(F.col("id"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select("id", F.lit(0).alias("l"), F.lit(1).alias("r")))
        per = rows.groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        out = per.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("n_left_only"), F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("n_right_only"))
        return out.select(F.lit(name).alias("law"), "*", ((F.col("n_left_only") == 0) & (F.col("n_right_only") == 0)).alias("holds"))

    ids = lambda df, c: df.select(F.col(c).alias("id"))
    return law("dispositions", ids(evidence, "evidence_id"), ids(dispositions, "evidence_id")).unionAll(law("images", ids(evidence.where("kind = 'image'"), "evidence_id"), ids(relations, "evidence_id")))


def apply_corrections(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """Records with the sorted list of their corrections (empty if none); records are never dropped or changed."""
    c = corrections.groupBy(F.col("record_id").alias("__r")).agg(F.array_sort(F.collect_list(F.struct("original", "suggested"))).alias("corrections"))
    out = records.join(c, F.col("record_id") == F.col("__r"), "left").drop("__r")
    return out.withColumn("corrections", F.coalesce("corrections", F.array().cast("array<struct<original:string,suggested:string>>")))


def merge_dispositions(evidence: DataFrame, dispositions: DataFrame, excluded: DataFrame) -> DataFrame:
    """Dispositions completed to one for each evidence id.

    Known ones stay. Missing images are uncertain; missing audio of an excluded record is excluded_logistics; the rest is unreconciled.
    """
    d = dispositions.select(F.col("evidence_id").alias("__d"), "status")
    x = excluded.select(F.col("record_id").alias("__x")).distinct()
    out = evidence.join(d, F.col("evidence_id") == F.col("__d"), "left").join(x, F.col("record_id") == F.col("__x"), "left")
    filled = F.when(F.col("kind") == "image", "uncertain").when(F.col("__x").isNotNull(), "excluded_logistics").otherwise("unreconciled")
    return out.select("evidence_id", F.coalesce("status", filled).alias("status"), F.col("__d").isNull().alias("auto_filled"))


def reconcile_view(evidence: DataFrame, excluded: DataFrame) -> DataFrame:
    """Evidence whose id is in no excluded record's ``evidence_ids``."""
    gone = excluded.select(F.explode("evidence_ids").alias("__g")).distinct()
    return evidence.join(gone, F.col("evidence_id") == F.col("__g"), "left_anti")


def interval_overlap(points: DataFrame, ranges: DataFrame, start: str, end: str, r_start: str, r_end: str, bucket: float, keep: list[str], r_keep: list[str], on: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of closed intervals that meet: start <= r_end and end >= r_start.

    Both sides are dealt to the time buckets they touch; a pair is taken in the first bucket that both touch, so none repeats. Intervals
    with a null end or that end before they start are skipped. ``on`` are equal keys of both sides besides.
    """
    floor = lambda c: F.floor(F.col(c) / bucket)
    names = [f"__on{i}" for i in range(len(on))]
    left = points.where(F.col(start) <= F.col(end)).select(*keep, F.col(start).alias("__s"), F.col(end).alias("__e"), *(F.col(a).alias(n) for n, (a, _) in zip(names, on)))
    right = ranges.where(F.col(r_start) <= F.col(r_end)).select(*r_keep, F.col(r_start).alias("__rs"), F.col(r_end).alias("__re"), *(F.col(b).alias(f"{n}r") for n, (_, b) in zip(names, on)))
    left = left.withColumn("__b", F.explode(F.sequence(floor("__s"), floor("__e"))))
    right = right.withColumn("__rb", F.explode(F.sequence(floor("__rs"), floor("__re"))))
    match = F.col("__b") == F.col("__rb")
    for n in names:
        match = match & (F.col(n) == F.col(f"{n}r"))
    first = F.col("__b") == F.greatest(floor("__s"), floor("__rs"))
    return left.join(right, match & first & (F.col("__s") <= F.col("__re")) & (F.col("__e") >= F.col("__rs"))).select(*keep, *r_keep)


def _index(items: list) -> dict:
    """Query items (id, grams, document) as postings: for each gram the places of the items that have it, end to end."""
    grams = sorted({g for _, gs, _ in items for g in gs})
    at = {g: i for i, g in enumerate(grams)}
    pairs = sorted((at[g], n) for n, (_, gs, _) in enumerate(items) for g in gs)
    starts = np.searchsorted([g for g, _ in pairs], np.arange(len(grams) + 1)) if pairs else np.zeros(1, dtype=np.int64)
    return {"ids": [i for i, _, _ in items], "docs": [d for _, _, d in items], "sizes": np.array([len(g) for _, g, _ in items], dtype=np.int64), "grams": grams, "starts": starts, "places": np.array([n for _, n in pairs], dtype=np.int64)}


def _scorer(told, score: str, least: float, k: int | None, larger: bool, id_type: pa.DataType, query_type: pa.DataType):
    """Scores each row against all items of a block: its best item, or for each item the ``k`` best rows of the partition."""

    def run(batches):
        x = told.value
        known, n_items = pa.array(x["grams"], pa.string()), len(x["ids"])
        documents = np.array([str(d) for d in x["docs"]])
        held: list[tuple] = []  # (item, score, row id)
        floor = np.full(n_items, least)

        def thin() -> None:
            nonlocal held
            held.sort(key=lambda h: (h[0], -h[1], h[2]))
            out, last, n = [], None, 0
            for h in held:
                n = n + 1 if h[0] == last else 1
                last = h[0]
                if n <= k:
                    out.append(h)
                    if n == k:
                        floor[last] = max(floor[last], h[1])
            held = out

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x["ids"][i] for i, _, _ in found], query_type), pa.array([r for _, _, r in found], id_type), pa.array([float(s) for _, s, _ in found], pa.float64())], names=["__q", "__r", "score"])

        for batch in batches:
            lists = batch.column("g")
            places = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            best = []
            for i in range(batch.num_rows):
                mine = places[(ends[i - 1] if i else 0) : ends[i]]
                hit = [x["places"][x["starts"][g] : x["starts"][g + 1]] for g in mine[mine >= 0].tolist()]
                if not hit:
                    continue
                both = np.bincount(np.concatenate(hit), minlength=n_items)
                value = both / (x["sizes"] + len(mine) - both) if score == "jaccard" else both / np.maximum(np.minimum(x["sizes"], len(mine)), 1)
                ok = (both > 0) & (value >= floor)
                if "allowed" in batch.schema.names:
                    ok &= np.isin(documents, batch.column("allowed")[i].as_py() or [])
                at = np.flatnonzero(ok).tolist()
                if not at:
                    continue
                key = batch.column("r")[i].as_py()
                if k is None:
                    top = max(value[j] for j in at)
                    best.append(((max if larger else min)((j for j in at if value[j] == top), key=lambda j: x["ids"][j]), top, key))
                else:
                    held += [(j, value[j], key) for j in at]
                    if len(held) > 4 * k * n_items + 2_000:
                        thin()  # what an item's best rows don't reach is no longer gathered
            if k is None:
                yield rows(best)
        if k is not None:
            thin()
            yield rows(held)

    return run


def _scored(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, score: str, least: float, k: int | None, larger: bool = False, row_grams: str = "grams", query_grams: str = "grams", document: str | None = None, block_grams: int = 2_000_000) -> DataFrame:
    """(__q, __r, score) against a stated query set, in one pass over the rows for each block of it; rows with nulls for ids take no part.

    The queries (slides, notes, or the documents of one event) are gathered in blocks of about ``block_grams`` grams, which bounds what is broadcast;
    more blocks mean more passes. No pair is moved but the best of each partition.
    """
    spark = rows.sparkSession
    kind, query_kind = rows.schema[row_id].dataType, queries.schema[query_id].dataType
    asked = queries.where(F.col(query_id).isNotNull() & (F.size(query_grams) > 0)).select(F.col(query_id).alias("q"), F.col(query_grams).alias("g"), (F.col(document) if document else F.lit(None)).cast("string").alias("d"))
    total = asked.agg(F.sum(F.size("g")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_grams))
    source = rows.where(F.col(row_id).isNotNull() & (F.size(row_grams) > 0)).select(F.col(row_id).alias("r"), F.col(row_grams).alias("g"), *(["allowed"] if document else []))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        told = spark.sparkContext.broadcast(_index([(x["q"], x["g"], x["d"]) for x in part.collect()]))
        got = source.mapInArrow(_scorer(told, score, least, k, larger, to_arrow_type(kind), to_arrow_type(query_kind)), f"__q {query_kind.simpleString()}, __r {kind.simpleString()}, score double")
        if blocks > 1:
            got = keep(got)
            told.destroy()
        out = got if out is None else out.unionAll(got)
    return out


def top_k(pairs: DataFrame, key: str, k: int, order: list[Column], least: float | None = None) -> DataFrame:
    """The first ``k`` rows of each key, with their rank; Spark limits before the shuffle."""
    rows = pairs.where(F.col("score") >= least) if least is not None else pairs
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def lexical_topk(slides: DataFrame, records: DataFrame, slide_id: str, record_id: str, slide_grams: str = "grams", record_grams: str = "grams", k: int = 5, least: float = 0.03) -> DataFrame:
    """The ``k`` most similar records of each slide by bigram Jaccard, ties by record id; slides without any stay with nulls."""
    pairs = _scored(records, slides, record_id, slide_id, "jaccard", least, k, row_grams=record_grams, query_grams=slide_grams)
    best = top_k(pairs, "__q", k, [F.col("score").desc(), F.col("__r")]).withColumnRenamed("__r", record_id)
    return slides.select(slide_id).join(best, F.col(slide_id) == F.col("__q"), "left").drop("__q")


def best_document(records: DataFrame, documents: DataFrame, record_id: str, document_id: str, least: float = 0.02) -> DataFrame:
    """Each record's single best document by bigram Jaccard; ties go to the larger id. Rows that share a record_id give one."""
    pairs = _scored(records, documents, record_id, document_id, "jaccard", least, None, larger=True)
    return top_k(pairs, "__r", 1, [F.col("score").desc(), F.col("__q").desc()]).select(F.col("__r").alias(record_id), F.col("__q").alias(document_id), "score")


def note_topk(notes: DataFrame, records: DataFrame, eligible: DataFrame, note_id: str, record_id: str, source: str, document: str, k: int = 3, least: float = 0.03) -> DataFrame:
    """The ``k`` records that each note contains most, among records whose source opened the note's document (``eligible(source, document)``, a few documents a source)."""
    opened = eligible.groupBy(F.col(source).alias("__es")).agg(F.collect_set(F.col(document).cast("string")).alias("allowed"))
    rows = records.join(opened, F.col(source) == F.col("__es"))
    pairs = _scored(rows, notes, record_id, note_id, "containment", least, k, document=document)
    return top_k(pairs, "__q", k, [F.col("score").desc(), F.col("__r")]).select(F.col("__q").alias(note_id), F.col("__r").alias(record_id), "score", "rank")


def pair_scores(fragments: DataFrame, key: str, least: tuple[float, float, int] | None = None) -> DataFrame:
    """(a, b, overall, a_to_b, b_to_a, shared) for pairs a < b that share a keyword or an edge word: Jaccard of keywords, of one's tail with the other's head, and back.

    ``fragments(key, keywords, head, tail)`` carries sets of words, a row a key. Pairs that share nothing score 0 and are left out; ``least(overall, edge, shared)`` leaves out pairs with
    fewer shared keywords and those under both scores. Pairs are made where they go, in blocks (``overlaps``), and never shuffled.
    """
    return overlaps.scored(fragments, key, least)


def neighbor_cap(pairs: DataFrame, k: int = 4, score: str = "score") -> DataFrame:
    """Pairs (a, b, score) that at least one side counts among its ``k`` best; ties by the partner's id, so input order doesn't matter."""
    both = pairs.select(F.col("a").alias("me"), F.col("b").alias("you"), F.col(score).alias("score")).unionAll(pairs.select(F.col("b"), F.col("a"), F.col(score)))
    rank = F.row_number().over(Window.partitionBy("me").orderBy(F.col("score").desc(), "you"))
    kept = both.withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.select(F.least("me", "you").alias("a"), F.greatest("me", "you").alias("b"), "score").distinct()


def nearest_sets(left: DataFrame, right: DataFrame, key: str, left_words: str, right_words: str, k: int, least: float = 0.0, digits: int = 6, first: int = 4) -> DataFrame:
    """(me, you, score, rank): for each row of ``left`` its ``k`` best rows of ``right`` under another key, by Jaccard of their sets of words, ties by the partner's key.

    Exact, without the pairs that share a word. A row's words are probed from the rarest in ``right`` on, ``first`` of them in the first round, four times as many in all in each
    next one. Who shares none of the words probed shares at most the r that are left, so its score is at most r of n; once the k-th best found
    beats that (or ``least`` does), the row is done, and its frequent words, which meet the most partners, are never probed. Partners whose size alone rules them
    out are not compared either. Scores are rounded to ``digits`` before they are ranked; rows with null keys or without words have no partners. Rounds are kept in the shared folder.
    """
    hair = 10.0**-digits
    sets = lambda df, words, name: df.where(F.col(key).isNotNull()).select(F.col(key).alias(name), F.array_distinct(F.filter(words, lambda w: w.isNotNull())).alias("s")).where(F.size("s") > 0)
    targets = keep(sets(right, right_words, "you").withColumn("m", F.size("s")))
    posts = targets.select("you", "m", F.explode("s").alias("w"))
    rarity = posts.groupBy(F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("df"))
    mine = sets(left, left_words, "me")
    # a word's place in the row's own order of rarity; words that ``right`` doesn't have are never probed
    words = mine.select("me", F.explode("s").alias("w")).join(rarity, F.col("w") == F.col("v")).select("me", "w", "df")
    probes = words.withColumn("at", F.row_number().over(Window.partitionBy("me").orderBy("df", "w"))).select("me", "w", "at")
    probes = keep(probes)
    ends = probes.groupBy(F.col("me").alias("e")).agg(F.max("at").alias("known"))
    active = keep(mine.join(ends, F.col("me") == F.col("e")).select("me", "s", F.size("s").alias("n"), "known", F.lit(least).cast("double").alias("floor")))
    best, low, high = None, 0, first
    while True:
        some = probes.where((F.col("at") > low) & (F.col("at") <= high)).join(active.select(F.col("me").alias("a"), "n", "floor"), F.col("me") == F.col("a")).drop("a")
        fits = (F.col("m") >= F.col("n") * F.col("floor") - hair) & (F.col("n") >= F.col("m") * F.col("floor") - hair)
        met = some.join(posts.select("you", "m", F.col("w").alias("v")), (F.col("w") == F.col("v")) & (F.col("me") != F.col("you")) & fits).select("me", "you").distinct()
        met = met.join(active.select(F.col("me").alias("a"), F.col("s").alias("x")), F.col("me") == F.col("a")).join(targets.select(F.col("you").alias("b"), F.col("s").alias("y")), F.col("you") == F.col("b"))
        found = met.select("me", "you", F.round(X.jaccard(F.col("x"), F.col("y")), digits).alias("score")).where(F.col("score") >= least)
        # a pair that meets again in a later round is the same pair
        rows = found if best is None else best.select("me", "you", "score").unionByName(found).distinct()
        rank = F.row_number().over(Window.partitionBy("me").orderBy(F.col("score").desc(), "you"))
        new = keep(rows.withColumn("rank", rank).where(F.col("rank") <= k))
        last = new.where(F.col("rank") == k).select(F.col("me").alias("b"), F.col("score").alias("kth"))
        left_over = F.greatest(F.col("known") - high, F.lit(0)) / F.col("n")
        floor = F.greatest(F.coalesce("kth", F.lit(least)), F.lit(least))
        rest = active.join(last, F.col("me") == F.col("b"), "left").where((F.col("known") > high) & (left_over >= floor - hair)).select("me", "s", "n", "known", floor.alias("floor"))
        rest = keep(rest)
        for old in (best, active):
            if old is not None:
                drop(old)
        best, active, low, high = new, rest, high, 4 * high
        if active.isEmpty():
            break
    for old in (active, probes, targets):
        drop(old)
    return best


def nearest_pairs(fragments: DataFrame, key: str, k: int = 4) -> DataFrame:
    """(a, b, score): what ``neighbor_cap`` keeps of ``pair_scores`` by ``overall``, a row's best of each pair of blocks alone being moved. ``fragments(key, keywords)``."""
    kept = overlaps.nearest(fragments, key, [("keywords", "keywords")], k)
    return kept.select(F.least("me", "you").alias("a"), F.greatest("me", "you").alias("b"), "score").distinct()


def mutual_best_sets(fragments: DataFrame, key: str, least: float, gap: float) -> DataFrame:
    """(a, b, score): what ``mutual_best`` keeps of the scores of tails against heads, a row's two best of each pair of blocks alone being moved. ``fragments(key, head, tail)``.

    A side's two best partners tell its best and how far it stands before the next.
    """
    best = keep(overlaps.nearest(fragments, key, [("tail", "head"), ("head", "tail")], 2, least))

    def side(s: int) -> DataFrame:
        at = lambda n: F.max(F.when(F.col("rank") == n, F.struct("you", "score")))
        rows = best.where(F.col("side") == s).groupBy("me").agg(at(1).alias("x"), at(2).alias("y"))
        return rows.where(F.col("x.score") - F.coalesce("y.score", F.lit(0.0)) >= gap).select("me", "x.you", "x.score")

    out, back = side(0), side(1).select(F.col("me").alias("b2"), F.col("you").alias("a2"))
    return out.join(back, (F.col("me") == F.col("a2")) & (F.col("you") == F.col("b2"))).select(F.col("me").alias("a"), F.col("you").alias("b"), "score")


def asof(probes: DataFrame, records: DataFrame, on: str, probe_time: str, record_time: str, record_id: str, keep: list[str]) -> DataFrame:
    """For each probe the last record of its key that begins at or before it (ties: the larger id), or null.

    One union along one order, whose state, the last record, runs on over range partitions: a key of any size is spread over many tasks.
    """
    a = probes.select(F.col(on).alias(on), F.col(probe_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*keep).alias("__keep"), F.lit(None).cast(records.schema[record_id].dataType).alias("__id"))
    b = records.select(F.col(on), F.col(record_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__keep"].dataType).alias("__keep"), F.col(record_id).alias("__id"))
    found = last_before(a.unionByName(b), on, ["__t", "__side", "__id"], "__id", "__last")
    return found.where("__side = 1").select(on, "__keep.*", F.col("__last").alias(record_id))


def evidence_packet(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """Units with their evidence rows nested, sorted by id; unknown ids are left out."""
    e = evidence.select(F.col("evidence_id").alias("__e"), "literal_text")
    rows = units.select("unit_id", F.explode_outer("evidence_ids").alias("evidence_id")).join(e, F.col("evidence_id") == F.col("__e"), "left")
    packed = F.array_sort(F.collect_list(F.when(F.col("__e").isNotNull(), F.struct("evidence_id", "literal_text"))))
    return rows.groupBy("unit_id").agg(packed.alias("evidence"))


def route_select(candidates: DataFrame, window: str) -> DataFrame:
    """Per window the routes of three engines with the highest mean similarity of their texts, the first combination of equals.

    ``candidates(window, engine, route, text)``: routes of a window are few (3 x 3), so their combinations meet inside one row.
    """
    per = candidates.groupBy(window).agg(*(F.array_sort(F.collect_list(F.when(F.col("engine") == e, F.struct("route", "text")))).alias(e) for e in ("a", "b", "c")))
    combos = F.flatten(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.transform("c", lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))
    rows = per.select(window, F.posexplode(combos).alias("ordinal", "m"))
    sim = lambda p, q: X.edit_similarity(F.col(f"m.{p}.text"), F.col(f"m.{q}.text"))
    rows = rows.withColumn("score", (sim("x", "y") + sim("x", "z") + sim("y", "z")) / 3)
    first = F.row_number().over(Window.partitionBy(window).orderBy(F.col("score").desc(), "ordinal"))
    return rows.withColumn("n", first).where("n = 1").select(window, F.col("m.x.route").alias("route_a"), F.col("m.y.route").alias("route_b"), F.col("m.z.route").alias("route_c"), "score")


def deletions(c: Column) -> Column:
    """A word and all it becomes with one character left out; distinct."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))


def reading_keys(words: DataFrame, word: str, readings: DataFrame) -> DataFrame:
    """(word, reading) of distinct words: their characters' readings in order, a character without one for itself. ``readings(character, reading)``, the least of several."""
    one = readings.groupBy(F.col("character").alias("__c")).agg(F.min("reading").alias("__r"))
    chars = words.select(F.col(word).alias("word")).where(F.length(word) > 0).distinct().select("word", F.posexplode(F.split("word", "")).alias("at", "c")).where("c <> ''")
    met = chars.join(one, F.col("c") == F.col("__c"), "left").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("__r", "c").alias("r")))).alias("k"))
    return met.select("word", F.array_join("k.r", " ").alias("reading"))


def fuzzy_terms(records: DataFrame, terms: DataFrame, most: int = 5, readings: DataFrame | None = None) -> DataFrame:
    """Suggested corrections (record_id, original, suggested, page): Latin tokens within one edit of an OCR term and CJK windows of equal length with one different character or, with ``readings``, with the same reading.

    ``records(record_id, tokens)``, ``terms(page, term)`` with page an ordinal. Pairs meet on deletion neighbourhoods and on readings. Equal texts (case aside) are no
    correction. The earliest page of a pair counts; ``most`` a record, by page, original and suggestion.
    """
    cjk = f"^[{X.CJK_WIDE}]+$"
    a = records.select("record_id", F.explode(F.array_distinct("tokens")).alias("original")).withColumn("lo", F.lower("original"))
    b = terms.select("page", F.col("term").alias("suggested")).groupBy("suggested").agg(F.min("page").alias("page")).withColumn("ls", F.lower("suggested"))
    left = a.select("record_id", "original", "lo", F.explode(deletions(F.col("lo"))).alias("d"))
    right = b.select("suggested", "page", "ls", F.explode(deletions(F.col("ls"))).alias("e"))
    near = left.join(right, F.col("d") == F.col("e")).where((F.col("lo") != F.col("ls")) & X.within_one_edit(F.col("lo"), F.col("ls")))
    near = near.where(~F.col("lo").rlike(cjk) | (F.col("ls").rlike(cjk) & (F.length("lo") == F.length("ls")))).select("record_id", "original", "suggested", "page")
    if readings is not None:
        spoken = lambda df, w, r: df.join(reading_keys(df.where(F.col(w).rlike(cjk)), w, readings).withColumnsRenamed({"word": f"__{w}", "reading": r}), F.col(w) == F.col(f"__{w}"))
        alike = spoken(a, "original", "ra").join(spoken(b, "suggested", "rb"), (F.col("ra") == F.col("rb")) & (F.length("original") == F.length("suggested")) & (F.col("original") != F.col("suggested")))
        near = near.unionByName(alike.select("record_id", "original", "suggested", "page"))
    one = near.groupBy("record_id", "original", "suggested").agg(F.min("page").alias("page"))
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy("page", "original", "suggested"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most)


def prefix_first(files: DataFrame, sources: DataFrame, file: str, stem: str, ordinal: str) -> DataFrame:
    """For each file the first source, by ordinal, whose stem it begins with: an equi-join on the file's prefixes of the lengths that stems have."""
    s = sources.select(F.col(stem).alias("__stem"), F.col(ordinal).alias("__o")).where(F.length("__stem") > 0)
    lengths = s.agg(F.collect_set(F.length("__stem")).alias("n")).scalar()
    prefixes = F.transform(F.filter("__n", lambda n: n <= F.length(file)), lambda n: F.substring(F.col(file), F.lit(1), n))
    rows = files.withColumn("__n", lengths).select(file, F.explode(prefixes).alias("__p")).join(s, F.col("__p") == F.col("__stem"))
    return rows.groupBy(file).agg(F.min(F.struct("__o", "__stem")).alias("m")).select(file, F.col("m.__stem").alias(stem))


def mutual_best(scores: DataFrame, least: float = 0.20, margin: float = 0.05) -> DataFrame:
    """(a, b, score): directed pairs where b is a's best successor and a is b's best predecessor, each by ``margin`` over the next."""
    s = scores.where(F.col("score") >= least)

    def ranked(me: str, you: str) -> DataFrame:
        w = Window.partitionBy(me).orderBy(F.col("score").desc(), you)
        return s.select("a", "b", "score", F.row_number().over(w).alias("n"), (F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).alias("gap")).where(f"n = 1 AND gap >= {margin}").select("a", "b", "score")

    return ranked("a", "b").join(ranked("b", "a"), ["a", "b", "score"], "left_semi")


def derived_upsert(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """Derived rows replaced by fresh ones, with ids that go on from the largest; applying it twice changes nothing but the order of ids.

    ``fresh`` is ordered by derived_from and path, over range partitions.
    """
    kept = manifest.where(F.col("derived_from").isNull())
    base = kept.agg(F.coalesce(F.max(F.regexp_extract("source_id", r"(\d+)$", 1).cast("long")), F.lit(0)).alias("base"))
    new = ranked(fresh, ["derived_from", "path"], "__place").withColumn("source_id", F.format_string("F%06d", base.scalar() + F.col("__place"))).drop("__place")
    return kept.unionByName(new, allowMissingColumns=True)


def resume_pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an accepted earlier row: one with text, or one that is known to be empty."""
    ok = done.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.col("status") == "empty")).select(F.col(key).alias("__k"))
    return inputs.join(ok, F.col(key) == F.col("__k"), "left_anti")


def same_multiset(plan: DataFrame, submitted: DataFrame, key: str, value: str) -> DataFrame:
    """Per key whether the submitted values are a permutation of the planned ones."""
    a = plan.select(F.col(key).alias("k"), F.col(value).alias("v"), F.lit(1).alias("n"))
    b = submitted.select(F.col(key).alias("k"), F.col(value).alias("v"), F.lit(-1).alias("n"))
    return a.unionAll(b).groupBy("k", "v").agg(F.sum("n").alias("n")).groupBy(F.col("k").alias(key)).agg((F.max(F.abs("n")) == 0).alias("confirmed"))


def track_duration(tracks: DataFrame, sources: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """Tracks with ok / short / unknown: short under ``least`` of their own source, unknown without a source or its duration."""
    s = sources.select(F.col(key).alias("__k"), F.col("duration").alias("source_duration"))
    out = tracks.join(s, F.col(key) == F.col("__k"), "left").drop("__k")
    return out.withColumn("state", F.when(F.coalesce("source_duration", F.lit(0.0)) <= 0, "unknown").when(F.col("duration") < least * F.col("source_duration"), "short").otherwise("ok"))


def hash_mismatch(manifest: DataFrame, current: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, state) for files that changed, went or came since the manifest."""
    m, c = manifest.select(F.col(key).alias("a"), F.col(digest).alias("x")), current.select(F.col(key).alias("b"), F.col(digest).alias("y"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("x") != F.col("y"), "changed")
    return m.join(c, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias(key), state.alias("state")).where("state IS NOT NULL")


def carry_over_images(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh evidence with the image rows of the old; ids are dropped and given anew by ``windows.assign_ids``."""
    return fresh.drop("evidence_id").unionByName(old.where("kind = 'image'").drop("evidence_id"), allowMissingColumns=True)


def note_hint(fragments: DataFrame, notes: DataFrame, key: str, least: float = 0.10) -> DataFrame:
    """Each fragment's best note line: 1.0 where the line contains the first 24 characters (6 at least) of head or tail, else Jaccard of words; first best wins.

    Meets on shared words; a containing line shares the words inside the 24 characters.
    """
    edges = fragments.select(key, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("head_text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("tail_text").alias("t")))).alias("e")).select(key, "e.*")
    edges = edges.withColumn("w", X.words("t")).withColumn("lead", F.substring("t", 1, 24))
    lines = notes.select("line_no", F.col("text").alias("line"), X.words("text").alias("lw"))
    met = edges.select(key, "side", F.explode("w").alias("g")).join(lines.select("line_no", F.explode("lw").alias("h")), F.col("g") == F.col("h")).select(F.col(key).alias("__k"), F.col("side").alias("__s"), F.col("line_no").alias("__l")).distinct()
    rows = met.join(edges, (F.col("__k") == F.col(key)) & (F.col("__s") == F.col("side"))).join(lines, F.col("__l") == F.col("line_no"))
    score = F.when((F.length("lead") >= 6) & F.contains("line", "lead"), 1.0).otherwise(X.jaccard(F.col("w"), F.col("lw")))
    return top_k(rows.withColumn("score", score), key, 1, [F.col("score").desc(), F.col("line_no"), F.col("side")], least).select(key, "line_no", "score")


def timeline_start(events: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Each event's first ``event_start`` time, null if none."""
    first = log.where("kind = 'event_start'").groupBy(F.col(key).alias("__k")).agg(F.min_by("ts", "ordinal").alias("started"))
    return events.join(first, F.col(key) == F.col("__k"), "left").drop("__k")
