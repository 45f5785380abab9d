"""Search over packages: full text with BM25, LIKE tiers, transcript context, packets, listings.

A token is a literal substring and white space means AND between tokens; there is no query grammar. Full text knows trigrams, so tokens of
fewer than three characters are no part of it. ``LIKE`` wildcards in a token keep their meaning. Privacy filters come before every tier.
A query is a few words that the caller holds, so it is part of the plan. Without an index tables are read once for counts and once for hits of each tier that is asked; with a
``TextIndex`` of kinds ``unit`` (topic, claim) and ``record`` (clean_literal) the postings of the query's trigrams are read instead. Hits are written once, as what follows asks for them more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators.fulltext import TextIndex
from quillstone.operators.scratch import keep

CERTAINTY = "CASE certainty WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


def trigram_sizes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size): the number of trigrams of each row; rows of fewer than three characters have none."""
    return rows.select(F.col(key).alias("key"), F.length(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("n")).where("n >= 3").select("key", (F.col("n") - 2).alias("size")).distinct()


def asked_grams(queries: DataFrame) -> DataFrame:
    """(query, g): the distinct case-folded trigrams of ``queries(query)``."""
    return queries.select("query", F.explode(F.array_distinct(X.grams(F.lower("query"), 3))).alias("g")).where(F.length("g") == 3)


def trigram_postings(rows: DataFrame, key: str, text: str, queries: DataFrame | None = None) -> DataFrame:
    """(gram, key, tf, size): case-folded trigrams of each row with their number; rows of fewer than three characters have none.

    With ``queries(query)`` only the trigrams they ask for, each looked for in each row, which suits a few queries; ``bm25`` then needs
    ``trigram_sizes`` of the same rows.
    """
    t = rows.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t")).where(F.length("t") >= 3)
    if queries is not None:
        listed = asked_grams(queries).agg(F.collect_set("g").alias("a")).scalar()
        found = t.withColumn("a", listed).select("key", "t", F.explode(F.filter("a", lambda g: F.contains(F.col("t"), g))).alias("gram"))
        # a look-ahead counts occurrences that overlap
        quoted = F.concat(F.lit(r"(?=\Q"), F.replace("gram", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
        return found.groupBy("gram", "key", (F.length("t") - 2).alias("size")).agg(F.sum(F.regexp_count("t", quoted)).alias("tf"))
    # sizes and grams first: beside an explode the text would go along with each of its grams
    grams = t.select("key", (F.length("t") - 2).alias("size"), X.grams(F.col("t"), 3).alias("grams")).select("key", "size", F.explode("grams").alias("gram"))
    return grams.groupBy("gram", "key", "size").agg(F.count(F.lit(1)).alias("tf"))


def bm25(postings: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, sizes: DataFrame | None = None) -> DataFrame:
    """(query, key, score, matched, asked): trigram BM25 of rows that have all of a query's trigrams; higher is better.

    Queries shorter than three characters match nothing here. ``queries(query)`` is any number of rows; it joins by gram.
    ``sizes(key, size)`` are all rows with trigrams, where the postings hold those of the queries only.
    """
    docs = (postings.select("key", "size").distinct() if sizes is None else sizes).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    asked = asked_grams(queries)
    asked = asked.withColumn("asked", F.count(F.lit(1)).over(Window.partitionBy("query")))
    df = postings.groupBy(F.col("gram").alias("d")).agg(F.count(F.lit(1)).alias("df"))
    hits = postings.join(asked, F.col("gram") == F.col("g")).join(df, F.col("gram") == F.col("d")).withColumn("n", docs.select("n").scalar()).withColumn("mean", docs.select("mean").scalar())
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return hits.groupBy("query", "key", "asked").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched")).where("matched = asked")


K1, B = 1.2, 0.75


def phrases_of(query: str) -> list[str]:
    """What a query asks of the full text: its words of three characters and more, case folded."""
    return list(dict.fromkeys(w.lower() for w in query.split() if len(w) >= 3))


def _times(word: str, *columns: str) -> Column:
    """How often a word stands in the columns, occurrences that overlap included."""
    quoted = "(?=\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E)"
    one = lambda c: F.when(F.contains(F.lower(c), F.lit(word)), F.regexp_count(F.lower(c), F.lit(quoted))).otherwise(0)
    return sum((one(c) for c in columns), F.lit(0)).cast("long")


def _size(*columns: str) -> Column:
    """Trigrams of the columns."""
    return sum((F.greatest(F.length(F.coalesce(c, F.lit(""))) - 2, F.lit(0)) for c in columns), F.lit(0)).cast("long")


def match(units: DataFrame, words: list[str], by: list[str], *columns: str) -> DataFrame:
    """The rows of ``units`` with size, tf (array, one count a word) and idf (array) and mean: BM25's parts, over all rows of the same ``by``.

    Number of rows, mean size and the words' row counts are of the whole table, whatever is filtered later. Rows without any of the words are left out.
    """
    rows = units.withColumn("tf", F.array(*(_times(w, *columns) for w in words)).cast("array<bigint>")).withColumn("size", _size(*columns))
    few = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(words)))).alias("df"))
    idf = F.transform("df", lambda d: F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(1e-6)))
    few = few.select(*(f"__{c}" for c in by), "mean", idf.alias("idf"))
    hits = rows.where(F.exists("tf", lambda x: x > 0))
    if not by:
        return hits.withColumn("mean", few.select("mean").scalar()).withColumn("idf", few.select("idf").scalar())
    same = [F.col(c) == F.col(f"__{c}") for c in by]
    return hits.join(few, same).drop(*(f"__{c}" for c in by))


def bm25_of(places: list[int]) -> Column:
    """BM25 of the words at these places of tf and idf; null unless the row has them all."""
    at = lambda c, i: F.get(c, F.lit(i))
    part = lambda i: at("idf", i) * (at("tf", i) * (K1 + 1)) / (at("tf", i) + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    has = F.lit(bool(places))
    for i in places:
        has = has & (at("tf", i) > 0)
    return F.when(has, sum((part(i) for i in places), F.lit(0.0)))


def _indexed_token(index: TextIndex, token: str, limit: int, records: DataFrame | None) -> DataFrame:
    """``search_token`` from an index: a tier is asked only if those before it found nothing. The driver sees the ``limit`` hits of a tier."""
    words = phrases_of(token)
    top = lambda hits, key: hits.select("chunk", "local", "id", key.alias("key")).orderBy("key", "id").limit(limit).collect()
    tiers = [
        lambda: top(index.seats(index.best("unit", words, limit), "unit"), -F.col("score")) if words else [],
        lambda: top(index.seats(index.holds("unit", token), "unit", "certainty"), F.expr(CERTAINTY).cast("double")),
        lambda: top(index.seats(index.holds("record", token), "record"), F.lit(0.0)) if records is None else [],
    ]
    for tier, ask in enumerate(tiers, 1):
        if found := ask():
            rows = index.spark.createDataFrame([(tier, r["id"], n, r["chunk"], r["local"]) for n, r in enumerate(found, 1)], "tier int, id string, rank int, chunk long, local int")
            kind, field = ("record", 0) if tier == 3 else ("unit", 1)
            return index.texts(rows, kind, field).select("tier", "id", "text", "rank")
    if records is None:
        return index.spark.createDataFrame([], "tier int, id string, text string, rank int")
    rows = records.where(F.col("clean_literal").ilike(f"%{token}%")).orderBy("record_id").limit(limit)
    return rows.select(F.lit(3).alias("tier"), F.col("record_id").alias("id"), F.col("clean_literal").alias("text"), F.row_number().over(Window.orderBy("record_id")).alias("rank"))


def search_token(units: DataFrame | None, records: DataFrame | None, token: str, limit: int = 20, fulltext: bool = True, index: TextIndex | None = None) -> DataFrame:
    """(tier, id, text, rank): the first tier with hits of: full text over topic and claim, LIKE on claim or topic, LIKE on the records.

    Tier 1 ranks by BM25 of the token's words over all units; a word of three characters and more is one phrase of trigrams. LIKE ignores case. Each
    tier keeps its first ``limit`` rows: by score, or by certainty, then by id; it is asked only if those before it found nothing. With an ``index`` the tables aren't read, but for ``records`` that are given.
    """
    if index is not None:
        return _indexed_token(index, token, limit, records)
    pattern = f"%{token}%"
    words = phrases_of(token) if fulltext else []
    like = units.where(F.col("claim").ilike(pattern) | F.col("topic").ilike(pattern))
    second = like.select(F.lit(2).alias("tier"), F.col("unit_id").alias("id"), F.col("claim").alias("text"), F.expr(CERTAINTY).cast("double").alias("key"))
    third = records.where(F.col("clean_literal").ilike(pattern)).select(F.lit(3).alias("tier"), F.col("record_id").alias("id"), F.col("clean_literal").alias("text"), F.lit(0.0).alias("key"))
    tiers = [second, third]
    if words:
        scored = match(units, words, [], "topic", "claim").withColumn("score", bm25_of(list(range(len(words))))).where("score IS NOT NULL")
        tiers.insert(0, scored.select(F.lit(1).alias("tier"), F.col("unit_id").alias("id"), F.col("claim").alias("text"), (-F.col("score")).alias("key")))
    for rows in tiers:
        out = keep(rows.orderBy("key", "id").limit(limit))
        if not out.isEmpty():
            break
    return out.select("tier", "id", "text", F.row_number().over(Window.partitionBy("tier").orderBy("key", "id")).alias("rank"))


def tokens_of(query: str) -> list[str]:
    """What a query falls into when the whole finds nothing: its words, or the 2-grams of its CJK runs if it is one word."""
    import re

    parts = query.split()
    if len(parts) > 1:
        return parts
    runs = re.findall(f"[{X.CJK}]{{2,}}", query)
    return sorted({r[i : i + 2] for r in runs for i in range(len(r) - 1)})


def _first(rows: DataFrame, by: list[str], order: list, limit: int, name: str, salt: int = 64) -> DataFrame:
    """The first ``limit`` rows of each group with their rank; a large group is thinned in ``salt`` parts first, so no task orders all of it."""
    part = F.pmod(F.xxhash64("id"), F.lit(salt))
    rows = rows.withColumn("__part", part).withColumn(name, F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))).where(F.col(name) <= limit)
    return rows.drop("__part").withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= limit)


def _looked_up(index: TextIndex, event: str, asked: list[tuple[str, int]], words: list[str]) -> DataFrame:
    """(event, kind, id, tier, ordinal, key) of all hits, from an index; each event's units are counted alone."""
    n = len(words)
    stats = index.stats.where("kind = 'unit'").select(F.col("event").alias("__e"), F.col("n"), (F.col("size") / F.col("n")).alias("mean"))
    hits = index.match("unit", words)
    df = hits.groupBy(F.col("event").alias("__d")).agg(F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(n))).alias("df"))
    few = stats.join(df, F.col("__e").eqNullSafe(F.col("__d"))).withColumn("idf", F.transform("df", lambda d: F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(1e-6)))).select("__e", "mean", "idf")
    scored = hits.join(few, F.col("event").eqNullSafe(F.col("__e")))
    full = [F.struct(F.lit(o).alias("ordinal"), (-bm25_of([words.index(w) for w in phrases_of(t)])).alias("key")) for t, o in asked]
    found = scored.select("event", "chunk", "local", "id", "certainty", F.explode(F.filter(F.array(*full), lambda h: h["key"].isNotNull())).alias("h")).select("event", "chunk", "local", "id", "certainty", F.lit(1).alias("tier"), "h.*")
    spoken = None
    for t, o in asked:
        found = found.unionByName(index.holds("unit", t).select("*", F.lit(2).alias("tier"), F.lit(o).alias("ordinal"), F.lit(None).cast("double").alias("key")))
        more = index.holds("record", t).select("*", F.lit(3).alias("tier"), F.lit(o).alias("ordinal"), F.lit(0.0).alias("key"))
        spoken = more if spoken is None else spoken.unionByName(more)
    found = index.seats(found, "unit", "certainty").withColumn("key", F.coalesce("key", F.expr(CERTAINTY).cast("double")))
    rows = lambda hits, kind: hits.select(F.col("event").alias(event), F.lit(kind).alias("kind"), "id", "tier", "ordinal", "key")
    return rows(found, "unit").unionByName(rows(index.seats(spoken, "record"), "record"))


def search(units: DataFrame | None, records: DataFrame | None, query: str, event: str = "event", limit: int = 20, index: TextIndex | None = None) -> DataFrame:
    """(event, kind, id, matched, rank): the whole query first; where an event has no hit for it, its tokens, most matched first.

    Each event is a package of its own: its units' BM25 counts its units alone. Per event and token the first tier with hits holds: full text, LIKE on
    units, LIKE on records, ``limit`` rows of each. Tokens' hits merge by how many tokens they match; ties by the first token and the place there.
    Units and records rank apart, ``limit`` of each an event. Texts don't move: hits are ids, which ``cite`` joins with what they cite.
    """
    parts = tokens_of(query)
    asked = [(query, 0)] + [(t, i + 1) for i, t in enumerate(parts) if t != query]
    words = list(dict.fromkeys(w for t, _ in asked for w in phrases_of(t))) or ["\0\0\0"]
    rows = keep(_scanned(units, records, event, asked, words) if index is None else _looked_up(index, event, asked, words))
    # one row an event and token: its tier; and of the whole query and the tokens what comes first
    best = rows.groupBy(F.col(event).alias("e"), F.col("ordinal").alias("o")).agg(F.min("tier").alias("t"))
    best = best.withColumn("whole", F.min("o").over(Window.partitionBy("e")) == 0).where("whole = (o = 0)")
    rows = rows.join(best, (F.col(event) == F.col("e")) & (F.col("ordinal") == F.col("o")) & (F.col("tier") == F.col("t"))).select(event, "kind", "id", "ordinal", "key")
    rows = _first(rows, [event, "ordinal"], ["key", "id"], limit, "place")
    merged = rows.groupBy(event, "kind", "id").agg(F.count(F.lit(1)).alias("matched"), F.min(F.struct("ordinal", "place")).alias("seen"))
    return _first(merged, [event, "kind"], [F.col("matched").desc(), "seen"], limit, "rank").drop("seen")


def _scanned(units: DataFrame, records: DataFrame, event: str, asked: list[tuple[str, int]], words: list[str]) -> DataFrame:
    """(event, kind, id, tier, ordinal, key) of all hits, from the tables."""
    hit = lambda tier, n, key: F.struct(F.lit(tier).alias("tier"), F.lit(n).alias("ordinal"), key.alias("key"))
    some = F.filter(F.col("hits"), lambda h: h["key"].isNotNull())

    def listed(rows: DataFrame, kind: str, name: str, hits: list[Column]) -> DataFrame:
        rows = rows.select(event, F.lit(kind).alias("kind"), F.col(name).alias("id"), F.array(*hits).alias("hits"))
        return rows.select(event, "kind", "id", F.explode(some).alias("h")).select(event, "kind", "id", "h.*")

    scored = match(units, words, [event], "topic", "claim")
    full = listed(scored, "unit", "unit_id", [hit(1, n, -bm25_of([words.index(w) for w in phrases_of(t)])) for t, n in asked])
    seen = lambda *c: lambda t: sum((F.coalesce(F.col(x).ilike(f"%{t}%"), F.lit(False)).cast("int") for x in c), F.lit(0)) > 0
    like = listed(units, "unit", "unit_id", [hit(2, n, F.when(seen("claim", "topic")(t), F.expr(CERTAINTY).cast("double"))) for t, n in asked])
    spoken = listed(records, "record", "record_id", [hit(3, n, F.when(seen("clean_literal")(t), F.lit(0.0))) for t, n in asked])
    return full.unionByName(like).unionByName(spoken)


def response(hits: DataFrame, events: DataFrame, event: str = "event") -> DataFrame:
    """(event, units, evidence): ids in rank order of each event that has hits; if none has, the first event with nothing. Lists hold ``search``'s limit at most."""
    hits = keep(hits)
    ids = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "id")))), lambda x: x["id"])
    got = hits.groupBy(event).agg(ids("unit").alias("units"), ids("record").alias("evidence"))
    none = events.agg(F.min(event).alias(event)).select(event, F.array().cast("array<string>").alias("units"), F.array().cast("array<string>").alias("evidence"))
    return got.unionByName(none.where((hits.agg(F.count(F.lit(1)).alias("n")).scalar() == 0) & F.col(event).isNotNull()))


def transcript_context(records: DataFrame, asks: DataFrame, event: str = "event", context: int = 3) -> DataFrame:
    """(ask, event, record_id, position, line): the record each ask names, by record_id or else the last that starts by around_seconds, with ``context`` records on both sides.

    ``asks(ask, event, record_id, around_seconds)``, ``records(event, record_id, start_seconds, clean_literal, label)``. A line marks the asked record by
    an arrow and has its clock, text and the labels logistics and uncertain. Asks for records or events that don't exist give no rows.
    """
    w = Window.partitionBy(event).orderBy("record_id")
    placed = records.withColumn("__at", F.row_number().over(w))
    a = asks.select("ask", F.col(event).alias("__e"), F.col("record_id").alias("__r"), "around_seconds")
    named = a.where("__r IS NOT NULL").join(placed.select(event, "record_id", "__at"), (F.col("__e") == F.col(event)) & (F.col("__r") == F.col("record_id"))).select("ask", "__e", "__at")
    # as of: asks and records in one order of time, the last record before each ask
    times = placed.select(F.col(event).alias("__e"), F.col("start_seconds").alias("__t"), F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"), F.col("__at").alias("__p"), F.col("record_id").alias("__i"), F.lit(0).alias("__k"))
    when = a.where("__r IS NULL").select("__e", F.coalesce("around_seconds", F.lit(0.0)).alias("__t"), "ask", F.lit(None).cast("int").alias("__p"), F.lit(None).cast(records.schema["record_id"].dataType).alias("__i"), F.lit(1).alias("__k"))
    before = Window.partitionBy("__e").orderBy("__t", "__k", "__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = times.unionByName(when).withColumn("__at", F.last("__p", ignorenulls=True).over(before)).where("__k = 1 AND __at IS NOT NULL").select("ask", "__e", "__at")
    seats = named.unionByName(timed).select("ask", "__e", F.col("__at").alias("__target"), F.explode(F.sequence(F.col("__at") - context, F.col("__at") + context)).alias("__seat"))
    out = seats.join(placed, (F.col("__e") == F.col(event)) & (F.col("__seat") == F.col("__at")))
    mark = F.when(F.col("__seat") == F.col("__target"), "→").otherwise(" ")
    tag = F.when(F.col("label").isin("logistics", "uncertain"), F.concat(F.lit(" ["), "label", F.lit("]"))).otherwise("")
    line = F.concat(mark, F.lit(" "), "record_id", F.lit(" ["), X.clock("start_seconds"), F.lit("] "), "clean_literal", tag)
    return out.select("ask", event, "record_id", (F.col("__seat") - F.col("__target")).alias("position"), line.alias("line"))


def uncertainties(units: DataFrame, relations: DataFrame, event: str = "event", limit: int = 20, width: int = 120) -> DataFrame:
    """(event, kind, position, line): each event's first ``limit`` units of low or medium certainty, and its note conflicts, cut to ``width`` characters by their definition.

    ``relations(event, note_id, relation, detail)``: those whose relation is conflict.
    """
    rows = units.where(F.col("certainty").isin("low", "medium")).select(event, F.col("unit_id").alias("id"), "certainty", F.concat("unit_id", F.lit(" ["), "certainty", F.lit("] "), "claim").alias("line"))
    first = _first(rows, [event], ["certainty", "id"], limit, "position").select(event, F.lit("unit").alias("kind"), "position", "line")
    notes = relations.where("relation = 'conflict'").withColumn("position", F.row_number().over(Window.partitionBy(event).orderBy("note_id", "detail")))
    return first.unionByName(notes.select(event, F.lit("note").alias("kind"), "position", F.substring(F.concat("note_id", F.lit(" · conflict · "), "detail"), 1, width).alias("line")))


def packet(units: DataFrame, evidence: DataFrame, query: str, limit: int = 8, index: TextIndex | None = None) -> DataFrame:
    """(tier, id, rank, text, evidence): units by full text, else by LIKE, each with its evidence rows; else evidence whose text has the query.

    ``evidence(evidence_id, source_id, kind, literal_text)``; a unit's evidence is ordered by id, ids without a row are left out.
    """
    spoken = evidence.select(F.col("evidence_id").alias("record_id"), F.col("literal_text").alias("clean_literal"))
    hits = search_token(units, spoken, query, limit, index=index)
    ids = hits.where("tier < 3").join(units.select("unit_id", F.explode("evidence_ids").alias("e")), F.col("id") == F.col("unit_id")).select("id", "e")
    found = ids.join(evidence.select("evidence_id", "source_id", "kind"), F.col("e") == F.col("evidence_id")).groupBy(F.col("id").alias("u")).agg(F.sort_array(F.collect_list(F.struct("evidence_id", "source_id", "kind"))).alias("evidence"))
    return hits.join(found, F.col("id") == F.col("u"), "left").select("tier", "id", "rank", "text", "evidence")


def cite(hits: DataFrame, units: DataFrame, records: DataFrame) -> DataFrame:
    """Search hits with text, certainty and evidence ids (units) or times (records)."""
    u = units.select(F.col("unit_id").alias("__u"), F.col("claim").alias("__c"), "certainty", "evidence_ids")
    r = records.select(F.col("record_id").alias("__r"), F.col("clean_literal").alias("__l"), "start_seconds", "end_seconds")
    out = hits.join(u, (F.col("kind") == "unit") & (F.col("id") == F.col("__u")), "left").join(r, (F.col("kind") == "record") & (F.col("id") == F.col("__r")), "left")
    return out.withColumn("text", F.coalesce("__c", "__l")).withColumn("at", F.when(F.col("start_seconds").isNotNull(), F.concat_ws("-", X.minutes("start_seconds"), X.minutes("end_seconds")))).drop("__u", "__r", "__c", "__l", "start_seconds", "end_seconds")


def uncertain_units(units: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` units of low or medium certainty, ordered by the certainty's name (low comes first) and id."""
    return units.where(F.col("certainty").isin("low", "medium")).orderBy("certainty", "unit_id").limit(limit)


def list_events(listing: DataFrame, gates: DataFrame, event: str) -> DataFrame:
    """Event statistics with the gate's status, ``unknown`` without one; private events are hidden."""
    g = gates.select(F.col(event).alias("__e"), "status")
    return listing.where(~F.endswith(F.col(event).cast("string"), F.lit("_private"))).join(g, F.col(event) == F.col("__e"), "left").drop("__e").withColumn("status", F.coalesce("status", F.lit("unknown")))
