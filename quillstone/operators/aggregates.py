"""Counts, scores and folds."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as X


def inventory_counts(files: DataFrame) -> DataFrame:
    """Per kind: files, bytes and seconds of audio."""
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("total_bytes"), F.sum(F.when(F.col("kind") == "audio", F.coalesce("duration", F.lit(0.0))).otherwise(0.0)).alias("audio_seconds"))


def manifest(files: DataFrame) -> DataFrame:
    """One row: counts by kind as a map, totals."""
    c = inventory_counts(files)
    return c.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n_files")))).alias("counts"), F.sum("n_files").alias("file_count"), F.sum("total_bytes").alias("total_bytes"), F.sum("audio_seconds").alias("audio_duration_seconds"))


def route_counts(evidence: DataFrame, kind: str = "kind", route: str = "route", unresolved: Column | None = None) -> DataFrame:
    """Rows by ``kind:route`` and how many are unresolved."""
    bad = F.col("uncertainty").isNotNull() if unresolved is None else unresolved
    return evidence.groupBy(F.concat_ws(":", kind, route).alias("route")).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("unresolved"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def disposition_invariants(dispositions: DataFrame, evidence: DataFrame, known: list[str]) -> DataFrame:
    """One row of laws: ids unique, statuses known (unknown ones are reported, not rejected), every id is evidence, every evidence has one."""
    d = dispositions.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status").isin(known)).alias("ok"))
    e = evidence.select(F.col("evidence_id").alias("__e")).distinct()
    both = d.join(e, F.col("evidence_id") == F.col("__e"), "full")
    all_ = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return both.agg(all_(F.coalesce(F.col("n"), F.lit(1)) == 1).alias("unique"), all_(F.coalesce("ok", F.lit(True))).alias("known_status"), all_(F.col("__e").isNotNull()).alias("no_orphan"), all_(F.col("evidence_id").isNotNull()).alias("complete"))


def hallucination_score(segments: DataFrame, key: str, text: str, generic: list[str]) -> DataFrame:
    """Per key how much its non-blank segments look like a loop: the most of the top segment's share (from 3 on), the share of generic phrases and 1 - distinct/n; 1.0 without any.

    Two aggregations, so that a repeated line counts before it moves.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    per = segments.select(F.col(key).alias("k"), t.alias("t")).groupBy("k", "t").agg(F.count(F.lit(1)).alias("c"))
    per = per.withColumn("c", F.when(F.col("t") == "", 0).otherwise(F.col("c")))
    out = per.groupBy(F.col("k").alias(key)).agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.count_if(F.col("c") > 0).alias("d"), F.sum(F.when(F.lower("t").isin(generic), F.col("c")).otherwise(0)).alias("g"))
    n = F.col("n")
    score = F.when(n == 0, 1.0).otherwise(F.greatest(F.when(n >= 3, F.col("top") / n).otherwise(0.0), F.col("g") / n, 1 - F.col("d") / n))
    return out.select(key, F.col("n").alias("n_segments"), score.alias("score"))


def dominant_line(texts: DataFrame, key: str, text: str, least: int = 8) -> DataFrame:
    """Per text: non-blank lines, and the most frequent one's share if there are at least ``least``; null else."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), F.trim), lambda x: x != "")
    rows = texts.select(F.col(key).alias("k"), F.explode_outer(lines).alias("line")).groupBy("k", "line").agg(F.count("line").alias("c"))
    return rows.groupBy(F.col("k").alias(key)).agg(F.sum("c").alias("n_lines"), F.max("c").alias("top")).select(key, "n_lines", F.when(F.col("n_lines") >= least, F.col("top") / F.col("n_lines")).alias("dominant_share"))


def text_health(texts: DataFrame, key: str, text: str, most: float = 0.35) -> DataFrame:
    """healthy / empty / replacement_marks (two or more) / dominant_line."""
    marks = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^�]", ""))
    base = texts.select(F.col(key).alias("__k"), F.trim(F.coalesce(F.col(text), F.lit(""))).alias("t"), marks.alias("marks"))
    out = dominant_line(texts, key, text).join(base, F.col(key) == F.col("__k"))
    return out.select(key, F.when(F.col("t") == "", "empty").when(F.col("marks") >= 2, "replacement_marks").when(F.col("dominant_share") > most, "dominant_line").otherwise("healthy").alias("health"))


def route_medoid(routes: DataFrame, key: str) -> DataFrame:
    """Per key the route with the highest mean similarity to the others (first of equals by route rank), and the least similarity of any pair.

    ``routes(key, rank, route, text)``; the routes of a key are few, so they meet in one row.
    """
    per = routes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "route", F.coalesce("text", F.lit("")).alias("text")))).alias("r"))
    sims = lambda x: F.transform(F.filter("r", lambda y: y["rank"] != x["rank"]), lambda y: X.edit_similarity(x["text"], y["text"]))
    mean = lambda a: F.when(F.size(a) == 0, 1.0).otherwise(F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(a), F.lit(1)))
    scored = F.transform("r", lambda x: F.struct((-mean(sims(x))).alias("m"), x["rank"].alias("rank"), x["route"].alias("route"), x["text"].alias("text"), F.array_min(sims(x)).alias("least")))
    out = per.withColumn("s", scored).withColumn("best", F.array_min("s"))
    return out.select(key, F.col("best.route").alias("route"), (-F.col("best.m")).alias("mean_similarity"), F.coalesce(F.array_min(F.transform("s", lambda x: x["least"])), F.lit(1.0)).alias("min_similarity"))


@F.pandas_udf(T.StructType([T.StructField("two", T.DoubleType()), T.StructField("three", T.DoubleType()), T.StructField("surplus", T.IntegerType())]))
def support(base: pd.Series, second: pd.Series, third: pd.Series) -> pd.DataFrame:
    """Share of the base text's characters that matching blocks of one other text, and of both, support; characters that the longest other has over it."""
    out = []
    for a, b, c in zip(base.fillna(""), second.fillna(""), third.fillna("")):
        marks = [[0] * len(a), [0] * len(a)]
        for m, other in zip(marks, (b, c)):
            for i, _, n in difflib.SequenceMatcher(None, a, other, autojunk=False).get_matching_blocks():
                m[i : i + n] = [1] * n
        size = max(len(a), 1)
        hits = [x + y for x, y in zip(*marks)]
        out.append((sum(h >= 1 for h in hits) / size, sum(h >= 2 for h in hits) / size, max(0, max(len(b), len(c)) - len(a))))
    return pd.DataFrame(out, columns=["two", "three", "surplus"])


def topic_rollup(units: DataFrame) -> DataFrame:
    """Units per topic path, with the ordinal of the first, which orders the topics."""
    return units.groupBy(F.array_join("topic_path", " / ").alias("topic")).agg(F.count(F.lit(1)).alias("n_units"), F.min("ordinal").alias("first_seen"))


def document_frequency(docs: DataFrame, key: str, words: str, share: float = 0.75, from_docs: int = 4) -> DataFrame:
    """(word, df, common): words in more than int(share x N) documents are common, once there are ``from_docs``."""
    n = docs.agg(F.count_distinct(key).alias("n"))
    df = docs.select(F.col(key).alias("k"), F.explode(words).alias("word")).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("n", n.scalar()).select("word", "df", ((F.col("n") >= from_docs) & (F.col("df") > F.floor(F.col("n") * share))).alias("common"))


def fragment_summary(records: DataFrame, key: str, ordinal: str, text: str, end: str, edge: int = 2, chars: int = 180) -> DataFrame:
    """Per fragment: sentences, last end, the first and last ``edge`` sentences joined and cut to ``chars`` characters."""
    w = Window.partitionBy(key)
    rows = records.select(key, ordinal, text, end, F.row_number().over(w.orderBy(ordinal)).alias("n"), F.row_number().over(w.orderBy(F.col(ordinal).desc())).alias("m"))
    pick = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= edge, F.struct(ordinal, text)))), lambda s: s[text]), " ")
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("sentence_count"), F.max(end).alias("duration_seconds"), pick("n").alias("head"), pick("m").alias("tail"))
    return out.withColumn("head", F.substring("head", 1, chars)).withColumn("tail", F.when(F.length("tail") > chars, F.substring(F.col("tail"), F.length("tail") - chars + 1, F.lit(chars))).otherwise(F.col("tail")))


def ordered_text(rows: DataFrame, keys: list[str], order: list[str], text: str, sep: str) -> DataFrame:
    """Texts of each key in order, joined: windows from sentences, slide text from lines."""
    pick = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("__t")))), lambda s: s["__t"]), sep)
    return rows.groupBy(*keys).agg(pick.alias("text"), F.count(F.lit(1)).alias("n"))


def selection_counts(windows: DataFrame) -> DataFrame:
    """Windows per engine, how many were escalated and how many stay uncertain."""
    return windows.groupBy("engine").agg(F.count(F.lit(1)).alias("n"), F.count_if("escalated").alias("escalated"), F.count_if("uncertain").alias("uncertain"))


def event_totals(log: DataFrame, key: str, last: int = 200) -> DataFrame:
    """Per event, over its last ``last`` rows only: rows, done, failed, sum of hours."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("ordinal").desc())
    rows = log.withColumn("n", F.row_number().over(w)).where(F.col("n") <= last)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("hours").alias("hours"))


def event_listing(units: DataFrame, records: DataFrame, event: str) -> DataFrame:
    """Per event: units, records, last end. Events with only one of both are listed too."""
    u = units.groupBy(event).agg(F.count(F.lit(1)).alias("n_units"), F.lit(0).cast("long").alias("n_records"), F.lit(None).cast("double").alias("last_end"))
    r = records.groupBy(event).agg(F.lit(0).cast("long").alias("n_units"), F.count(F.lit(1)).alias("n_records"), F.max("end_seconds").alias("last_end"))
    return u.unionByName(r).groupBy(event).agg(F.sum("n_units").alias("n_units"), F.sum("n_records").alias("n_records"), F.max("last_end").alias("last_end"))


def term_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Per term: engines whose text has it, and whether that passes: forbidden terms in none, expected ones in two or more.

    ``texts(engine, text)``, ``terms(term, expected)``: terms are a short configuration table; each text is read once and emits the terms it has.
    """
    listed = terms.agg(F.collect_set("term").alias("all"))
    has = texts.withColumn("all", listed.scalar()).select("engine", F.explode(F.filter("all", lambda t: F.contains(F.lower("text"), F.lower(t)))).alias("__t")).distinct()
    n = has.groupBy("__t").agg(F.count(F.lit(1)).alias("engines"))
    out = terms.join(n, F.col("term") == F.col("__t"), "left").withColumn("engines", F.coalesce("engines", F.lit(0)))
    return out.select("term", "expected", "engines", F.when(F.col("expected"), F.col("engines") >= 2).otherwise(F.col("engines") == 0).alias("passes"))


def gate(violations: DataFrame) -> DataFrame:
    """One row: errors, warnings and FAIL, WARN or PASS."""
    out = violations.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return out.withColumn("status", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def over_filter(records: DataFrame, most: float = 0.4) -> DataFrame:
    """One row: share of records excluded, and whether that is suspicious."""
    out = records.agg(F.count(F.lit(1)).alias("n"), F.count_if("excluded").alias("excluded"))
    return out.withColumn("ratio", F.coalesce(F.try_divide("excluded", "n"), F.lit(0.0))).withColumn("warn", F.col("ratio") > most)


def audit_counts(audited: DataFrame) -> DataFrame:
    """One row: faithful, repaired and residual units; repaired counts those that stayed flagged too."""
    return audited.agg(F.count_if(F.col("verdict") == "faithful").alias("faithful"), F.count_if("audit_repaired").alias("repaired"), F.count_if("audit_flagged").alias("residual"))


def substage_progress(log: DataFrame, key: str, pattern: str) -> DataFrame:
    """Per key: rows whose message matches, and those of them that are done."""
    hit = F.col("message").rlike(pattern)
    return log.groupBy(key).agg(F.count_if(hit).alias("total"), F.count_if(hit & (F.col("status") == "done")).alias("done"))


def continuity_counts(records: DataFrame, text: str, joined: Column) -> DataFrame:
    """One row: records, those that end without a closing mark, those that end in a connecting word, those whose window join is unresolved."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    return records.agg(F.count(F.lit(1)).alias("records"), F.count_if(~t.rlike(r"[.!?。！？…]$")).alias("nonterminal"), F.count_if(t.rlike(r"(?i)\b(?:and|but|or|und|et|y|because|so)\s*$")).alias("connector_ending"), F.count_if(joined).alias("unresolved_joins"))
