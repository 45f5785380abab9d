"""Deterministic work around external models: chunking, validation, repair guards and conservative defaults.

A model is a callable ``rows -> rows`` behind ``mapInPandas``, or a table of its stored results; nothing here calls one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators.windows import neighbor_text


def call_model(rows: DataFrame, model: Callable, schema: str) -> DataFrame:
    """Run an adapter over Arrow batches; its output schema is declared."""

    def run(batches):
        for pdf in batches:
            yield model(pdf)

    return rows.mapInPandas(run, schema)


def chunks(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Adds chunk (0, 1, ...) of ``size`` rows in order inside each group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("chunk", F.floor((n - 1) / size))


def chunk_fingerprints(rows: DataFrame, group: str, order: str, cols: list[str]) -> DataFrame:
    """(group, chunk, fingerprint): content digests that key a cache of model results; work to do is what the cache lacks."""
    line = F.to_json(F.struct(*sorted(cols)))
    packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("j")))), lambda x: x["j"]), "\n")
    return rows.groupBy(group, "chunk").agg(F.sha2(packed, 256).alias("fingerprint"))


def adjudication_batches(records: DataFrame, candidates: DataFrame, group: str, order: str, key: str, text: str, size: int = 10, chars: int = 120) -> DataFrame:
    """(group, key, batch, previous, text, next): the candidates of each group in batches of ``size``, each with the ends of the texts beside it, cut to ``chars`` characters."""
    c = candidates.select(F.col(key).alias("__c")).distinct()
    beside = neighbor_text(records.select(group, order, key, F.col(text).alias("__t")), group, order, "__t", chars)
    rows = beside.join(c, F.col(key) == F.col("__c"), "left_semi")
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("batch", F.floor((n - 1) / size)).select(group, key, "batch", F.coalesce("previous", F.lit("")).alias("previous"), F.col("__t").alias(text), F.coalesce("next", F.lit("")).alias("next"))


def first_answers(answers: DataFrame, group: str, key: str, known: list[str], attempts: int = 5) -> DataFrame:
    """(group, key, verdict) from ``answers(group, batch, attempt, key, verdict)``: of each batch the first of ``attempts`` tries that gave any known verdict; the rest stays unmarked."""
    good = answers.where((F.col("attempt") < attempts) & F.col("verdict").isin(known))
    first = good.groupBy(F.col(group).alias("__g"), F.col("batch").alias("__b")).agg(F.min("attempt").alias("__a"))
    kept = good.join(first, (F.col(group) == F.col("__g")) & (F.col("batch") == F.col("__b")) & (F.col("attempt") == F.col("__a")))
    return kept.groupBy(group, key).agg(F.min("verdict").alias("verdict"))


def pending(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose content the ``cache(fingerprint)`` of earlier answers lacks: what a resumed run still has to ask."""
    done = cache.select(F.col("fingerprint").alias("__f"))
    return keyed.join(done, F.col("fingerprint") == F.col("__f"), "left_anti")


def halve(rows: DataFrame, failed: DataFrame, group: str, order: str) -> DataFrame:
    """The rows of ``failed(group, chunk)`` chunks with a new chunk: a chunk of several rows falls into its first and second half, one of a single row stays and has ``spent``.

    Chunk c becomes 2c and 2c + 1, so halving again goes on from there.
    """
    f = failed.select(F.col(group).alias("__g"), F.col("chunk").alias("__c")).distinct()
    w = Window.partitionBy(group, "chunk")
    out = rows.join(f, (F.col(group) == F.col("__g")) & (F.col("chunk") == F.col("__c")), "left_semi")
    out = out.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__at", F.row_number().over(w.orderBy(order)))
    second = (F.col("__at") > F.ceil(F.col("__n") / 2)).cast("long")
    return out.withColumn("chunk", F.col("chunk") * 2 + second).withColumn("spent", F.col("__n") == 1).drop("__n", "__at")


def valid_units(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds valid: a unit's references are there and all inside its own chunk (``chunks(chunk, ids)``)."""
    c = chunks.select(F.col("chunk").alias("__c"), "ids")
    out = units.join(c, F.col("chunk") == F.col("__c"), "left")
    ok = (F.size("evidence_ids") > 0) & (F.size(F.array_except("evidence_ids", F.coalesce("ids", F.array().cast("array<string>")))) == 0)
    return out.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("__c", "ids")


def coverage_fill(evidence: DataFrame, dispositions: DataFrame) -> DataFrame:
    """The first disposition of each evidence id; missing ones are uncertain and marked auto_filled."""
    first = dispositions.groupBy(F.col("evidence_id").alias("__e")).agg(F.min_by("status", "ordinal").alias("status"))
    out = evidence.select("evidence_id").join(first, F.col("evidence_id") == F.col("__e"), "left")
    return out.select("evidence_id", F.coalesce("status", F.lit("uncertain")).alias("status"), F.col("__e").isNull().alias("auto_filled"))


def promote_covered(dispositions: DataFrame, units: DataFrame) -> DataFrame:
    """Auto-filled uncertain ids that a unit cites are covered."""
    cited = units.select(F.explode("evidence_ids").alias("__c")).distinct()
    out = dispositions.join(cited, F.col("evidence_id") == F.col("__c"), "left")
    up = F.col("auto_filled") & (F.col("status") == "uncertain") & F.col("__c").isNotNull()
    return out.withColumn("status", F.when(up, "covered").otherwise(F.col("status"))).drop("__c")


def repair_guard(original: Column, repaired: Column, pool: Column) -> Column:
    """Whether a repair keeps every detail (number or longer word) of the original that the evidence backs."""
    lost = F.array_except(X.key_details(original), X.key_details(repaired))
    return F.size(F.array_intersect(lost, X.key_details(pool))) == 0


def audit_resolve(units: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Two audit rounds: faithful, or without a verdict, stays; a faithful second verdict repairs; else the unit is flagged and its certainty low.

    ``first(unit_id, verdict, repair)``, ``second(unit_id, verdict)``.
    """
    a = first.select(F.col("unit_id").alias("__a"), F.col("verdict").alias("v1"), "repair")
    b = second.select(F.col("unit_id").alias("__b"), F.col("verdict").alias("v2"))
    out = units.join(a, F.col("unit_id") == F.col("__a"), "left").join(b, F.col("unit_id") == F.col("__b"), "left")
    bad = F.col("v1").isNotNull() & (F.col("v1") != "faithful")
    fixed = bad & F.col("repair").isNotNull() & (F.coalesce("v2", F.lit("")) == "faithful")
    out = out.withColumn("audit_repaired", fixed).withColumn("audit_flagged", bad & ~fixed).withColumn("verdict", F.coalesce("v1", F.lit("faithful")))
    return out.withColumn("claim", F.when(F.col("audit_repaired"), F.col("repair")).otherwise(F.col("claim"))).withColumn("certainty", F.when(F.col("audit_flagged"), "low").otherwise(F.col("certainty"))).drop("__a", "__b", "v1", "v2", "repair")


def judge_pairs(pairs: DataFrame, verdicts: DataFrame, known: list[str]) -> DataFrame:
    """Pairs with a model's relation: an answer for the swapped pair counts; a missing or unknown one is ``different`` with the reason it is degraded."""
    v = verdicts.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b"), "relation").groupBy("__a", "__b").agg(F.min("relation").alias("relation"))
    out = pairs.join(v, (F.least("a", "b") == F.col("__a")) & (F.greatest("a", "b") == F.col("__b")), "left")
    reason = F.when(F.col("relation").isNull(), "missing").when(~F.col("relation").isin(known), "unknown_relation")
    return out.withColumn("degraded", reason).withColumn("relation", F.when(F.col("degraded").isNull(), F.col("relation")).otherwise("different")).drop("__a", "__b")


def classify_relations(candidates: DataFrame, verdicts: DataFrame, key: str, known: list[str]) -> DataFrame:
    """Relations from verdicts(key, relation, matched): unknown without candidates or verdict, with an unknown name, or with matches outside the candidates."""
    v = verdicts.select(F.col(key).alias("__k"), "relation", "matched")
    out = candidates.join(v, F.col(key) == F.col("__k"), "left").drop("__k")
    ok = (F.size("candidates") > 0) & F.col("relation").isin(known) & (F.size(F.array_except("matched", "candidates")) == 0)
    ok = F.coalesce(ok, F.lit(False))
    return out.withColumn("relation", F.when(ok, F.col("relation")).otherwise("unknown")).withColumn("matched", F.when(ok, F.col("matched")).otherwise(F.array().cast("array<string>")))


def absence_not_conflict(relations: DataFrame) -> DataFrame:
    """A conflict that matches nothing is unknown."""
    return relations.withColumn("relation", F.when((F.col("relation") == "conflict") & (F.size(F.coalesce("matched", F.array().cast("array<string>"))) == 0), "unknown").otherwise(F.col("relation")))


def nominate(candidates: DataFrame, nominated: DataFrame, key: str, n_records: Column, most: int = 120) -> DataFrame:
    """Candidates, or a model's nominations where lexical search found none and the source is small."""
    v = nominated.select(F.col(key).alias("__k"), F.col("ids").alias("__ids"))
    out = candidates.join(v, F.col(key) == F.col("__k"), "left")
    use = (F.size("candidates") == 0) & (n_records <= most) & F.col("__ids").isNotNull()
    return out.withColumn("nominated", use).withColumn("candidates", F.when(use, F.col("__ids")).otherwise(F.col("candidates"))).drop("__k", "__ids")


def report_references(reports: DataFrame, units: DataFrame, key: str, text: str, pattern: str = r"U\d{6,}") -> DataFrame:
    """Per report: unit ids it cites, those that don't exist, and whether it is valid (cites some, all known)."""
    cited = reports.select(F.col(key).alias("__k"), F.explode_outer(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)))).alias("id"))
    known = units.select(F.col("unit_id").alias("__u")).distinct()
    rows = cited.join(known, F.col("id") == F.col("__u"), "left")
    out = rows.groupBy(F.col("__k").alias(key)).agg(F.count("id").alias("n_cited"), F.count_if(F.col("id").isNotNull() & F.col("__u").isNull()).alias("n_unknown"))
    return out.withColumn("valid", (F.col("n_cited") > 0) & (F.col("n_unknown") == 0))


#: What a supervisor does about each status.
ACTIONS = {"running": "wait", "stopped": "resume", "failed": "retry", "blocked": "report", "done": "archive"}


def supervisor_actions(runs: DataFrame, attempts_limit: int = 2) -> DataFrame:
    """Adds action by status; failures beyond the limit are reported."""
    known = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    act = F.coalesce(F.try_element_at(known, F.col("status")), F.lit("report"))
    return runs.withColumn("action", F.when((F.col("status") == "failed") & (F.col("attempts") >= attempts_limit), "report").otherwise(act))
