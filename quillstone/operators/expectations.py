"""Data-quality rules: each gives rows (rule, severity, key, detail); their union goes to ``aggregates.gate``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.joins import track_duration
from quillstone.operators.windows import coverage_level


def violations(rows: DataFrame, rule: str, severity: str, key: str, bad: Column, detail: Column | None = None) -> DataFrame:
    """Rows where ``bad`` holds; null counts as good."""
    text = F.lit("") if detail is None else detail.cast("string")
    return rows.where(F.coalesce(bad, F.lit(False))).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(key).cast("string").alias("key"), F.coalesce(text, F.lit("")).alias("detail"))


def unique(rows: DataFrame, rule: str, key: str) -> DataFrame:
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return violations(n, rule, "error", key, F.col("n") > 1, F.col("n"))


def subset(left: DataFrame, right: DataFrame, rule: str, key: str, severity: str = "error") -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    r = right.select(F.col(key).alias("__k")).distinct()
    return violations(left.join(r, F.col(key) == F.col("__k"), "left_anti"), rule, severity, key, F.lit(True))


def not_empty(rows: DataFrame, rule: str) -> DataFrame:
    return violations(rows.agg(F.count(F.lit(1)).alias("n")), rule, "error", "n", F.col("n") == 0)


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def package_checks(evidence: DataFrame, records: DataFrame, units: DataFrame, dispositions: DataFrame) -> DataFrame:
    """The checks of a package: unique ids, units that cite existing evidence and have claims, a disposition for every evidence id, records with text and proper times."""
    cited = units.select("unit_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    return union(
        unique(evidence, "evidence_id_unique", "evidence_id"),
        unique(records, "record_id_unique", "record_id"),
        unique(units, "unit_id_unique", "unit_id"),
        unique(dispositions, "disposition_unique", "evidence_id"),
        subset(evidence, dispositions, "disposition_missing", "evidence_id"),
        subset(dispositions, evidence, "disposition_orphan", "evidence_id"),
        subset(cited.where("evidence_id IS NOT NULL"), evidence, "unit_cites_unknown", "evidence_id"),
        violations(cited, "unit_without_evidence", "error", "unit_id", F.col("evidence_id").isNull()),
        violations(units, "unit_without_claim", "error", "unit_id", F.trim(F.coalesce("claim", F.lit(""))) == ""),
        violations(records, "record_without_text", "warning", "record_id", F.trim(F.coalesce("clean_literal", F.lit(""))) == ""),
        violations(records, "record_times", "error", "record_id", F.col("end_seconds") < F.col("start_seconds")),
    )


def alignment(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence ids that records cite but that don't exist, evidence that no record cites, record ids that repeat."""
    cited = records.select(F.explode("evidence_ids").alias("evidence_id")).distinct()
    return union(subset(cited, evidence, "record_cites_unknown", "evidence_id"), subset(evidence, cited, "evidence_never_cited", "evidence_id"), unique(records, "record_id_repeats", "record_id"))


def durations(tracks: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Tracks that cover under 90 % of their own source are errors; those whose own or whose source's duration is unknown are warnings."""
    rows = track_duration(tracks, sources, key)
    return union(
        violations(rows, "track_truncated", "error", key, (F.col("state") == "short") & F.col("duration").isNotNull()),
        violations(rows, "track_unprobed", "warning", key, F.col("duration").isNull()),
        violations(rows, "source_duration_unknown", "warning", key, (F.col("state") == "unknown") & F.col("duration").isNotNull()),
    )


def coverage(records: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Transcripts that end before 85 % of their source (error) or before 95 % (warning)."""
    s = sources.select(F.col(key).alias("__k"), F.col("duration").alias("__d"))
    rows = records.groupBy(key).agg(F.max("end_seconds").alias("covered")).join(s, F.col(key) == F.col("__k")).withColumn("level", coverage_level(F.col("covered"), F.col("__d")))
    return union(*(violations(rows, f"transcript_coverage_{x}", x, key, F.col("level") == x) for x in ("error", "warning")))


def relevance(decided: DataFrame, records: DataFrame, key: str, most: float = 0.4) -> DataFrame:
    """The filter must keep every record (error), and is suspect where it excludes more than ``most`` of them (warning)."""
    lost = subset(records, decided, "relevance_lost_record", key)
    share = decided.agg((F.count_if("excluded") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("share"))
    return union(lost, violations(share, "relevance_over_filter", "warning", "share", F.col("share") > most))


def claim_audit(audited: DataFrame) -> DataFrame:
    """Units that an audit left flagged are warnings: they were downgraded, not lost."""
    return violations(audited, "claim_residual", "warning", "unit_id", F.col("audit_flagged"))


def package_state(units: DataFrame, literals: DataFrame, records: DataFrame, receipts: DataFrame, event: str = "event") -> DataFrame:
    """Per event: no units, literal rows that aren't as many as the records, a receipt that isn't complete; all errors."""
    n = lambda df, name: df.groupBy(F.col(event).alias(f"__{name}")).agg(F.count(F.lit(1)).alias(name))
    rows = receipts.join(n(units, "u"), F.col(event) == F.col("__u"), "left").join(n(literals, "l"), F.col(event) == F.col("__l"), "left").join(n(records, "r"), F.col(event) == F.col("__r"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return union(
        violations(rows, "package_without_units", "error", event, zero("u") == 0),
        violations(rows, "package_rows_differ", "error", event, zero("l") != zero("r"), F.concat_ws("/", zero("l"), zero("r"))),
        violations(rows, "package_incomplete", "error", event, ~F.coalesce(F.col("status"), F.lit("")).isin("COMPLETE", "COMPLETE_WITH_UNCERTAINTY"), F.col("status")),
    )
