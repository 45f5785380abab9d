"""Sinks: JSON lines, packages of Parquet tables with a text index, and markdown views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import projections as P
from quillstone.operators.fulltext import TextIndex


def jsonl(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines by Spark's commit protocol. With ``order`` the files are range-partitioned by it, so that reading them in name order keeps it without one task writing all."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").json(path)


def package(tables: dict[str, DataFrame], root: str) -> None:
    """Rebuild a package: its tables by event, and the text index of its units and records, from which search answers; private events are in no index."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("event").parquet(f"{root}/{name}")
    units = P.hide_private(tables["units"].withColumn("topic", F.array_join("topic_path", " / ")))
    records = P.hide_private(tables["literal_records"])
    TextIndex.build(units.sparkSession, f"{root}/index", {"unit": (units, "unit_id", ["topic", "claim"]), "record": (records, "record_id", ["clean_literal"])})


def _lines(rows: DataFrame, group: str, order: list[str], line) -> DataFrame:
    """One markdown text a group from ordered lines."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("__l")))), lambda x: x["__l"]), "\n")
    return rows.groupBy(group).agg(joined.alias("markdown"))


def literal_markdown(records: DataFrame) -> DataFrame:
    """Per source: a heading with id and time, the text, its evidence, the raw text where it differs, and edits."""
    raw = F.when(F.coalesce("raw_text", F.col("clean_literal")) != F.col("clean_literal"), F.concat(F.lit("\n> raw: "), F.col("raw_text"))).otherwise("")
    line = F.concat(F.lit("### "), F.col("record_id"), F.lit(" "), X.clock("start_seconds"), F.lit("-"), X.clock("end_seconds"), F.lit("\n"), F.coalesce("clean_literal", F.lit("")), raw, F.lit("\n"), F.concat_ws(", ", F.coalesce("evidence_ids", F.array().cast("array<string>"))), F.lit("\n"))
    return _lines(records, "source_id", ["record_id"], line)


def slide_markdown(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per slide source: each relation with its evidence texts."""
    e = evidence.select(F.col("evidence_id").alias("__e"), "literal_text")
    rows = relations.select("slide_source_id", "relation_id", "relation", F.posexplode("slide_evidence_ids").alias("n", "evidence_id")).join(e, F.col("evidence_id") == F.col("__e"), "left")
    line = F.concat(F.lit("- "), F.col("relation_id"), F.lit(" ("), F.col("relation"), F.lit(") "), F.col("evidence_id"), F.lit(": "), F.coalesce("literal_text", F.lit("")))
    return _lines(rows, "slide_source_id", ["relation_id", "n"], line)


def topic_markdown(index: DataFrame) -> DataFrame:
    """One line a topic and record: how many of the topic's units cite it."""
    return index.select("topic", "record_id", F.concat(F.lit("- "), F.col("topic"), F.lit(": "), F.col("record_id"), F.lit(" ("), F.col("n_units").cast("string"), F.lit(" units)")).alias("markdown"))


def report(units: DataFrame) -> DataFrame:
    """(topic, unit_id, line): a heading a topic with its number of units (unit_id empty), and a line for each claim of high certainty; in order of topic and unit_id.

    A line is a row, so a topic may have any number of them; ``jsonl`` with that order writes them without one task that holds all.
    """
    topic = F.array_join("topic_path", " / ").alias("topic")
    heads = units.groupBy(topic).agg(F.count(F.lit(1)).alias("n")).select("topic", F.lit("").alias("unit_id"), F.concat(F.lit("## "), "topic", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    return heads.unionByName(units.where("certainty = 'high'").select(topic, "unit_id", F.concat(F.lit("- "), "unit_id", F.lit(": "), "claim").alias("line")))


def uncertainty(dispositions: DataFrame, evidence: DataFrame, corrections: DataFrame) -> DataFrame:
    """Evidence that is uncertain or in conflict, with where it is and suggested corrections of its record."""
    d = dispositions.where(F.col("status").isin("uncertain", "conflict")).select(F.col("evidence_id").alias("__d"), "status")
    c = corrections.groupBy(F.col("record_id").alias("__c")).agg(F.array_sort(F.collect_list(F.concat_ws(" -> ", "original", "suggested"))).alias("corrections"))
    out = evidence.join(d, F.col("evidence_id") == F.col("__d")).join(c, F.col("record_id") == F.col("__c"), "left")
    return out.select("evidence_id", "status", "locator", F.coalesce("corrections", F.array().cast("array<string>")).alias("corrections"))


def note_corroboration(relations: DataFrame, material: list[str]) -> DataFrame:
    """Note relations that say something, and how many there are of each."""
    return relations.where(F.col("relation").isin(material)).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("note_evidence_id")).alias("note_ids"))


def receipt(rows: DataFrame, **counts) -> DataFrame:
    """One row of counts and laws about a stage's output."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *(v.alias(k) for k, v in counts.items()))


def write_with_receipt(rows: DataFrame, path: str, **counts) -> dict:
    """Write a table and return its receipt, ``n_rows`` and the named ``counts``, which are observed as the rows pass; nothing is read again. Counts of distinct values can't be observed."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(v.alias(k) for k, v in counts.items())).write.mode("overwrite").parquet(path)
    return dict(seen.get)


def archive_plan(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """What an archive move would do to each file: move where the hash still holds, refuse where it changed or went. Nothing is moved here."""
    c = current.select(F.col("path").alias("__p"), F.col("sha256").alias("__h"))
    out = manifest.join(c, F.col("path") == F.col("__p"), "left")
    return out.select("path", "sha256", F.when(F.col("__p").isNull(), "missing").when(F.col("__h") != F.col("sha256"), "changed").otherwise("move").alias("action"))


def readable(paragraphs: DataFrame, records: DataFrame, key: str, order: str) -> DataFrame:
    """(key, paragraph, line): each paragraph of a reading copy under its times, with the first and last record as evidence; nothing is reworded.

    ``paragraphs`` as ``windows.paragraphs`` gives them, ``records(key, order, record_id, start_seconds, end_seconds)``.
    """
    at = lambda p: records.select(F.col(key).alias(f"__{p}k"), F.col(order).alias(f"__{p}o"), F.col("record_id").alias(f"{p}_id"), F.col("start_seconds").alias(f"{p}_start"), F.col("end_seconds").alias(f"{p}_end"))
    rows = paragraphs.join(at("a"), (F.col(key) == F.col("__ak")) & (F.col("first") == F.col("__ao"))).join(at("b"), (F.col(key) == F.col("__bk")) & (F.col("last") == F.col("__bo")))
    line = F.concat(F.lit("**"), X.minutes("a_start"), F.lit("–"), X.minutes("b_end"), F.lit("**  "), "text", F.lit("\n<sub>"), "a_id", F.lit("–"), "b_id", F.lit("</sub>"))
    return rows.select(key, "paragraph", line.alias("line"))


def details(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """(topic, unit_id, evidence_id, line): the first package form as lines: a unit's claim (evidence_id empty), then an appendix line for each evidence row that it cites."""
    topic = F.array_join("topic_path", " / ").alias("topic")
    claims = units.select(topic, "unit_id", F.lit("").alias("evidence_id"), F.concat(F.lit("### "), "unit_id", F.lit(" ["), "certainty", F.lit("]\n"), "claim").alias("line"))
    e = evidence.select(F.col("evidence_id").alias("__e"), "source_id", "kind", "literal_text")
    cited = units.select(topic, "unit_id", F.explode("evidence_ids").alias("evidence_id")).join(e, F.col("evidence_id") == F.col("__e"))
    return claims.unionByName(cited.select("topic", "unit_id", "evidence_id", F.concat(F.lit("- "), "evidence_id", F.lit(" "), "source_id", F.lit(" "), "kind", F.lit(": "), "literal_text").alias("line")))


def word_postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(word, key, tf): the first package form's index, of words of letters and digits, case folded."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return rows.select(F.col(key).alias("key"), F.explode(words).alias("word")).groupBy("word", "key").agg(F.count(F.lit(1)).alias("tf"))
