"""The fixture tables read as the domain's entities, in Spark and as SQL with the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SENTENCE = "[^.!?]+[.!?]*"


class Tables:
    """Domain tables of one folder; each is built when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def records(self, *also: str) -> DataFrame:
        """record_id, source_id, idx, text, start_s, end_s: sentences of documents at 15 characters a second, with the columns ``also`` of their document."""
        rows = self.raw("documents").select(F.col("doc_id").alias("source_id"), *also, F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("idx", "text"))
        w = Window.partitionBy("source_id").orderBy("idx")
        before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
        return rows.withColumn("start_s", before / 15).withColumn("end_s", (before + F.length("text")) / 15).withColumn("record_id", F.format_string("R%06d_%05d", "source_id", "idx"))

    def units(self) -> DataFrame:
        """unit_id, event, topic_path, topic, claim, certainty, evidence_ids, ordinal."""
        labels = self.raw("labels").select(F.col("doc_id").alias("k"), "quality")
        rows = self.raw("documents").join(labels, F.col("doc_id") == F.col("k"), "left")
        return rows.select(
            F.format_string("U%06d", "doc_id").alias("unit_id"), F.col("source").alias("event"), F.array("lang", "source").alias("topic_path"), F.concat_ws(" / ", "lang", "source").alias("topic"), F.col("text").alias("claim"),
            F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium").alias("certainty"), F.array(F.format_string("E%06d", "doc_id"), F.format_string("E%06d", F.col("doc_id") + 1)).alias("evidence_ids"), F.col("doc_id").alias("ordinal"),
        )

    def evidence(self) -> DataFrame:
        return self.raw("documents").select(F.format_string("E%06d", "doc_id").alias("evidence_id"), F.format_string("R%06d", "doc_id").alias("record_id"), F.col("source").alias("source_id"), F.when(F.col("doc_id") % 5 == 0, "image").otherwise("audio").alias("kind"), F.col("text").alias("literal_text"), F.col("doc_id").alias("n"))

    def dispositions(self) -> DataFrame:
        return self.raw("labels").select(F.format_string("E%06d", "doc_id").alias("evidence_id"), F.when(F.col("toxic") == 1, "conflict").when(F.col("quality") == 0, "uncertain").otherwise("covered").alias("status"), F.col("doc_id").alias("ordinal"))

    def excluded(self) -> DataFrame:
        """Records that logistics talk excludes: every seventh."""
        return self.raw("documents").where("doc_id % 7 = 0").select(F.format_string("R%06d", "doc_id").alias("record_id"), F.array(F.format_string("E%06d", "doc_id")).alias("evidence_ids"))

    def turns(self) -> DataFrame:
        return self.raw("conversations")

    def log(self) -> DataFrame:
        """event, ordinal, ts (seconds), kind, value, status: the progress timeline."""
        e = self.raw("events")
        status = F.when(F.col("event_type").isin("purchase", "order"), "done").when(F.col("value") > 90, "failed").otherwise("running")
        return e.select(F.col("user_id").alias("event"), F.col("event_id").alias("ordinal"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.col("event_type").alias("kind"), "value", status.alias("status"), (F.col("value") / 60).alias("hours"))


#: The same tables for DuckDB, as common table expressions.
CTE = {
    "rec": rf"""rec AS (
  SELECT printf('R%06d_%05d', source_id, idx) AS record_id, *, CAST(before AS DOUBLE) / 15 AS start_s, (CAST(before AS DOUBLE) + length(text)) / 15 AS end_s
  FROM (SELECT doc_id AS source_id, i - 1 AS idx, s AS text, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{SENTENCE}') AS x FROM documents))))""",
    "units": """units AS (
  SELECT printf('U%06d', d.doc_id) AS unit_id, source AS event, lang || ' / ' || source AS topic, text AS claim,
    CASE WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' ELSE 'medium' END AS certainty, [printf('E%06d', d.doc_id), printf('E%06d', d.doc_id + 1)] AS evidence_ids, d.doc_id AS ordinal
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "evidence": """evidence AS (
  SELECT printf('E%06d', doc_id) AS evidence_id, printf('R%06d', doc_id) AS record_id, source AS source_id, CASE WHEN doc_id % 5 = 0 THEN 'image' ELSE 'audio' END AS kind, text AS literal_text, doc_id AS n FROM documents)""",
    "dispositions": """dispositions AS (
  SELECT printf('E%06d', doc_id) AS evidence_id, CASE WHEN toxic = 1 THEN 'conflict' WHEN quality = 0 THEN 'uncertain' ELSE 'covered' END AS status FROM labels)""",
    "excluded": "excluded AS (SELECT printf('R%06d', doc_id) AS record_id, printf('E%06d', doc_id) AS evidence_id FROM documents WHERE doc_id % 7 = 0)",
    "log": """log AS (
  SELECT user_id AS event, event_id AS ordinal, CAST(floor(epoch(ts)) AS DOUBLE) AS ts, event_type AS kind, value,
    CASE WHEN event_type IN ('purchase', 'order') THEN 'done' WHEN value > 90 THEN 'failed' ELSE 'running' END AS status, value / 60 AS hours FROM events)""",
}


def sql(names: str, body: str) -> str:
    """A query over domain tables, named by their keys."""
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body


def compact_sql(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^0-9A-Za-z]', '', 'g'))"


def bigrams_sql(c: str) -> str:
    """Distinct 2-grams of a column that is compacted already; inside a lambda it would be compacted again for each gram."""
    return f"CASE WHEN length({c}) = 0 THEN [] WHEN length({c}) < 2 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))) END"


def compacted_sql(table: str, key: str) -> str:
    return f"(SELECT {key}, {compact_sql('text')} AS c FROM {table})"
