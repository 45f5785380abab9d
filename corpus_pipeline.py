"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads it
again as the next one's docs. All but the last return the columns of ``documents``. Rows with a null doc_id, null or empty texts go
through every stage by the rules of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontam, piece_codec, quality, toxicity
from quillstone.llm.common import Scratch, few, fresh, table
from quillstone.llm.neardup import near_duplicates


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality probability is at least 1/2, by a model of the labelled ones among them."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("quality_score >= 0.5").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity probability is under 1/2, by a model of the labelled ones among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, spans=False).where("toxic_score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the smallest doc_id. Null doc_ids stay.

    The ids that go are written first and broadcast up to a million of them; beyond, the texts are joined with them by a shuffle.
    """
    k, scratch = fresh(docs.columns, "gone"), Scratch(spark, "near-copies")
    gone = scratch.keep(near_duplicates(docs, scratch=scratch).where("NOT kept").select(F.col("doc_id").alias(k)).distinct(), "ids")
    scratch.sweep(gone)
    return docs.join(few(gone, 1_000_000), F.col("doc_id") == F.col(k), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, checked by decoding."""
    return piece_codec.encode_decode(docs, remember=4_000_000).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Trained models, a network and library-exact token ids can't be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # a stage's table goes once the next one is written
        docs = scratch.sweep(scratch.keep(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
