"""Canonical exact digests of documents, by DataFrame functions only.

Canonical form: NFKC, full case folding, NFKC again (ICU's routines, which Spark itself carries, called as SQL functions), every run of
white space one space, none at the ends. Fingerprint: two differently salted 64-bit xxhash values of it, 128 bits as hex. Documents
are counted by hash first; only texts whose hash is shared are moved, and there bytes decide: classes are grouped by hash and
canonical text. Should two texts ever share a hash, the SHA-256 of the canonical text is added to both fingerprints.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import Scratch, few


def _nfkc(text: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def _folded(text: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """Canonical form; null reads as empty."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(_nfkc(_folded(_nfkc(text))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x85\x1c-\x1f]+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits of xxhash as 32 hex digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(salt), canon)), 16, "0") for salt in (1, 2))))


def classes(canon: DataFrame, most_shared: int = 500_000, scratch: Scratch | None = None, hashed: DataFrame | None = None) -> DataFrame:
    """(bucket, strong, copy_of, n_copies, collides) of distinct canonical texts of ``canon(doc_id, bucket, canon)``.

    Rows are counted by hash, with combining before the shuffle. Texts of shared hashes alone are then grouped by hash and text, which compares
    bytes; a large group of copies costs a row a task. Shared hashes are broadcast up to ``most_shared``; beyond, texts are joined with them by a shuffle.
    ``hashed(doc_id, bucket, strong)`` are the same rows, where they are written already, so that only the second step reads texts.
    """
    scratch = scratch or Scratch(canon.sparkSession, "classes")
    strong = F.sha2(F.col("canon"), 256)
    hashed = canon.select("doc_id", "bucket", strong.alias("strong")) if hashed is None else hashed.select("doc_id", "bucket", "strong")
    one = hashed.groupBy("bucket").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"), F.min("strong").alias("strong"))
    one = scratch.keep(one, "buckets")
    shared = few(one.where("n_copies > 1").select(F.col("bucket").alias("b")), most_shared)
    met = canon.select("doc_id", "bucket", "canon").join(shared, F.col("bucket") == F.col("b"), "left_semi").groupBy("bucket", "canon").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"))
    met = met.select("bucket", strong.alias("strong"), "copy_of", "n_copies").withColumn("collides", F.count(F.lit(1)).over(Window.partitionBy("bucket")) > 1)
    return one.where("n_copies = 1").select("bucket", "strong", "copy_of", "n_copies", F.lit(False).alias("collides")).unionByName(met)


def mark(bucket: str, strong: str, collides: Column) -> Column:
    """The fingerprint of a class."""
    return F.when(collides, F.concat_ws("-", bucket, strong)).otherwise(F.col(bucket))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text, canon, strong, bucket for each row of ``docs(doc_id, text, ...)``; null text reads as empty, other columns go."""
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("canon", canonical(F.col("text")))
    return got.withColumn("bucket", wide_hash(F.col("canon"))).withColumn("strong", F.sha2(F.col("canon"), 256))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, copy_of, n_copies: equal canonical texts share all but doc_id; copy_of is the smallest doc_id of the group.

    Empty and null texts are one group. Rows with a null doc_id take part; copy_of is null where a group has no doc_id.
    """
    rows = fingerprint(docs).select("doc_id", "bucket", "strong", "canon")
    return join_classes(rows.drop("canon"), classes(rows))


def join_classes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows(bucket, strong, ...)`` with fingerprint, copy_of and n_copies."""
    found = found.select(F.col("bucket").alias("__b"), F.col("strong").alias("__s"), "copy_of", "n_copies", "collides")
    out = rows.join(found, (F.col("bucket") == F.col("__b")) & (F.col("strong") == F.col("__s")))
    return out.withColumn("fingerprint", mark("bucket", "strong", F.col("collides"))).drop("__b", "__s", "collides", "bucket", "strong")


def _part(doc_id: Column, kind: T.DataType, cuts: list) -> Column:
    """How many of the sorted ``cuts`` lie under an id, by two short searches; null ids stand with the least."""
    step = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    name = kind.simpleString()
    heads = F.from_json(F.lit(json.dumps([r[0] for r in rows], default=str)), f"array<{name}>")
    tails = F.from_json(F.lit(json.dumps(rows, default=str)), f"array<array<{name}>>")
    under = lambda a: F.size(F.filter(a, lambda c: c < doc_id))
    row = under(heads)
    found = F.when(row == 0, 0).otherwise((row - 1) * step + under(F.element_at(tails, F.greatest(row, F.lit(1)))))
    return F.when(doc_id.isNull(), 0).otherwise(found).cast("int")


def with_next(docs: DataFrame, rows_per_part: int = 20_000, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, next_text: the text of the next row in descending doc_id (null ids last, ties by text), after the last the first.

    ``also`` names further columns to keep, each with its next value as ``next_...``. Range partitions of the ids alone give cuts; each part of rows
    is ordered in a task of its own, and the first row of each part also goes, as a guest, to the end of the part before. The driver sees one or
    two ids a part, so one row in some thousands. Ids are of any type that orders; a single row is its own next, and so are all-null ids in a ring.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *also)
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    n = ids.count()
    parts = max(1, n // rows_per_part, min(n // 8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = []
    if parts > 1:
        least = ids.repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("m")).select("m").distinct().orderBy("m")
        cuts = [r["m"] for r in least.collect()][1:]
    part = _part(F.col("doc_id"), kind, cuts) if cuts else F.lit(0)
    placed = docs.withColumn("part", part)
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    names = ("text", *also)
    if cuts:
        heads = sorted((r["part"], r["head"]) for r in ids.withColumn("part", part).groupBy("part").agg(F.max("doc_id").alias("head")).collect())
        hosts = [p for p, _ in heads]
        schema = T.StructType([T.StructField("head", kind), T.StructField("host", T.IntegerType())])
        guests = few(spark.createDataFrame([(head, hosts[(i + 1) % len(hosts)]) for i, (_, head) in enumerate(heads)], schema), 1_000_000)
        placed = placed.join(guests, F.col("doc_id") == F.col("head"), "left")
        seat = lambda p, g: F.struct(F.col(p).cast("int").alias("part"), F.lit(g).alias("guest"))
        seats = F.when(F.col("host").isNull(), F.array(seat("part", False))).otherwise(F.array(seat("part", False), seat("host", True)))
        placed = placed.select("doc_id", *names, F.explode(seats).alias("seat")).select("doc_id", *names, "seat.*")
        after = {f"next_{c}": F.lead(c).over(order) for c in names}
    else:
        placed = placed.withColumn("guest", F.lit(False))
        ring = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        after = {f"next_{c}": F.coalesce(F.lead(c).over(order), F.first(c).over(ring)) for c in names}
    return placed.withColumns(after).where("NOT guest").select("doc_id", *names, *after)
