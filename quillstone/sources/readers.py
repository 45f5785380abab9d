"""Sources: JSON lines, documents, directories as tables, notes, normalised engine output, packages.

Paths go to Spark's readers alone, so any store works; schemas are declared, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as X
from quillstone.operators import projections as P
from quillstone.operators.fulltext import TextIndex
from quillstone.sources import schemas as S


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: T.StructType, mode: str = "lenient") -> DataFrame:
    """JSON lines. ``lenient``: a missing path is an empty table, blank lines go, bad JSON stops the job; ``strict``: a missing path stops too, a line that is no JSON stops the job, and JSON that is no object goes; ``tolerant``: bad lines go."""
    if mode != "strict" and not exists(spark, path):
        return spark.createDataFrame([], schema)
    if mode == "tolerant":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if mode == "strict":
        lines = spark.read.text(path).where(F.trim("value") != "")
        kind = F.coalesce(F.schema_of_variant(F.try_parse_json("value")), F.raise_error(F.concat(F.lit("a line is no JSON: "), F.substring("value", 1, 200))).cast("string"))
        objects = lines.where(F.startswith(kind, F.lit("OBJECT")))
        return objects.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tail(spark: SparkSession, path: str, schema: T.StructType, n: int) -> DataFrame:
    """The last ``n`` good lines of a log, oldest first, with their ordinal; only ``n`` rows are gathered."""
    lines = spark.read.text(path).withColumn("__file", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id())
    good = lines.withColumn("r", F.from_json("value", schema.add("_corrupt_record", T.StringType()) if "_corrupt_record" not in schema.names else schema, {"columnNameOfCorruptRecord": "_corrupt_record"})).where("r IS NOT NULL AND r._corrupt_record IS NULL AND trim(value) <> ''")
    last = good.orderBy(F.col("__file").desc(), F.col("__at").desc()).limit(n)
    return last.orderBy("__file", "__at").select("r.*", F.col("__at").alias("ordinal")).drop("_corrupt_record")


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON value a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_directory(spark: SparkSession, folder: str, schema: T.StructType, skip: str = "receipt.json") -> DataFrame:
    """A folder of JSON files as rows with the file's stem as key; names that end in ``skip`` are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("file", F.col("_metadata.file_name"))
    return rows.where(~F.endswith("file", F.lit(skip))).withColumn("key", F.regexp_replace("file", r"\.json$", ""))


def composite_key(stem: Column) -> Column:
    """(source_id, start, end, window_id, route) of ``window__route``, where a window is ``source_start_end`` with times in tenths of milliseconds."""
    window, route = F.element_at(F.split(stem, "__"), 1), F.when(F.contains(stem, F.lit("__")), F.element_at(F.split(stem, "__"), -1))
    part = lambda i: F.nullif(F.regexp_extract(window, r"^(.*)_(\d+)_(\d+)$", i), F.lit(""))
    return F.struct(part(1).alias("source_id"), (part(2).cast("double") / 10000).alias("start_seconds"), (part(3).cast("double") / 10000).alias("end_seconds"), window.alias("window_id"), route.alias("route"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder, sorted ids by path: source_id, path, kind, size, mtime, sha256, eligible."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select("path", F.col("length").alias("size_bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at"), F.sha2("content", 256).alias("sha256"))
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    rows = rows.withColumn("kind", P.file_kind(ext)).withColumn("eligible", P.file_kind(ext).isin("audio", "video", "image", "note") & ~F.startswith(F.regexp_extract("path", "[^/]*$", 0), F.lit(".")))
    from quillstone.operators.windows import assign_ids

    return assign_ids(rows.withColumn("__folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "__folder", ["path"], "F", "source_id").drop("__folder")


def group_events(files: DataFrame, root: str, orders: DataFrame | None = None) -> DataFrame:
    """Files with their event: the first folder below ``root``, loose files together as ``misc``; a user's order counts only if it is an exact permutation."""
    rel = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    event = F.when(F.contains(rel, F.lit("/")), F.substring_index(rel, "/", 1)).otherwise("misc")
    rows = files.withColumn("event", event).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    from quillstone.operators.windows import guarded_order

    orders = rows.sparkSession.createDataFrame([], "event string, name string, ordinal int") if orders is None else orders
    return guarded_order(rows, orders, "event", "name")


def queue(files: DataFrame, regions: DataFrame) -> DataFrame:
    """Per event: files by kind, and whether a video awaits its slide region."""
    r = regions.select(F.col("event").alias("__e")).distinct()
    counts = files.groupBy("event").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("audio", "video", "image", "note")))
    return counts.join(r, F.col("event") == F.col("__e"), "left").withColumn("awaiting_region", (F.col("n_video") > 0) & F.col("__e").isNull()).drop("__e")


def note_lines(texts: DataFrame, key: str, text: str, headings: bool = False) -> DataFrame:
    """(key, line_no, text): non-blank lines with their number in the file; lines that begin with ``#`` only with ``headings``."""
    rows = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("n", "t")).select(key, (F.col("n") + 1).alias("line_no"), F.trim("t").alias("text"))
    rows = rows.where("text <> ''")
    return rows if headings else rows.where(~F.startswith("text", F.lit("#")))


def note_evidence(lines: DataFrame, key: str) -> DataFrame:
    """Note lines as evidence N000001 ... in the order of file and line."""
    from quillstone.operators.windows import assign_ids

    rows = assign_ids(lines, key, ["line_no"], "N", "note_evidence_id")
    return rows.select("note_evidence_id", F.lit("note").alias("kind"), F.struct(F.col(key).alias("path"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end")).alias("locator"), F.col("text").alias("literal_text"))


def merge_notes(notes: DataFrame, group: str, name: str, text: str) -> DataFrame:
    """One document a group: each note under a header with its name, in the order of names."""
    block = F.concat(F.lit("# "), F.col(name), F.lit("\n\n"), F.trim(F.coalesce(text, F.lit(""))), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), block.alias("b"))))
    return notes.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n").alias("document"), F.count(F.lit(1)).alias("n_notes"))


def fragment_runs(fragments: DataFrame, records: DataFrame, broken: DataFrame) -> DataFrame:
    """Fragments with the reason they are skipped, if any: missing_literal_records, broken_jsonl, empty_transcript.

    ``records(fragment_id, clean_literal)``, ``broken(fragment_id)`` for fragments whose file didn't parse.
    """
    r = records.groupBy(F.col("fragment_id").alias("__r")).agg(F.count_if(F.trim(F.coalesce("clean_literal", F.lit(""))) != "").alias("said"))
    b = broken.select(F.col("fragment_id").alias("__b")).distinct()
    out = fragments.join(r, F.col("fragment_id") == F.col("__r"), "left").join(b, F.col("fragment_id") == F.col("__b"), "left")
    reason = F.when(F.col("__b").isNotNull(), "broken_jsonl").when(F.col("__r").isNull(), "missing_literal_records").when(F.col("said") == 0, "empty_transcript")
    return out.withColumn("skip_reason", reason).drop("__r", "__b", "said")


def normalize_evidence(whisper: DataFrame, vision: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Four engines' rows as one evidence table: whisper segments with offsets in ms, OCR items with boxes, recognised chunks of nested JSON, page texts.

    Blank texts go; ids are left to ``windows.assign_ids``.
    """
    w = whisper.select("source_id", F.posexplode("transcription").alias("i", "t")).select(
        "source_id", F.lit("audio").alias("kind"), F.lit("whisper").alias("route"), (F.col("t.offsets.from") / 1000).alias("start_seconds"), (F.col("t.offsets.to") / 1000).alias("end_seconds"), X.clean_space("t.text").alias("literal_text"), F.lit("low").alias("quality"), F.lit("single_engine").alias("uncertainty"),
    )
    bucket = P.quality_bucket(F.col("t.confidence"))
    v = vision.select(F.col("file").alias("source_id"), F.posexplode("items").alias("reading_order", "t")).select("source_id", "reading_order", F.lit("image").alias("kind"), F.lit("vision").alias("route"), F.struct("t.x", "t.y", "t.width", "t.height").alias("box"), X.clean_space("t.text").alias("literal_text"), bucket["quality"].alias("quality"), F.when(bucket["uncertain"], "low_confidence").alias("uncertainty"))
    c = chunks.select("source_id", F.lit("audio").alias("kind"), F.lit("funasr").alias("route"), "start_seconds", "end_seconds", "chunk_index", X.clean_space(X.nested_text("result")).alias("literal_text"), F.lit("low").alias("quality"), F.lit("single_engine").alias("uncertainty"))
    p = pages.select("source_id", F.lit("image").alias("kind"), F.lit("vlm").alias("route"), X.clean_space("text").alias("literal_text"), F.lit("low").alias("quality"), F.lit("generated").alias("uncertainty"))
    out = w
    for more in (v, c, p):
        out = out.unionByName(more, allowMissingColumns=True)
    return out.where("literal_text <> ''")


def package(spark: SparkSession, root: str, event: str | None = None) -> dict[str, DataFrame]:
    """A package's tables, partitioned by event, and the heads of its text index as ``postings``; private events are never read."""
    out = {}
    for name in S.PACKAGE_TABLES:
        df = package_index(spark, root).heads if name == "postings" else spark.read.parquet(f"{root}/{name}")
        df = P.hide_private(df)
        out[name] = df.where(F.col("event") == event) if event else df
    return out


def package_index(spark: SparkSession, root: str) -> TextIndex:
    """What ``retrieval.search`` and its like take to answer from a package."""
    return TextIndex(spark, f"{root}/index")


def finite(c: str) -> Column:
    """A probe's number, null where it isn't finite."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
