"""Further registered queries: sources and sinks read back, text functions, retrieval context, checks, plans."""

from __future__ import annotations

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import aggregates as A
from quillstone.operators import expectations as E
from quillstone.operators import frames as V
from quillstone.operators import graph as G
from quillstone.operators import joins as J
from quillstone.operators import model_boundary as M
from quillstone.operators import projections as P
from quillstone.operators import resources as S
from quillstone.operators import retrieval as R
from quillstone.operators import windows as W
from quillstone.operators.scratch import work_folder
from quillstone.plans import catalog as C
from quillstone.plans.catalog import query
from quillstone.plans.domain import Tables, sql
from quillstone.sources import frames, readers, schemas, writers
from quillstone.streaming import online
from quillstone.streaming.snapshots import KeyedSnapshot

# ---------------------------------------------------------------- sources and sinks, written and read back


@query("SELECT doc_id, lang, n_chars FROM documents")
def jsonl_strict(t: Tables) -> DataFrame:
    """JSON that is no object and blank lines go; one line that is no JSON stops the job."""
    rows = t.raw("documents").select("doc_id", "lang", "n_chars")
    noise = t.spark.createDataFrame([("[1, 2]",), ('"text"',), ("17",), ("null",), ("   ",)], "value string")
    path = f"{work_folder(t.spark)}/strict.jsonl"
    rows.select(F.to_json(F.struct("*")).alias("value")).unionAll(noise).write.text(path)
    broken = f"{work_folder(t.spark)}/broken.jsonl"
    t.spark.createDataFrame([("[broken",)], "value string").write.text(broken)
    try:
        readers.jsonl(t.spark, broken, rows.schema, "strict").collect()
    except PySparkException:
        return readers.jsonl(t.spark, path, rows.schema, "strict")
    raise AssertionError("a broken line was read")


@query("SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 50")
def jsonl_tail(t: Tables) -> DataFrame:
    rows = t.raw("documents").select("doc_id", "lang")
    path = f"{work_folder(t.spark)}/tail.jsonl"
    writers.jsonl(rows, path, order=["doc_id"])
    return readers.jsonl_tail(t.spark, path, rows.schema, 50).select("doc_id")


@query("SELECT r_regionkey, r_name FROM region")
def json_document(t: Tables) -> DataFrame:
    """One file a row, its value spread over lines."""
    rows = t.raw("region").select("r_regionkey", "r_name")
    path = f"{work_folder(t.spark)}/documents"
    rows.select(F.concat(F.lit('{\n "r_regionkey":\n  '), F.col("r_regionkey").cast("string"), F.lit(',\n "r_name": "'), "r_name", F.lit('"\n}')).alias("value")).repartition(5, "r_regionkey").write.option("maxRecordsPerFile", 1).text(path)
    return readers.json_document(t.spark, path, rows.schema)


@query("SELECT r_regionkey, true AS keyed FROM region")
def keyed_directory(t: Tables) -> DataFrame:
    rows = t.raw("region").select("r_regionkey")
    path = f"{work_folder(t.spark)}/keyed"
    rows.repartition(5, "r_regionkey").write.option("maxRecordsPerFile", 1).json(path)
    return readers.keyed_directory(t.spark, path, rows.schema).select("r_regionkey", F.startswith("key", F.lit("part-")).alias("keyed"))


@query("SELECT 'other' AS kind, CAST(sum(octet_length(encode(r_name)) + 1) AS BIGINT) AS total_bytes, true AS numbered FROM region")
def file_inventory(t: Tables) -> DataFrame:
    path = f"{work_folder(t.spark)}/files"
    t.raw("region").select("r_name").repartition(3).write.option("compression", "none").format("text").save(path)
    rows = readers.inventory(t.spark, path).withColumn("kind", F.when(F.endswith("path", F.lit(".txt")), "other").otherwise(F.col("kind")))
    return rows.groupBy("kind").agg(F.sum("size_bytes").alias("total_bytes"), (F.count_distinct("source_id") == F.count(F.lit(1))).alias("numbered"))


@query(f"WITH {C._FILES} SELECT page_id, CAST(page_id % 9 AS VARCHAR) AS event, row_number() OVER (PARTITION BY page_id % 9 ORDER BY CASE WHEN page_id % 9 = 4 THEN -page_id ELSE 0 END, regexp_extract(path, '[^/]*$')) AS position FROM files")
def group_events(t: Tables) -> DataFrame:
    """A user's order of one event is a permutation and counts; that of another misses files and doesn't."""
    files = C._files(t).select("page_id", "path")
    name = F.regexp_extract("path", "[^/]*$", 0)
    asked = files.where("page_id % 9 = 4 OR page_id % 18 = 5").select((F.col("page_id") % 9).cast("string").alias("event"), name.alias("name"), (-F.col("page_id")).cast("int").alias("ordinal"))
    return readers.group_events(files, "in", asked).select("page_id", "event", "position")


@query(sql("rec", """SELECT doc_id AS fragment_id, CASE WHEN doc_id % 11 = 0 THEN 'broken_jsonl' WHEN r.n IS NULL THEN 'missing_literal_records' WHEN r.said = 0 THEN 'empty_transcript' END AS skip_reason
FROM documents LEFT JOIN (SELECT source_id, count(*) AS n, count(*) FILTER (WHERE source_id % 7 <> 0 AND trim(text) <> '') AS said FROM rec WHERE source_id % 5 <> 0 GROUP BY 1) r ON doc_id = source_id"""))
def fragment_runs(t: Tables) -> DataFrame:
    docs = t.raw("documents").select(F.col("doc_id").alias("fragment_id"))
    records = t.records().where("source_id % 5 <> 0").select(F.col("source_id").alias("fragment_id"), F.when(F.col("source_id") % 7 != 0, F.col("text")).otherwise(" ").alias("clean_literal"))
    return readers.fragment_runs(docs, records, docs.where("fragment_id % 11 = 0")).select("fragment_id", "skip_reason")


@query("SELECT doc_id, md5(lang || chr(10) || text || chr(10) || source) AS text_md5 FROM documents")
def nested_text(t: Tables) -> DataFrame:
    said = lambda c: F.named_struct(F.lit("text"), F.col(c))
    value = F.to_json(F.named_struct(F.lit("a"), F.named_struct(F.lit("deep"), said("lang")), F.lit("b"), F.array(F.named_struct(F.lit("n"), F.lit(1), F.lit("x"), said("text"))), F.lit("c"), said("source")))
    return t.raw("documents").select("doc_id", F.md5(X.nested_text(value)).alias("text_md5"))


@query(sql("units rec evidence dispositions", """SELECT 'units' AS name, count(*) AS n FROM units WHERE event = 'src1' UNION ALL SELECT 'literal_records', count(*) FROM rec JOIN documents ON source_id = doc_id WHERE source = 'src1'
UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE source_id = 'src1' UNION ALL SELECT 'dispositions', count(*) FROM dispositions JOIN evidence USING (evidence_id) WHERE source_id = 'src1' UNION ALL SELECT 'relations', 0
UNION ALL SELECT 'postings', sum(len(list_distinct(list_concat(list_transform(range(1, length(topic) - 1), lambda i: substr(lower(topic), i, 3)), list_transform(range(1, length(claim) - 1), lambda i: substr(lower(claim), i, 3))))))::BIGINT FROM units WHERE event = 'src1'"""))
def package_scan(t: Tables) -> DataFrame:
    """A package is written, then one event of it is read; its postings are those of the units."""
    units = t.units()
    evidence = t.evidence().withColumn("event", F.col("source_id"))
    where = evidence.select(F.col("evidence_id").alias("k"), "event")
    tables = {
        "units": units, "literal_records": C.cite_records(t), "evidence": evidence,
        "dispositions": t.dispositions().join(where, F.col("evidence_id") == F.col("k")).drop("k"),
        "relations": t.spark.createDataFrame([("none", "r", "supports")], "event string, relation_id string, relation string"),
    }
    root = work_folder(t.spark)
    writers.package(tables, root)
    got = readers.package(t.spark, root, "src1")
    over = F.exists(F.array(F.shiftrightunsigned("gram", 42), F.shiftrightunsigned("gram", 21).bitwiseAND(2**21 - 1), F.col("gram").bitwiseAND(2**21 - 1)), lambda c: c == 0)
    got["postings"] = got["postings"].where((F.col("kind") == "unit") & ~over).select(F.explode(F.sequence(F.lit(1), F.col("n_docs"))))
    count = lambda name: got[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    out = count(schemas.PACKAGE_TABLES[0])
    for name in schemas.PACKAGE_TABLES[1:]:
        out = out.unionByName(count(name))
    return out


@query(sql("log", "SELECT event, max(ordinal) AS ordinal, count(*) AS n_rows FROM log GROUP BY event"))
def progress_snapshot(t: Tables) -> DataFrame:
    """The sink of a progress stream, called with three batches out of order, the second twice, and read back."""
    rows = t.log().select("event", F.col("ordinal").cast("double").alias("ts"), "ordinal")
    root = work_folder(t.spark)
    for epoch, part in ((0, 1), (1, 2), (1, 2), (2, 0)):
        online.upsert_snapshot(rows.where(F.col("ordinal") % 3 == part), epoch, root)
    return KeyedSnapshot(t.spark, f"{root}/snapshot").read().select("event", "ordinal", "n_rows")


@query("SELECT doc_id % 3 AS slide_source_id, md5(string_agg('- ' || printf('L%06d', doc_id) || ' (supports) ' || printf('E%06d', doc_id) || ': ' || lang, chr(10) ORDER BY doc_id)) AS markdown_md5 FROM documents GROUP BY 1")
def slide_markdown(t: Tables) -> DataFrame:
    relations = t.raw("documents").select((F.col("doc_id") % 3).alias("slide_source_id"), F.format_string("L%06d", "doc_id").alias("relation_id"), F.lit("supports").alias("relation"), F.array(F.format_string("E%06d", "doc_id")).alias("slide_evidence_ids"))
    evidence = t.raw("documents").select(F.format_string("E%06d", "doc_id").alias("evidence_id"), F.col("lang").alias("literal_text"))
    return writers.slide_markdown(relations, evidence).select("slide_source_id", F.md5("markdown").alias("markdown_md5"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE text = '') AS empty, count(*) = count(DISTINCT doc_id) AS ids_unique FROM documents")
def stage_receipt(t: Tables) -> DataFrame:
    """The counts are observed on the write; whether ids are unique is asked of the written id column alone."""
    path = f"{work_folder(t.spark)}/stage"
    seen = writers.write_with_receipt(t.raw("documents"), path, empty=F.count_if(F.col("text") == ""))
    ids = t.spark.read.parquet(path).select((F.count(F.lit(1)) == F.count_distinct("doc_id")).alias("ids_unique"))
    return ids.select(F.lit(seen["n_rows"]).cast("long").alias("n_rows"), F.lit(seen["empty"]).cast("long").alias("empty"), "ids_unique")


@query(sql("units evidence", "SELECT topic, unit_id, '' AS evidence_id, md5('### ' || unit_id || ' [' || certainty || ']' || chr(10) || claim) AS line_md5 FROM units UNION ALL SELECT topic, unit_id, e.evidence_id, md5('- ' || e.evidence_id || ' ' || e.source_id || ' ' || e.kind || ': ' || e.literal_text) FROM (SELECT topic, unit_id, unnest(evidence_ids) AS i FROM units) JOIN evidence e ON i = e.evidence_id"))
def package_details(t: Tables) -> DataFrame:
    return writers.details(t.units(), t.evidence()).select("topic", "unit_id", "evidence_id", F.md5("line").alias("line_md5"))


@query("SELECT word, count(*) AS n_items, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT word, item_id, count(*) AS tf FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY 1, 2) GROUP BY word")
def word_postings(t: Tables) -> DataFrame:
    return writers.word_postings(t.raw("benchmark"), "item_id", "text").groupBy("word").agg(F.count(F.lit(1)).alias("n_items"), F.sum("tf").alias("n"))


_PARAGRAPHS = r"""x AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY idx) AS n, length(regexp_replace(s, '\s+', '', 'g')) AS c,
    regexp_matches(s, '[.!?。！？…]$') AND lower(string_split(regexp_replace(s, '[.!?。！？…]+$', ''), ' ')[-1]) NOT IN ('and', 'but', 'or', 'und', 'et', 'y', 'because', 'so') AS proper
  FROM (SELECT *, regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS s FROM rec) WHERE s <> ''),
r AS (SELECT source_id, n, c AS size, 0 AS paragraph, (c >= 180 AND proper) OR c >= 360 AS closed FROM x WHERE n = 1
  UNION ALL SELECT x.source_id, x.n, CASE WHEN closed THEN 0 ELSE size END + c, paragraph + CASE WHEN closed THEN 1 ELSE 0 END, (CASE WHEN closed THEN 0 ELSE size END + c >= 180 AND proper) OR CASE WHEN closed THEN 0 ELSE size END + c >= 360 FROM r JOIN x ON x.source_id = r.source_id AND x.n = r.n + 1),
p AS (SELECT r.source_id, paragraph, min(idx) AS "first", max(idx) AS "last", string_agg(s, ' ' ORDER BY r.n) AS joined FROM r JOIN x ON x.source_id = r.source_id AND x.n = r.n GROUP BY 1, 2)"""
_RECURSIVE = sql("rec", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _PARAGRAPHS


@query(_RECURSIVE + '\nSELECT source_id, CAST(paragraph AS INTEGER) AS paragraph, "first", "last", md5(joined) AS text_md5 FROM p')
def paragraphs(t: Tables) -> DataFrame:
    return W.paragraphs(t.records(), "source_id", "idx", "text").select("source_id", "paragraph", "first", "last", F.md5("text").alias("text_md5"))


@query(_RECURSIVE + """\nSELECT p.source_id, CAST(paragraph AS INTEGER) AS paragraph, md5('**' || printf('%02d:%02d', a // 60, a % 60) || '–' || printf('%02d:%02d', b // 60, b % 60) || '**  ' || joined || chr(10) || '<sub>' || i || '–' || j || '</sub>') AS line_md5
FROM (SELECT p.*, u.record_id AS i, v.record_id AS j, CAST(floor(u.start_s) AS BIGINT) AS a, CAST(floor(v.end_s) AS BIGINT) AS b FROM p JOIN rec u ON u.source_id = p.source_id AND u.idx = "first" JOIN rec v ON v.source_id = p.source_id AND v.idx = "last") p""")
def readable_transcript(t: Tables) -> DataFrame:
    records = t.records().select("source_id", "idx", "record_id", F.col("start_s").alias("start_seconds"), F.col("end_s").alias("end_seconds"))
    return writers.readable(W.paragraphs(t.records(), "source_id", "idx", "text"), records, "source_id", "idx").select("source_id", "paragraph", F.md5("line").alias("line_md5"))


# ---------------------------------------------------------------- frames


_PIXEL = "CAST(round(greatest(0.0, least(255.0, 128 + 400 * CAST(x AS DOUBLE)))) AS BIGINT)"


def _pictures(t: Tables) -> DataFrame:
    """Embedding vectors as grey frames of eight columns, a video a label."""
    level = lambda x: F.lpad(F.hex(F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 400 * x.cast("double")))).cast("long")), 2, "0")
    rows = t.raw("embeddings").select(F.concat(F.lit("v"), F.coalesce("label", F.lit(0)).cast("string")).alias("video"), "vec_id", F.size("embedding").alias("n"), F.unhex(F.array_join(F.transform("embedding", level), "")).alias("pixels"))
    frame = (F.row_number().over(Window.partitionBy("video").orderBy("vec_id")) - 1).cast("long")
    return rows.select("video", frame.alias("frame"), frame.cast("double").alias("t"), F.lit(8).alias("width"), (F.col("n") / 8).cast("int").alias("height"), F.lit(1).alias("channels"), "pixels")


@query(f"""SELECT 'v' || coalesce(label, 0) AS video, row_number() OVER (PARTITION BY coalesce(label, 0) ORDER BY vec_id) - 1 AS frame, (row_number() OVER (PARTITION BY coalesce(label, 0) ORDER BY vec_id) - 1) / 2.0 AS t,
CAST(list_sum(list_transform(embedding, lambda x: {_PIXEL})) AS BIGINT) AS total FROM embeddings""")
def raw_frames(t: Tables) -> DataFrame:
    """Frames are written to a file a video and read back in ranges of seven."""
    rows = _pictures(t)
    height, folder = rows.agg(F.max("height")).first()[0] or 1, work_folder(t.spark)
    frames.write_frames(rows, folder, 8, height)
    total = F.expr("aggregate(sequence(1, length(pixels)), 0L, (a, i) -> a + CAST(conv(hex(substr(pixels, i, 1)), 16, 10) AS BIGINT))")
    return frames.read_frames(t.spark, folder, 8, height, fps=2.0, frames_per_part=7).select("video", "frame", "t", total.alias("total"))


@query()
def frame_descriptors(t: Tables) -> DataFrame:
    return V.describe(_pictures(t)).select("video", "frame", "phash", F.round("lap", 6).alias("lap"), F.round(F.aggregate("gray64", F.lit(0.0), lambda a, x: a + x) / 4096, 6).alias("mean"))


@query()
def still_regions(t: Tables) -> DataFrame:
    """A framed slide on a ground of embedding values, which move from frame to frame."""

    def drawn(parts):
        for pdf in parts:
            made = []
            for frame, pixels in zip(pdf["frame"], pdf["pixels"]):
                ground = np.roll(np.resize(np.frombuffer(pixels, dtype=np.uint8), 96 * 64), int(frame) * 37).reshape(64, 96).copy()
                ground[6:46, 8:72], ground[8:44, 10:70], ground[20:23, 20:50] = 0, 235, 40
                made.append(ground.tobytes())
            yield pdf.assign(width=96, height=64, channels=1, pixels=made)

    return V.still_region(_pictures(t).mapInPandas(drawn, _pictures(t).schema))


# ---------------------------------------------------------------- text functions


_KEEP = r"regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')"


@query(f"SELECT doc_id, md5({_KEEP}) AS compact_md5 FROM documents")
def compact_nfkc(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.md5(X.compact_nfkc("text")).alias("compact_md5"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\s+', '', 'g')) AS compact_md5 FROM documents")
def compact_space(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.md5(X.compact_space("text")).alias("compact_md5"))


@query("""WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark)
SELECT a.item_id, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS containment FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def containment(t: Tables) -> DataFrame:
    rows = t.raw("benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    other = rows.select((F.col("item_id") - 1).alias("k"), F.col("w").alias("v"))
    return rows.join(other, F.col("item_id") == F.col("k")).select("item_id", F.round(X.containment(F.col("w"), F.col("v")), 6).alias("containment"))


#: Latin letters of the fixtures as CJK ones, so that the CJK functions have something to read.
_CJK = ("abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄")
_AS_CJK = f"translate(text, '{_CJK[0]}', '{_CJK[1]}')"


@query(f"""SELECT item_id, array_to_string(list_sort(list_distinct(flatten(list_transform(regexp_extract_all(t, '[一-鿿]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))), ',') AS shingles FROM (SELECT item_id, {_AS_CJK} AS t FROM benchmark)""")
def cjk_shingles(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", F.array_join(X.cjk_shingles(F.translate("text", *_CJK)), ",").alias("shingles"))


@query(f"""SELECT item_id, len(list_distinct(flatten(list_transform(list_filter(regexp_extract_all(t, '[一-鿿]+'), lambda r: length(r) >= 3), lambda r: list_transform(range(1, length(r) - 1), lambda i: substr(r, i, 3)))))) AS n_windows FROM (SELECT item_id, {_AS_CJK} AS t FROM benchmark)""")
def cjk_windows(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", F.size(X.cjk_windows(F.translate("text", *_CJK), 3)).cast("long").alias("n_windows"))


@query("""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9]{3,}'), lambda w: regexp_matches(w, '[A-Za-z]') AND lower(w) NOT IN ('the', 'that')))) AS n_terms FROM documents""")
def ocr_terms(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.size(X.ocr_terms("text", ["the", "that"])).cast("long").alias("n_terms"))


@query("SELECT item_id, unnest([1, 2]) AS n, item_id AS id FROM benchmark")
def lenient_json(t: Tables) -> DataFrame:
    """Objects of the first array in a chatty answer, after a thinking block that has one too."""
    rows = F.to_json(F.array(F.struct(F.col("item_id").alias("id"), F.lit(1).alias("n")), F.struct(F.col("item_id").alias("id"), F.lit(2).alias("n"))))
    said = F.concat(F.lit("<think>[{\"n\": 9}]</think> Sure, {here}:\n```json\n"), rows, F.lit("\n``` done [7]"))
    got = t.raw("benchmark").select("item_id", F.explode(X.json_objects(said)).alias("j"))
    return got.select("item_id", F.from_json("j", "id bigint, n int").alias("o")).select("item_id", "o.n", "o.id")


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: round(x * 100) * 1.0) AS g FROM embeddings), n AS (SELECT *, lag(g) OVER (ORDER BY vec_id) AS h FROM g)
SELECT vec_id, round(list_sum(list_transform(list_zip(g, h), lambda z: abs(z[1] - z[2]))) / len(g) / 255, 6) AS difference FROM n WHERE h IS NOT NULL""")
def pixel_difference(t: Tables) -> DataFrame:
    rows = t.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x * F.lit(100).cast("float")).cast("double")).alias("g"))
    other = rows.select((F.col("vec_id") + 1).alias("k"), F.col("g").alias("h"))
    return rows.join(other, F.col("vec_id") == F.col("k")).select("vec_id", F.round(X.pixel_difference(F.col("g"), F.col("h")), 6).alias("difference"))


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x * 100) AS DOUBLE)) AS g FROM embeddings),
e AS (SELECT vec_id, list_transform(list_filter(range(0, 64), lambda i: i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6), lambda i: g[i] + g[i + 2] + g[i - 7] + g[i + 9] - 4 * g[i + 1]) AS e FROM g)
SELECT vec_id, round(list_var_pop(e) + 0.013) AS sharpness FROM e""")
def laplacian_variance(t: Tables) -> DataFrame:
    """An embedding's 64 values as an image of eight rows."""
    gray = F.transform("embedding", lambda x: F.round(x * F.lit(100).cast("float")).cast("double"))
    return t.raw("embeddings").select("vec_id", F.round(X.laplacian_variance(gray, 8) + 0.013).alias("sharpness"))


@query(f"""SELECT w AS word, array_to_string(string_split(translate(w, '{_CJK[1]}', '{_CJK[0]}'), ''), ' ') AS reading FROM (SELECT DISTINCT unnest(flatten(list_transform(regexp_extract_all(t, '[一-鿿]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))) AS w FROM (SELECT {_AS_CJK} AS t FROM benchmark))""")
def reading_keys(t: Tables) -> DataFrame:
    """Each stand-in letter reads as the Latin one it stands for."""
    readings = t.spark.createDataFrame(list(zip(_CJK[1], _CJK[0])), "character string, reading string")
    words = t.raw("benchmark").select(F.explode(X.cjk_shingles(F.translate("text", *_CJK))).alias("w"))
    return J.reading_keys(words, "w", readings)


@query("SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN NULL ELSE value END AS seconds FROM events")
def finite_probe(t: Tables) -> DataFrame:
    """A probe's numbers, of which some are no numbers."""
    k = F.col("event_id") % 7
    odd = F.when(k == 0, "NaN").when(k == 1, "Infinity").when(k == 2, "-Infinity").otherwise(F.col("value").cast("string"))
    rows = t.raw("events").select("event_id", odd.cast("double").alias("seconds"))
    return rows.select("event_id", readers.finite("seconds").alias("seconds"))


# ---------------------------------------------------------------- projections, joins, windows


@query("SELECT event_id, value / 100 >= 0.72 AND event_id % 100 >= 82 AND event_id % 2 = 0 AS passes FROM events")
def ensemble_gate(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", P.ensemble_gate(F.col("value") / 100, F.col("event_id") % 100 / 100, F.col("event_id") % 2 == 0).alias("passes"))


@query(sql("evidence", "SELECT evidence_id FROM evidence WHERE kind <> 'image' OR source_id IN ('src1', 'src4', 'src7')"))
def slide_track(t: Tables) -> DataFrame:
    receipts = t.spark.createDataFrame([(f"src{i}", i % 3 == 1, i % 10) for i in range(11)] + [("src10", True, 0)], "source_id string, slide_track boolean, slides int")
    return P.slide_track(t.evidence(), receipts).select("evidence_id")


@query(sql("evidence", "SELECT doc_id, kind, md5(literal_text) AS text_md5 FROM labels JOIN evidence ON evidence_id = printf('E%06d', doc_id)"))
def evidence_lookup(t: Tables) -> DataFrame:
    rows = t.raw("labels").select("doc_id", F.format_string("E%06d", "doc_id").alias("evidence_id"))
    return J.lookup(rows, t.evidence(), "evidence_id", ["kind", "literal_text"]).select("doc_id", "kind", F.md5("literal_text").alias("text_md5"))


@query(sql("evidence", "SELECT doc_id + 900 AS page, kind FROM documents LEFT JOIN evidence ON n = doc_id + 900"))
def page_lookup(t: Tables) -> DataFrame:
    """A page map that may miss pages: what it lacks stays null."""
    rows = t.raw("documents").select((F.col("doc_id") + 900).alias("page"))
    return J.lookup(rows, t.evidence().withColumnRenamed("n", "page"), "page", ["kind"], required=False)


@query(sql("evidence", "SELECT printf('E%06d', row_number() OVER (ORDER BY kind, source_id, n)) AS evidence_id, n FROM (SELECT kind, source_id, n FROM evidence WHERE kind = 'image' UNION ALL SELECT 'audio', source_id, n FROM evidence WHERE kind = 'audio' AND n % 2 = 0)"))
def carry_over_images(t: Tables) -> DataFrame:
    """New audio evidence beside the images of the old, numbered anew."""
    old = t.evidence().select("evidence_id", "kind", "source_id", "n")
    made = J.carry_over_images(old, old.where("kind = 'audio' AND n % 2 = 0"))
    return W.assign_ids(made, "kind", ["source_id", "n"]).select("evidence_id", "n")


@query("""WITH f AS (SELECT conv_id, min_by(text, turn) AS h, max_by(text, turn) AS l FROM conversations GROUP BY 1), e AS (SELECT conv_id, 0 AS side, h AS t FROM f UNION ALL SELECT conv_id, 1, l FROM f),
w AS (SELECT *, list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9'']+')) AS w FROM e),
n AS (SELECT item_id AS line_no, text AS line, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9'']+')) AS lw FROM benchmark),
s AS (SELECT conv_id, side, line_no, CASE WHEN length(substr(t, 1, 24)) >= 6 AND contains(line, substr(t, 1, 24)) THEN 1.0 ELSE len(list_intersect(w, lw)) / len(list_distinct(list_concat(w, lw))) END AS score FROM w, n WHERE list_has_any(w, lw))
SELECT conv_id, line_no, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, line_no, side) AS r FROM s WHERE score >= 0.03) WHERE r = 1""")
def note_hint(t: Tables) -> DataFrame:
    f = t.turns().groupBy("conv_id").agg(F.min_by("text", "turn").alias("head_text"), F.max_by("text", "turn").alias("tail_text"))
    out = J.note_hint(f, t.raw("benchmark").select(F.col("item_id").alias("line_no"), "text"), "conv_id", 0.03)
    return out.select("conv_id", "line_no", F.round("score", 6).alias("score"))


@query("SELECT conv_id, sha1(array_to_string(list_sort(k), chr(10)) || chr(10) || substr(h, 1, 120) || chr(10) || right(l, 120)) AS digest FROM (SELECT conv_id, list(role || turn) AS k, min_by(text, turn) AS h, max_by(text, turn) AS l FROM conversations GROUP BY 1)")
def content_order(t: Tables) -> DataFrame:
    f = t.turns().groupBy("conv_id").agg(F.collect_list(F.concat("role", F.col("turn").cast("string"))).alias("k"), F.min_by("text", "turn").alias("h"), F.max_by("text", "turn").alias("l"))
    return f.select("conv_id", W.content_order("k", "h", "l").alias("digest"))


@query("SELECT o_orderkey, CASE WHEN c < 0.85 THEN 'error' WHEN c < 0.95 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT o_orderkey, sum(l_extendedprice) / nullif(max(o_totalprice), 0) AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def coverage_level(t: Tables) -> DataFrame:
    n = t.raw("lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("covered"))
    rows = n.join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", W.coverage_level(F.col("covered"), F.col("o_totalprice")).alias("level"))


def _risk_sql() -> str:
    risk = r"CASE WHEN NOT regexp_matches(trim(text), '[.!?。！？…]$') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(trim(text), '(?i)\b(?:and|but|or|und|et|y|because|so)\s*$') THEN 4 ELSE 0 END"
    out = [f"a AS (SELECT source_id, record_id, start_s, {risk} AS risk FROM rec)"]
    for k in range(1, 5):
        away = " AND ".join(f"abs(start_s - t{j}) >= 60" for j in range(1, k)) or "true"
        picked = f"JOIN p{k - 1} USING (source_id)" if k > 1 else ""
        kept = ", ".join(f"t{j}" for j in range(1, k))
        out.append(f"p{k} AS (SELECT source_id, {kept + ', ' if kept else ''}start_s AS t{k}, record_id FROM (SELECT a.*, {kept + ', ' if kept else ''}row_number() OVER (PARTITION BY source_id ORDER BY risk DESC, start_s) AS n FROM a {picked} WHERE {away}) WHERE n = 1)")
    return sql("rec", "").rstrip() + ",\n" + ",\n".join(out) + "\n" + " UNION ALL ".join(f"SELECT source_id, record_id FROM p{k}" for k in range(1, 5))


@query(_risk_sql())
def spaced_topk(t: Tables) -> DataFrame:
    risk = P.continuity_risk(F.col("text"), F.lit(False), F.lit("high"))
    return W.spaced_topk(t.records().select("source_id", "record_id", "start_s", risk.alias("risk")), "source_id", "start_s", "risk", 4, 60.0).select("source_id", "record_id")


@query(sql("rec", r"""SELECT count(*) AS records, count(*) FILTER (WHERE NOT regexp_matches(trim(text), '[.!?。！？…]$')) AS nonterminal, count(*) FILTER (WHERE regexp_matches(trim(text), '(?i)\b(?:and|but|or|und|et|y|because|so)\s*$')) AS connector_ending, count(*) FILTER (WHERE idx % 13 = 0) AS unresolved_joins FROM rec"""))
def continuity_counts(t: Tables) -> DataFrame:
    return A.continuity_counts(t.records(), "text", F.col("idx") % 13 == 0)


# ---------------------------------------------------------------- retrieval


@query(sql("units", "SELECT event, 'unit' AS kind, rank AS position, md5(unit_id || ' [' || certainty || '] ' || claim) AS line_md5 FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY certainty, unit_id) AS rank FROM units WHERE certainty IN ('low', 'medium')) WHERE rank <= 20 UNION ALL SELECT source, 'note', row_number() OVER (PARTITION BY source ORDER BY d.doc_id), md5(substr(printf('N%06d', d.doc_id) || ' · conflict · ' || text, 1, 120)) FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1"))
def uncertainties(t: Tables) -> DataFrame:
    toxic = t.raw("labels").select(F.col("doc_id").alias("k"), "toxic")
    relations = t.raw("documents").join(toxic, F.col("doc_id") == F.col("k")).select(F.col("source").alias("event"), F.format_string("N%06d", "doc_id").alias("note_id"), F.when(F.col("toxic") == 1, "conflict").otherwise("supports").alias("relation"), F.col("text").alias("detail"))
    return R.uncertainties(t.units(), relations).select("event", "kind", "position", F.md5("line").alias("line_md5"))


@query(sql("rec", """, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY record_id) AS n FROM rec),
a AS (SELECT 'R' || doc_id AS ask, doc_id AS e, (SELECT n FROM r WHERE r.source_id = doc_id AND r.record_id = printf('R%06d_%05d', doc_id, 2)) AS n FROM documents UNION ALL SELECT 'T' || doc_id, doc_id, (SELECT max(n) FROM r WHERE r.source_id = doc_id AND start_s <= 40.0) FROM documents)
SELECT ask, r.source_id AS event, record_id, r.n - a.n AS position, md5(CASE WHEN r.n = a.n THEN '→' ELSE ' ' END || ' ' || record_id || ' [' || printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) || '] ' || text || CASE WHEN idx % 5 = 0 THEN ' [logistics]' WHEN idx % 5 = 1 THEN ' [uncertain]' ELSE '' END) AS line_md5
FROM a JOIN (SELECT *, CAST(CASE WHEN abs(start_s - floor(start_s) - 0.5) < 1e-9 THEN floor(start_s) + floor(start_s) % 2 ELSE round(start_s) END AS BIGINT) AS s FROM r) r ON r.source_id = e AND r.n BETWEEN a.n - 3 AND a.n + 3""").replace("\n, r AS", ", r AS"))
def transcript_context(t: Tables) -> DataFrame:
    label = F.when(F.col("idx") % 5 == 0, "logistics").when(F.col("idx") % 5 == 1, "uncertain").otherwise("content")
    records = t.records().select(F.col("source_id").alias("event"), "record_id", F.col("start_s").alias("start_seconds"), F.col("text").alias("clean_literal"), label.alias("label"))
    docs = t.raw("documents").select("doc_id")
    named = docs.select(F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("ask"), F.col("doc_id").alias("event"), F.format_string("R%06d_%05d", "doc_id", F.lit(2)).alias("record_id"), F.lit(None).cast("double").alias("around_seconds"))
    timed = docs.select(F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("ask"), F.col("doc_id").alias("event"), F.lit(None).cast("string").alias("record_id"), F.lit(40.0).alias("around_seconds"))
    out = R.transcript_context(records, named.unionByName(timed))
    return out.select("ask", "event", "record_id", F.col("position").cast("long").alias("position"), F.md5("line").alias("line_md5"))


# ---------------------------------------------------------------- graph


_MUTUAL = f"""{C._FRAG}, {C._DIRECTED}, s AS (SELECT * FROM d WHERE score >= 0.05),
x AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n, score - coalesce(lead(score) OVER (PARTITION BY a ORDER BY score DESC, b), 0) AS gap FROM s),
y AS (SELECT a, b, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS n, score - coalesce(lead(score) OVER (PARTITION BY b ORDER BY score DESC, a), 0) AS gap FROM s),
m AS (SELECT x.a, x.b FROM x JOIN y ON x.a = y.a AND x.b = y.b WHERE x.n = 1 AND y.n = 1 AND x.gap >= 0.005 AND y.gap >= 0.005)"""


@query(f"""WITH RECURSIVE {_MUTUAL}, u AS (SELECT a, b FROM m UNION SELECT b, a FROM m), cc AS (SELECT a AS n, a AS z FROM u UNION SELECT cc.n, u.b FROM cc JOIN u ON cc.z = u.a),
k AS (SELECT n, min(z) AS chain FROM cc GROUP BY 1), h AS (SELECT a AS node FROM m WHERE a NOT IN (SELECT b FROM m) UNION SELECT chain FROM k WHERE chain NOT IN (SELECT chain FROM k JOIN m ON m.a = k.n WHERE m.a NOT IN (SELECT b FROM m))),
w AS (SELECT node AS head, node, 1 AS position FROM h UNION ALL SELECT w.head, m.b, position + 1 FROM w JOIN m ON m.a = w.node WHERE m.b <> w.head)
SELECT chain, node, CAST(position AS INTEGER) AS position FROM w JOIN k ON k.n = w.head""")
def chain_walk(t: Tables) -> DataFrame:
    return G.chain_walk(J.mutual_best_sets(C._fragments(t), "conv_id", 0.05, 0.005))


# ---------------------------------------------------------------- model boundary


@query("SELECT source, chunk FROM (SELECT source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 5) AS BIGINT) AS chunk FROM documents) GROUP BY 1, 2 HAVING chunk % 2 = 1")
def resume_chunks(t: Tables) -> DataFrame:
    """What is left to ask where every other chunk has an answer by its content."""
    keyed = M.chunk_fingerprints(M.chunks(t.raw("documents"), "source", "doc_id", 5), "source", "doc_id", ["doc_id", "text"])
    return M.pending(keyed, keyed.where("chunk % 2 = 0").select("fingerprint")).select("source", "chunk")


@query("""WITH c AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS chunk FROM documents), h AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY doc_id) AS k FROM c WHERE chunk % 3 = 0 WINDOW w AS (PARTITION BY source, chunk))
SELECT source, doc_id, CAST(chunk * 2 + CASE WHEN k > ceil(n / 2) THEN 1 ELSE 0 END AS BIGINT) AS chunk, n = 1 AS spent FROM h""")
def halve_chunks(t: Tables) -> DataFrame:
    """Every third chunk failed."""
    rows = M.chunks(t.raw("documents").select("source", "doc_id"), "source", "doc_id", 5)
    return M.halve(rows, rows.where("chunk % 3 = 0"), "source", "doc_id").select("source", "doc_id", "chunk", "spent")


@query("SELECT doc_id, length(text) AS size, lang = 'en' AS english FROM documents")
def call_model(t: Tables) -> DataFrame:
    """An adapter that counts, over Arrow batches."""
    rows = t.raw("documents").select("doc_id", "text", "lang")
    return M.call_model(rows, lambda p: p.assign(size=p["text"].str.len(), english=p["lang"] == "en")[["doc_id", "size", "english"]], "doc_id long, size long, english boolean")


@query("""WITH n AS (SELECT doc_id, idx, record_id, text, coalesce(right(lag(text) OVER w, 120), '') AS p, coalesce(substr(lead(text) OVER w, 1, 120), '') AS x FROM (SELECT source_id AS doc_id, * FROM rec) WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT record_id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1) // 10 AS BIGINT) AS batch, md5(p || '|' || text || '|' || x) AS said_md5 FROM n WHERE length(text) % 3 = 0""".replace("WITH n", sql("rec", "").rstrip() + ",\nn", 1))
def adjudication_batches(t: Tables) -> DataFrame:
    rows = t.records()
    out = M.adjudication_batches(rows, rows.where(F.length("text") % 3 == 0), "source_id", "idx", "record_id", "text")
    return out.select("record_id", "batch", F.md5(F.concat_ws("|", "previous", "text", "next")).alias("said_md5"))


@query("""WITH a AS (SELECT source, doc_id, doc_id % 4 AS batch, unnest([0, 1, 2, 3, 4, 5]) AS attempt FROM documents), v AS (SELECT *, CASE WHEN attempt < batch OR batch = 3 AND attempt < 5 THEN 'garbled' WHEN doc_id % 2 = 0 THEN 'content' ELSE 'logistics' END AS verdict FROM a)
SELECT source, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'content' ELSE 'logistics' END AS verdict FROM documents WHERE doc_id % 4 <> 3""")
def first_answers(t: Tables) -> DataFrame:
    """A batch answers from its own number of tries on; the last batch only after the five that count."""
    rows = t.raw("documents").select("source", "doc_id", (F.col("doc_id") % 4).alias("batch"), F.explode(F.array(*map(F.lit, range(6)))).alias("attempt"))
    garbled = (F.col("attempt") < F.col("batch")) | ((F.col("batch") == 3) & (F.col("attempt") < 5))
    rows = rows.withColumn("verdict", F.when(garbled, "garbled").when(F.col("doc_id") % 2 == 0, "content").otherwise("logistics"))
    return M.first_answers(rows, "source", "doc_id", ["content", "logistics", "uncertain"])


# ---------------------------------------------------------------- resources


_SAMPLES = "s AS (SELECT user_id AS k, event_id * 7.0 AS ts, 300.0 + (event_id * 37 % 97) * 30 AS free_mb, 8000.0 AS total_mb, (event_id * 13 % 40) * 1.0 AS load1, 8.0 AS cores, (event_id * 31 % 11) * 4000.0 AS swap_used_mb FROM events)"
_ZONED = _SAMPLES + """, r AS (SELECT *, (swap_used_mb - lag(swap_used_mb) OVER w) / nullif(ts - lag(ts) OVER w, 0) * 10 AS rate FROM s WINDOW w AS (PARTITION BY k ORDER BY ts)),
z AS (SELECT k, ts, CASE WHEN free_mb < 640 OR load1 > 32 OR coalesce(rate > 256, false) AND free_mb < 1024 THEN 'red' WHEN free_mb < 1200 OR load1 > 20 THEN 'yellow' ELSE 'green' END AS raw FROM r),
p AS (SELECT *, lag(raw) OVER (PARTITION BY k ORDER BY ts) AS was FROM z), zoned AS (SELECT k, ts, raw, last_value(CASE WHEN was IS NULL OR was = raw THEN raw END IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS zone FROM p)"""


def _samples(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.raw("events").select(F.col("user_id").alias("k"), (e * 7.0).alias("ts"), (300.0 + e * 37 % 97 * 30).alias("free_mb"), F.lit(8000.0).alias("total_mb"), (e * 13 % 40 * 1.0).alias("load1"), F.lit(8.0).alias("cores"), (e * 31 % 11 * 4000.0).alias("swap_used_mb"))


@query(f"WITH {_ZONED} SELECT * FROM zoned")
def resource_zones(t: Tables) -> DataFrame:
    return S.zones(_samples(t), "k", "ts").select("k", "ts", "raw", "zone")


@query(f"""WITH {_ZONED}, q AS (SELECT event_id AS request, user_id AS k, event_id * 7.0 + 3 AS a FROM events WHERE event_type = 'purchase'),
w AS (SELECT unnest(list_concat([0.0, 2.0, 6.0], list_transform(range(0, 38), lambda i: 14.0 + 8.0 * i))) AS waited), m AS (SELECT request, waited, zone FROM (SELECT request, waited, k, a + waited AS at FROM q, w) x ASOF LEFT JOIN zoned ON x.k = zoned.k AND x.at >= zoned.ts)
SELECT request, min(waited) AS waited, arg_min(zone, waited) AS zone, CASE WHEN arg_min(zone, waited) = 'red' THEN 'timeout_pass' WHEN min(waited) > 0 THEN 'resume' ELSE 'pass' END AS action FROM m WHERE zone <> 'red' OR waited >= 300 GROUP BY request""")
def resource_gate(t: Tables) -> DataFrame:
    asked = t.raw("events").where("event_type = 'purchase'").select(F.col("event_id").alias("request"), F.col("user_id").alias("k"), (F.col("event_id") * 7.0 + 3).alias("a"))
    return S.gate(asked, S.zones(_samples(t), "k", "ts"), "request", "k", "a", "ts")


@query(sql("rec", "SELECT record_id, end_s - start_s < 2.5 AS is_short FROM rec"))
def short_flag(t: Tables) -> DataFrame:
    return P.relevance_candidates(t.records(), "text", "start_s", "end_s", C._HITS).select("record_id", "is_short")


# ---------------------------------------------------------------- expectations


@query(sql("units rec evidence", """, f AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars * CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 1.0 END END AS d, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS s FROM documents WHERE n_chars > 0),
g AS (SELECT source_id, max(end_s) AS covered, any_value(n_chars) / 15.0 * CASE WHEN source_id % 3 = 0 THEN 2.0 ELSE 1.08 END AS d FROM rec JOIN documents ON source_id = doc_id GROUP BY 1)
SELECT 'track_truncated' AS rule, 'error' AS severity, count(*) AS n FROM f WHERE s IS NOT NULL AND d < 0.9 * s UNION ALL SELECT 'track_unprobed', 'warning', count(*) FROM f WHERE d IS NULL UNION ALL SELECT 'source_duration_unknown', 'warning', count(*) FROM f WHERE s IS NULL AND d IS NOT NULL
UNION ALL SELECT 'transcript_coverage_error', 'error', count(*) FROM g WHERE covered / d < 0.85 UNION ALL SELECT 'transcript_coverage_warning', 'warning', count(*) FROM g WHERE covered / d >= 0.85 AND covered / d < 0.95
UNION ALL SELECT 'record_cites_unknown', 'error', count(DISTINCT doc_id + 1) FROM documents WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'evidence_never_cited', 'error', count(*) FROM documents WHERE doc_id - 1 NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'claim_residual', 'warning', count(*) FROM labels WHERE toxic = 1 AND doc_id % 2 <> 0
UNION ALL SELECT 'package_rows_differ', 'error', count(DISTINCT source) FROM documents WHERE source IN ('src3', 'src5') UNION ALL SELECT 'package_incomplete', 'error', count(DISTINCT source) FROM documents WHERE source IN ('src2')""").replace("\n, f AS", ", f AS"))
def meeting_checks(t: Tables) -> DataFrame:
    """Counts of violations by rule, over tables with a known share of faults."""
    docs = t.raw("documents")
    k = F.col("doc_id")
    some = docs.where("n_chars > 0")
    tracks = some.select(k.alias("source_id"), F.when(k % 6 != 0, F.col("n_chars") * F.when(k % 4 == 0, 0.5).otherwise(1.0)).alias("duration"))
    sources = some.select(k.alias("source_id"), F.when(k % 10 != 0, F.col("n_chars").cast("double")).alias("duration"))
    records = t.records().withColumnRenamed("end_s", "end_seconds")
    lengths = docs.select(k.alias("source_id"), (F.col("n_chars") / 15 * F.when(k % 3 == 0, 2.0).otherwise(1.08)).alias("duration"))
    cites = docs.select(F.format_string("R%06d", k).alias("record_id"), F.array(F.format_string("E%06d", k + 1)).alias("evidence_ids"))
    decided = C._decided(t).select("doc_id", "excluded")
    events = docs.select(F.col("source").alias("event"))
    receipts = events.distinct().withColumn("status", F.when(F.col("event") == "src2", "PARTIAL").otherwise("COMPLETE"))
    found = E.union(
        E.durations(tracks, sources), E.coverage(records, lengths), E.alignment(cites, t.evidence()), E.relevance(decided, docs, "doc_id"), E.claim_audit(C._audited(t)),
        E.package_state(t.units(), events.where("event <> 'src3'").unionAll(events.where("event = 'src5'")), events, receipts),
    )
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
