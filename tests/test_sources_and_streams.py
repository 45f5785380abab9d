"""Readers, sinks, entry points and streaming twins."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.fulltext import packed
from quillstone.operators.retrieval import search_token
from quillstone.sources import readers, schemas, writers
from quillstone.streaming import online, stateful
from quillstone.streaming.snapshots import KeyedSnapshot

ROW = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_jsonl_modes(spark, tmp_path, rows):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert rows(readers.jsonl(spark, str(p), ROW)) == [(1, "x"), (2, None)]
    assert readers.jsonl(spark, str(tmp_path / "none"), ROW).count() == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n{broken\n[3]\n')
    assert readers.jsonl(spark, str(bad), ROW, "tolerant").count() >= 1
    with pytest.raises(Exception):
        readers.jsonl(spark, str(bad), ROW, "strict").collect()
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "none"), ROW, "strict").collect()


def test_jsonl_tail(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text("".join(json.dumps({"a": i, "b": "z"}) + "\n" for i in range(20)) + "{oops\n")
    assert [r.a for r in readers.jsonl_tail(spark, str(p), ROW, 3).collect()] == [17, 18, 19]


def test_directory_as_table_and_composite_keys(spark, tmp_path, rows):
    for name in ("F000001_0_200000__norm.json", "F000001_150000_350000__raw.json", "x_receipt.json"):
        (tmp_path / name).write_text('{"a": 1,\n "b": "t"}')
    df = readers.keyed_directory(spark, str(tmp_path), ROW).select("b", readers.composite_key(F.col("key")).alias("k")).select("b", "k.*")
    assert rows(df, "source_id", "start_seconds", "end_seconds", "route") == [("F000001", 0.0, 20.0, "norm"), ("F000001", 15.0, 35.0, "raw")]
    assert readers.json_document(spark, str(tmp_path / "x_receipt.json"), ROW).first().a == 1


def test_inventory_events_and_archive(spark, tmp_path, rows):
    for name in ("ev1/a.wav", "ev1/b.PNG", "loose.md", "ev2/.hidden.wav"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(name)
    files = readers.inventory(spark, str(tmp_path))
    got = {os.path.basename(r.path): r for r in files.collect()}
    assert got["a.wav"].kind == "audio" and got["b.PNG"].kind == "image" and got["loose.md"].eligible and len({r.source_id for r in got.values()}) == len(got)
    events = {os.path.basename(r.path): r.event for r in readers.group_events(files, f"file:{tmp_path}").collect()}
    assert events["a.wav"] == "ev1" and events["loose.md"] == "misc"
    (tmp_path / "loose.md").write_text("changed")
    plan = {os.path.basename(r.path): r.action for r in writers.archive_plan(spark.createDataFrame(list(got.values()), files.schema), readers.inventory(spark, str(tmp_path))).collect()}
    assert plan["loose.md"] == "changed" and plan["a.wav"] == "move"


def test_fragment_skip_reasons(spark, rows):
    f = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "fragment_id string")
    r = spark.createDataFrame([("a", "x"), ("b", " "), ("d", "y")], "fragment_id string, clean_literal string")
    broken = spark.createDataFrame([("d",)], "fragment_id string")
    assert rows(readers.fragment_runs(f, r, broken), "fragment_id", "skip_reason") == [("a", None), ("b", "empty_transcript"), ("c", "missing_literal_records"), ("d", "broken_jsonl")]


def test_package_round_trip_hides_private(spark, tmp_path):
    units = spark.createDataFrame([("e", "U1", ["t"], "the launch"), ("x_private", "U2", ["t"], "secret")], "event string, unit_id string, topic_path array<string>, claim string")
    records = spark.createDataFrame([("e", "R1", "words")], "event string, record_id string, clean_literal string")
    empty = spark.createDataFrame([("e", "z")], "event string, evidence_id string")
    writers.package({"units": units, "literal_records": records, "evidence": empty, "dispositions": empty, "relations": empty}, str(tmp_path / "p"))
    got = readers.package(spark, str(tmp_path / "p"))
    assert [r.unit_id for r in got["units"].collect()] == ["U1"] and got["postings"].where(F.col("gram") == int(packed("lau")[0])).count() == 1
    assert [r.id for r in search_token(None, None, "launch", index=readers.package_index(spark, str(tmp_path / "p"))).collect()] == ["U1"]
    assert search_token(None, None, "secret", index=readers.package_index(spark, str(tmp_path / "p"))).count() == 0
    assert set(got) == set(schemas.PACKAGE_TABLES)


SCHEDULE = [(1, 0, 12), (2, 12, 20), (3, 20, 31), (1, 31, 40), (4, 40, 50)]


def frames():
    hashes = {1: 0, 2: (1 << 20) - 1, 3: ((1 << 20) - 1) << 22, 4: ((1 << 20) - 1) << 43}
    out = []
    for page, a, b in SCHEDULE:
        for t in range(a * 2, b * 2):
            h = hashes[page]
            out.append(("v", t / 2, h - (1 << 64) if h >= 1 << 63 else h, [0.0] * 4, float(t % 7)))
    out[30] = (*out[30][:2], -1, *out[30][3:])  # one stray frame changes nothing
    return out


FRAME = "video string, t double, phash long, gray64 array<double>, lap double"


@pytest.mark.parametrize("parts", [1, 5])
def test_segments_follow_the_schedule(spark, parts):
    df = spark.createDataFrame(frames(), FRAME).repartition(parts)
    got = online.segment_frames(df).orderBy("start").collect()
    assert [(r.start, r.end) for r in got][:-1] == [(float(a), float(b)) for _, a, b in SCHEDULE][:-1] and len(got) == 5
    from quillstone.operators.windows import dedupe_pages

    pages = dedupe_pages(spark.createDataFrame(got), "video", "start", "phash").collect()
    assert len(pages) == 4 and max(len(p.time_ranges) for p in pages) == 2


def machine(track, duration=None, **settings):
    s = online.Segmenter(**settings)
    for frame in track:
        if not s.push(frame):
            break
    return s, [(x["start"], x["end"], x["best_t"]) for x in s.finish(duration)]


FAR = (1 << 30) - 1


def test_flicker_retracts_all():
    assert machine([(i * 0.5, 0 if i // 3 % 2 else FAR, [], 1.0) for i in range(60)])[1] == []


def test_the_last_segment_ends_at_the_duration():
    track = [(float(t), 0 if t < 5 else FAR, [], float(t % 3)) for t in range(10)]
    assert machine(track, 10.0)[1] == [(0.0, 5.0, 2.0), (5.0, 10.0, 5.0)]
    assert machine(track)[1][-1][1] == 10.0, "ten frames a second apart are ten seconds"


def test_a_flash_leaves_no_trace():
    """One differing frame, the sharpest of all, falls back to the anchor; another stays open at the end."""
    track = [(float(t), FAR if t in (4, 9) else 0, [], 9.0 if t in (4, 9) else 1.0) for t in range(10)]
    assert machine(track, 10.0)[1] == [(0.0, 10.0, 0.0)]


def test_the_confirming_frame_is_judged_by_the_new_anchor():
    """Page b begins at 3; the frame that confirms it is page c already, whose next frame confirms c at 4."""
    b, c = FAR, FAR << 32
    track = [(float(t), h, [], 1.0) for t, h in enumerate([0, 0, 0, b, c, c, c])]
    assert machine(track, 7.0)[1] == [(0.0, 3.0, 0.0), (3.0, 4.0, 3.0), (4.0, 7.0, 4.0)]


def test_wild_frames_cut_the_track_off():
    """Each of three frames differs greatly from the one before it: the track ends where that began, also for the sharpest frame."""
    calm, wild = [(float(t), 0, [0.0] * 4, 1.0) for t in range(5)], [(5.0, 0, [255.0] * 4, 7.0), (6.0, 0, [0.0] * 4, 8.0), (7.0, 0, [255.0] * 4, 9.0)]
    s, got = machine([*calm, *wild, (8.0, 0, [0.0] * 4, 1.0)], 9.0)
    assert got == [(0.0, 5.0, 0.0)] and s.cut_at == 5.0 and s.frames == 8
    slow = [(float(t), 0, [0.0 if t < 5 else 255.0] * 4, 1.0) for t in range(10)]
    assert len(machine(slow, 10.0)[1]) == 2, "one great change is a page"


def test_short_segments_lengthen_the_one_before_and_floods_are_withdrawn():
    short = [(t / 4, h, [], 1.0) for t, h in enumerate([0] * 8 + [FAR] * 2 + [FAR << 32] * 8)]
    assert machine(short, 4.5)[1] == [(0.0, 2.5, 0.0), (2.5, 4.5, 2.5)]
    pages = [(float(t), (t // 10 + 1) * 0x0F1E2D3C4B5A6978 % (1 << 62), [], 1.0) for t in range(100)]
    assert len(machine(pages, 100.0)[1]) == 10 and machine(pages, 100.0, pages=4)[1] == []


def test_the_stream_equals_the_batch(spark, tmp_path):
    df = spark.createDataFrame(frames(), FRAME)
    want = sorted(map(tuple, online.segment_frames(df).collect()))
    for i, (low, high) in enumerate(((0, 15), (15, 33), (33, 60))):
        df.where(f"t >= {low} AND t < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.segment_stream(stream, "3 seconds").writeStream.outputMode("append").format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "cp")).start()
    until(lambda: spark.sql("SELECT * FROM segs").count() >= len(want), lambda i: df.limit(0).write.mode("append").parquet(str(tmp_path / "in")))
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM segs").collect())) == want


def until(done, push, seconds=60):
    """Wait for a processing-time timer; batches without rows keep the query going."""
    import time

    end, i = time.time() + seconds, 0
    while time.time() < end and not done():
        time.sleep(1)
        push(i)
        i += 1


def test_events_without_rows_stall(spark, tmp_path):
    log = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.5)], "event string, ts double")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = stateful.stall_stream(stream, "2 seconds").writeStream.outputMode("append").format("memory").queryName("stalls").option("checkpointLocation", str(tmp_path / "cp")).start()
    found = lambda: {(r.event, r.state): (r.n_rows, r.last_ts) for r in spark.sql("SELECT * FROM stalls").collect()}
    until(lambda: ("b", "stalled") in found(), lambda i: log.limit(0).write.mode("append").parquet(str(tmp_path / "in")))
    q.stop()
    assert found() == {("a", "running"): (2, 2.0), ("a", "stalled"): (2, 2.0), ("b", "running"): (1, 1.5), ("b", "stalled"): (1, 1.5)}


def test_latest_snapshot_streams(spark, tmp_path):
    log = [(float(i), f"e{i % 2}", "stage", f"m{i}") for i in range(10)]
    df = spark.createDataFrame(log, "ts double, event string, kind string, message string").withColumn("ts", F.timestamp_seconds("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = online.latest_snapshot(stream, delay="1 minute").writeStream.outputMode("update").format("memory").queryName("snap").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    streamed = {r.event: r.message for r in spark.sql("SELECT * FROM snap").collect()}
    assert streamed == {r.event: r.message for r in online.latest_snapshot(df).collect()} == {"e0": "m8", "e1": "m9"}
    online.upsert_snapshot(df, 3, str(tmp_path / "out"))
    assert KeyedSnapshot(spark, str(tmp_path / "out/snapshot")).read().count() == 2


def test_upserts_merge(spark, rows, tmp_path):
    snap = KeyedSnapshot(spark, str(tmp_path / "s"), key="event", buckets=4)
    batch = lambda *r: spark.createDataFrame(list(r), "event string, ts double, v int")
    with pytest.raises(ValueError):
        snap.read()
    assert snap.upsert(batch(("a", 1.0, 1), ("b", 2.0, 2), ("b", 1.0, 9)), 0)
    assert snap.upsert(batch(("a", 3.0, 5), ("c", 1.0, 3)), 1)
    got = [("a", 3.0, 5, 2), ("b", 2.0, 2, 2), ("c", 1.0, 3, 1)]
    assert rows(snap.read()) == got
    # the same epoch again, and one from before, change nothing
    assert not snap.upsert(batch(("a", 9.0, 9)), 1) and not snap.upsert(batch(("a", 9.0, 9)), 0)
    assert rows(snap.read()) == got
    # an old row doesn't win; a tie does; null keys and orders count
    assert snap.upsert(batch(("b", 0.5, 7), ("c", 1.0, 4), (None, None, 0)), 5)
    assert rows(snap.read()) == [("a", 3.0, 5, 2), ("b", 2.0, 2, 3), ("c", 1.0, 4, 2), (None, None, 0, 1)]
    assert snap.upsert(batch(), 6)
    assert snap.read().count() == 4 and snap.epochs() == [5, 6]
    with pytest.raises(ValueError):
        snap.upsert(spark.createDataFrame([(1,)], "event int"), 7)


def test_a_batch_that_dies_before_its_commit_leaves_the_snapshot(spark, rows, tmp_path, monkeypatch):
    snap = KeyedSnapshot(spark, str(tmp_path / "s"), buckets=2)
    one = spark.createDataFrame([("a", 1.0)], "event string, ts double")
    two = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "event string, ts double")
    snap.upsert(one, 0)

    def dies(epoch, said):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(snap, "_commit", dies)
        with pytest.raises(OSError):
            snap.upsert(two, 1)
    assert rows(snap.read()) == [("a", 1.0, 1)]
    assert snap.upsert(two, 1) and rows(snap.read()) == [("a", 2.0, 2), ("b", 2.0, 1)]


def test_strict_lines_stop(spark, tmp_path):
    for n, line in enumerate(("not json at all", "[broken", '"open', "17x", '{"doc_id": 1')):
        (tmp_path / f"{n}.jsonl").write_text('{"doc_id": 1}\n' + line + "\n")
        with pytest.raises(PySparkException):
            readers.jsonl(spark, str(tmp_path / f"{n}.jsonl"), T.StructType.fromDDL("doc_id int"), "strict").collect()
    (tmp_path / "good.jsonl").write_text('{"doc_id": 1}\n[1]\n"x"\n-3\ntrue\nnull\n\n {"doc_id": 2}\n')
    assert [r[0] for r in readers.jsonl(spark, str(tmp_path / "good.jsonl"), T.StructType.fromDDL("doc_id int"), "strict").collect()] == [1, 2]


def test_states_and_tasks(spark, rows):
    snap = spark.createDataFrame([("a", "running"), ("b", "running"), ("c", "done")], "event string, status string")
    assert rows(online.current_state(snap, spark.createDataFrame([("a",)], "event string"))) == [("a", "running"), ("b", "stopped"), ("c", "done")]
    tasks = spark.createDataFrame([("x",), ("y",), ("z",)], "task string")
    needs = spark.createDataFrame([("y", "x"), ("z", "y")], "task string, needs string")
    assert rows(online.ready_tasks(tasks, needs, spark.createDataFrame([("x",)], "task string"))) == [("y",)]


def test_entry_points_agree(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).limit(1).count() >= 0
