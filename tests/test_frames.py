"""Frames: source and sink, descriptors, still regions, pages, zones on a stream; against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import frames as V
from quillstone.operators import windows as W
from quillstone.sources import frames as S
from quillstone.streaming import online, stateful

KIND = "video string, frame long, t double, width int, height int, channels int, pixels binary"


def clips(n=11, width=6, height=4, channels=1, seed=1):
    rng = np.random.default_rng(seed)
    return [(v, i, float(i), width, height, channels, rng.integers(0, 256, width * height * channels, dtype=np.uint8).tobytes()) for v in ("a", "b", "c") for i in range(n)]


@pytest.mark.parametrize("per_part", [1, 4, 1000])
def test_frames_come_back_whatever_the_parts(spark, tmp_path, per_part):
    rows = clips()
    S.write_frames(spark.createDataFrame(rows, KIND), str(tmp_path), 6, 4)
    got = S.read_frames(spark, str(tmp_path), 6, 4, fps=2.0, frames_per_part=per_part)
    assert {(r["video"], r["frame"], bytes(r["pixels"])) for r in got.collect()} == {(r[0], r[1], r[6]) for r in rows}
    assert got.where("t <> frame / 2.0").count() == 0 and got.count() == 33
    assert got.rdd.getNumPartitions() == 3 * math.ceil(11 / per_part)


def test_a_cut_tail_is_told(spark, tmp_path):
    S.write_frames(spark.createDataFrame(clips(5), KIND), str(tmp_path), 6, 4)
    with open(tmp_path / "b.raw", "ab") as f:
        f.write(b"x" * 7)
    assert {tuple(r) for r in S.tails(spark, str(tmp_path), 6, 4).collect()} == {("a", 5, 0), ("b", 5, 7), ("c", 5, 0)}
    assert S.read_frames(spark, str(tmp_path), 6, 4).count() == 15
    short = online.frame_shortfall(S.tails(spark, str(tmp_path), 6, 4), F.lit(10.0))
    assert short.where("short").count() == 3


def test_gaps_and_wrong_sizes_stop(spark, tmp_path):
    rows = clips(4)
    with pytest.raises(Exception, match="is due"):
        S.write_frames(spark.createDataFrame(rows[:1] + rows[2:], KIND), str(tmp_path / "x"), 6, 4)
    with pytest.raises(Exception, match="is due"):
        S.write_frames(spark.createDataFrame(rows, KIND), str(tmp_path / "y"), 5, 4)
    assert S.tails(spark, str(tmp_path / "x"), 6, 4).count() == 0
    with pytest.raises(ValueError):
        S._Shape({"path": "x", "width": 0, "height": 3})


def test_a_stream_reads_what_files_grow_by(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.raw").write_bytes(b"\1" * 24 * 3 + b"\2" * 10)
    q = S.stream_frames(spark, str(folder), 6, 4).writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    first = spark.sql("SELECT video, frame FROM grown").collect()
    with open(folder / "a.raw", "ab") as f:
        f.write(b"\2" * 14)
    (folder / "b.raw").write_bytes(b"\3" * 48)
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, first)) == [("a", 0), ("a", 1), ("a", 2)]
    rows = {(r["video"], r["frame"]): bytes(r["pixels"]) for r in spark.sql("SELECT * FROM grown").collect()}
    assert sorted(rows) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)] and rows["a", 3] == b"\2" * 24


def plain_shrunk(image, side):
    h, w = image.shape
    out = np.zeros((side, side))
    for i in range(side):
        for j in range(side):
            total = 0.0
            y0, y1, x0, x1 = i * h / side, (i + 1) * h / side, j * w / side, (j + 1) * w / side
            for y in range(int(y0), min(h, math.ceil(y1))):
                for x in range(int(x0), min(w, math.ceil(x1))):
                    total += image[y, x] * max(0, min(y + 1, y1) - max(y, y0)) * max(0, min(x + 1, x1) - max(x, x0))
            out[i, j] = total / ((y1 - y0) * (x1 - x0))
    return np.rint(out.round(9))


def plain_hash(image):
    tiny = plain_shrunk(image, 32)
    basis = [[math.sqrt((1 if k == 0 else 2) / 32) * math.cos(math.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
    low = [round(sum(basis[u][y] * basis[v][x] * tiny[y, x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sum(sorted(low)[31:33]) / 2
    bits = int("".join("1" if x > middle else "0" for x in low), 2)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def test_descriptors(spark):
    rng = np.random.default_rng(5)
    pictures = [("p", 0, 0.0, 80, 50, 1, rng.integers(0, 256, 4000, dtype=np.uint8).tobytes()), ("p", 1, 1.0, 80, 50, 3, rng.integers(0, 256, 12000, dtype=np.uint8).tobytes()), ("p", 2, 2.0, 40, 90, 1, bytes(np.linspace(0, 255, 3600).astype(np.uint8)))]
    pictures += [("p", 3, 3.0, 9, 9, 1, b"short"), ("p", 4, 4.0, 9, 9, 1, None), ("p", 5, 5.0, 1, 1, 1, b"\7")]
    got = {r["frame"]: r for r in V.describe(spark.createDataFrame(pictures, KIND)).collect()}
    for v, i, t, w, h, c, raw in pictures[:3]:
        x = np.frombuffer(raw, dtype=np.uint8)
        g = x.reshape(h, w) if c == 1 else np.rint(x.reshape(h, w, 3).astype(float) @ [0.114, 0.587, 0.299])
        assert got[i]["phash"] == plain_hash(g.astype(float))
        assert np.array_equal(np.array(got[i]["gray64"]), plain_shrunk(g.astype(float), 64).ravel())
        at = lambda y, x: float(g[abs(y) if y < h else 2 * h - 2 - y, abs(x) if x < w else 2 * w - 2 - x])  # noqa: B023, E731
        lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(w)]
        assert got[i]["lap"] == pytest.approx(np.var(lap))
    assert got[3]["phash"] is got[4]["phash"] is None and got[5]["lap"] == 0.0


def test_hashes_bear_noise(spark):
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:90, 0:160]
    base = (128 + 60 * np.sin(x / 17) + 50 * np.cos(y / 11 + x / 40)).clip(0, 255)
    noisy = (base + rng.normal(0, 3, base.shape)).clip(0, 255)
    other = (128 + 60 * np.cos(x / 9) - 50 * np.sin(y / 23)).clip(0, 255)
    rows = [("v", i, float(i), 160, 90, 1, p.astype(np.uint8).tobytes()) for i, p in enumerate((base, noisy, other))]
    a, b, c = (r["phash"] & (1 << 64) - 1 for r in V.describe(spark.createDataFrame(rows, KIND)).orderBy("frame").collect())
    assert (a ^ b).bit_count() <= 5 < 15 < (a ^ c).bit_count()


@pytest.mark.parametrize("seed", range(5))
def test_areas_by_flood(seed):
    mask = np.random.default_rng(seed).random((23, 31)) < (0.2, 0.4, 0.5, 0.6, 1.0)[seed]
    seen, out = set(), []
    for start in map(tuple, np.argwhere(mask)):
        if start in seen:
            continue
        seen.add(start)
        todo, cells = [start], []
        while todo:
            y, x = todo.pop()
            cells.append((y, x))
            for n in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if 0 <= n[0] < 23 and 0 <= n[1] < 31 and mask[n] and n not in seen:
                    seen.add(n)
                    todo.append(n)
        ys, xs = zip(*cells)
        out.append((len(cells), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    assert V.areas(mask) == sorted(out)


def film(n=24, width=160, height=100, box=(10, 12, 96, 70), seed=0, still=False):
    """A framed slide with bars of text on a moving ground."""
    rng = np.random.default_rng(seed)
    x, y, w, h = box
    for i in range(n):
        g = np.full((height, width), 90.0) if still else rng.integers(0, 256, (height, width)).astype(float)
        g[y - 2 : y + h + 2, x - 2 : x + w + 2] = 0
        g[y : y + h, x : x + w] = 235
        g[y + 20 : y + 24, x + 20 : x + 70] = 40
        yield (np.clip(g + rng.normal(0, 1, g.shape), 0, 255)).astype(np.uint8)


def plain_region(images):
    stack = np.stack(images).astype(float)
    edges = np.stack([V.edges_of(i) for i in images])
    still = stack.var(axis=0) <= 64
    fixed = np.stack([V.widened(e) for e in edges]).sum(axis=0) >= math.ceil(0.6 * len(images))
    free = V.widened(V.narrowed(still & ~V.widened(V.narrowed(V.widened(fixed, 2), 2))))
    found = [a for a in V.areas(free) if a[3] * a[4] >= 0.1 * still.size]
    if not found:
        return None
    n, x, y, w, h = max(found, key=lambda a: (a[0], -a[2], -a[1]))
    density = edges[:, y : y + h, x : x + w].mean()
    return (x, y, w, h), n / (w * h) * V.plausible(density)


@pytest.mark.parametrize("parts", [1, 7])
def test_still_region(spark, parts):
    films = {"slides": list(film()), "other": list(film(seed=3, box=(40, 20, 100, 60))), "noise": [np.random.default_rng(i).integers(0, 256, (100, 160)).astype(np.uint8) for i in range(12)]}
    rows = [(v, i, float(i), 160, 100, 1, g.tobytes()) for v, gs in films.items() for i, g in enumerate(gs)] + [("slides", 99, 0.0, 160, 100, 1, None)]
    got = {r["video"]: r for r in V.still_region(spark.createDataFrame(rows, KIND).repartition(parts)).collect()}
    assert got["noise"]["x"] is None and got["noise"]["confidence"] == 0 and got["noise"]["n_frames"] == 12
    for v, (x, y, w, h) in (("slides", (10, 12, 96, 70)), ("other", (40, 20, 100, 60))):
        r = got[v]
        (px, py, pw, ph), sure = plain_region(films[v])
        assert (r["x"], r["y"], r["width"], r["height"], r["confidence"]) == pytest.approx((px / 160, py / 100, pw / 160, ph / 100, sure), abs=1e-6)
        assert abs(px - x) <= 6 and abs(py - y) <= 6 and abs(pw - w) <= 12 and abs(ph - h) <= 12 and 0 < r["confidence"] <= 1


def plain_pages(rows, near, most):
    out = {}
    for v in {r[0] for r in rows}:
        pages = []
        for _, s, e, h in sorted((r for r in rows if r[0] == v), key=lambda r: (r[1], r[3])):
            hit = next((p for p in pages if ((h ^ p[0]) & (1 << 64) - 1).bit_count() <= near), None)
            if hit:
                hit[2].append((s, e))
            else:
                pages.append([h, s, [(s, e)]])
        if len(pages) <= most:
            out |= {(v, f"P{i + 1}"): (s, sorted(r)) for i, (_, s, r) in enumerate(pages)}
    return out


@pytest.mark.parametrize("seed, near, most", [(1, 5, 500), (2, 2, 500), (3, 5, 12), (4, 0, 500)])
def test_pages_by_rounds(spark, seed, near, most):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(9)]

    def near_one():
        h = rng.choice(centres)
        for _ in range(rng.randint(0, 7)):
            h ^= 1 << rng.randrange(64)
        return h - (1 << 64) if h >= 1 << 63 else h

    rows = [(v, float(i), i + 0.5, near_one()) for v, n in (("hot", 160), ("b", 7)) for i in range(n)]
    got = W.dedupe_pages(spark.createDataFrame(rows, "video string, start double, end double, phash long").repartition(5), "video", "start", "phash", near, most)
    assert {(r["video"], r["page_id"]): (r["image_time"], [tuple(x) for x in r["time_ranges"]]) for r in got.collect()} == plain_pages(rows, near, most)


def test_zones_on_a_stream(spark, tmp_path):
    rng = random.Random(4)
    kind = "k string, n long, v double"
    rows = [(k, i, rng.uniform(0, 100)) for k in ("a", "b") for i in range(40)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 14 == part], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{part}"))
    folder = tmp_path / "in"
    spark.createDataFrame([], kind).write.parquet(str(folder))
    stream = stateful.zone_stream(spark.readStream.schema(kind).parquet(str(folder)), "k", ["n"], "v", 50.0)
    q = stream.writeStream.format("memory").queryName("zones").option("checkpointLocation", str(tmp_path / "cp")).start()
    for part in range(3):
        for f in (tmp_path / f"{part}").glob("*.parquet"):
            f.rename(folder / f"{part}-{f.name}")
        q.processAllAvailable()
    q.stop()
    batch = W.zone_hysteresis(spark.createDataFrame(rows, kind), "k", ["n"], "v", 50.0)
    assert {(r["k"], r["n"], r["zone"]) for r in spark.sql("SELECT * FROM zones").collect()} == {(r["k"], r["n"], r["zone"]) for r in batch.collect()}


def test_registered_frames(spark):
    """The queries over the smallest tables."""
    from quillstone.plans import catalog, more

    folder = "/root/testdata/sf0.001"
    t = catalog.Tables(spark, folder)
    pictures = {(r["video"], r["frame"]): np.frombuffer(bytes(r["pixels"]), dtype=np.uint8).reshape(r["height"], 8) for r in more._pictures(t).collect()}
    got = {(r["video"], r["frame"]): r for r in catalog.QUERIES["frame_descriptors"](spark, folder).collect()}
    assert got.keys() == pictures.keys()
    for k in sorted(pictures)[:25]:
        assert got[k]["phash"] == plain_hash(pictures[k].astype(float))
        assert got[k]["mean"] == pytest.approx(plain_shrunk(pictures[k].astype(float), 64).mean(), abs=1e-4)
    films = {}
    for (v, i), p in sorted(pictures.items()):
        g = np.roll(np.resize(p.ravel(), 96 * 64), i * 37).reshape(64, 96).copy()
        g[6:46, 8:72], g[8:44, 10:70], g[20:23, 20:50] = 0, 235, 40
        films.setdefault(v, []).append(g)
    for r in catalog.QUERIES["still_regions"](spark, folder).collect():
        want = plain_region(films.pop(r["video"]))
        if want is None:
            assert r["x"] is None
        else:
            (x, y, w, h), sure = want
            assert (r["x"], r["y"], r["width"], r["height"], r["confidence"]) == pytest.approx((x / 96, y / 64, w / 96, h / 64, sure), abs=1e-6)
    assert not films
