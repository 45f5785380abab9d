"""What frames look like: descriptors of each, and the region of a video that stands still.

Frames come in Arrow batches as raw bytes (see ``sources.frames``); pixels never leave the task that reads them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sides of the small images, and the analysis of still regions.
HASH_SIDE, SMALL_SIDE, LOW = 32, 64, 8
STILL_VARIANCE, EDGE_SHARE, LEAST_AREA, FULL_FRAME, STILL_SHARE = 64.0, 0.6, 0.10, 0.97, 0.90
EDGE_LOW, EDGE_HIGH = 50, 150
PLAUSIBLE = ((0.001, 0.0), (0.0025, 1.0), (0.15, 1.0), (0.35, 0.0))


@lru_cache(maxsize=64)
def area_weights(size: int, to: int) -> np.ndarray:
    """``to`` x ``size``: each target cell is the mean of the stretch of source cells that it covers, in parts where it cuts them."""
    edges = np.linspace(0, size, to + 1)
    i = np.arange(size)
    cover = np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i)
    return np.maximum(cover, 0) / (size / to)


@lru_cache(maxsize=8)
def dct_matrix(n: int) -> np.ndarray:
    """The orthonormal DCT-II."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * math.sqrt(2 / n)
    m[0] /= math.sqrt(2)
    return m


def grey(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """A frame as whole grey levels; three channels are blue, green and red."""
    x = np.frombuffer(pixels, dtype=np.uint8)
    if channels == 1:
        return x.reshape(height, width)
    return np.rint(x.reshape(height, width, 3) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def shrunk(image: np.ndarray, side: int) -> np.ndarray:
    """Grey levels of a ``side`` x ``side`` image by area."""
    return np.rint(area_weights(image.shape[0], side) @ image.astype(float) @ area_weights(image.shape[1], side).T)


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits, signed: which of the 8 x 8 lowest frequencies are above their median; the first is the highest bit."""
    d = dct_matrix(HASH_SIDE)[:LOW]
    low = (d @ shrunk(image, HASH_SIDE) @ d.T).round(6)
    return int.from_bytes(np.packbits(low.ravel() > np.median(low)).tobytes(), "big", signed=True)


def sharpness(image: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, borders mirrored without their own pixel; a side of one pixel has no neighbours across."""
    x = image.astype(float)
    mode = {"mode": "reflect"}
    x = np.pad(x, ((1, 1), (0, 0)), **(mode if x.shape[0] > 1 else {"mode": "edge"}))
    x = np.pad(x, ((0, 0), (1, 1)), **(mode if x.shape[1] > 1 else {"mode": "edge"}))
    return float((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var())


def describe(frames: DataFrame) -> DataFrame:
    """(video, frame, t, gray64, phash, lap) of ``frames(video, frame, t, width, height, channels, pixels)``: a 64 x 64 grey image by area (0 to 255), a perceptual hash and sharpness.

    Null pixels, or too few for their size, have null descriptors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            small, hashes, laps = [], [], []
            for pixels, w, h, c in zip(b.column("pixels"), *(b.column(x).to_pylist() for x in ("width", "height", "channels"))):
                raw = pixels.as_buffer() if pixels.is_valid else None
                if raw is None or not all((w, h, c)) or raw.size != w * h * c:
                    small.append(None), hashes.append(None), laps.append(None)
                    continue
                image = grey(raw, w, h, c)
                small.append(shrunk(image, SMALL_SIDE).ravel().astype(np.float32))
                hashes.append(perceptual_hash(image))
                laps.append(sharpness(image))
            yield pa.RecordBatch.from_arrays([b.column("video"), b.column("frame"), b.column("t"), pa.array(small, pa.list_(pa.float32())), pa.array(hashes, pa.int64()), pa.array(laps, pa.float64())], names=["video", "frame", "t", "gray64", "phash", "lap"])

    return frames.mapInArrow(run, "video string, frame long, t double, gray64 array<float>, phash long, lap double")


def edges_of(image: np.ndarray) -> np.ndarray:
    """Pixels of a steep grey slope, and of a fair one that touch such: |dx| + |dy| of the Sobel operator."""
    x = np.pad(image.astype(np.int32), 1, mode="edge")
    dx = (x[:-2, 2:] + 2 * x[1:-1, 2:] + x[2:, 2:]) - (x[:-2, :-2] + 2 * x[1:-1, :-2] + x[2:, :-2])
    dy = (x[2:, :-2] + 2 * x[2:, 1:-1] + x[2:, 2:]) - (x[:-2, :-2] + 2 * x[:-2, 1:-1] + x[:-2, 2:])
    steep = np.abs(dx) + np.abs(dy)
    return (steep >= EDGE_HIGH) | (steep >= EDGE_LOW) & widened(steep >= EDGE_HIGH)


def widened(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """The mask and the eight neighbours of its pixels."""
    for _ in range(times):
        x = np.pad(mask, 1)
        rows = x[:-2] | x[1:-1] | x[2:]
        mask = rows[:, :-2] | rows[:, 1:-1] | rows[:, 2:]
    return mask


def narrowed(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """Pixels whose neighbours are all in the mask; beyond the border counts as in."""
    return ~widened(~mask, times)


def areas(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(pixels, x, y, width, height) of areas that touch by sides or corners: a row's runs, joined with the runs they meet in the row above by union-find."""
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []  # row, first, behind the last

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y, row in enumerate(mask):
        cuts = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
        here, j = [], 0
        for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist()):
            n = len(runs)
            runs.append((y, a, b))
            parent.append(n)
            here.append(n)
            while j < len(above) and runs[above[j]][2] < a:
                j += 1
            i = j
            while i < len(above) and runs[above[i]][1] <= b:
                parent[root(above[i])] = root(n)
                i += 1
        above = here
    out: dict[int, list[int]] = {}
    for i, (y, a, b) in enumerate(runs):
        o = out.setdefault(root(i), [0, a, y, b, y + 1])
        o[0], o[1], o[2], o[3], o[4] = o[0] + b - a, min(o[1], a), min(o[2], y), max(o[3], b), max(o[4], y + 1)
    return sorted((n, x, y, x2 - x, y2 - y) for n, x, y, x2, y2 in out.values())


def plausible(density: float) -> float:
    """How far a density of edges speaks for slides: the height of the fixed curve."""
    return float(np.interp(density, *zip(*PLAUSIBLE), left=0.0, right=0.0))


def region_of(n: int, total: np.ndarray, squares: np.ndarray, votes: np.ndarray, edges: np.ndarray) -> tuple[tuple[int, int, int, int] | None, float]:
    """((x, y, width, height) in pixels, confidence) of the largest still area, from sums over ``n`` frames: grey levels, their squares, votes of widened edges, and edges."""
    still = squares / n - (total / n) ** 2 <= STILL_VARIANCE
    fixed = votes >= max(1, math.ceil(EDGE_SHARE * n))
    moat = widened(narrowed(widened(fixed, 2), 2))
    free = widened(narrowed(still & ~moat))
    size = still.size
    found = [a for a in areas(free) if a[3] * a[4] >= LEAST_AREA * size]
    if not found:
        return None, 0.0
    pixels, x, y, w, h = max(found, key=lambda a: (a[0], -a[2], -a[1]))
    if w * h >= FULL_FRAME * size and still.mean() < STILL_SHARE:
        return None, 0.0
    density = edges[y : y + h, x : x + w].sum() / n / (w * h)
    return (x, y, w, h), pixels / (w * h) * plausible(density)


def still_region(frames: DataFrame) -> DataFrame:
    """(video, n_frames, x, y, width, height, confidence): the part of each video that stands still within edges that stay, as shares of the frame; null where there is none.

    ``frames(video, width, height, channels, pixels)`` of one size a video. Each task sums up its frames of a video into four images (grey levels, squares, edges, votes of edges
    widened by a pixel), whole numbers that add up in any order; sums of a video are added up in two steps, and only the last makes a region.
    """
    sums = "video string, width int, height int, n long, total binary, squares binary, votes binary, edges binary"

    def add(into: dict, key: tuple, n: int, images: list[np.ndarray]) -> None:
        if key not in into:
            into[key] = [0, [np.zeros(len(i), dtype=np.int64) for i in images]]
        into[key][0] += n
        for have, more in zip(into[key][1], images):
            have += more

    def told(held: dict) -> pa.RecordBatch:
        keys = list(held)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.int64())]
        columns += [pa.array([held[k][1][i].tobytes() for k in keys], pa.binary()) for i in range(4)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in sums.split(", ")])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for video, pixels, w, h, c in zip(b.column("video").to_pylist(), b.column("pixels"), *(b.column(x).to_pylist() for x in ("width", "height", "channels"))):
                raw = pixels.as_buffer() if pixels.is_valid else None
                if raw is None or not all((w, h, c)) or raw.size != w * h * c:
                    continue
                image = grey(raw, w, h, c)
                level, edge = image.ravel().astype(np.int64), edges_of(image)
                add(held, (video, w, h), 1, [level, level * level, widened(edge).ravel(), edge.ravel()])
                if len(held) > 16:
                    yield told(held)
                    held.clear()
        if held:
            yield told(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for i in range(b.num_rows):
                key = tuple(b.column(c)[i].as_py() for c in ("video", "width", "height"))
                if key not in held and held:
                    yield told(held)
                    held.clear()
                add(held, key, b.column("n")[i].as_py(), [np.frombuffer(b.column(c)[i].as_buffer(), dtype=np.int64) for c in ("total", "squares", "votes", "edges")])
        if held:
            yield told(held)

    def region(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            total, squares, votes, edges = (np.frombuffer(x, dtype=np.int64).reshape(r.height, r.width) for x in (r.total, r.squares, r.votes, r.edges))
            box, sure = region_of(r.n, total, squares, votes, edges)
            x, y, w, h = box or (None,) * 4
            share = lambda v, of: None if v is None else round(v / of, 6)
            out.append((r.video, r.n, share(x, r.width), share(y, r.height), share(w, r.width), share(h, r.height), round(sure, 6)))
        return pd.DataFrame(out, columns=["video", "n_frames", "x", "y", "width", "height", "confidence"])

    first = frames.select("video", "width", "height", "channels", "pixels").mapInArrow(summed, sums).withColumn("part", F.spark_partition_id() % 16)
    order = ["video", "width", "height"]
    some = first.repartition(*order, "part").sortWithinPartitions(*order).drop("part").mapInArrow(merged, sums)
    whole = some.repartition(*order).sortWithinPartitions(*order).mapInArrow(merged, sums)
    kind = "video string, n_frames long, x double, y double, width double, height double, confidence double"
    return whole.mapInPandas(lambda it: (region(p) for p in it if len(p)), kind)
