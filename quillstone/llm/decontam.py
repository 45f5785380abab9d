"""Benchmark decontamination by greedy string tiling.

Items and documents are word sequences. Words of the items have ids; runs of known words in a document are hashed by a running
Karp-Rabin hash of the seed length and joined with the items' seeds, which names the (document, item) pairs that share one. For
each such pair tiling repeatedly finds the greatest length at which running hashes of item and document still agree on free
places, marks the matches of that length, none overlapping, and goes on down to the least match; what part of the item the tiles
cover decides, whatever the order of its passages in the document. Items shorter than a seed are matched as one whole.

Documents are read in one pass without a shuffle. The items' index is broadcast in blocks of about ``block_words`` words, which
bounds it; a larger benchmark takes more passes, one for each block, each written before the next block is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, few, fresh, give_back, mix64

#: A-Z to a-z; ASCII that is neither letter nor digit to a space: marks and line breaks don't break a match.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


_BACK = pow(int(_BASE), -1, 1 << 64)


class Runs:
    """Karp-Rabin hashes, modulo 2^64, of the windows of any size of a sequence of ids, from one running sum."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        up, self.down = (np.full(n + 1, v, dtype=np.uint64) for v in (int(_BASE), _BACK))
        up[0] = self.down[0] = 1
        self.down = np.multiply.accumulate(self.down)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up)[:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.down[starts]


def running_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` ids."""
    return Runs(ids).at(np.arange(max(0, len(ids) - size + 1)), size)


def _room(free: np.ndarray) -> np.ndarray:
    """How many free places lie in a row from each place on."""
    n = len(free)
    stop = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, length) of equal ids, longest first, ties by place; none shorter than ``least``.

    Each pass searches the greatest length of which free windows of both have equal hashes, then marks its matches that don't overlap.
    Memory is linear in both sequences, however often a passage repeats.
    """
    if min(len(item), len(doc)) < least:
        return []
    ri, rd = Runs(item), Runs(doc)
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    most, tiles = min(len(item), len(doc)), []

    def both(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Free windows of the item whose hash a free one of the document has; the document's free windows and hashes."""
        a, b = np.flatnonzero(room_i >= size), np.flatnonzero(room_d >= size)
        hb = rd.at(b, size)
        return a[np.isin(ri.at(a, size), hb)], b, hb

    while True:
        room_i, room_d = _room(free_i), _room(free_d)
        low, high = least - 1, min(most, int(room_i.max(initial=0)), int(room_d.max(initial=0)))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(both(middle)[0]) else (low, middle - 1)
        if low < least:
            return tiles
        most = low
        places, b, hb = both(most)
        order = np.argsort(hb, kind="stable")
        b, hb = b[order], hb[order]
        next_: dict[int, int] = {}
        before = len(tiles)
        for a in places.tolist():
            if not free_i[a : a + most].all():
                continue
            h = ri.at(np.array([a]), most)[0]
            k = next_.get(int(h), int(np.searchsorted(hb, h)))
            while k < len(b) and hb[k] == h and not (free_d[b[k] : b[k] + most].all() and (doc[b[k] : b[k] + most] == item[a : a + most]).all()):
                k += 1  # what is taken stays so
            next_[int(h)] = k
            if k < len(b) and hb[k] == h:
                tiles.append((a, int(b[k]), most))
                free_i[a : a + most] = free_d[b[k] : b[k] + most] = False
        if len(tiles) == before:  # unequal words with equal hashes
            most -= 1


class Index:
    """Items of one block: word ids, sequences, and seeds sorted by hash; items shorter than a seed by their whole length."""

    def __init__(self, items: list[tuple], seed: int):
        self.seed, self.words, self.items = seed, {}, []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for key, text in items:
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)], dtype=np.int64)
            if len(ids):
                size = min(seed, len(ids))
                found.setdefault(size, []).append((np.unique(running_hashes(ids, size)), len(self.items)))
                self.items.append((key, ids))
        self.seeds = {}
        for size, rows in found.items():
            hashes, owners = np.concatenate([h for h, _ in rows]), np.concatenate([np.full(len(h), k) for h, k in rows])
            order = np.argsort(hashes, kind="stable")
            self.seeds[size] = hashes[order], owners[order]

    def candidates(self, ids: np.ndarray) -> list[int]:
        """Items that share a seed with a document."""
        known = ids > 0
        if not known.any():
            return []
        runs, room, out = Runs(ids), _room(known), set()
        for size, (hashes, owners) in self.seeds.items():
            at = np.flatnonzero(room >= size)
            h = np.unique(runs.at(at, size))
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                out.update(owners[a:b].tolist())
        return sorted(out)


def _matcher(told, least: float, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = told.value
        get = index.words.get
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column("text")):
                words = words_of(t.as_py() or "")
                ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
                for k in index.candidates(ids):
                    item, seq = index.items[k]
                    tiles = tile(seq, ids, min(index.seed, len(seq)))
                    covered = sum(n for *_, n in tiles)
                    if tiles and covered >= least * len(seq):
                        rows.append((i, item, covered / len(seq), len(tiles), tiles[0][2]))
            cols = list(zip(*rows)) or [[]] * 5
            keys = batch.column("doc_id").take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names=["doc_id", "item_id", "coverage", "n_tiles", "longest"])
        give_back()

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, seed: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest: each pair of ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` whose tiles of at least ``seed`` words cover ``coverage`` of the item.

    Words are compared without case, marks and line breaks. An item of fewer than ``seed`` words is one tile, found where all its words stand
    in a row; items without words, null and empty texts and an empty table match nothing. Repeated documents give repeated pairs, repeated
    items don't; other columns are not read, ids keep their types and rows with null ids take part.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.size(F.split("text", r"[\s\p{Punct}]+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-2 * int(total) // block_words)) if total > block_words else 1
    narrow = docs.select("doc_id", "text")
    key, item = (t.schema[c].dataType for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    scratch, out = Scratch(spark, "leaks"), None
    kinds = [to_arrow_type(item), pa.float64(), pa.int64(), pa.int64()]
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        told = spark.sparkContext.broadcast(Index(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=str), seed))
        got = narrow.mapInArrow(_matcher(told, coverage, kinds), f"doc_id {key.simpleString()}, item_id {item.simpleString()}, coverage double, n_tiles long, longest long")
        if blocks > 1:
            got = scratch.keep(got, f"block{b}")
            told.destroy()
        out = got if out is None else out.union(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, most_ids: int = 1_000_000, **settings) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with a null doc_id stay.

    The ids of the others are written first and broadcast up to ``most_ids`` of them; beyond, the texts are joined with them by a shuffle.
    """
    k = fresh(docs.columns, "leaked")
    bad = Scratch(docs.sparkSession, "clean").keep(leaks(docs, benchmark, **settings).where("doc_id IS NOT NULL").select(F.col("doc_id").alias(k)).distinct(), "ids")
    return docs.join(few(bad, most_ids), F.col("doc_id") == F.col(k), "left_anti")
