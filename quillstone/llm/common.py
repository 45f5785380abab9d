"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``, which a session must name."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return root.rstrip("/")


class Scratch:
    """Tables written once to the shared folder, to cut lineage and to survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.made = spark, f"{shared_root(spark)}/quillstone-{label}-{uuid.uuid4().hex}", []
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        self.made.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _remove(self, folder) -> None:
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def drop(self, df: DataFrame) -> None:
        """Remove a kept table that no later plan reads."""
        for file in df.inputFiles()[:1]:
            self._remove(self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent())

    def sweep(self, out: DataFrame) -> DataFrame:
        """Remove the kept tables that ``out`` doesn't read."""
        mark = self.base.rsplit("/", 1)[1] + "/"
        used = {f.split(mark, 1)[1].split("/")[0] for f in out.inputFiles() if mark in f}
        for path in self.made:
            if path.rsplit("/", 1)[1] not in used:
                self._remove(self.spark._jvm.org.apache.hadoop.fs.Path(path))
        self.made = [p for p in self.made if p.rsplit("/", 1)[1] in used]
        return out

    def clear(self) -> None:
        """Remove all kept tables, once no later plan reads any."""
        self._remove(self.spark._jvm.org.apache.hadoop.fs.Path(self.base))


def give_back() -> None:
    """At a task's end: memory that Arrow and the C library keep for later goes back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def fresh(columns: list[str], name: str) -> str:
    """A column name that clashes with none, whatever the case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def place(docs: DataFrame, name: str) -> int:
    """Where a column stands."""
    return [c.lower() for c in docs.columns].index(name)


def few(df: DataFrame, most: int) -> DataFrame:
    """A written table ready to be broadcast if it has at most ``most`` rows, and as it is beyond."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def ids_and_texts(batch: pa.RecordBatch, key: str = "doc_id", text: str = "text") -> Iterator[tuple[int | None, str]]:
    """Rows of an Arrow batch one by one, so that only one text is decoded at a time; null text reads as empty."""
    keys, texts = batch.column(key), batch.column(text)
    for i in range(batch.num_rows):
        yield keys[i].as_py(), texts[i].as_py() or ""


_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle, none make none."""
    import xxhash

    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x20".join(words), seed=n)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    m = n - width + 1
    out = np.zeros(m, dtype=np.uint64)
    for i in range(width):
        # each place has a multiplier of its own, then the running value is mixed: order counts
        out = mix64(out + h[i : i + m] * (_WEIGHTS[i % 5] | np.uint64(1)))
    return np.unique(out)


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def groups(rows: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from batches that arrive sorted by them.

    Only the run that reaches over the end of a batch is held back.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in rows:
        if batch.num_rows == 0:
            continue
        cuts = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            cuts[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(cuts).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
