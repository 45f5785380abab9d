"""Quality probabilities from random-indexing word vectors and a small network.

Words are runs of letters and digits as written, and runs of marks. Every word has a fixed sparse index vector, a rule of its
hash. One pass over all documents adds to each word bucket the index vectors of the words around it; the sums are aggregated in
Spark and, centred and scaled, are the word vectors. A document pools its words' vectors: their mean, their spread and the mean
product of neighbours'. Nothing else enters. A two-layer network, trained with numpy on a bounded sample, maps that to a logit, and a temperature fitted on examples
that it has not trained on calibrates it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import give_back, mix64, place
from quillstone.llm.toxicity import labelled

WORDS, DIM, ONES, REACH = 1 << 14, 32, 2, 2

#: 0: white space and control signs, 1: letters, digits and all beyond ASCII, 2: marks.
_KIND = np.array([0 if b <= 32 or b == 127 else 1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)
#: An odd base and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse, as many as were ever asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            rows = [np.full(n, v, dtype=np.uint64) for v in (_BASE, _BACK)]
            for r in rows:
                r[0] = 1
            self.up, self.down = (np.multiply.accumulate(r) for r in rows)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def words(raw: bytes, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Places and buckets of the words of UTF-8 text, read in slices that end where a word does."""
    whole = np.frombuffer(raw, dtype=np.uint8)
    places, found, at = [], [], 0
    while at < len(whole):
        size = step
        while True:
            part = whole[at : at + size]
            kind = _KIND[part]
            cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
            if at + len(part) == len(whole):
                cuts = np.r_[cuts, len(part)]
            if len(cuts):
                break
            size *= 2  # a word longer than the slice
        cuts = np.r_[0, cuts]
        up, down = _POWERS.get(int(cuts[-1]))
        sums = np.zeros(cuts[-1] + 1, dtype=np.uint64)
        np.cumsum((part[: cuts[-1]].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        real = np.flatnonzero(kind[cuts[:-1]] > 0)
        first, last = cuts[:-1][real], cuts[1:][real]
        places.append(first + at)
        found.append((mix64((sums[last] - sums[first]) * down[first]) % np.uint64(WORDS)).astype(np.int64))
        at += int(cuts[-1])
    return (np.concatenate(places), np.concatenate(found)) if places else (np.empty(0, np.int64),) * 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few non-zero entries of each word's index vector."""
    h = mix64(np.arange(WORDS * ONES, dtype=np.uint64) + np.uint64(1 << 40)).reshape(WORDS, ONES)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def blocks(texts: Iterator[str], most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, text of each word, its bucket) of texts that lie end to end, about ``most`` bytes at once; a longer text stands alone."""
    held, size = [], 0

    def out() -> tuple[int, np.ndarray, np.ndarray]:
        ends = np.cumsum([len(x) + 1 for x in held])
        at, w = words(b"\n".join(held))
        return len(held), np.searchsorted(ends, at, "right"), w

    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size > most:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    sums, seen = np.zeros(WORDS * DIM), np.zeros(WORDS, dtype=np.int64)
    for _, doc, w in blocks(t.as_py() for b in batches for t in b.column("text")):
        for a in range(0, len(w), 1 << 18):  # a long text's words, part by part
            here, text = w[a : a + (1 << 18) + REACH], doc[a : a + (1 << 18) + REACH]
            own = min(1 << 18, len(here))
            seen += np.bincount(here[:own], minlength=WORDS)
            for o in range(1, REACH + 1):
                left = np.flatnonzero(text[o:] == text[:-o])
                left = left[left < own]
                for x, y in ((here[left], here[left + o]), (here[left + o], here[left])):
                    for k in range(ONES):
                        sums += np.bincount(x * DIM + place[y, k], weights=sign[y, k], minlength=WORDS * DIM)
    at, sums = np.flatnonzero(seen), sums.reshape(WORDS, DIM)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64()), *(pa.array(sums[at, d], pa.float64()) for d in range(DIM))], names=["bucket", "n", *(f"d{d}" for d in range(DIM))])
    give_back()


def word_vectors(docs: DataFrame) -> np.ndarray:
    """WORDS x DIM vectors from all documents; what reaches the driver has that fixed size."""
    fields = ", ".join(f"d{d} double" for d in range(DIM))
    rows = docs.select("text").mapInArrow(_contexts, f"bucket long, n long, {fields}").groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM))).toPandas()
    out = np.zeros((WORDS, DIM), dtype=np.float32)
    if len(rows):
        # sums of whole numbers: the same in any order
        v = rows[[f"d{d}" for d in range(DIM)]].to_numpy() / rows[["n"]].to_numpy()
        v -= np.average(v, axis=0, weights=rows["n"])
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-3
        out[rows["bucket"].to_numpy()] = v
    return out


def pooled(vectors: np.ndarray, texts: Iterator[str]) -> np.ndarray:
    """Mean and spread of each text's word vectors and the mean product of neighbours' vectors; texts without words pool to zeros."""
    out = []
    for n, doc, w in blocks(texts):
        sums, size = np.zeros((n, 3 * DIM)), np.bincount(doc, minlength=n)
        for a in range(0, len(w), 1 << 15):
            v, d = vectors[w[a : a + (1 << 15) + 1]], doc[a : a + (1 << 15) + 1]
            beside = np.zeros_like(v)
            beside[:-1] = np.where((d[1:] == d[:-1])[:, None], v[1:] * v[:-1], np.float32(0))
            all_, d = np.hstack([v, v * v, beside])[: 1 << 15], d[: 1 << 15]
            starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            sums[d[starts]] += np.add.reduceat(all_, starts, axis=0)
        sums /= np.maximum(size, 1)[:, None]
        mean, square, beside = np.split(sums, 3, axis=1)
        out.append(np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), beside]))
    return np.concatenate(out) if out else np.zeros((0, 3 * DIM))


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _pooler(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            x = pooled(m.vectors, (t.as_py() for t in batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["h", "y", "x"])

    return run


def _train(model: Model, x: np.ndarray, y: np.ndarray, apart: np.ndarray, hidden: int, rounds: int, seed: int) -> Model:
    """Adam on the log loss with weight decay; ``apart`` marks the examples that set the temperature."""
    rng = np.random.default_rng(seed)
    model.mean, model.scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-4
    d = x.shape[1]
    p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    xs, ys = ((x - model.mean) / model.scale)[~apart].astype(float), y[~apart]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(xs))
        for i in range(0, len(xs), 256):
            b = order[i : i + 256]
            h = np.tanh(xs[b] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - ys[b]) / len(b)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [xs[b].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3][0])
    hx, hy = (x[apart], y[apart]) if apart.any() else (x, y)
    z = model.logits(hx)
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - hy * z / t)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    model.temperature = float(grid[np.argmin([loss(t) for t in grid])])
    return model


def fit(docs: DataFrame, labels: DataFrame, train=lambda k: F.lit(True), most_labelled: int = 20_000, hidden: int = 32, rounds: int = 30, seed: int = 7) -> Model:
    """A model from labels ``quality``; the sample is bounded by ``most_labelled`` documents.

    Without examples of both classes every text scores the share of good labels (1/2 without labels).
    """
    sc = docs.sparkSession.sparkContext
    d = 3 * DIM
    model = Model(word_vectors(docs), np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    told = sc.broadcast(model)
    rows = labelled(docs, labels, "quality", train, most_labelled).select(F.xxhash64("doc_id").alias("h"), "y", "text")
    seen = rows.mapInArrow(_pooler(told), "h long, y int, x array<double>").toPandas().sort_values("h", kind="stable")
    told.destroy()
    y = seen["y"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        model.b2 = float(np.log(p / (1 - p)))
        return model
    x = np.array(seen["x"].tolist(), dtype=float)
    apart = seen["h"].to_numpy() % 6 == 0
    return _train(model, x, y, apart if 50 <= apart.sum() < len(y) else np.zeros(len(y), bool), hidden, rounds, seed)


def _scorer(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            x = pooled(m.vectors, (t.as_py() for t in batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.probabilities(x) if len(x) else [], pa.float64())], names=[*batch.schema.names, "quality_score"])
        give_back()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality_score (0 to 1). Null and empty texts pool to zeros. A column of that name is replaced; others stay."""
    docs = docs.drop("quality_score")
    told = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scorer(told, place(docs, "text")), f"{fields}, quality_score double")
