"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words and their stems of six, seven and eight bytes, as inflected words are each rare. Fit: a bounded sample of labelled rows gives the class counts of tokens, each document
counting a token once, so that a document that repeats itself is one witness; the counts of tokens over all documents are,
with a small constant, the Dirichlet prior of the log-odds; each token scores the lower confidence bound of its log-odds, a word the
best of its own and its stems', and words without evidence a small cost. Score: a linear-time scan finds all maximal segments of a text; extreme-value theory gives each
its expected number by chance in a clean text of that length (lambda solves the moment equation, K fits the sample's clean
maxima); a logistic map of the best and of all significant segments, fitted on the sample, gives the probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, give_back, place

#: A-Z to a-z, ASCII that is neither letter nor digit to a space.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


#: Bytes of stems.
STEMS = (6, 7, 8)


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def terms(words: list[bytes]) -> list[bytes]:
    """Words and the stems of longer ones."""
    return words + [s for w in words for s in stems(w)]


def stems(word: bytes) -> list[bytes]:
    return [word[:n] + b"*" for n in STEMS if len(word) > n]


class Scores(dict):
    """word -> score, remembered within a bound."""

    def __init__(self, known: dict[bytes, float], rest: float):
        self.known, self.rest = known, rest

    def __missing__(self, word: bytes) -> float:
        if len(self) > 100_000:
            self.clear()
        best = max(self.known.get(t, self.rest) for t in (word, *stems(word)))
        self[word] = best
        return best


def labelled(docs: DataFrame, labels: DataFrame, label: str, train, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled documents for which ``train(doc_id)`` holds, drawn by a hash of doc_id.

    The drawn ids are a table of at most ``most`` rows, which bounds what is broadcast. Rows without a label or a doc_id are no examples; of
    rows that share a doc_id the least text is one, with its highest label.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("k")).agg(F.max(label).cast("int").alias("y"))
    drawn = one.where(train(F.col("k"))).orderBy(F.xxhash64("k"), "k").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("k"))
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time; only positive scores are visited one by one."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum through, nearest kept one with a lesser sum before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((start, end, low, high, j))
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, h - l) for a, b, l, h, _ in kept]


@dataclass
class Model:
    score: dict[bytes, float]
    rest: float
    lam: float
    k: float
    weights: tuple[float, float, float, float]
    alpha: float

    @property
    def scores(self) -> Scores:
        if "_scores" not in self.__dict__:
            self.__dict__["_scores"] = Scores(self.score, self.rest)
        return self.__dict__["_scores"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_scores"}

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of tokens; (first token, end, score, expected number by chance) of each significant passage or else of the best."""
        words = tokens(text)
        found = segments(np.fromiter(map(self.scores.__getitem__, words), dtype=float, count=len(words)))
        size = np.log(self.k * max(len(words), 1))
        out = [(a, b, s, float(np.exp(min(50.0, size - self.lam * s)))) for a, b, s in found]
        return len(words), [x for x in out if x[3] <= self.alpha] or sorted(out, key=lambda x: x[3])[:1]

    def features(self, n: int, found: list) -> tuple[float, float, float]:
        """The best passage's and all significant passages' surprise, and the text's toxic share.

        A surprise is the negative log of an expected number, kept within the numbers that the logistic map can tell apart: one in e^30 by chance is certain,
        and e^12 by chance is nothing.
        """
        logs = [-np.log(max(x[3], 1e-30)) for x in found]
        best = max(logs, default=-np.log(self.k * max(n, 1)) - 1)
        return max(-12.0, min(30.0, best)), float(np.log1p(sum(x for x in logs if x > 0))), float(np.log1p(sum(x[2] for x in found) / max(n, 1) * 100))

    def probability(self, n: int, found: list) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(n, found)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _class_counts(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            words = list(held[0].keys() | held[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([held[1][w] for w in words], pa.int64()), pa.array([held[0][w] for w in words], pa.int64())], names=["token", "bad", "good"])
            held[0].clear(), held[1].clear()
            return batch

        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text")):
                held[1 if y else 0].update(set(terms(tokens(t.as_py()))))
                if len(held[0]) + len(held[1]) > most:
                    yield out()
        yield out()

    return run


def _corpus_counts(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            cut: Counter = Counter()
            for w, n in held.items():
                for s in stems(w):
                    cut[s] += n
            total = sum(held.values()) + sum(cut.values())
            words, counts = [*held.keys(), *cut.keys(), None], [*held.values(), *cut.values(), total]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["token", "n"])

        for batch in batches:
            for t in batch.column("text"):
                held.update(tokens(t.as_py() or ""))
                if len(held) > most:
                    yield out()
        yield out()

    return run


def evidence(sample: DataFrame, docs: DataFrame, scratch: Scratch, prior: float, floor: float, z: float) -> DataFrame:
    """(token, bad, bound, share): toxic documents with each token, the lower confidence bound of its log-odds, and its share among clean ones with the prior.

    All tokens of ``sample`` are there, however rare; without tokens of both classes none is.
    """
    counts = sample.mapInArrow(_class_counts(200_000), "token binary, bad long, good long").select("token", "bad", "good", F.lit(0).cast("long").alias("n"))
    corpus = docs.select("text").mapInArrow(_corpus_counts(200_000), "token binary, n long").select("token", F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("good"), "n")
    met = counts.unionByName(corpus).groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum("n").alias("n"))
    # the null token has the number of all tokens
    met = scratch.keep(met.where("bad + good > 0 OR token IS NULL"), "tokens")
    both = met.agg(F.sum("bad").alias("bads"), F.sum("good").alias("goods"), F.max(F.when(F.col("token").isNull(), F.col("n"))).alias("total")).where("bads > 0 AND goods > 0")
    rows = met.where("token IS NOT NULL").withColumn("all", both.select(F.struct("*")).scalar()).where("all IS NOT NULL").select("token", "bad", "good", "n", "all.*")
    rows = rows.withColumn("a", prior * F.col("n") / (F.col("total") + 1) + floor)
    odds = lambda y, n: F.log((F.col(y) + F.col("a")) / (F.col(n) + prior - F.col(y) - F.col("a")))
    bound = odds("bad", "bads") - odds("good", "goods") - z * F.sqrt(1 / (F.col("bad") + F.col("a")) + 1 / (F.col("good") + F.col("a")))
    return rows.select("token", "bad", bound.alias("bound"), ((F.col("good") + F.col("a")) / (F.col("goods") + prior)).alias("share"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a small logistic regression."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train=lambda k: F.lit(True), most_labelled: int = 20_000, prior: float = 1000.0, floor: float = 0.5, cost: float = 0.3, z: float = 2.33, alpha: float = 0.05) -> Model:
    """A model from labels ``toxic``; the sample is bounded by ``most_labelled`` documents; the model has every token whose bound passes.

    Without examples of both classes every text scores the share of toxic labels (0 without labels).
    """
    sc = docs.sparkSession.sparkContext
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.keep(labelled(docs, labels, "toxic", train, most_labelled), "sample")
    up = evidence(sample, docs, scratch, prior, floor, z).where("bound > 1.0 AND bad > 0").orderBy("token").collect()
    rest, lam, k = -cost, 1.0, 1.0
    score = {bytes(r.token): r.bound for r in up}
    if score:
        q = np.array([r.share for r in up])
        s = np.array([score[bytes(r.token)] for r in up])
        low, high = 1e-6, 50.0
        for _ in range(100):
            lam = (low + high) / 2
            over = (q * np.exp(np.minimum(lam * s, 600))).sum() + (1 - q.sum()) * np.exp(lam * rest) > 1
            low, high = (low, lam) if over else (lam, high)
    model = Model(score, rest, lam, k, (0.0, 0.0, 0.0, 0.0), alpha)
    told = sc.broadcast(model)
    seen = sample.mapInArrow(_sample_scan(told), "y int, n long, best double, found array<double>").collect()
    told.destroy()
    scratch.clear()
    y = np.array([r.y for r in seen], dtype=float)
    if not len(y) or y.min() == y.max() or not score:
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        model.weights = (float(np.log(p / (1 - p))), 0.0, 0.0, 0.0)
        return model
    clean = [(max(r.n, 1), r.best) for r in seen if not r.y]
    model.k = float(len(clean) / sum(n * np.exp(-lam * b) for n, b in clean))
    x = []
    for r in seen:
        size = np.log(model.k * max(r.n, 1))
        all_ = [(0, 0, f, float(np.exp(min(50.0, size - lam * f)))) for f in r.found]
        x.append(model.features(r.n, [f for f in all_ if f[3] <= alpha] or sorted(all_, key=lambda f: f[3])[:1]))
    model.weights = tuple(map(float, _logistic(np.array(x), y)))
    return model


def _sample_scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            ns, best, all_ = [], [], []
            for t in batch.column("text"):
                words = tokens(t.as_py())
                found = segments(np.fromiter(map(m.scores.__getitem__, words), dtype=float, count=len(words)))
                ns.append(len(words))
                best.append(max((s for *_, s in found), default=0.0))
                all_.append(sorted((s for *_, s in found), reverse=True))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("y").to_pylist(), pa.int32()), pa.array(ns, pa.int64()), pa.array(best, pa.float64()), pa.array(all_, pa.list_(pa.float64()))], names=["y", "n", "best", "found"])

    return run


def _spans(text: str, found: list, alpha: float) -> list[dict]:
    """Significant passages with their places in code points."""
    import re

    marks = [m.span() for m in re.finditer(rb"[^ ]+", text.encode("utf-8", "surrogatepass").translate(_TABLE).translate(bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))))]
    raw, at, seen, out = text.encode("utf-8", "surrogatepass"), 0, 0, []
    for a, b, s, e in sorted(found):
        if e <= alpha:
            first, end = marks[a][0], marks[b - 1][1]
            seen += len(raw[at:first].decode("utf-8", "replace"))
            start, size = seen, len(raw[first:end].decode("utf-8", "replace"))
            out.append({"start": start, "end": start + size, "score": s, "expected": e})
            at, seen = end, start + size
    return out


_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))


def _scorer(model, spans: bool, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            p, got = [], []
            for t in batch.column(at):
                said = t.as_py() or ""
                n, found = m.scan(said)
                p.append(m.probability(n, found))
                got.append(_spans(said, found, m.alpha) if spans else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(got, _PASSAGES)], names=[*batch.schema.names, "toxic_score", "toxic_passages"])
        m.scores.clear()
        give_back()

    return run


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """``docs`` with toxic_score (0 to 1) and toxic_passages (start and end in code points, score, expected number by chance).

    Null and empty texts score as a text without passages. Columns of those two names in ``docs`` are replaced; others stay.
    """
    docs = docs.drop("toxic_score", "toxic_passages")
    told = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scorer(told, spans, place(docs, "text")), f"{fields}, toxic_score double, toxic_passages array<struct<start:bigint,end:bigint,score:double,expected:double>>")
