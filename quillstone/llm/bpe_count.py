"""Exact token counts of a byte-level BPE tokenizer, by rank-synchronous merging of ragged arrays.

Texts are cut at single spaces into chunks, which is a cut that the pre-tokenizer's pattern always makes; each new chunk is cut
into pre-tokens, and all new pre-tokens of a batch lie end to end in one symbol array. In each round every pre-token applies
its own lowest-rank pair, at all its places at once; finished ones leave. Counts of chunks are remembered within a bound of
characters and until the end of the task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import give_back

NEVER = np.iinfo(np.int32).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """A vocabulary's merges as sorted arrays, and its counts of texts."""

    def __init__(self, path: str, remember: int = 12_000_000):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        key = left << 32 | right
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.keys = key[self.order]
        self.first = np.zeros(256, dtype=np.int64)
        for ch, b in byte_symbols().items():
            self.first[b] = vocab[ch]
        special = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # the same cuts by the faster engine, for texts of ASCII and Latin letters only
        latin = "A-Za-zÀ-ÖØ-öø-ɏ"
        self.plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{latin}]+| ?[0-9]+| ?[^\t-\r 0-9{latin}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
        self.other = re.compile(rf"[^\t-\r -~{latin}]")
        self.loose = re.compile(r"\s[ ]|[ ]\s")
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of chunks and pre-tokens."""
        self.chunks: dict[str, int] = {}
        self.tokens: dict[str, int] = {}
        self.held = 0  # characters of both

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Symbols that each word has left after all merges."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        left = sizes.copy()
        seq = np.repeat(np.arange(len(words)), sizes)
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rank = np.full(len(sym), NEVER, dtype=np.int32)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            spans = np.diff(np.r_[starts, len(seq)])
            low = np.minimum.reduceat(rank, starts)
            live = np.repeat(low < NEVER, spans)
            low = np.repeat(low, spans)
            if not live.all():
                sym, seq, rank, low = sym[live], seq[live], rank[live], low[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            run = np.r_[True, np.diff(hit) != 1]
            hit = hit[(hit - hit[run][np.cumsum(run) - 1]) % 2 == 0]  # aaa: the left pair only
            left -= np.bincount(seq[hit], minlength=len(left))
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where they are once the others are gone
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            touched = np.zeros(len(sym), dtype=bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            near = np.flatnonzero(touched)
            rank[near] = NEVER
            near = near[near + 1 < len(sym)]
            near = near[seq[near] == seq[near + 1]]
            rank[near] = self.ranks(sym[near], sym[near + 1])
        return left

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special tokens stood between them."""
        parts = self.special.split(text) if self.special else [text]
        return [t for p in parts for t in (self.pattern if self.other.search(p) else self.plain).findall(p)], len(parts) - 1

    def learn(self, texts: list[str]) -> list[int]:
        """Counts of texts as they stand."""
        known = self.tokens
        joined = "\n".join(texts)
        if self.special and self.special.search(joined):
            cuts = [self.cut(t) for t in texts]
        else:
            find = (self.pattern if self.other.search(joined) else self.plain).findall
            cuts = [(find(t), 0) for t in texts]
        new = list({t for ts, _ in cuts for t in ts}.difference(known))
        if new:
            known.update(zip(new, self.merge([t.encode("utf-8", "surrogatepass") for t in new]).tolist()))
            self.held += sum(map(len, new))
        return [(known[ts[0]] if len(ts) == 1 else sum([known[t] for t in ts])) + n for ts, n in cuts]

    def count(self, texts: list[str]) -> list[int]:
        if self.held > self.remember:
            self.forget()
        split = [None if self.loose.search(t) else t.split(" ") for t in texts]
        # where white space meets a space the pattern may not cut there: such texts count whole
        whole = [i for i, s in enumerate(split) if s is None]
        heads = [s[0] for s in split if s is not None]
        new = list({c for s in split if s is not None for c in s[1:]} - self.chunks.keys())
        self.chunks.update(zip(new, self.learn([f" {c}" for c in new])))
        self.held += sum(map(len, new))
        head = dict(zip(set(heads), self.learn(list(set(heads))))) if heads else {}
        out = [0] * len(texts)
        for i, s in enumerate(split):
            if s is not None:
                out[i] = head[s[0]] + sum(map(self.chunks.__getitem__, s[1:]))
        for i, n in zip(whole, self.learn([texts[i] for i in whole])):
            out[i] = n
        return out


_READY: dict[str, RankMerger] = {}


def merger(path: str | None) -> RankMerger:
    """One per worker and path."""
    path = path or default_path()
    if path not in _READY:
        _READY[path] = RankMerger(path)
    return _READY[path]


def _counter(path: str | None, text: str, bytes_at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        try:
            yield from rows(m, batches)
        finally:
            m.forget()
            give_back()

    def rows(m: RankMerger, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, some, held = [], [], [], 0
            for t in batch.column(text):
                s = t.as_py() or ""
                sizes.append(len(s.encode("utf-8", "surrogatepass")))
                some.append(s)
                held += sizes[-1]
                if held > bytes_at_once:
                    counts += m.count(some)
                    some, held = [], 0
            counts += m.count(some)
            at = batch.schema.get_field_index(text)
            names = batch.schema.names
            rest = [(batch.column(i), names[i]) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*(n for _, n in rest), "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 512, bytes_at_once: int = 2_000_000) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, over_limit: one row per row of ``docs``, whole texts, in one pass without a shuffle.

    Null and empty texts have 0 of each. Special strings inside texts count as the tokenizer's special tokens. Repeated rows stay; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(_counter(path, "t", bytes_at_once), f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
