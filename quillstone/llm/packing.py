"""Packing of documents into token sequences of a fixed size, by exact complements and then best fit.

Texts become ids in Arrow batches, an end id behind each; longer documents are cut, the first piece being the short one. All that the packing needs to
know is how many pieces there are of each length, a table of at most ``size`` rows however large the corpus. The plan is made of it:

* Complements: for each length from the greatest down, the single lengths, pairs and triples that sum to exactly what is missing are looked up in an
  index of sums, and taken as often as all their lengths are there; each taking exhausts a length, so there are at most ``size`` of them.
* Best fit: the rest, from the greatest length down, goes to the open sequences with the least sufficient gap, gaps being kept as counts too.

The plan says which runs of a length's ranks go where. Pieces get ranks without an order: each task numbers its own, and counts of (task, length) shift
them. So no task ever holds more than a batch of pieces, and no group is gathered.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.bpe_count import byte_symbols
from quillstone.llm.common import Scratch, fresh, give_back


def _same_by_ranks(spec: dict):
    """A byte-pair encoder of tiktoken that gives the ids of a tokenizers file, or None where the file asks for more than ranks.

    It must be plain byte-level BPE: no normalizer, the byte-level pattern without a prefix space, and merges in the order of the ids that they make.
    """
    import public_tokenizers
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocab, symbols = model["vocab"], byte_symbols()
    made = [vocab[m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["merges"]]
    special = {t["content"] for t in spec.get("added_tokens") or []}
    words = {w: i for w, i in vocab.items() if w not in special}
    if any(a >= b for a, b in zip(made, made[1:])) or len(made) + 256 != len(words):
        return None
    ranks = {bytes(symbols[c] for c in w): i for w, i in words.items()}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class ChunkIds:
    """Ids of whole texts as the tokenizers library gives them, chunks between single spaces remembered.

    A space between two signs that are no white space always begins a pre-token of byte-level vocabularies, so texts are cut there. New chunks are encoded end to end,
    parted by tabs, by ranks alone where the vocabulary allows (which is the faster library), else by the tokenizers library. Chunks that hold tabs or
    special strings or end in white space go to the latter one by one.
    """

    def __init__(self, path: str | None, remember: int = 8_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.odd = re.compile("|".join([r"\t", r"\s\Z", *map(re.escape, special)]))
        self.by_ranks = _same_by_ranks(spec)
        self.tab = self._ids("\t")
        self.cut = re.compile(r" (?<=\S )(?=\S)")
        self.wide_space = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, chunks: list[str]) -> None:
        """Ids of each chunk behind a space."""
        odd = self.odd.search
        plain = [c for c in chunks if c and not odd(c)] if len(self.tab) == 1 else []
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            joined = "\t".join([f" {c}" for c in some])
            ids = self._ids(joined) if self.by_ranks is None else self.by_ranks.encode_to_numpy(joined).astype("<u4")
            at = np.flatnonzero(ids == self.tab[0])
            if len(at) != len(some) - 1:
                raise RuntimeError("the library didn't part chunks at tabs")
            raw, starts, ends = ids.tobytes(), (np.r_[-1, at] + 1) * 4, np.r_[at, len(ids)] * 4
            self.chunks.update((c, raw[a:b]) for c, a, b in zip(some, starts.tolist(), ends.tolist()))
        if len(plain) < len(chunks):
            for c in chunks:
                if c not in self.chunks:
                    self.chunks[c] = self._ids(f" {c}").tobytes()
        self.held += sum(map(len, chunks))

    def _split(self, text: str) -> list[str]:
        if any(x in text for x in ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r")) or self.wide_space.search(text):
            return self.cut.split(text)
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > self.remember:
            self.forget()
        split = [self._split(t) for t in texts]
        self._learn(list({c for s in split for c in s[1:]} - self.chunks.keys()))
        heads = self.library.encode_batch([s[0] for s in split], add_special_tokens=False)
        get = self.chunks.__getitem__
        return [np.array(h.ids, dtype="<u4").tobytes() + b"".join(map(get, s[1:])) for h, s in zip(heads, split)]


_READY: dict[str | None, ChunkIds] = {}


def _ids_of(path: str | None) -> ChunkIds:
    """One per worker and path."""
    if path not in _READY:
        _READY[path] = ChunkIds(path)
    return _READY[path]


def _pieces(size: int, end: int, path: str | None, digest: bool, chars_at_once: int):
    """Batches of (k, text) to pieces, each with its task's number and its rank among the task's pieces of its length."""
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, seen = _ids_of(path), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        try:
            for batch in batches:
                some, rows, held = [], [], 0
                for i, t in enumerate(batch.column("t")):
                    some.append(t.as_py() or "")
                    rows.append(i)
                    held += len(some[-1])
                    if held > chars_at_once or i == batch.num_rows - 1:
                        yield cut(batch.column("k"), rows, known.encode(some), seen, task)
                        some, rows, held = [], [], 0
        finally:
            known.forget()
            give_back()

    def cut(keys: pa.Array, rows: list[int], ids: list[bytes], seen: np.ndarray, task: int) -> pa.RecordBatch:
        ids = [x + tail for x in ids]
        n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        first = (n - 1) % size + 1
        count = (n - first) // size + 1
        doc = np.repeat(np.arange(len(ids)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = np.where(piece == 0, 0, first[doc] + (piece - 1) * size)
        length = np.where(piece == 0, first[doc], size)
        order = np.argsort(length, kind="stable")
        run = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0])
        rank = np.empty(len(length), dtype=np.int64)
        rank[order] = np.arange(len(length)) - np.repeat(run, np.diff(np.r_[run, len(length)])) + seen[length[order]]
        seen += np.bincount(length, minlength=size + 1)
        parts = [memoryview(ids[d])[4 * a : 4 * (a + b)] for d, a, b in zip(doc.tolist(), start.tolist(), length.tolist())]
        if digest:
            said = pa.array([zlib.crc32(p) for p in parts], pa.int64())
        else:
            said = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int32)))
        at = pa.array(np.array(rows)[doc])
        columns = [keys.take(at), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), said, pa.array(np.full(len(doc), task, dtype=np.int32)), pa.array(rank)]
        return pa.RecordBatch.from_arrays(columns, names=["k", "piece", "start", "length", "ids", "task", "rank"])

    return run


@dataclass
class Plan:
    """Runs of ranks: pieces of ``length`` with ranks from ``first`` on go ``each`` to a sequence, into sequences from ``sequence`` on, at ``offset``.

    Sorted by length and first; ``sequences`` is their number.
    """

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces, by one search."""
        most = np.int64(max(int(rank.max(initial=0)), int(self.first.max(initial=0))) + 1)
        if int(most) * (int(length.max(initial=0)) + 1) >= 2**63:
            raise OverflowError("too many pieces of one length")
        at = np.searchsorted(self.length * most + self.first, length * most + rank, side="right") - 1
        copy, slot = np.divmod(rank - self.first[at], self.each[at])
        return self.sequence[at] + copy, self.offset[at] + slot * length


class _Sums:
    """Which lengths are there, and the index of sums of two of them.

    ``pair[s]`` is the greatest smaller part of a sum s. Counts only fall, so an entry of 0 stays right; others are looked at when used and searched anew
    once their lengths are gone.
    """

    def __init__(self, counts: np.ndarray, size: int):
        self.left, self.pair = np.array(counts, dtype=np.int64), np.zeros(size + 1, dtype=np.int64)
        for s in range(2, size + 1):
            self.pair[s] = self._search(s)

    def _search(self, s: int) -> int:
        y = np.arange(1, s // 2 + 1)
        ok = (self.left[y] > 0) & (self.left[s - y] > 0)
        if s % 2 == 0:
            ok[-1] = self.left[s // 2] > 1
        at = np.flatnonzero(ok)
        return int(y[at[-1]]) if len(at) else 0

    def there(self, lengths: list[int]) -> bool:
        return all(self.left[v] >= lengths.count(v) for v in set(lengths))

    def two(self, s: int) -> list[int] | None:
        y = int(self.pair[s])
        if y and not self.there([y, s - y]):
            y = self.pair[s] = self._search(s)
        return [s - int(y), int(y)] if y else None

    def complement(self, top: int, gap: int, parts: int) -> list[int] | None:
        """So many lengths (one to three) that are there besides ``top`` and sum to ``gap``, greatest first."""
        if parts == 1:
            found = [[gap]] if self.there([gap, top]) else []
        elif parts == 2:
            found = [x] if (x := self.two(gap)) else []
        else:
            one = np.flatnonzero(self.left[:gap])[::-1]
            found = ([x, *two] for x in one[self.pair[gap - one] > 0].tolist() if (two := self.two(gap - x)))
        return next((x for x in found if self.there([top, *x])), None)


def make_plan(counts: np.ndarray, size: int) -> Plan:
    """A plan for ``counts[n]`` pieces of each length n from 1 to ``size``, in time that depends on ``size`` alone.

    Complements of one length are taken for all lengths before those of two, and those before three, so that short pieces last. Of this plan and the one by best
    fit alone, that with fewer sequences is taken.
    """
    counts = np.asarray(counts, dtype=np.int64)
    return min((_plan(counts, size, most) for most in (3, 2, 1, 0)), key=lambda p: p.sequences)


def _plan(counts: np.ndarray, size: int, most: int) -> Plan:
    sums = _Sums(np.where(np.arange(size + 1) < size, counts, 0), size)
    left = sums.left
    done: list[tuple[list[tuple[int, int]], int]] = []  # ((length, how often) of a sequence, how many sequences)
    if counts[size]:
        done.append(([(size, 1)], int(counts[size])))
    for parts in range(1, most + 1):
        for top in range(size - 1, 0, -1):
            while left[top] and (rest := sums.complement(top, size - top, parts)):
                need = {v: [top, *rest].count(v) for v in (top, *rest)}
                times = min(int(left[v]) // c for v, c in need.items())
                done.append((list(need.items()), times))
                for v, c in need.items():
                    left[v] -= times * c
    # best fit: open[g] has the sequences with a gap of g
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for n in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[n])
        for gap in sorted(g for g in open_ if g >= n):
            each = gap // n
            for held, times in open_.pop(gap):
                full = min(times, rest // each)
                rest -= full * each
                last = rest if full < times else 0
                rest -= last
                for m, k in ((each, full), (last, int(last > 0)), (0, times - full - (last > 0))):
                    if k:
                        open_.setdefault(gap - m * n, []).append(([*held, (n, m)] if m else held, k))
            if not rest:
                break
        each = size // n
        if rest // each:
            open_.setdefault(size - each * n, []).append(([(n, each)], rest // each))
        if rest % each:
            open_.setdefault(size - rest % each * n, []).append(([(n, rest % each)], 1))
    done += [x for held in open_.values() for x in held]
    used, runs, sequence = np.zeros(size + 1, dtype=np.int64), [], 0
    for held, times in done:
        offset = 0
        for n, m in held:
            runs.append((n, int(used[n]), m, sequence, offset))
            used[n] += m * times
            offset += n * m
        sequence += times
    if not np.array_equal(used, counts):
        raise RuntimeError("the plan leaves pieces over")
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    return Plan(*(table[:, i] for i in range(5)), sequences=sequence)


def pack(docs: DataFrame, size: int = 2048, key: str = "doc_id", text: str = "text", end: int = 0, path: str | None = None, digest: bool = False, scratch: Scratch | None = None, chars_at_once: int = 1_000_000) -> DataFrame:
    """A row per piece: key, piece (from 0), start (ids of its document before it), length, ids, sequence_id (from 0), offset.

    ``ids`` are the tokenizer's with ``end`` behind the last; with ``digest`` their CRC-32 as little-endian unsigned 32-bit integers stands in their place. A null
    or empty text is the end id alone. Documents of more than ``size`` ids are cut from the back into pieces of ``size``; the first piece has what remains. Repeated rows
    and null keys are documents like others; other columns are not read; an empty table has no pieces. Pieces of a sequence lie gapless from offset 0; equal lengths are
    interchangeable, and which of them goes where follows the tables that Spark wrote. Sequence numbers have no gaps. Pieces are written to the shared folder
    first, without texts; the driver gets one count for each length.
    """
    if size < 1:
        raise ValueError("size must be positive")
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    kind, said = docs.schema[key].dataType.simpleString(), "long" if digest else "array<int>"
    made = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(_pieces(size, end, path, digest, chars_at_once), f"k {kind}, piece int, start long, length long, ids {said}, task int, rank long")
    made = scratch.keep(made, "pieces")
    sizes = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = scratch.keep(sizes.select(F.col("task").alias("t"), F.col("length").alias("l"), "n", before.alias("before")), "sizes")
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in sizes.groupBy("l").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["l"]] = r["n"]
    plan = make_plan(counts, size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = plan.place(length, rank)
            columns = [batch.column(c) for c in ("k", "piece", "start", "length", "ids")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["k", "piece", "start", "length", "ids", "sequence_id", "offset"])

    ranked = made.hint("merge").join(sizes.drop("n"), (F.col("task") == F.col("t")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("rank") + F.col("before"))
    out = ranked.select("k", "piece", "start", "length", "ids", "rank").mapInArrow(place, f"k {kind}, piece int, start long, length long, ids {said}, sequence_id long, offset long")
    return out.select(F.col("k").alias(key), *out.columns[1:])


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """sequence_id, ids (those of its pieces in a row) and spans (key, piece, offset, length) of what ``pack`` made with ids; a sequence has at most ``size`` pieces."""
    k = fresh(packed.columns, "key")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "piece", F.col(key).alias(k), "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda p: F.struct(p[k].alias(key), p["piece"], p["offset"], p["length"])).alias("spans"))
