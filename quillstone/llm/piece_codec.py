"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

No piece of such a vocabulary has a space mark after another character, so texts cut before each run of spaces into segments
that merge on their own; ``Codec`` verifies that of the vocabulary. Every segment has an agenda of its adjacent pairs that make a
piece; the best-scored pair, the leftmost of equals, is taken, merged, and its neighbours enter anew. Segments of up to 48
characters hold their agendas end to end in one array and take one pair each at a time; longer ones have a heap. Each new segment
is then decoded from its ids, and every Arrow batch checks its new segments against the sentencepiece library, both ways, and
stops on a difference. Segments are remembered within a bound of characters and until the end of the task, so the work follows
the distinct segments.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import give_back

_NEVER = float("inf")
MARK = "▁"  # stands for a space in pieces
_SEGMENT = re.compile(r" +[^ ]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, path: str, verify: bool = True, remember: int = 16_000_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix:
            raise ValueError("only merge-type vocabularies with identity normalization and a space put first are supported")
        pieces = list(enumerate(model.pieces))
        if any(p.type not in (1, 2, 3, 6) for _, p in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = [(i, p) for i, p in pieces if p.type == 1]
        if any(MARK in p.piece.lstrip(MARK) for _, p in normal):
            raise ValueError("pieces reach over a space")
        text = lambda p: p.piece.replace(MARK, " ")
        self.ids = {text(p): i for i, p in normal}
        self.order = {text(p): -p.score for _, p in normal}
        self.raw = {i: text(p).encode() for i, p in normal} | {i: bytes([int(p.piece[3:5], 16)]) for i, p in pieces if p.type == 6}
        self.byte = {self.raw[i][0]: i for i, p in pieces if p.type == 6}
        self.unknown = next(i for i, p in pieces if p.type == 2)
        self.raw[self.unknown] = (train.unk_surface or " ⁇ ").encode()
        self.verify, self.remember = verify, remember
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self._tables(len(pieces))
        self.forget()

    def _tables(self, n: int) -> None:
        """Symbols of the joint agenda: pieces by their ids, from ``n`` on the characters that only stand inside pieces, then all others by code point."""
        symbol = dict(self.ids)
        for c in sorted({c for t in self.ids for c in t}.difference(symbol)):
            symbol[c] = n + len(symbol) - len(self.ids)
        self.top = n + len(symbol) - len(self.ids)
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.top
        for t, i in symbol.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        pairs = [(symbol[t[:k]] << 32 | symbol[t[k:]], self.order[t], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in symbol and t[k:] in symbol]
        pairs.sort()
        self.keys, self.costs, self.made = (np.array([x[j] for x in pairs], dtype=kind) for j, kind in enumerate((np.int64, np.float64, np.int64)))
        inside = {i: t for t, i in symbol.items() if t not in self.ids}
        self.shown = [str(i) for i in range(n)] + [self._bytes(inside[i]) for i in range(n, self.top)]
        self.spelt = [self.raw.get(i, b"") for i in range(n)] + [inside[i].encode() for i in range(n, self.top)]

    def _bytes(self, c: str) -> str:
        """Ids of a character that is no piece."""
        return ",".join(str(self.byte[b]) for b in c.encode("utf-8", "surrogatepass")) if self.byte else str(self.unknown)

    def forget(self) -> None:
        """Drop what is remembered of segments."""
        self.held = 0  # characters of the segments known and of their ids
        self.known: dict[str, str] = {}
        self.past: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def agenda(self, s: str) -> list[int]:
        """Ids of a segment: of all adjacent pairs that make a piece, the best-scored merges first, the leftmost of equals."""
        order = self.order
        if len(s) > 48:
            parts = self._long(s)
        else:
            # short segments keep the agenda as a plain list beside the symbols: its least entry is found by one scan
            parts = list(s)
            get = order.get
            cost = list(map(get, map(add, s, s[1:]), repeat(_NEVER)))
            while cost and (best := min(cost)) != _NEVER:
                i = cost.index(best)
                mine = parts[i] = parts[i] + parts.pop(i + 1)
                del cost[i]
                if i < len(cost):
                    cost[i] = get(mine + parts[i + 1], _NEVER)
                if i:
                    cost[i - 1] = get(parts[i - 1] + mine, _NEVER)
        ids = self.ids
        out = [ids.get(p) for p in parts]
        if None not in out:
            return out
        out = []
        for p in parts:
            got = ids.get(p)
            if got is not None:
                out.append(got)
            elif self.byte:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _long(self, s: str) -> list[str]:
        """Symbols of a segment of any length, with a heap for the agenda."""
        n, order = len(s), self.order
        # symbol i reaches up to end[i]; back[i] is where the symbol before it begins
        end, back, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(order[s[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if s[i : i + 2] in order]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not live[i] or end[i] != j or not live[j] or end[j] != k:
                continue
            live[j], end[i] = False, k
            if k < n:
                back[k] = i
                if (pair := s[i : end[k]]) in order:
                    heapq.heappush(heap, (order[pair], i, k, end[k]))
            if (h := back[i]) >= 0 and (pair := s[h:k]) in order:
                heapq.heappush(heap, (order[pair], h, i, k))
        return [s[i : end[i]] for i in range(n) if live[i]]

    def text_of(self, ids: list[int]) -> str:
        """The text that ids spell, with the leading space that encoding put there."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")

    def segments(self, text: str) -> list[str]:
        """A text with the leading space, cut before each run of spaces."""
        text = " " + text.replace(MARK, " ")
        if "  " in text or text[-1] == " ":
            return _SEGMENT.findall(text)
        return [f" {x}" for x in text[1:].split(" ")]

    def _cost(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost of each pair and its place in the tables."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return (np.where(self.keys[at] == key, self.costs[at], _NEVER) if len(self.keys) else np.full(len(key), _NEVER)), at

    def agendas(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, number of each segment's) of segments whose agendas lie end to end, all taking their best pair at once."""
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        sym = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        seq = np.repeat(np.arange(len(segments)), sizes)
        cost, at = np.full(len(sym), _NEVER), np.zeros(len(sym), dtype=np.int64)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        cost[inner], at[inner] = self._cost(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            spans = np.diff(np.r_[starts, len(seq)])
            best = np.repeat(np.minimum.reduceat(cost, starts), spans)
            live = best < _NEVER
            if not live.all():
                done.append((sym[~live], seq[~live]))
                sym, seq, cost, at, best = sym[live], seq[live], cost[live], at[live], best[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(cost == best)
            hit = hit[np.r_[True, seq[hit][1:] != seq[hit][:-1]]]  # the leftmost of each
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # where they are once the others are gone
            sym, seq, cost, at = sym[keep], seq[keep], cost[keep], at[keep]
            touched = np.zeros(len(sym), dtype=bool)
            touched[moved] = True
            touched[np.maximum(moved - 1, 0)] = True
            near = np.flatnonzero(touched)
            cost[near] = _NEVER
            near = near[near + 1 < len(sym)]
            near = near[seq[near] == seq[near + 1]]
            cost[near], at[near] = self._cost(sym[near], sym[near + 1])
        if not done:
            return sym, np.zeros(len(segments), dtype=np.int64)
        sym, seq = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(seq, kind="stable")
        return sym[order], np.bincount(seq, minlength=len(segments))

    def learn(self, new: list[str]) -> None:
        # without byte pieces a run of strange characters is one id, which a heap's segment sees as a whole
        joint = [s for s in new if len(s) <= 48 and (self.byte or int(self.of_char[list(map(ord, s))].max()) < self.top)]
        ids, texts = {}, {}
        for i in range(0, len(joint), 50_000):
            some = joint[i : i + 50_000]
            sym, counts = self.agendas(some)
            if len(sym) and sym.max() >= self.top:
                shown = [self.shown[x] if x < self.top else self._bytes(chr(x - self.top)) for x in sym.tolist()]
                spelt = [self.spelt[x] if x < self.top else chr(x - self.top).encode("utf-8", "surrogatepass") for x in sym.tolist()]
            else:
                sym = sym.tolist()
                shown, spelt = list(map(self.shown.__getitem__, sym)), list(map(self.spelt.__getitem__, sym))
            ends = np.cumsum(counts).tolist()
            back = b"".join(spelt).decode("utf-8", "replace")
            for s, a, b in zip(some, [0, *ends], ends):
                ids[s] = ",".join(shown[a:b])
            # the ids of all spell the segments end to end, or each is looked at by itself
            texts.update(zip(some, some) if back == "".join(some) else ((s, b"".join(spelt[a:b]).decode("utf-8", "replace")) for s, a, b in zip(some, [0, *ends], ends)))
        for s in set(new).difference(ids):
            x = self.agenda(s)
            ids[s], texts[s] = ",".join(map(str, x)), self.text_of(x)
        if self.verify:
            # segments that stand end to end keep their cuts, so the library sees some hundred at once; spaces alone would join the next
            apart = [[s] for s in new if s != " " and not s.strip(" ")]
            whole = [s for s in new if s.strip(" ")]
            for group in apart + [whole[i : i + 500] for i in range(0, len(whole), 500)]:
                theirs = self.library.encode("".join(group)[1:], num_threads=1)
                if ",".join([ids[s] for s in group]) != ",".join(map(str, theirs)) or self.library.decode(theirs) != "".join([texts[s] for s in group])[1:]:
                    raise AssertionError(f"the library gives other ids or text for a run that begins with {group[0]!r}")
        for s in new:
            got = ids[s]
            self.known[s] = got
            self.held += len(s) + len(got)
            if texts[s] != s:
                self.odd[s] = texts[s]

    def run(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(ids' number, ids joined by commas, decoded text) of each text."""
        if self.held > self.remember:
            # what is met again moves back from the past, the rest is forgotten the next time
            self.past, self.known, self.held = self.known, {}, 0
            self.odd = {s: t for s, t in self.odd.items() if s in self.past}
        cuts = [self.segments(t) if t else [] for t in texts]
        known, past = self.known, self.past
        new = []
        for s in {s for c in cuts for s in c}.difference(known):
            if s in past:
                known[s] = got = past[s]
                self.held += len(s) + len(got)
            else:
                new.append(s)
        if new:
            self.learn(new)
        out = []
        for c in cuts:
            ids = ",".join(map(self.known.__getitem__, c))
            text = "".join([self.odd.get(s, s) for s in c] if self.odd else c)
            out.append((ids.count(",") + 1 if ids else 0, ids, text[1:]))
        return out


_READY: dict[tuple, Codec] = {}


def codec(path: str | None, verify: bool, remember: int) -> Codec:
    key = (path or default_path(), verify, remember)
    if key not in _READY:
        _READY[key] = Codec(*key)
    return _READY[key]


def _runner(path: str | None, verify: bool, chars_at_once: int, digests: bool, remember: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, verify, remember)
        try:
            yield from rows(c, batches)
        finally:
            c.forget()
            give_back()

    def rows(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

        def out(keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
            n, ids, back = zip(*c.run(texts))
            if digests:
                ids, back = pa.array(list(map(sha, ids)), pa.string()), list(map(sha, back))
            else:
                # all ids of the batch lie in one array, without an object for each
                flat = np.fromstring(",".join([x for x in ids if x]), dtype=np.int32, sep=",")
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), ids, pa.array(back, pa.string())], names=["k", "n_tokens", "ids", "decoded"])

        for batch in batches:
            texts, some, start, held = batch.column("t"), [], 0, 0
            for i in range(batch.num_rows):
                some.append(texts[i].as_py() or "")
                held += len(some[-1])
                if held > chars_at_once or i + 1 == batch.num_rows:
                    yield out(batch.column("k").slice(start, i + 1 - start), some)
                    some, start, held = [], i + 1, 0

    return run


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, verify: bool = True, digests: bool = False, chars_at_once: int = 2_000_000, remember: int = 16_000_000) -> DataFrame:
    """key, n_tokens, ids, decoded: whole texts encoded, then decoded from those ids, in one pass without a shuffle.

    With ``digests`` both become SHA-256 in hex, made where the ids are, so that they need not be moved: of the decimal ids joined by commas, and of the text in UTF-8.
    ``remember`` bounds the characters of segments and ids that a worker keeps, twice that in all. Null and empty texts have no ids and decode to an empty text. Repeated rows stay; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    wide = "string" if digests else "array<int>"
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(_runner(path, verify, chars_at_once, digests, remember), f"k {kind}, n_tokens long, ids {wide}, decoded string")
    return out.withColumnRenamed("k", key)
