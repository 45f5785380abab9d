"""MinHash near-duplicates with b-bit signatures.

Plan: one Arrow pass makes each document's shingle set, its digest, ``hashes`` minima, of which ``bands`` keys and the low
four bits of each minimum (the packed b-bit signature) stay. Equal sets fold into one class by a plain aggregation, so
copies cost nothing further. Classes that share a band key are candidates. Within a bucket the packed signatures are compared
by exclusive or and bit counts, the similarity corrected for chance matches of b bits, and a spanning forest of the likely pairs
goes on; buckets larger than ``block`` are met part by part (``_linked_within``), so no task holds an unbounded group. Likely
pairs form coarse components. The texts of their members alone are read once more and every likely pair that is not joined yet is
confirmed on the full sets, in the same way, which gives the links' spanning forest and, from it, the components.

With 112 minima in 28 bands of 4 a pair at similarity 0.85 shares no band with probability 1e-9, at 0.80 4e-7; the estimate
falls under the cut for a pair at the threshold with probability 1e-7 at most (``least_equal``, the exact binomial tail).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillstone.llm.common import Scratch, ascii_words, few, give_back, groups, mix64, shingle_hashes
from quillstone.llm.components import components

BITS = 4
_ONES = np.uint64(0x1111111111111111)


def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, hashes + 1, dtype=np.uint64)
    return mix64(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix64(k + np.uint64(0xA0761D6478BD642F))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 4096) -> np.ndarray:
    """The least value of each hash function over a set; 32 bits each."""
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(shingles), step):
        h = np.multiply.outer(shingles[i : i + step], a)
        h += b
        h >>= np.uint64(32)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def pack(low: np.ndarray) -> bytes:
    """The low four bits of each minimum, two in a byte, filled up to whole 64-bit words."""
    low = (low & np.uint64(15)).astype(np.uint8)
    low = np.concatenate([low, np.zeros(-len(low) % 16, dtype=np.uint8)])
    return (low[::2] | low[1::2] << 4).tobytes()


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the packed values differ between words of 64 bits, counted over the last axis."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & _ONES).sum(axis=-1, dtype=np.int16)


def corrected(equal: np.ndarray, hashes: int, bits: int = BITS) -> np.ndarray:
    """Similarity estimated from the number of equal b-bit values, less what chance makes equal."""
    c = 2.0**-bits
    return (equal / hashes - c) / (1 - c)


def least_equal(threshold: float, hashes: int, bits: int = BITS, loss: float = 1e-7) -> int:
    """Equal values under which a pair at the threshold stays with probability ``loss`` at most, by the binomial tail."""
    p, tail = threshold + (1 - threshold) * 2.0**-bits, 0.0
    for k in range(hashes + 1):
        tail += comb(hashes, k) * p**k * (1 - p) ** (hashes - k)
        if tail > loss:
            return k
    return hashes


def _signer(hashes: int, bands: int, width: int):
    a, b = _family(hashes)
    rows = hashes // bands
    place = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, digest, sig, keys = [], [], [], []
            for t in batch.column("text"):
                s = shingle_hashes(ascii_words(t.as_py() or ""), width)
                n.append(len(s))
                if len(s) == 0:
                    digest.append(None), sig.append(None), keys.append(None)
                    continue
                m = minima(s, a, b)
                k = place.copy()
                for r in range(rows):
                    k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + m.reshape(bands, rows)[:, r])
                digest.append(xxhash.xxh3_128_digest(s.tobytes())), sig.append(pack(m)), keys.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sig", "bands"])
        give_back()

    return sign


def signatures(docs: DataFrame, hashes: int = 112, bands: int = 28, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, digest of the set, packed b-bit signature, band keys. Null and empty text: size 0, the rest null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signer(hashes, bands, width), "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def stars(self, ids: np.ndarray) -> tuple[list[int], list[int]]:
        """(member, least member of its tree) for members that aren't that."""
        tops = np.fromiter(map(self.top, range(len(ids))), dtype=np.int64, count=len(ids))
        order = np.lexsort((ids, tops))
        first = np.r_[True, tops[order][1:] != tops[order][:-1]]
        least = np.empty(len(ids), dtype=np.int64)
        least[order] = ids[order][first][np.cumsum(first) - 1]
        odd = least != ids
        return ids[odd].tolist(), least[odd].tolist()


def _words(g: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(g.column("sig").to_pylist()), dtype=np.uint64).reshape(g.num_rows, -1)


def _likely(sig: np.ndarray, hashes: int, least: float, strip: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j whose estimated similarity is at least ``least``, and the estimate, strip by strip."""
    n = len(sig)
    for i in range(0, n, strip):
        top = sig[i : i + strip]
        for j in range(i, n, 1024):
            side = sig[j : j + 1024]
            differ = np.zeros((len(top), len(side)), dtype=np.int16)
            for k in range(sig.shape[1]):
                differ += unequal(top[:, k, None, None], side[None, :, k, None])
            near = corrected(hashes - differ, hashes)
            x, y = np.nonzero(near >= least)
            keep = x + i < y + j
            if keep.any():
                x, y = x[keep], y[keep]
                yield x + i, y + j, near[x, y]


_EDGES = "key long, u long, v long"


def _edges(k: list, u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, u, v)], names=["key", "u", "v"])


def _screen(hashes: int, least: float):
    """Spanning stars (key, member, least member) of the likely pairs of each bucket block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, us, vs, twos = [], [], [], []

        def out() -> pa.RecordBatch:
            if twos:
                # most buckets hold two: compared at once
                k, u, v, a, b = zip(*twos)
                a, b = (np.frombuffer(b"".join(x), dtype=np.uint64).reshape(len(twos), -1) for x in (a, b))
                for i in np.flatnonzero(corrected(hashes - unequal(a, b), hashes) >= least).tolist():
                    ks.append(k[i])
                    us.append(max(u[i], v[i]))
                    vs.append(min(u[i], v[i]))
            rows = _edges(ks, us, vs)
            for x in (ks, us, vs, twos):
                x.clear()
            return rows

        for g in groups(batches, ["key", "block"]):
            if g.num_rows == 2:
                (u, v), (a, b) = g.column("doc_id").to_pylist(), g.column("sig").to_pylist()
                twos.append((g.column("key")[0].as_py(), u, v, a, b))
            elif g.num_rows > 2:
                ids = g.column("doc_id").to_numpy()
                forest = _Forest(len(ids))
                for x, y, _ in _likely(_words(g), hashes, least):
                    for p, q in zip(x.tolist(), y.tolist()):
                        forest.join(p, q)
                u, v = forest.stars(ids)
                ks += [g.column("key")[0].as_py()] * len(u)
                us += u
                vs += v
            if len(us) + len(twos) > 50_000:
                yield out()
        yield out()
        give_back()

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct values."""
    n, m = len(x), len(y)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    if n > m:
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (n + m - both)


def _confirm(hashes: int, least: float, percent: int, width: int):
    """Spanning stars (key, member, least member) of the confirmed links of each block of a coarse component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["key", "block"]):
            ids = g.column("doc_id").to_numpy()
            sets = [shingle_hashes(ascii_words(t.as_py() or ""), width) for t in g.column("text")]
            forest = _Forest(len(ids))
            for x, y, e in _likely(_words(g), hashes, least):
                for k in np.argsort(-e, kind="stable").tolist():
                    p, q = int(x[k]), int(y[k])
                    if forest.top(p) != forest.top(q) and linked(sets[p], sets[q], percent):
                        forest.join(p, q)
            u, v = forest.stars(ids)
            yield _edges([g.column("key")[0].as_py()] * len(u), u, v)
        give_back()

    return run


def _dealt(rows: DataFrame, run) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "doc_id").mapInArrow(run, _EDGES)


def _parted(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with block, one of their key's ``sizes(k, parts)``; rows of other keys go."""
    return rows.join(sizes, F.expr("key = k")).withColumn("block", F.expr("pmod(xxhash64(doc_id), parts)")).drop("k", "parts")


def _sets(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows(key, ..., set)`` with the set that ``edges`` hang theirs on."""
    e = edges.select(F.col("key").alias("k"), "u", "v")
    return rows.join(e, F.expr("key = k AND set = u"), "left").withColumn("set", F.coalesce("v", "set")).drop("k", "u", "v")


def _linked_within(rows: DataFrame, weight: str, most: float, run, scratch: Scratch, payload: DataFrame | None = None, most_keys: int = 1_000_000) -> DataFrame:
    """Edges (u, v) that span the links among the ``rows(key, doc_id, ...)`` of each key; ``run`` finds those of a key's block, as stars.

    Keys up to ``most`` in ``weight`` are one block. Larger ones are cut into parts that first link within themselves; then the heads of the
    stars meet each other; only what still stands apart from the rest of its key meets it member by member. So a large group of alike texts
    costs a row a member, and no link between unlike members is lost. ``payload(doc_id, ...)`` is joined to the rows that have company. Keys with
    company are broadcast up to ``most_keys``; beyond, rows are joined with them by a shuffle.
    """
    with_payload = lambda df: df if payload is None else df.join(payload.withColumnRenamed("doc_id", "__d"), F.expr("doc_id = __d")).drop("__d")
    sizes = rows.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum(F.expr(weight)) / most).alias("parts")).where("n > 1").drop("n")
    sizes = scratch.keep(sizes, "sizes")
    first = scratch.keep(_dealt(with_payload(_parted(rows, few(sizes, most_keys))), run), "within")
    large = scratch.keep(sizes.where("parts > 1"), "large")
    if large.isEmpty():
        return first.select("u", "v")
    members = rows.join(few(large.select("k"), most_keys), F.expr("key = k"), "left_semi").withColumn("set", F.col("doc_id"))
    members = scratch.keep(_sets(members.select("key", "doc_id", "set", F.expr(weight).alias("w")), first), "members")
    heads = members.where("doc_id = set")
    cut = heads.groupBy(F.col("key").alias("k")).agg(F.ceil(F.sum("w") / most).alias("parts"))
    full = lambda df: with_payload(df.drop("w") if payload is not None else df.select(F.col("key").alias("__k"), F.col("doc_id").alias("__i"), *[c for c in df.columns if c not in ("key", "doc_id", "w")]).join(rows, F.expr("key = __k AND doc_id = __i")).drop("__k", "__i"))
    second = scratch.keep(_dealt(full(_parted(heads.drop("set"), cut)), run), "heads")
    members = _sets(members, second)
    sets = members.groupBy(F.col("key").alias("k"), F.col("set").alias("ks")).agg(F.sum("w").alias("sw"))
    # a set that fills a part has parts of its own; the others of a key share some under the least number as a name
    whole = Window.partitionBy("k")
    own = f"sw >= {most}"
    sets = sets.withColumn("many", F.count(F.lit(1)).over(whole)).withColumn("rest", F.ceil(F.sum(F.expr(f"IF({own}, 0, sw)")).over(whole) / most)).where("many > 1")
    sets = scratch.keep(sets.select("k", "ks", F.expr(own).alias("own"), F.expr(f"IF({own}, ceil(sw / {most}), rest)").alias("parts")), "sets")
    if sets.isEmpty():
        return first.union(second).select("u", "v")
    apart = members.join(sets, F.expr("key = k AND set = ks")).select("key", "doc_id", F.expr("IF(own, pmod(xxhash64(doc_id), parts), pmod(xxhash64(set), parts))").alias("part"), F.expr("IF(own, set, -9223372036854775807L)").alias("set"))
    apart = scratch.keep(apart, "apart")
    place = apart.select("key", "set", "part").distinct().withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("set", "part")).cast("long"))
    place = scratch.keep(place, "place")
    two = place.alias("a").join(place.alias("b"), F.expr("a.key = b.key AND a.at <= b.at AND NOT (a.set = b.set AND a.set <> -9223372036854775807L)"))
    two = two.select(F.col("a.key").alias("k"), F.expr("a.at * 2147483648 + b.at").alias("block"), F.explode(F.expr("array_distinct(array(a.at, b.at))")).alias("seat"))
    seats = place.select(F.col("key").alias("pk"), F.col("set").alias("ps"), F.col("part").alias("pp"), "at").join(two, F.expr("pk = k AND at = seat")).select("pk", "ps", "pp", "block")
    met = apart.join(seats, F.expr("key = pk AND set = ps AND part = pp")).select("key", "doc_id", "block")
    third = scratch.keep(_dealt(full(met), run), "members_met")
    return first.union(second).union(third).select("u", "v")


def near_duplicates(docs: DataFrame, percent: int = 80, hashes: int = 112, bands: int = 28, width: int = 5, block: int = 1024, block_shingles: int = 2_000_000, most_ids: int = 1_000_000, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs(doc_id, text, ...)``.

    Documents link where 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles; a component's id is
    its smallest doc_id, and only that document is kept. Null, empty and blank texts have size 0 and link with nothing. Rows
    that share a doc_id count as one document with several texts. A null doc_id gives component null and is kept. doc_id is of a whole-number type; other columns of ``docs`` are not read.
    Tables on the way go to ``scratch`` in the shared folder; those that the result doesn't read are removed. The ids of likely members are broadcast up to ``most_ids`` of them, so that no other text is moved; beyond, texts are joined by a shuffle.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise ValueError("components are named by the smallest doc_id, which must be of a whole-number type")
    scratch = scratch or Scratch(spark, "neardup")
    least = float(corrected(least_equal(percent / 100, hashes), hashes))
    signed = scratch.keep(signatures(docs, hashes, bands, width), "signed")
    full = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.keep(full.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("r")).select("digest", "r.*"), "classes")
    rows = classes.select(F.explode("bands").alias("key"), "doc_id")
    likely = _linked_within(rows, "1", block, _screen(hashes, least), scratch, payload=classes.select("doc_id", "sig"))
    coarse = scratch.keep(components(likely, scratch).withColumnRenamed("component", "key"), "coarse")
    parts = coarse.join(classes.select("doc_id", "sig", "n_shingles"), F.col("node") == F.col("doc_id")).select("key", F.col("doc_id").alias("d"), "sig", "n_shingles")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    texts = texts.join(few(coarse.select("node"), most_ids), F.col("doc_id") == F.col("node"), "left_semi")
    texts = scratch.keep(texts.join(parts, F.col("doc_id") == F.col("d")).select("key", "doc_id", "sig", "n_shingles", "text"), "texts")
    links = _linked_within(texts, f"greatest(n_shingles / {block_shingles}, 1 / {block})", 1.0, _confirm(hashes, least, percent, width), scratch)
    labels = scratch.keep(components(links, scratch), "labels")
    reps = classes.select(F.col("digest").alias("dg"), F.col("doc_id").alias("rep"))
    out = signed.select("doc_id", "n_shingles", "digest").join(reps, F.col("digest") == F.col("dg"), "left")
    out = out.join(labels, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return scratch.sweep(out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept")))
