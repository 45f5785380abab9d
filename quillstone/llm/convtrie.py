"""Prefix trie of conversations by chained digests.

Turns become SHA-256 digests of role and text, so no text moves. A prefix of d turns has the digest of its parent's digest and its last turn's, from
the digest of nothing at the root on; equal prefixes of any conversations have equal digests and are one node. Conversations are chained in a stream over sorted
turns, which holds one digest at a time, and each prefix is a row; nodes are groups of (depth, digest), summed up before they move.

Sums over subtrees go from each node to all its ancestors. A node belongs to its smallest member; the nodes of one owner are one path down to the end
of its conversation. So each owner's nodes are summed up along its path first, and one row for the path goes to each ancestor above it: the rows that move
are no more than the prefixes, and no node's descendants ever meet unsummed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch

ROOT = hashlib.sha256(b"").digest()


def turn_digest(role: str = "role", text: str = "text"):
    """32 bytes for a turn; the role's length parts it from the text. Nulls read as empty."""
    said = F.coalesce(F.col(role), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, F.coalesce(F.col(text), F.lit(""))), 256))


def _chain(shared: bool):
    """Sorted turns (base, own, conv_id, h, digest, bytes) to prefixes. A base's first turns stand before the conversations that borrow them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, head, now, at, depth, digest = None, [], None, 0, 0, ROOT
        began = False
        ids, depths, digests, above, sizes, ends = [], [], [], [], [], []

        def put(conv, d: int, mine: bytes, up: bytes | None, n: int) -> None:
            ids.append(conv), depths.append(d), digests.append(mine), above.append(up), sizes.append(n), ends.append(False)

        def turn(conv, mine: bytes, n: int) -> None:
            nonlocal depth, digest
            up, depth, digest = digest, depth + 1, hashlib.sha256(digest + mine).digest()
            put(conv, depth, digest, up, n)

        def flush() -> pa.RecordBatch:
            columns = [pa.array(ids, pa.int64()), pa.array(depths, pa.int64()), pa.array(digests, pa.binary()), pa.array(above, pa.binary()), pa.array(sizes, pa.int64()), pa.array(ends, pa.bool_())]
            for x in (ids, depths, digests, above, sizes, ends):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "digest", "above", "bytes", "ends"])

        for batch in batches:
            # the last prefix of a conversation ends it; it stays until that is known
            for b, conv, h, mine, n in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "h", "digest", "bytes"))):
                if not began or conv != now or (conv is None) != (now is None):
                    if ids:
                        ends[-1] = True
                    if not began or b != base:
                        base, head = b, []
                    began, now, at, depth, digest = True, conv, 0, 0, ROOT
                    put(conv, 0, ROOT, None, 0)
                    lent = shared and conv != b
                    if lent:
                        for x in head[:h]:
                            turn(conv, *x)
                at += 1
                if shared and conv == b and at <= 8:
                    head.append((mine, n))
                if not lent or at > h:
                    turn(conv, mine, n)
            if len(ids) > 20_000:
                held = [x.pop() for x in (ids, depths, digests, above, sizes, ends)]
                yield flush()
                for x, v in zip((ids, depths, digests, above, sizes, ends), held):
                    x.append(v)
        if ids:
            ends[-1] = True
            yield flush()

    return run


def prefixes(turns: DataFrame, borrow: bool = False) -> DataFrame:
    """conv_id, depth, digest, above (its parent's digest), bytes (UTF-8, of its last text) and ends, a row for each prefix of each conversation, the empty one too.

    Turns are ordered by ``turn``, null first, ties by role and text; null roles and texts read as empty. With ``borrow`` conversation c has the first crc32(c) % 9 turns of
    conversation c - c % 5 in place of its own first ones. Null conv_ids form one conversation, which borrows nothing. A conversation is chained in one task, as a chain is one turn
    after the other, but of its turns only 40 bytes each get there, and the task holds one at a time.
    """
    c = F.col("conv_id")
    said = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select(c.cast("long").alias("conv_id"), "turn", turn_digest().alias("digest"), F.octet_length(said).cast("long").alias("bytes"), F.substring(F.coalesce("role", F.lit("")), 1, 64).alias("r"), F.substring(said, 1, 64).alias("t"))
    base = c - c % 5 if borrow else c
    h = (F.crc32(c.cast("string").cast("binary")) % 9).cast("int") if borrow else F.lit(0)
    rows = rows.withColumns({"base": base, "h": F.coalesce(h, F.lit(0)), "other": F.coalesce(c != base, F.lit(False))})
    rows = rows.repartition("base").sortWithinPartitions("base", "other", "conv_id", F.col("turn").asc_nulls_first(), "r", "t", "digest")
    kind = "conv_id long, depth long, digest binary, above binary, bytes long, ends boolean"
    return rows.select("base", "conv_id", "h", "digest", "bytes").mapInArrow(_chain(borrow), kind)


def _joined_ids(rows: DataFrame) -> DataFrame:
    """digest and SHA-256 hex of the decimal conv_ids of ``rows(digest, conv_id)``, ascending, joined by commas.

    Range partitions of (digest, conv_id) make texts of up to some thousand ids each; the digests of a node's texts, in order, are read as a stream.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, ids = batch.column("digest"), batch.column("conv_id").to_pylist()
            key = np.array(digest.to_pylist(), dtype=object)
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(ids)] if ids else []
            made = [(key[a], ids[a], ",".join("" if i is None else str(i) for i in ids[a:b])) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.string())], names=["digest", "first", "text"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for mine, text in zip(batch.column("digest").to_pylist(), batch.column("text")):
                if mine != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = mine, hashlib.sha256(text.as_py().encode())
                else:
                    state.update(b"," + text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["digest", "sha"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["digest", "sha"])

    order = [F.col("digest"), F.col("conv_id").asc_nulls_first()]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(texts, "digest binary, first long, text string")
    return parts.repartition("digest").sortWithinPartitions("digest", F.col("first").asc_nulls_first()).select("digest", "text").mapInArrow(hashes, "digest binary, sha string")


def trie(turns: DataFrame, borrow: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """A row per distinct prefix: conv_id (its smallest member), depth, digest, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``n_leaves`` counts childless nodes of the subtree, ``saved_tokens`` sums (members - 1) times the bytes of the last text over it: what a cache that holds each shared prefix once
    spares. ``ends_sha256`` is the SHA-256 of the ids of the conversations that end here, ascending and joined by commas. An empty table has no root.
    The conversation without an id counts as a member, and is the smallest only where it is the only one; its conv_id is null and reads as empty among ends.
    Repeated turns are turns. See ``prefixes`` for orders and nulls.
    """
    scratch = scratch or Scratch(turns.sparkSession, "trie")
    rows = scratch.keep(prefixes(turns, borrow), "prefixes")
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("above").alias("above"), F.first("bytes").alias("bytes"))
    nodes = scratch.keep(nodes, "nodes")
    # digests differ from depth to depth, as each is made of the one before
    children = nodes.where("depth > 0").groupBy(F.col("above").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    path = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = {"leaves": F.sum((F.col("n_children") == 0).cast("long")).over(path), "saved": F.sum((F.col("n_convs") - 1) * F.col("bytes")).over(path)}
    top = F.row_number().over(Window.partitionBy("conv_id").orderBy("depth")) == 1
    nodes = scratch.keep(nodes.withColumns(below).withColumn("top", top), "paths")
    tops = nodes.where("top")
    # one row a path for each node above it
    heads = tops.where("depth > 0").select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "leaves", "saved")
    gone = rows.join(heads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("depth") < F.col("d")))
    gone = gone.groupBy("digest").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    # above its top, a path's parent has an owner of its own
    owner = nodes.select(F.col("digest").alias("a"), F.col("conv_id").alias("up"))
    parents = tops.where("depth > 0").select("digest", "above").join(owner, F.col("above") == F.col("a")).select("digest", "up", F.lit(True).alias("known"))
    ends = _joined_ids(rows.where("ends").select("digest", "conv_id"))
    out = nodes.join(gone, "digest", "left").join(parents, "digest", "left").join(ends, "digest", "left")
    none = hashlib.sha256(b"").hexdigest()
    out = out.select(
        "conv_id", "depth", "digest", F.when(F.col("known"), F.col("up")).when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("sha", F.lit(none)).alias("ends_sha256"),
    )
    return scratch.sweep(out)
