"""Difference of two snapshots of a table, with rows found again under new keys.

Rows of both snapshots become codes, SHA-256 of each column's bytes, and no text moves. Rows with equal keys pair first; among the rest, rows with equal
content pair in the order of their keys. Both steps are the same work: range partitions of (group, order), a numpy kernel for each partition that ranks each
side's rows within the runs of a group and finds partners by a search, and one join for what a partition can't settle alone. Only the first and the last run of a
partition can go on in another; their rows wait with their rank, counts of the parts before shift the ranks, and rows of one group with one rank meet. So a
group that holds a third of all rows is spread over as many tasks as its rows need, nothing is broadcast, and the driver gets Spark's own sample of range keys and
a count of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, give_back


def _code(col: Column) -> Column:
    """32 bytes that equal values alone share; null has 32 zeros."""
    return F.coalesce(F.unhex(F.sha2(col.cast("string").cast("binary"), 256)), F.lit(b"\0" * 32))


def _words(codes: pa.Array, width: int) -> np.ndarray:
    """Codes of ``width`` times 32 bytes as rows of big-endian 64-bit integers."""
    codes = codes.cast(pa.binary(32 * width))
    n = len(codes)
    raw = np.frombuffer(codes.buffers()[1], dtype=">u8", count=(codes.offset + n) * 4 * width)[codes.offset * 4 * width :]
    return raw.reshape(n, 4 * width).astype(np.uint64)


def _places(values: pa.Array) -> np.ndarray:
    """Dense ranks of values, null as the least."""
    return pc.rank(values, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _kernel(by_key: bool, width: int, names: list[str]):
    """Pairs the two sides of one range partition; columns of the output are ``names`` as old_ and new_, then state, group rank and part.

    ``state``: 0 a pair, 1 a row without partner, 2 a row of a run that may go on in another partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            if held := [b for b in batches if b.num_rows]:
                yield settle(pa.Table.from_batches(held).combine_chunks())
        finally:
            give_back()

    def settle(rows: pa.Table) -> pa.RecordBatch:
        part, column = TaskContext.get().partitionId(), lambda c: rows.column(c).combine_chunks()
        keys, rid = _places(column("key")), column("rid").to_numpy(zero_copy_only=False)
        later = column("later").to_numpy(zero_copy_only=False).astype(bool)
        content = _words(column("content"), width)
        codes = [content[:, i] for i in range(content.shape[1])][::-1]
        # rows in the order of their groups, within them by the other code, then as written
        order = np.lexsort([rid, *codes, keys]) if by_key else np.lexsort([rid, keys, *codes])
        group = np.cumsum(np.r_[0, (np.diff(keys[order]) != 0) if by_key else (content[order][1:] != content[order][:-1]).any(axis=1)])
        last = int(group[-1])
        sides = []
        for side in (False, True):
            at = order[later[order] == side]
            g = group[later[order] == side]
            first = np.searchsorted(g, g, side="left")
            sides.append((at, g, np.arange(len(g)) - first))
        (old, old_g, old_rank), (new, new_g, new_rank) = sides
        # a row's partner: its rank behind the first row of its group on the other side
        spot = np.searchsorted(new_g, old_g, side="left") + old_rank
        safe = np.minimum(spot, max(len(new_g) - 1, 0))
        inner = (old_g > 0) & (old_g < last)
        paired = inner & (spot < len(new_g)) & (new_g[safe] == old_g if len(new_g) else False)
        taken = np.zeros(len(new), dtype=bool)
        taken[spot[paired]] = True
        new_open = ~((new_g > 0) & (new_g < last))
        a = np.r_[old[paired], old[~paired], np.full((~taken).sum(), -1)]
        b = np.r_[new[spot[paired]], np.full((~paired).sum(), -1), new[~taken]]
        state = np.r_[np.zeros(paired.sum()), np.where(inner[~paired], 1, 2), np.where(new_open[~taken], 2, 1)].astype(np.int32)
        rank = np.r_[old_rank[paired], old_rank[~paired], new_rank[~taken]].astype(np.int64)
        out, labels = [], []
        for side, at in (("old", a), ("new", b)):
            take = pa.array(at, pa.int64(), mask=at < 0)
            for c in names:
                out.append(column(c).take(take))
                labels.append(f"{side}_{c}")
        return pa.RecordBatch.from_arrays([*out, pa.array(state), pa.array(rank), pa.array(np.full(len(a), part, dtype=np.int32))], names=[*labels, "state", "rank", "part"])

    return run


def _pair(rows: DataFrame, by_key: bool, width: int, names: list[str], scratch: Scratch, rows_per_part: int, step: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, rows without partner) with ``names`` as old_ and new_ columns, absent sides null."""
    least = 1 if rows_per_part < 1 else -(-rows.count() // rows_per_part)
    parts = max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    head = F.substring("content", 1, 8)
    order = ["key", head, "rid"] if by_key else [head, "key", "rid"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = ", ".join(f"`{side}_{c}` {kinds[c]}" for side in ("old", "new") for c in names)
    done = rows.repartitionByRange(parts, *order).mapInArrow(_kernel(by_key, width, names), f"{made}, state int, rank long, part int")
    done = scratch.keep(done, step)
    both = lambda c: F.coalesce(f"old_{c}", f"new_{c}")
    wait = done.where("state = 2").withColumns({"g": both("key") if by_key else both("content"), "side": F.col("new_rid").isNotNull()})
    # a group's parts in order; one row for each side and part that the group reaches into
    sizes = wait.groupBy("g", "side", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "side").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = scratch.keep(sizes.select(F.col("g").alias("g2"), F.col("side").alias("side2"), F.col("part").alias("part2"), before.alias("before")).where("before > 0"), f"{step}-parts")
    met = F.col("g").eqNullSafe(F.col("g2")) & (F.col("side") == F.col("side2")) & (F.col("part") == F.col("part2"))
    wait = wait.join(sizes.hint("merge"), met, "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("g2", "side2", "part2", "before")
    old = wait.where("NOT side").select("g", "rank", *(f"old_{c}" for c in names))
    new = wait.where("side").select(F.col("g").alias("h"), F.col("rank").alias("rank2"), *(f"new_{c}" for c in names))
    joined = old.hint("merge").join(new, F.col("g").eqNullSafe(F.col("h")) & (F.col("rank") == F.col("rank2")), "full").drop("g", "h", "rank", "rank2")
    joined = scratch.keep(joined, f"{step}-met")
    is_pair = "old_rid IS NOT NULL AND new_rid IS NOT NULL"
    plain = done.drop("rank", "part")
    pairs = plain.where("state = 0").drop("state").unionByName(joined.where(is_pair))
    return pairs, plain.where("state = 1").drop("state").unionByName(joined.where(f"NOT ({is_pair})"))


def difference(before: DataFrame, after: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ("text", "lang", "source"), content: tuple[str, ...] = ("text",), also: dict[str, Column] | None = None, rows_per_part: int = 500_000, scratch: Scratch | None = None) -> DataFrame:
    """A row per pair or unpaired row: key (later, else earlier), old_key (earlier, else null), op, changed (a pair's differing ``columns``, in order), and ``also``.

    ``op``: of rows with equal keys ``same``, or ``update`` where a column differs; ``rekey`` for rows with equal ``content`` under other keys, the i-th smallest earlier key
    with the i-th smallest later one; ``insert`` and ``delete`` for rows that are left. Nulls, keys too, equal only nulls; a null key is the least. Rows of one key on
    one side pair in the order of their contents, and those too many count as unpaired. Columns are compared by the SHA-256 of their text; other
    columns are not read. ``also`` names small columns computed on each row of ``after``, null for a delete. Two empty tables give no row.
    """
    scratch = scratch or Scratch(before.sparkSession, "difference")
    if not content or not set(content) <= set(columns):
        raise ValueError("content must be some of the columns")
    also = also or {}
    kind = after.schema[key].dataType
    kinds = {f.name: f.dataType.simpleString() for f in after.select(*(c.alias(n) for n, c in also.items())).schema.fields}

    def coded(rows: DataFrame, later: bool) -> DataFrame:
        more = [(c if later else F.lit(None).cast(kinds[n])).alias(f"also_{n}") for n, c in also.items()]
        inner = reduce(F.concat, [_code(F.col(c)) for c in content])
        rest = [_code(F.col(c)).alias(f"code_{c}") for c in columns if c not in content]
        return rows.select(F.col(key).cast(kind).alias("key"), F.lit(later).alias("later"), inner.alias("content"), *rest, *more)

    rows = coded(before, False).unionByName(coded(after, True)).withColumn("rid", F.monotonically_increasing_id())
    rows = scratch.keep(rows, "coded")
    names = [c for c in rows.columns if c != "later"]
    pairs, rest = _pair(rows, True, len(content), names, scratch, rows_per_part, "keys")
    sides = [rest.where(F.col(f"{s}_rid").isNotNull()).select(*(F.col(f"{s}_{c}").alias(c) for c in names), F.lit(s == "new").alias("later")) for s in ("old", "new")]
    moved, alone = _pair(scratch.keep(sides[0].unionByName(sides[1]), "left"), False, len(content), names, scratch, rows_per_part, "contents")
    spots = {c: (F.substring("old_content", 32 * i + 1, 32), F.substring("new_content", 32 * i + 1, 32)) for i, c in enumerate(content)}
    spots |= {c: (F.col(f"old_code_{c}"), F.col(f"new_code_{c}")) for c in columns if c not in content}
    changed = F.concat_ws(",", *(F.when(spots[c][0] != spots[c][1], c) for c in columns))
    said = [F.col(f"new_also_{n}").alias(n) for n in also]

    def told(rows: DataFrame, op: Column, changed: Column) -> DataFrame:
        return rows.select(F.when(F.col("new_rid").isNotNull(), F.col("new_key")).otherwise(F.col("old_key")).alias("key"), F.col("old_key").alias("old_key"), op.alias("op"), changed.alias("changed"), *said)

    out = told(pairs, F.when(changed == "", "same").otherwise("update"), changed)
    out = out.unionByName(told(moved, F.lit("rekey"), changed)).unionByName(told(alone, F.when(F.col("new_rid").isNotNull(), "insert").otherwise("delete"), F.lit("")))
    return scratch.sweep(out)
