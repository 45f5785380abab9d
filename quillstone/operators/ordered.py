"""Work along an order whose state runs on, spread over range partitions.

Rows are range-partitioned by key and order and kept, so a key that holds a third of all rows is cut into as many parts as its rows need. Each part is summed up
apart: what it does to the state, as a function of the state at its start. The sums of a key's parts, a row a part, are composed in order, and each
part then runs once with its true start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.operators.scratch import keep


def placed(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` range-partitioned by key and order, written once, with the number of their part as ``__part``."""
    return keep(rows.repartitionByRange(F.col(key), *order).withColumn("__part", F.spark_partition_id()))


def last_before(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the last ``value`` of their key at or before them in ``order`` that isn't null.

    The state is one value, so a part's sum is its last one; a window over a key has a row a part.
    """
    part = placed(rows, key, [F.col(c) for c in order])
    here = F.last(value, ignorenulls=True).over(Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = part.groupBy(F.col(key).alias("__k"), F.col("__part").alias("__p")).agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("__v")))).alias("__s"))
    carried = F.last("__s.__v", ignorenulls=True).over(Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select("__k", "__p", carried.alias("__carry")).where("__carry IS NOT NULL")
    out = part.withColumn(name, here).join(carry, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")), "left")
    return out.withColumn(name, F.coalesce(name, "__carry")).drop("__k", "__p", "__carry", "__part")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple], bool]]:
    """(key, rows, whether the last) of each run of equal keys in a task whose rows come sorted."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in [*keys, *columns])):
            key = row[: len(keys)]
            if held and key != now:
                yield now, held, False
                held = []
            now = key
            held.append(row[len(keys) :])
    if held:
        yield now, held, True


def _paragraphs(run: list[tuple], size: int, number: int, hard: int, goes_on: bool) -> tuple[list[tuple], int, int]:
    """(number, first, last, text, whole) of each paragraph of a run that is entered at ``size`` within paragraph ``number``; then the exit size and number."""
    out, part, cut = [], [], size > 0
    for o, t, n, c in run:
        part.append((o, t))
        size += n
        if size >= c or size >= hard:
            out.append((number, part[0][0], part[-1][0], " ".join(x for _, x in part), not cut))
            part, size, number, cut = [], 0, number + 1, False
    if part:
        out.append((number, part[0][0], part[-1][0], " ".join(x for _, x in part), not cut and not goes_on))
    return out, size, number


def gathered(records: DataFrame, key: str, order: str, text: str, size: Column, closes: Column, hard: int) -> DataFrame:
    """(key, paragraph, first, last, text): records in order gathered into paragraphs; a record ends one that has the size ``closes`` by then, or ``hard``.

    ``size`` is what a record adds, at least 1; rows where it is null are left out. The state is the open paragraph's size, which is under ``hard``: the first run of a part is
    summed up by where each of those sizes leads and how many paragraphs end on the way; the other runs begin their keys, so they are done at once. Only first
    runs are read again, with their true entry. A paragraph that reaches over parts is put together from its pieces, of which it has no more than records.
    """
    kinds = {f.name: f.dataType for f in records.schema}
    k_type, o_type = kinds[key], kinds[order]
    k_arrow, o_arrow = to_arrow_type(k_type), to_arrow_type(o_type)
    columns = f"kind string, part int, k {k_type.simpleString()}, o {o_type.simpleString()}, t string, n int, c int, paragraph int, last {o_type.simpleString()}, whole boolean, only boolean, exits array<int>, ends array<int>"
    types = {"kind": pa.string(), "part": pa.int32(), "k": k_arrow, "o": o_arrow, "t": pa.string(), "n": pa.int32(), "c": pa.int32(), "paragraph": pa.int32(), "last": o_arrow, "whole": pa.bool_(), "only": pa.bool_(), "exits": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}

    def batch(length: int, **have) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(have[c], t) if c in have else pa.nulls(length, t) for c, t in types.items()], names=list(types))

    def pieces(k, found: list[tuple]) -> pa.RecordBatch:
        m = len(found)
        return batch(m, kind=["piece"] * m, k=[k] * m, paragraph=[f[0] for f in found], o=[f[1] for f in found], last=[f[2] for f in found], t=[f[3] for f in found], whole=[f[4] for f in found])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), True
        for (k,), run, last in _runs(batches, ["k"], ["o", "t", "n", "c"]):
            if first:
                state, ends = np.arange(hard), np.zeros(hard, dtype=np.int64)
                for _, _, n, c in run:
                    state = state + n
                    closed = (state >= c) | (state >= hard)
                    ends += closed
                    state[closed] = 0
                m = len(run)
                yield batch(m, kind=["row"] * m, part=[part] * m, k=[k] * m, o=[r[0] for r in run], t=[r[1] for r in run], n=[r[2] for r in run], c=[r[3] for r in run])
                yield batch(1, kind=["sum"], part=[part], k=[k], whole=[True], only=[last], exits=[state.tolist()], ends=[ends.tolist()])
                first = False
                continue
            found, size, number = _paragraphs(run, 0, 0, hard, last)
            yield pieces(k, found)
            if last:
                yield batch(1, kind=["sum"], part=[part], k=[k], whole=[False], only=[False], exits=[[size]], ends=[[number]])

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        size = number = 0
        out = []
        for r in pdf.sort_values("part").itertuples(index=False):
            out.append((r.part, size, number, r.only) if r.whole else None)
            at = size if r.whole else 0
            size, number = int(r.exits[at]), number + int(r.ends[at])
        return pd.DataFrame([x for x in out if x], columns=["p", "size", "number", "single"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, k, size, number, single), run, _ in _runs(batches, ["part", "k", "size", "number", "single"], ["o", "t", "n", "c"]):
            yield pieces(k, _paragraphs(run, size, number, hard, single)[0])

    rows = records.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("t"), size.cast("int").alias("n"), closes.cast("int").alias("c")).where("n IS NOT NULL")
    made = keep(rows.repartitionByRange("k", "o").sortWithinPartitions("k", "o").mapInArrow(begun, columns))
    sums = made.where("kind = 'sum'").select("k", "part", "whole", "only", "exits", "ends")
    # one row a part
    entries = keep(sums.groupBy("k").applyInPandas(composed, "p int, size int, number int, single boolean"))
    if entries.limit(100_001).count() <= 100_000:
        entries = F.broadcast(entries)
    again = made.where("kind = 'row'").select("part", "k", "o", "t", "n", "c").join(entries, F.col("part") == F.col("p"))
    again = again.repartition("part").sortWithinPartitions("part", "k", "o").mapInArrow(entered, columns)
    found = made.where("kind = 'piece'").unionByName(again)
    out = [F.col("k").alias(key), "paragraph", F.col("o").alias("first"), "last", F.col("t").alias("text")]
    cut = found.where("NOT whole").groupBy("k", "paragraph").agg(F.sort_array(F.collect_list(F.struct("o", "last", "t"))).alias("x"))
    cut = cut.select("k", "paragraph", F.col("x")[0]["o"].alias("o"), F.element_at("x", -1)["last"].alias("last"), F.array_join("x.t", " ").alias("t"))
    return found.where("whole").select(*out).unionByName(cut.select(*out))
