"""Resource zones of a machine's samples, and what a gate before heavy work would have done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.joins import asof
from quillstone.operators.windows import settled

#: Floors of free memory (MB) and their shares of the total, load per core, swap growth (MB in 10 s) and the free memory under which it counts.
RED_FREE, RED_SHARE, YELLOW_FREE, YELLOW_SHARE, RED_LOAD, YELLOW_LOAD, SWAP_GROWTH, SWAP_GUARD = 512.0, 0.08, 1024.0, 0.15, 4.0, 2.5, 256.0, 1024.0
#: Fixed values of the gate: first pause, longest pause, longest wait, in seconds.
FIRST_PAUSE, LONGEST_PAUSE, LONGEST_WAIT = 2.0, 8.0, 300.0


def raw_zone(swap_rate: Column) -> Column:
    """red, yellow or green from free_mb, total_mb, load1 and cores, and the growth of swap in 10 s (null at the first sample)."""
    red_free = F.greatest(F.lit(RED_FREE), F.col("total_mb") * RED_SHARE)
    yellow_free = F.greatest(F.lit(YELLOW_FREE), F.col("total_mb") * YELLOW_SHARE, red_free)
    thrashing = F.coalesce(swap_rate > SWAP_GROWTH, F.lit(False)) & (F.col("free_mb") < SWAP_GUARD)
    red = (F.col("free_mb") < red_free) | (F.col("load1") > F.col("cores") * RED_LOAD) | thrashing
    return F.when(red, "red").when((F.col("free_mb") < yellow_free) | (F.col("load1") > F.col("cores") * YELLOW_LOAD), "yellow").otherwise("green")


def zones(samples: DataFrame, key: str, ts: str) -> DataFrame:
    """Samples with raw and zone: the zone follows a raw reading once two in a row agree; the first sets it.

    ``samples(key, ts, free_mb, total_mb, load1, cores, swap_used_mb)``; times of a key differ.
    """
    w = Window.partitionBy(key).orderBy(ts)
    dt = F.col(ts) - F.lag(ts).over(w)
    rate = F.when(dt > 0, (F.col("swap_used_mb") - F.lag("swap_used_mb").over(w)) / dt * 10)
    rows = samples.withColumn("__rate", rate).withColumn("raw", raw_zone(F.col("__rate"))).drop("__rate")
    return settled(rows, key, [ts], F.col("raw"), "zone")


def gate(requests: DataFrame, zoned: DataFrame, request: str, key: str, at: str, ts: str) -> DataFrame:
    """(request, waited, zone, action) of each request: it asks at once, then after pauses that double up to a limit, and goes on where the zone isn't red or the longest wait is over.

    action: pass, resume (after red) or timeout_pass; without any sample yet bypass. The polls of a request are a fixed list of some forty, met with the samples as of then.
    """
    pauses, t, step = [0.0], 0.0, FIRST_PAUSE
    while t < LONGEST_WAIT:
        t += step
        step = min(step * 2, LONGEST_PAUSE)
        pauses.append(t)
    polls = requests.select(request, key, F.col(at).alias("__from"), F.explode(F.array(*map(F.lit, pauses))).alias("waited")).withColumn("__at", F.col("__from") + F.col("waited"))
    seen = asof(polls, zoned.select(key, F.col(ts).alias("__ts"), F.col("zone")), key, "__at", "__ts", "zone", [request, "waited"])
    done = (F.coalesce("zone", F.lit("")) != "red") | (F.col("waited") >= LONGEST_WAIT)
    first = seen.where(done).groupBy(request).agg(F.min(F.struct("waited", "zone")).alias("d"))
    action = F.when(F.col("d.zone").isNull(), "bypass").when(F.col("d.zone") == "red", "timeout_pass").when(F.col("d.waited") > 0, "resume").otherwise("pass")
    return first.select(request, F.col("d.waited").alias("waited"), F.col("d.zone").alias("zone"), action.alias("action"))
