"""Ordered operators: window functions where order is enough, grouped pandas where state resets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import ordered
from quillstone.operators.scratch import drop, keep, ranked


def assign_ids(rows: DataFrame, group: str, order: list[str], prefix: str = "E", name: str = "evidence_id") -> DataFrame:
    """Padded ordinals in the total order (group, *order), over range partitions, so neither one task nor one group's task sees all rows."""
    return ranked(rows, [group, *order], "__n").withColumn(name, F.format_string(f"{prefix}%06d", "__n")).drop("__n")


def silence_gaps(rows: DataFrame, key: str, start: str, end: str, over: float = 30.0) -> DataFrame:
    """Rows that begin more than ``over`` after the last end before them; the first row of a key is no gap."""
    last = F.max(end).over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("last_end", last).withColumn("gap", F.col(start) - F.col("last_end")).where(F.col("gap") > over)


def transcript_checks(rows: DataFrame, key: str, ordinal: str, start: str, end: str, text: str, long: int = 2000) -> DataFrame:
    """(key, ordinal, rule, severity) in file order: ends before it starts, starts before the last end, empty, too long."""
    last = F.max(end).over(Window.partitionBy(key).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1))
    rule = lambda name, level, cond: F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("severity")))
    found = F.array_compact(F.array(rule("non_positive_duration", "error", F.col(end) <= F.col(start)), rule("overlap", "warning", F.col(start) < F.col("__last") - 0.05), rule("empty_text", "error", F.trim(F.coalesce(text, F.lit(""))) == ""), rule("long_text", "warning", F.length(text) > long)))
    return rows.withColumn("__last", last).select(key, ordinal, F.explode(found).alias("v")).select(key, ordinal, "v.*")


def coverage_level(covered: Column, duration: Column) -> Column:
    """error under 85 % of the duration, warning under 95 %, else ok; an unknown duration is ok."""
    share = F.try_divide(covered, duration)
    return F.when(share < 0.85, "error").when(share < 0.95, "warning").otherwise("ok")


def context_rows(records: DataFrame, targets: DataFrame, key: str, record_id: str, k: int) -> DataFrame:
    """Rows up to ``k`` before and after each target (key, record_id), with the distance; the target's own is 0."""
    n = records.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(record_id)))
    t = targets.select(F.col(key).alias("__k"), F.col(record_id).alias("target"))
    spots = n.join(t, (F.col(key) == F.col("__k")) & (F.col(record_id) == F.col("target"))).select("__k", "target", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("distance"), (F.col("__n") + F.col("distance")).alias("__at"))
    return n.join(spots, (F.col(key) == F.col("__k")) & (F.col("__n") == F.col("__at"))).drop("__k", "__n", "__at")


def neighbor_text(records: DataFrame, key: str, order: str, text: str, chars: int = 120) -> DataFrame:
    """Adds previous (its last characters) and next (its first); null at the ends."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = F.lag(text).over(w), F.lead(text).over(w)
    return records.withColumn("previous", before).withColumn("next", F.substring(after, 1, chars)).withColumn("previous", F.when(F.length("previous") > chars, F.substring(F.col("previous"), F.length("previous") - chars + 1, F.lit(chars))).otherwise(F.col("previous")))


def overlap_size(before: Column, now: Column, least: int = 4, most: int = 80) -> Column:
    """The longest suffix of one text that begins the other, within bounds; 0 if none."""

    def size(x: Column) -> Column:
        a, b = x["a"], x["b"]
        top = F.least(F.length(a), F.length(b))
        found = F.filter(F.sequence(F.lit(least), F.greatest(top, F.lit(least))), lambda n: F.substring(a, F.length(a) - n + 1, n) == F.substring(b, F.lit(1), n))
        return F.when(top >= least, F.array_max(found))

    # only the last and first ``most`` characters can take part
    tail = F.when(F.length(before) > most, F.substring(before, F.length(before) - most + 1, F.lit(most))).otherwise(before)
    return F.coalesce(X.let(F.struct(tail.alias("a"), F.substring(now, 1, most).alias("b")), size), F.lit(0))


def cut_compact(text: Column, n: Column) -> Column:
    """A text without its first ``n`` characters that aren't white space (and without what white space stands before the rest)."""

    def cut(rest: Column) -> Column:
        ends = F.aggregate(F.split(rest, ""), F.struct(F.lit(0).alias("seen"), F.lit(0).alias("cut")), lambda s, c: F.when(s["seen"] < n, F.struct((s["seen"] + F.when(c.rlike(r"^\s$") | (c == ""), 0).otherwise(1)).alias("seen"), (s["cut"] + F.length(c)).alias("cut"))).otherwise(s))
        return F.regexp_replace(F.substring(rest, ends["cut"] + 1, F.length(rest)), r"^\s+", "")

    return X.let(F.regexp_replace(text, F.lit(r"^\s+"), F.lit("")), cut)


def overlap_dedup(records: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Cuts from each record what repeats the end of the record before it in the same track, as that stood uncut; logs matched characters."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    out = records.withColumn("__before", F.coalesce(before, F.lit("")))
    out = out.withColumn("matched", overlap_size(X.compact_space("__before"), X.compact_space(F.coalesce(text, F.lit("")))))
    return out.withColumn("cut_text", F.when(F.col("matched") > 0, cut_compact(F.col(text), F.col("matched"))).otherwise(F.col(text))).drop("__before")


def overlap_dedup_running(records: DataFrame, key: str, order: str, text: str, least: int = 4, most: int = 80) -> DataFrame:
    """As ``overlap_dedup``, but against the text before as it was already cut: state runs along the track.

    A track is one recording, whose records meet in one task; adds matched and cut_text.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        before, matched, cut = "", [], []
        for t in pdf[text].fillna(""):
            now = "".join(t.split())
            n = next((k for k in range(min(len(before), len(now), most), least - 1, -1) if before.endswith(now[:k])), 0)
            if n:
                seen = at = 0
                while seen < n:
                    seen += not t[at].isspace()
                    at += 1
                t = t[at:].lstrip()
            matched.append(n)
            cut.append(t)
            before = "".join(t.split())
        return pdf.assign(matched=matched, cut_text=cut)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    return records.groupBy(key).applyInPandas(run, f"{fields}, matched int, cut_text string")


def split_sentences(records: DataFrame, text: str, ends: str = "。！？!?；;") -> DataFrame:
    """A row for each sentence with its index; the closing mark stays with it and blank pieces go."""
    parts = F.filter(F.transform(F.split(F.col(text), f"(?<=[{ends}])"), X.strip), lambda s: s != "")
    return records.select("*", F.posexplode(parts).alias("sentence_index", "sentence"))


def slide_windows(tracks: DataFrame, key: str, duration: str, size: float = 20.0, overlap: float = 5.0) -> DataFrame:
    """Fixed windows that overlap; the last is clipped, and no window begins once one has reached the end."""
    stride = size - overlap
    last = F.when(F.col(duration) <= size, F.lit(0)).otherwise(F.ceil((F.col(duration) - size) / stride)).cast("int")
    rows = tracks.where(F.col(duration) > 0).select(key, F.col(duration).alias("__d"), F.explode(F.sequence(F.lit(0), last)).alias("window_index"))
    start = F.col("window_index") * F.lit(stride)
    return rows.select(key, "window_index", start.alias("start_seconds"), F.least(start + size, "__d").alias("end_seconds"))


_TERMINAL, _CONNECT = ".!?。！？…", ("and", "but", "or", "und", "et", "y", "because", "so")


def paragraphs(records: DataFrame, key: str, order: str, text: str, soft: int = 180, hard: int = 360) -> DataFrame:
    """(key, paragraph, first, last, text): sentences gathered until ``soft`` compact characters and a proper end, or ``hard``.

    State resets at each paragraph and runs on over range partitions (``ordered.gathered``), so a source of any length is spread over many tasks. Blank records are left out.
    """
    said = F.col("__s")
    ends = F.regexp_replace(said, f"[{re.escape(_TERMINAL)}]+$", "")
    word = F.lower(F.element_at(F.split(ends, " "), -1))
    proper = F.substring(said, -1, 1).isin(list(_TERMINAL)) & ~word.isin(list(_CONNECT))
    rows = records.select(key, order, X.strip(F.coalesce(text, F.lit(""))).alias("__s"))
    return ordered.gathered(rows, key, order, "__s", F.nullif(F.length(F.regexp_replace(said, r"[\s\p{Z}\x85\x1c-\x1f]+", "")), F.lit(0)), F.when(proper, soft).otherwise(hard), hard)


def spaced_topk(rows: DataFrame, key: str, at: str, risk: str, k: int = 4, apart: float = 180.0) -> DataFrame:
    """Per key a greedy pick of the riskiest rows (ties: the earlier), each at least ``apart`` from those picked.

    Each pick is a window over the one order by risk, so rows are sorted once and a key's rows may spill. Rows without a time are far from none.
    """
    worth = F.nanvl(risk, F.lit(None).cast("double")) if rows.schema[risk].dataType.simpleString() in ("float", "double") else F.col(risk)
    w = Window.partitionBy(key).orderBy(worth.desc_nulls_last(), F.col(at).asc_nulls_last())
    so_far, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.withColumn("__free", F.lit(True)).withColumn("__kept", F.lit(False))
    for _ in range(k):
        out = out.withColumn("__nth", F.count(F.when(F.col("__free"), 1)).over(so_far)).withColumn("__pick", F.first(F.when(F.col("__free"), F.struct(F.col(at).cast("double").alias("t"))), ignorenulls=True).over(whole))
        now = F.col("__free") & (F.col("__nth") == 1)
        far = F.coalesce(F.nanvl(F.abs(F.col(at).cast("double") - F.col("__pick.t")), F.lit(None).cast("double")) >= apart, F.lit(False))
        out = out.withColumn("__kept", F.col("__kept") | now).withColumn("__free", F.col("__free") & ~now & far).drop("__nth", "__pick")
    return out.where("__kept").drop("__free", "__kept")


def dedupe_pages(segments: DataFrame, video: str, start: str, phash: str, near: int = 5, most: int = 500, rounds: int = 1000) -> DataFrame:
    """(video, page_id, image time, time_ranges): in time order, the first page within ``near`` bits takes a segment in, else a new page begins; a video of more than ``most`` pages is no slides and has none.

    Equal hashes of a video are one. Hashes within ``near`` bits agree in one of ``near`` + 1 bands, so they meet there. Who begins a page is settled in rounds: a hash with no
    earlier one near that is open or begins a page begins one; who has a page's first hash before it joins. So a video of any length is spread over many tasks. Segments with a null start or hash are
    left out; equal starts count by hash.
    """
    bands = min(near + 1, 64)
    bits = [(64 * i // bands, 64 * (i + 1) // bands) for i in range(bands)]
    cut = lambda a, b: F.shiftrightunsigned("h", a).bitwiseAND((1 << b - a) - 1 if b - a < 63 else -1)
    rows = segments.select(F.col(video).alias("v"), F.col(start).cast("double").alias("s"), F.col("end").cast("double").alias("e"), F.col(phash).cast("long").alias("h")).where("s IS NOT NULL AND h IS NOT NULL")
    one = keep(rows.groupBy("v", "h").agg(F.min("s").alias("s")))
    spread = one.select("v", "h", "s", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), cut(a, b).alias("x")) for i, (a, b) in enumerate(bits)))).alias("b")).select("v", "h", "s", "b.*")
    other = spread.select(F.col("v").alias("v2"), F.col("h").alias("h2"), F.col("s").alias("s2"), F.col("band").alias("band2"), F.col("x").alias("x2"))
    earlier = (F.col("s2") < F.col("s")) | (F.col("s2") == F.col("s")) & (F.col("h2") < F.col("h"))
    met = (F.col("v").eqNullSafe(F.col("v2"))) & (F.col("band") == F.col("band2")) & (F.col("x") == F.col("x2")) & earlier
    links = keep(spread.join(other, met).where(F.bit_count(F.col("h").bitwiseXOR(F.col("h2"))) <= near).select("v", "h", "s", "h2", "s2").distinct())
    now = keep(one.withColumn("begins", F.lit(None).cast("boolean")))
    for _ in range(rounds):
        if now.where("begins IS NULL").isEmpty():
            break
        known = now.select(F.col("v").alias("v3"), F.col("h").alias("h3"), F.col("begins").alias("b3"))
        seen = links.join(known, F.col("v").eqNullSafe(F.col("v3")) & (F.col("h2") == F.col("h3"))).groupBy(F.col("v").alias("v4"), F.col("h").alias("h4")).agg(F.bool_or(F.coalesce("b3", F.lit(False))).alias("joins"), F.bool_or(F.col("b3").isNull()).alias("waits"))
        told = F.when(F.col("begins").isNotNull(), F.col("begins")).when(F.col("joins"), False).when(F.col("waits"), F.lit(None)).otherwise(True)
        new = keep(now.join(seen, F.col("v").eqNullSafe(F.col("v4")) & (F.col("h") == F.col("h4")), "left").select("v", "h", "s", told.alias("begins")))
        drop(now)
        now = new
    else:
        raise RuntimeError(f"pages did not settle in {rounds} rounds")
    first = now.where("begins").select("v", "h", "s")
    few = first.groupBy(F.col("v").alias("v5")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    pages = first.join(few, F.col("v").eqNullSafe(F.col("v5")), "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("s", "h")))
    p = pages.select(F.col("v").alias("pv"), F.col("h").alias("ph"), F.col("s").alias("ps"), "n")
    own = pages.select("v", "h", "n", "s")
    joined = links.join(p, F.col("v").eqNullSafe(F.col("pv")) & (F.col("h2") == F.col("ph"))).join(now.where("NOT begins").select(F.col("v").alias("v6"), F.col("h").alias("h6")), F.col("v").eqNullSafe(F.col("v6")) & (F.col("h") == F.col("h6")), "left_semi")
    joined = joined.groupBy("v", "h").agg(F.min_by("n", "n").alias("n"), F.min_by("ps", "n").alias("s"))
    at = own.unionByName(joined).select(F.col("v").alias("av"), F.col("h").alias("ah"), "n", F.col("s").alias("image_time"))
    out = rows.join(at, F.col("v").eqNullSafe(F.col("av")) & (F.col("h") == F.col("ah"))).groupBy("v", "n", "image_time").agg(F.sort_array(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("time_ranges"))
    return out.select(F.col("v").alias(video), F.format_string("P%d", "n").alias("page_id"), "image_time", "time_ranges")


def settled(samples: DataFrame, key: str, order: list[str], reading: Column, name: str) -> DataFrame:
    """Adds ``name``: the last reading that two samples in a row agreed on; the first sample sets it."""
    w = Window.partitionBy(key).orderBy(*order)
    out = samples.withColumn("__s", reading).withColumn("__p", F.lag("__s").over(w))
    out = out.withColumn("__set", F.when(F.col("__p").isNull() | (F.col("__p") == F.col("__s")), F.col("__s")))
    return out.withColumn(name, F.last("__set", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s", "__p", "__set")


def zone_hysteresis(samples: DataFrame, key: str, order: list[str], value: str, limit: float) -> DataFrame:
    """Adds zone (high or low): it switches only after two readings in a row on the other side; the first reading sets it."""
    return settled(samples, key, order, F.when(F.col(value) >= limit, "high").otherwise("low"), "zone")


def rate_of_change(samples: DataFrame, key: str, ts: str, value: str, per: float = 10.0) -> DataFrame:
    """Adds rate: change per ``per`` seconds since the sample before; null at the first and where time stands still."""
    w = Window.partitionBy(key).orderBy(ts)
    dt = F.col(ts) - F.lag(ts).over(w)
    return samples.withColumn("rate", F.when(dt > 0, (F.col(value) - F.lag(value).over(w)) / dt * per))


def stage_elapsed(log: DataFrame, key: str, order: list[str], stage: str, ts: str) -> DataFrame:
    """Adds run (which island of equal stages) and stage_started (its first time)."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.lag(stage).over(w).eqNullSafe(F.col(stage)), 0).otherwise(1)
    out = log.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("stage_started", F.min(ts).over(Window.partitionBy(key, "run"))).drop("__new")


def stale_stages(log: DataFrame, key: str, ts: str, now: Column, timeout: float) -> DataFrame:
    """Per key the newest time, its age and whether it is older than ``timeout`` seconds."""
    out = log.groupBy(key).agg(F.max(ts).alias("newest"))
    return out.withColumn("age", now - F.col("newest")).withColumn("stale", F.col("age") > timeout)


def natural_order(name: str) -> list[Column]:
    """P2 before P10: by the letters, then by the number."""
    return [F.regexp_extract(name, r"^[^\d]*", 0), F.regexp_extract(name, r"(\d+)", 1).try_cast("long")]


def content_order(keywords: str, head: str, tail: str) -> Column:
    """A digest of what a fragment says; sorting by it doesn't depend on names or input order."""
    return F.sha1(F.concat_ws("\n", F.array_sort(keywords), F.substring(head, 1, 120), F.substring(F.col(tail), F.greatest(F.length(tail) - 119, F.lit(1)), F.lit(120))))


def guarded_order(rows: DataFrame, orders: DataFrame, key: str, value: str) -> DataFrame:
    """Adds position from the user's order (key, value, ordinal), but only where that is an exact permutation of the key's values; else by value."""
    mine = rows.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(value)).alias("__have"))
    asked = orders.groupBy(F.col(key).alias("__o")).agg(F.array_sort(F.collect_list(value)).alias("__asked"))
    ok = mine.join(asked, F.col("__k") == F.col("__o")).where("__have = __asked").select("__k")
    o = orders.select(F.col(key).alias("__k"), F.col(value).alias("__v"), "ordinal").join(ok, "__k", "left_semi")
    out = rows.join(o, (F.col(key) == F.col("__k")) & (F.col(value) == F.col("__v")), "left")
    return out.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.col("ordinal").asc_nulls_last(), value))).drop("__k", "__v", "ordinal")
