"""Row-wise rules: filters, labels and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X

#: Rule groups of logistics talk; a table of the user's own may replace them.
LEXICON = {
    "scheduling": r"\b(?:schedule|reschedule|next week|tomorrow|calendar|agenda)\b",
    "audio_check": r"\b(?:can you hear|mic|microphone|mute|unmute|screen share)\b",
    "break": r"\b(?:break|lunch|coffee|bathroom|restroom)\b",
    "acknowledgment": r"^(?:ok|okay|yes|right|sure|thanks|thank you)\b",
}
#: Figures, money and percentages guard a record as content.
CONTENT_GUARD = r"[0-9]+(?:\.[0-9]+)?%?|[$€£]|\b(?:million|billion|percent)\b"

KINDS = {
    "image": ["png", "jpg", "jpeg", "heic", "webp", "tif", "tiff"],
    "audio": ["wav", "mp3", "m4a", "aac", "flac", "ogg"],
    "video": ["mp4", "mov", "mkv", "avi", "webm"],
    "note": ["md", "txt"],
    "config": ["json", "yaml", "yml", "toml"],
}


def fired_rules(text: Column, lexicon: dict[str, str] | None = None, longest_ack: int = 40) -> Column:
    """Names of the rule groups that match the trimmed text, without regard to case; acknowledgments only in short texts."""
    trimmed = F.trim(text)
    hits = []
    for name, pattern in (LEXICON if lexicon is None else lexicon).items():
        hit = trimmed.rlike(f"(?i){pattern}")
        hits.append(F.when(hit & (F.length(trimmed) <= longest_ack) if name == "acknowledgment" else hit, F.lit(name)))
    return F.array_compact(F.array(*hits))


def relevance_candidates(records: DataFrame, text: str = "text", start: str | None = None, end: str | None = None, lexicon: dict[str, str] | None = None) -> DataFrame:
    """Adds rules, is_candidate, has_content and, with times, is_short (under 2.5 s). Blank texts fire nothing."""
    out = records.withColumn("rules", fired_rules(F.coalesce(F.col(text), F.lit("")), lexicon))
    out = out.withColumn("is_candidate", F.size("rules") > 0).withColumn("has_content", F.coalesce(F.col(text), F.lit("")).rlike(f"(?i){CONTENT_GUARD}"))
    return out.withColumn("is_short", F.col(end) - F.col(start) < 2.5) if start and end else out


def relevance_decide(candidates: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Adds label, detector and excluded from ``verdicts(key, verdict)``: two signals must agree to exclude.

    No candidate: content. A candidate without a verdict: uncertain. A logistics verdict excludes unless the content guard holds, which keeps the label.
    """
    v = verdicts.select(F.col(key).alias("__k"), "verdict")
    out = candidates.join(v, F.col(key) == F.col("__k"), "left").drop("__k")
    label = F.when(~F.col("is_candidate"), "content").when(F.col("verdict").isNull(), "uncertain").otherwise(F.col("verdict"))
    detector = F.when(~F.col("is_candidate"), "default").when(F.col("verdict").isNull(), "lexical").otherwise("lexical+verdict")
    gone = F.col("is_candidate") & (F.coalesce("verdict", F.lit("")) == "logistics") & ~F.col("has_content")
    return out.withColumn("label", label).withColumn("detector", detector).withColumn("excluded", gone)


def hide_private(events: DataFrame, name: str = "event") -> DataFrame:
    """Events whose name ends in ``_private`` are never seen."""
    return events.where(~F.endswith(F.col(name), F.lit("_private")))


def file_kind(extension: Column) -> Column:
    out = F.lit("other")
    for kind, known in reversed(KINDS.items()):
        out = F.when(F.lower(extension).isin(known), kind).otherwise(out)
    return out


def quality_bucket(confidence: Column, high: float = 0.85, medium: float = 0.65) -> Column:
    """(quality, uncertain): uncertain below ``high``; null confidence is low and uncertain."""
    c = F.coalesce(confidence, F.lit(0.0))
    return F.struct(F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low").alias("quality"), (c < high).alias("uncertain"))


def disagreement_gate(records: DataFrame, marked: DataFrame, key: str, marker: str = "disagree", least: float = 0.93) -> DataFrame:
    """Records on which engines disagreed: by marker in ``uncertainty``, by ``agreement`` under ``least``, or by being in ``marked(key)``."""
    m = marked.select(F.col(key).alias("__k")).distinct().withColumn("__m", F.lit(True))
    out = records.join(m, F.col(key) == F.col("__k"), "left")
    hit = F.coalesce(F.contains("uncertainty", F.lit(marker)), F.lit(False)) | F.coalesce(F.col("agreement") < least, F.lit(False)) | F.coalesce("__m", F.lit(False))
    return out.where(hit).drop("__k", "__m")


def escalation_reasons(key: Column, text: Column, similarity: Column, risk: str = r"[0-9]|%|\$", least: float = 0.95, audit_percent: int = 10) -> Column:
    """Why a window goes to more engines: empty, low agreement, high-risk content, or its share of a stable audit sample."""
    return F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("empty_candidate")),
            F.when(similarity < least, F.lit("low_similarity")),
            F.when(text.rlike(risk), F.lit("high_risk")),
            F.when(X.ascii_bucket(key) < audit_percent, F.lit("audit_sample")),
        )
    )


def segment_filter(segments: DataFrame, start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """Segments that last and say something."""
    return segments.where((F.col(end) > F.col(start)) & (F.trim(F.col(text)) != ""))


def continuity_risk(text: Column, unresolved: Column, certainty: Column, connectors: str = r"(?i)\b(?:and|but|or|und|et|y|because|so)\s*$") -> Column:
    """3 without final punctuation, 4 with a connector at the end, 2 for an unresolved overlap, 3 for low certainty."""
    t = F.trim(text)
    points = [(~t.rlike(r"[.!?。！？…]$"), 3), (t.rlike(connectors), 4), (unresolved, 2), (certainty == "low", 3)]
    return sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))


def difficult_images(pages: DataFrame, least: float = 0.65) -> DataFrame:
    """Pages with an error or a mean item confidence under ``least``; pages without items count as confidence 0."""
    total = F.aggregate("items", F.lit(0.0), lambda s, x: s + F.coalesce(x["confidence"], F.lit(0.0)))
    mean = F.coalesce(F.try_divide(total, F.size("items")), F.lit(0.0))
    return pages.withColumn("mean_confidence", mean).where(F.col("error").isNotNull() | (F.col("mean_confidence") < least))


def rectangle_valid(x: Column, y: Column, w: Column, h: Column, slack: float = 1e-6) -> Column:
    """Whether a relative rectangle lies in the unit square, but for rounding."""
    return (x >= -slack) & (y >= -slack) & (w > 0) & (h > 0) & (x + w <= 1 + slack) & (y + h <= 1 + slack)


def rectangle_clamp(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The rectangle moved into the unit square and then cut to it."""
    cx, cy = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))
    return F.struct(cx.alias("x"), cy.alias("y"), F.greatest(F.least(w, 1 - cx), F.lit(0.0)).alias("width"), F.greatest(F.least(h, 1 - cy), F.lit(0.0)).alias("height"))


def eligible_sources(files: DataFrame, kinds: list[str]) -> DataFrame:
    """Files of the kinds that aren't hidden; a stored flag, where there is one, decides first."""
    base = F.regexp_extract("path", "[^/]*$", 0)
    return files.where(F.coalesce("eligible", F.col("kind").isin(kinds) & ~F.startswith(base, F.lit("."))))


def first_route(*routes: str) -> Column:
    """The first route that isn't missing or empty."""
    return F.coalesce(*(F.nullif(F.col(r), F.lit("")) for r in routes))


def engine_route(a_text: Column, b_text: Column, a_loop: Column, b_loop: Column, latin: float = 0.15, loop: float = 0.5) -> Column:
    """Which of two engines speaks for a track.

    Without a second text the first; both mostly Latin: the first; one looping (score at least ``loop``) and the other not: the other; else an arbiter.
    """
    both_latin = (X.latin_ratio(a_text) >= latin) & (X.latin_ratio(b_text) >= latin)
    blank = lambda t: F.trim(F.coalesce(t, F.lit(""))) == ""
    return F.when(blank(b_text), "first").when(blank(a_text), "second").when(both_latin, "first").when((a_loop >= loop) & (b_loop < loop), "second").when((b_loop >= loop) & (a_loop < loop), "first").otherwise("arbiter")


def language_route(probes: DataFrame, source: str, second: bool = True) -> DataFrame:
    """Engines per source from probe languages: English alone or no probe: the first engine; anything else: both, if there is a second."""
    langs = F.collect_set(F.lower("language"))
    engines = F.when((F.size("languages") == 0) | ((F.size("languages") == 1) & F.array_contains("languages", "en")) | ~F.lit(second), F.array(F.lit("first"))).otherwise(F.array(F.lit("first"), F.lit("second")))
    return probes.groupBy(source).agg(langs.alias("languages")).withColumn("engines", engines)


def ensemble_quality(score: Column, support: Column, escalated: Column, similarity: Column, text: Column, missing: Column, high: float = 0.82, firm: float = 0.90, low: float = 0.72, thin: float = 0.82, alike: float = 0.95) -> Column:
    """(quality, reason) of a window's consensus; empty text is low and marked unintelligible."""
    q = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "low").when(~escalated, F.when(similarity >= alike, "high").otherwise("medium"))
    q = q.when(missing | (score < low) | (support < thin), "low").when((score >= high) & (support >= firm), "high").otherwise("medium")
    r = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "unintelligible").when(escalated & missing, "route_unavailable").when(escalated & (score < low), "low_agreement").when(escalated & (support < thin), "low_support")
    return F.struct(q.alias("quality"), r.alias("reason"))


def ensemble_gate(similarity: Column, support: Column, terms_pass: Column) -> Column:
    return (similarity >= 0.72) & (support >= 0.82) & terms_pass


def records_to_evidence(records: DataFrame) -> DataFrame:
    """Literal records renamed to audio evidence, one to one; see ``expectations.unique`` for the ids."""
    return records.select(
        F.col("record_id").alias("evidence_id"), "source_id", F.lit("audio").alias("kind"), F.struct("start_seconds", "end_seconds").alias("locator"),
        F.col("clean_literal").alias("literal_text"), F.struct(F.lit("consensus").alias("route"), F.col("certainty").alias("quality")).alias("confidence"), "uncertainty",
    )


def pages_to_evidence(pages: DataFrame, ocr: DataFrame, page: str = "page_id") -> DataFrame:
    """Image evidence per page from ``ocr(page, items, error)``: no row: unavailable and low; an error: failed and low; else the items' lines and medium."""
    o = ocr.select(F.col(page).alias("__p"), "items", "error")
    out = pages.join(o, F.col(page) == F.col("__p"), "left")
    text = F.array_join(F.filter(F.transform("items", lambda x: F.trim(x["text"])), lambda t: t != ""), "\n")
    state = F.when(F.col("__p").isNull(), "unavailable").when(F.col("error").isNotNull(), "failed").otherwise("ok")
    return out.withColumn("state", state).withColumn("literal_text", F.when(F.col("state") == "ok", text).otherwise("")).withColumn("quality", F.when(F.col("state") == "ok", "medium").otherwise("low")).drop("__p", "items", "error")


def ready_candidates(candidates: DataFrame, key: str) -> DataFrame:
    """Per key: whether all parsed and have a start, and whether the saved order is the current one."""
    now = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "candidate_id"))), lambda x: x["candidate_id"])
    out = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("parsed") & F.col("start").isNotNull()).alias("ready"), now.alias("current_order"), F.first("saved_order", ignorenulls=True).alias("saved_order"))
    return out.withColumn("confirmed", F.coalesce(F.col("saved_order") == F.col("current_order"), F.lit(False)))


def slide_track(evidence: DataFrame, receipts: DataFrame) -> DataFrame:
    """Image rows only where the source's receipt has a slide track and at least one slide; other kinds stay."""
    ok = receipts.where(F.col("slide_track") & (F.col("slides") > 0)).select(F.col("source_id").alias("__s")).distinct()
    out = evidence.join(ok, F.col("source_id") == F.col("__s"), "left")
    return out.where((F.col("kind") != "image") | F.col("__s").isNotNull()).drop("__s")
