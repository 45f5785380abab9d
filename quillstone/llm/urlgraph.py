"""URL verdicts from rules and from trust that spreads over host links, by DataFrame functions only.

Hosts whose urls a rule allows are trusted seeds, hosts with blocked ones distrusted seeds. Personalised PageRank carries trust
along links; over the reversed links the same walk carries distrust to those who link to distrusted hosts. A host is blocked
where its distrust exceeds ``ratio`` times its trust. Both are shares of the mass of all seeds, of which each seeded page has the same, so a rare kind of seed
is not loud, and only the ratio decides, at any corpus size. Links count once a pair of hosts with their number as weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, ascii_lower

Rule = tuple[str, str, str]  # host, path, verdict


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): see ``judge``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(tail, r"^[^?#]*", 0)


def apply_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, the first of equals; nulls where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between two hosts in ``pages(host, html)``, by ``//host``, ``http://`` and ``https://`` in href or src; a host's links to itself are none."""
    link = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1)))
    rows = pages.where("host <> ''").select(F.col("host").alias("src"), link.alias("to"))
    rows = rows.groupBy("src", "to").agg(F.count(F.lit(1)).alias("n"))
    full = F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    dst = F.when(full.rlike(r"^(?i)https?://"), split_url(full)[0]).otherwise(F.lit(""))
    return rows.select("src", dst.alias("dst"), "n").where("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds(host, weight)`` over ``links(src, dst, n)``.

    With a column ``walk`` in both, each of its values is a walk of its own and the result has it too. What reaches hosts without links of their
    own returns to the seeds. Rounds are written to the shared folder. Without ``rounds`` they go on until no host's rank changes by more than
    ``tolerance`` of itself, so that a host that is reached late or holds little counts like any other.
    """
    if "walk" not in links.columns:
        one = propagate(links.withColumn("walk", F.lit(0)), seeds.withColumn("walk", F.lit(0)), scratch, damping, rounds, tolerance)
        return one.select("host", "rank")
    # one row a walk
    total = seeds.groupBy(F.col("walk").alias("k")).agg(F.sum("weight").alias("total"))
    seed = scratch.keep(seeds.join(F.broadcast(total), F.col("walk") == F.col("k")).select("walk", "host", (F.col("weight") / F.col("total")).alias("p")), "seeds")
    out = links.groupBy(F.col("walk").alias("k"), F.col("src").alias("s")).agg(F.sum("n").alias("d"))
    steps = scratch.keep(links.join(out, (F.col("walk") == F.col("k")) & (F.col("src") == F.col("s"))).select("walk", "src", "dst", (F.col("n") / F.col("d")).alias("w")), "steps")
    rank = seed.select("walk", "host", F.col("p").alias("rank"))
    done, none = 0, F.lit(0.0)
    while rounds is None or done < rounds:
        at = rank.select(F.col("walk").alias("k"), F.col("host").alias("h"), "rank")
        moved = steps.join(at, (F.col("walk") == F.col("k")) & (F.col("src") == F.col("h"))).groupBy("walk", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("w")).alias("m"))
        lost = moved.groupBy(F.col("walk").alias("k")).agg(F.sum("m").alias("moved"))
        back = seed.join(F.broadcast(lost), F.col("walk") == F.col("k"), "left").select("walk", "host", (F.col("p") * (1 - damping * F.coalesce("moved", none))).alias("m"), none.alias("was"))
        new = moved.select("walk", "host", (F.col("m") * damping).alias("m"), none.alias("was")).unionByName(back).unionByName(rank.select("walk", "host", none.alias("m"), F.col("rank").alias("was")))
        last, kept = rank, scratch.keep(new.groupBy("walk", "host").agg(F.sum("m").alias("rank"), F.sum("was").alias("was")), f"rank{done}")
        rank, done = kept.select("walk", "host", "rank"), done + 1
        settled = rounds is None and kept.where(F.abs(F.col("rank") - F.col("was")) > tolerance * F.col("rank")).isEmpty()
        if done > 1:
            scratch.drop(last)
        if settled:
            break
    return rank


def judge(pages: DataFrame, rules: list[Rule], ratio: float = 1.0, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """page_id, host, path, rule, trust, distrust, verdict for each row of ``pages(page_id, url, html, ...)``.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end; a null
    url or one without ``://`` has both empty. Repeated rows stay and count as pages; an empty table gives no row; html of any length is read for links once, inside its task. A rule fits its host and all subdomains where the path starts with the rule's; the longest
    decides, the first of equals. Else the host's scores do, which are 0 where no link reaches; only their ratio counts. Pages without a host are allowed unless a rule says otherwise; null html has no links.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    cut = cut.withColumn("rule", rule).withColumn("ruled", verdict)
    seeds = scratch.keep(cut.where("host <> '' AND ruled IS NOT NULL").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("good"), F.count_if(F.col("ruled") == "block").cast("double").alias("bad")), "ruled")
    links = scratch.keep(host_links(cut), "links")
    # both walks at once: trust along the links, distrust against them
    walks = links.select(F.lit("trust").alias("walk"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    weights = seeds.where("good > 0").select(F.lit("trust").alias("walk"), "host", F.col("good").alias("weight")).unionByName(seeds.where("bad > 0").select(F.lit("distrust").alias("walk"), "host", F.col("bad").alias("weight")))
    ranks = propagate(walks, weights, scratch, damping, rounds, tolerance)
    part = lambda w: F.coalesce(F.sum(F.when(F.col("walk") == w, F.col("rank"))), F.lit(0.0)).alias(w)
    # each walk's ranks sum to one; here each weighs as its seeds do among all
    mass = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    share = lambda c: (mass[c] or 0.0) / max((mass["good"] or 0.0) + (mass["bad"] or 0.0), 1.0)
    scores = ranks.groupBy(F.col("host").alias("h")).agg(part("trust"), part("distrust")).withColumns({"trust": F.col("trust") * share("good"), "distrust": F.col("distrust") * share("bad")})
    scores = scores.withColumn("method", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow"))
    out = cut.drop("html").join(scores, F.col("host") == F.col("h"), "left")
    out = out.select("page_id", "host", "path", "rule", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), F.coalesce("ruled", "method", F.lit("allow")).alias("verdict"))
    return scratch.sweep(out)
