"""Text functions as Column expressions; the two that Spark can't express are Arrow-batched pandas UDFs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed character ranges. Two ranges of CJK are in use and must not be merged.
CJK = "一-鿿"
CJK_WIDE = "㐀-鿿"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compact_nfkc(c: str | Column) -> Column:
    """NFKC, by the ICU routine on Spark's class path, then letters and digits only. Null stays null."""
    whole = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(col(c), F.lit("")), F.lit(True))
    return F.when(col(c).isNotNull(), F.regexp_replace(whole, r"[^\p{L}\p{N}]", ""))


def compact_alnum(c: str | Column) -> Column:
    """ASCII letters, digits and wide-range CJK only, lower-cased."""
    return F.lower(F.regexp_replace(col(c), f"[^0-9A-Za-z{CJK_WIDE}]", ""))


def compact_space(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"\s+", "")


def clean_space(c: str | Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def strip(c: str | Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once: inside other lambdas a plain expression would be computed again for each element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def grams(c: Column, n: int = 2) -> Column:
    """n-character grams in order; a shorter non-empty string is its own only gram; empty and null give none.

    The length guard comes before ``sequence``, which would count down.
    """
    none = F.array().cast("array<string>")

    def cut(chars: Column) -> Column:
        # characters are an array by now: a substring of a string would be searched for from its start each time
        size = F.size(chars)
        made = F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))
        return F.when(size == 0, none).when(size < n, F.array(F.array_join(chars, ""))).otherwise(made)

    return let(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?s)."), F.lit(0)), cut)


def char_bigrams(c: str | Column) -> Column:
    """Distinct 2-grams of the compact form."""
    # the compact form has no surrogate pairs, so a look-ahead at each place is each 2-gram
    cut = lambda t: F.when(F.length(t) == 1, F.array(t)).otherwise(F.array_distinct(F.regexp_extract_all(t, F.lit("(?=(..))"), F.lit(1))))
    return let(F.coalesce(compact_alnum(c), F.lit("")), cut)


def words(c: str | Column) -> Column:
    """2-grams of all CJK characters together, across what stands between them, then Latin words in lower case; distinct."""
    joined = F.regexp_replace(F.coalesce(col(c), F.lit("")), f"[^{CJK}]", "")
    pairs = F.filter(grams(joined), lambda g: F.length(g) == 2)
    latin = F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("[A-Za-z0-9']+"), F.lit(0)), F.lower)
    return F.array_distinct(F.concat(F.coalesce(pairs, F.array().cast("array<string>")), latin))


#: Words that carry no topic, in four languages.
STOP_WORDS = "a an and are as at be but by das de del den der des die du ein eine el en es et for from il in is it la le les los mit of on or que se sie the to un und une was wir with you".split()


def keywords(c: str | Column, stop: list[str] | None = None) -> Column:
    """``words`` without stop words and one-character Latin words."""
    kept = F.array_except(words(c), F.array(*map(F.lit, STOP_WORDS if stop is None else stop)))
    return F.filter(kept, lambda w: ~w.rlike("^[a-z0-9']$"))


def cjk_shingles(c: str | Column) -> Column:
    """Sorted distinct 2-grams of each CJK run of two or more characters."""
    runs = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(f"[{CJK}]{{2,}}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(runs, lambda r: grams(r)))))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller set; 0 if one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length (1 at least)."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts without white space (no junk heuristic); 1 for two empty ones. Not an edit distance."""
    strip = lambda x: "".join((x or "").split())
    return pd.Series([difflib.SequenceMatcher(None, strip(x), strip(y), autojunk=False).ratio() for x, y in zip(a, b)])


def key_details(c: str | Column) -> Column:
    """Numbers, and Latin tokens of three or more characters in lower case; distinct and sorted."""
    numbers = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    latin = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z][a-z0-9]{2,}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(numbers, latin)))


def ocr_terms(c: str | Column, stop: list[str] | None = None) -> Column:
    """CJK runs of 2 to 6 characters and Latin tokens of three or more with a letter, without stop words; distinct."""
    text = F.coalesce(col(c), F.lit(""))
    runs = F.filter(F.regexp_extract_all(text, F.lit(f"[{CJK_WIDE}]+"), F.lit(0)), lambda r: F.length(r).between(2, 6))
    latin = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]{3,}"), F.lit(0)), lambda t: t.rlike("[A-Za-z]") & ~F.lower(t).isin(STOP_WORDS if stop is None else stop))
    return F.array_distinct(F.concat(runs, latin))


def cjk_windows(c: str | Column, n: int) -> Column:
    """Windows of ``n`` characters in each CJK run; distinct."""
    runs = F.filter(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(f"[{CJK_WIDE}]+"), F.lit(0)), lambda r: F.length(r) >= n)
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: grams(r, n))))


def latin_ratio(c: str | Column) -> Column:
    """Latin letters over Latin letters and CJK characters; the denominator is 1 at least."""
    count = lambda kind: F.length(F.regexp_replace(F.coalesce(col(c), F.lit("")), f"[^{kind}]", ""))
    latin, cjk = count("A-Za-z"), count(CJK)
    return latin / F.greatest(latin + cjk, F.lit(1))


def parse_timestamp(c: str | Column) -> Column:
    """``[[HH:]MM:]SS[,mmm]`` to seconds; null where it is none."""
    parts = F.split(F.replace(col(c), F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    at = lambda k: F.coalesce(F.try_element_at(parts, n - k).try_cast("double"), F.lit(0.0))
    total = at(0) + F.when(n >= 2, 60 * at(1)).otherwise(0.0) + F.when(n >= 3, 3600 * at(2)).otherwise(0.0)
    return F.when(col(c).rlike(r"^\s*\d+(:\d+){0,2}([.,]\d+)?\s*$"), total)


def clock(c: str | Column, rounded: bool = True) -> Column:
    """Seconds as ``HH:MM:SS``, rounded (half to even); null gives ``?``."""
    s = F.bround(col(c)).cast("long") if rounded else F.floor(col(c)).cast("long")
    return F.when(col(c).isNull(), "?").otherwise(F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60))


def minutes(c: str | Column) -> Column:
    """Seconds as ``MM:SS``, cut off; minutes may exceed 59; null gives ``?``."""
    s = F.floor(col(c)).cast("long")
    return F.when(col(c).isNull(), "?").otherwise(F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60))


def plausible_edge(x: Column, low: float, good_low: float, good_high: float, high: float) -> Column:
    """Piecewise-linear plausibility: 0 outside [low, high], 1 inside [good_low, good_high], linear between."""
    return F.when((x <= low) | (x >= high), 0.0).when(x < good_low, (x - low) / (good_low - low)).when(x > good_high, (high - x) / (high - good_high)).otherwise(1.0)


def sample_times(duration: Column, n: int) -> Column:
    """``n`` evenly spaced times inside a duration, at the middles of equal parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: duration * (i + 0.5) / n)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def pixel_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two descriptor arrays over 255."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1)) / 255


def laplacian_variance(gray: Column, width: int) -> Column:
    """Variance of the four-neighbour Laplacian over the inner pixels of a row-major image: how sharp it is; 0 without inner pixels."""

    def edges(g: Column) -> Column:
        height = F.floor(F.size(g) / width).cast("int")
        inner = F.filter(F.sequence(F.lit(0), F.greatest(height * width - 1, F.lit(0))), lambda i: (i % width).between(1, width - 2) & F.floor(i / width).between(1, height - 2))
        at = lambda i: F.coalesce(F.get(g, i), F.lit(0.0)).cast("double")
        return F.transform(inner, lambda i: at(i - 1) + at(i + 1) + at(i - width) + at(i + width) - 4 * at(i))

    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))
    return let(let(gray, edges), lambda e: mean(F.transform(e, lambda x: x * x)) - mean(e) * mean(e))


def strip_filler(c: str | Column, fillers: list[str]) -> Column:
    """(text without a leading filler, edits): the removed filler is logged, the text after it is left as it stands."""
    pattern = "^(?:" + "|".join(sorted(map(_quote, fillers), key=len, reverse=True)) + r")[\s,，、.。…]*"
    found = F.regexp_extract(col(c), pattern, 0)
    edit = F.struct(F.lit("filler_removed").alias("type"), found.alias("removed_text"))
    empty = F.array().cast("array<struct<type:string,removed_text:string>>")
    return F.struct(F.regexp_replace(col(c), pattern, "").alias("text"), F.when(found != "", F.array(edit)).otherwise(empty).alias("edits"))


def _quote(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in s)


def text_fingerprint(*cols: str | Column) -> Column:
    """SHA-256 of the columns' JSON with sorted field names."""
    named = sorted((c if isinstance(c, str) else f"c{i}", col(c)) for i, c in enumerate(cols))
    return F.sha2(F.to_json(F.struct(*(x.alias(n) for n, x in named))), 256)


def ascii_bucket(c: str | Column, mod: int = 100) -> Column:
    """The first 8 hex digits of SHA-256, as a number modulo ``mod``: a stable sample key."""
    return F.conv(F.substring(F.sha2(col(c), 256), 1, 8), 16, 10).cast("long") % mod


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(s: pd.Series) -> pd.Series:
    """The JSON objects of the first array found in chatty text: thinking blocks and code fences are skipped; a lone object counts as one."""
    import json
    import re

    def read(text):
        if text is None:
            return []
        text = re.sub(r"(?s)<think>.*?</think>", "", text)
        for start in [m.start() for m in re.finditer(r"[\[{]", text)]:
            try:
                got, _ = json.JSONDecoder().raw_decode(text[start:])
            except ValueError:
                continue
            rows = got if isinstance(got, list) else [got]
            rows = [json.dumps(r, sort_keys=True, ensure_ascii=False) for r in rows if isinstance(r, dict)]
            if rows or got == []:
                return rows
        return []

    return s.map(read)


@F.pandas_udf(T.StringType())
def nested_text(s: pd.Series) -> pd.Series:
    """All values of ``text`` keys at any depth of a JSON value, in order, joined by line breaks."""
    import json

    def walk(v, out):
        if isinstance(v, dict):
            for k, x in v.items():
                if k == "text" and isinstance(x, str):
                    out.append(x)
                else:
                    walk(x, out)
        elif isinstance(v, list):
            for x in v:
                walk(x, out)
        return out

    def read(x):
        try:
            return "\n".join(walk(json.loads(x), [])) if x else ""
        except ValueError:
            return ""

    return s.map(read)
