"""Chat formatting by schema fingerprints, with DataFrame functions only.

A layout is known by its nested field paths. Of the paths of a table's schema, or of a JSON row's own value, those that some layout
declares are sorted and hashed; that SHA-256 selects a declarative mapping to canonical turns (conv_id, turn, role, text), so
further fields of a row don't matter. The template writes ``<|im_start|>role``, a line break, the text and ``<|im_end|>`` with a
line break for each turn; inside roles and texts the control sign is escaped, so that no text can forge a turn, and reading back is
exact.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    r"""``\`` to ``\b`` and ``<|`` to ``<\p``; in roles line breaks to ``\n`` too. Each backslash is then a mark's first sign."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\p"), F.lit("|"))
    out = F.replace(out, F.lit("\\n"), F.lit("\n")) if role else out
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` steps into arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def path_digest(fields: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(fields))).encode()).hexdigest()


def row_paths(value: Column) -> Column:
    """Nested field paths of a VARIANT value, from the schema that Spark derives for it; ``[]`` steps into arrays, whose elements count together.

    One pass over the schema's signs keeps the path of the place reached and of all that enclose it.
    """
    signs = F.regexp_extract_all(F.schema_of_variant(value), F.lit(r"(?:`(?:[^`]|``)*`|[^`<>:, ]+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9,]+\))?"), F.lit(0))
    texts = lambda *x: F.array(*x).cast("array<string>")

    def step(state: Column, sign: Column) -> Column:
        around, at, found = state["around"], state["at"], state["found"]
        top = F.element_at(around, -1)
        name = F.replace(F.regexp_replace(sign, r"^`|`?: $", ""), F.lit("``"), F.lit("`"))
        inner = F.concat(at, F.lit("[]"))
        go = lambda around, at, found: F.struct(around.alias("around"), at.alias("at"), found.alias("found"))
        return (
            F.when(sign == "OBJECT<", go(F.concat(around, F.array(at)), at, found))
            .when(sign == "ARRAY<", go(F.concat(around, F.array(inner)), inner, found))
            .when(sign == ">", go(F.slice(around, 1, F.size(around) - 1), at, found))
            .when(F.endswith(sign, F.lit(": ")), go(around, F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name)), found))
            .otherwise(go(around, at, F.concat(found, F.array(at))))
        )

    start = F.struct(texts(F.lit("")).alias("around"), F.lit("").alias("at"), texts().alias("found"))
    return F.aggregate(signs, start, step, lambda state: F.array_sort(F.array_distinct(state["found"])))


@dataclass(frozen=True)
class Layout:
    """``forms`` are the sets of field paths that name it, with any of ``more``; ``turns`` is a SQL expression of (role, text) over the row's ``v``."""

    name: str
    forms: tuple[tuple[str, ...], ...]
    more: tuple[str, ...]
    turns: str

    def digests(self) -> list[str]:
        some = chain.from_iterable(combinations(self.more, n) for n in range(len(self.more) + 1))
        return [path_digest([*form, *more]) for more in some for form in self.forms]


def _pick(path: str) -> str:
    return f"coalesce(try_variant_get(v, '{path}', 'string'), '')"


def _pairs(*pairs: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'text', {t})" for r, t in pairs) + ")"


def _said(c: str) -> str:
    """The text of a content: a string, or the texts of its parts in a row; parts without text give none."""
    part = "CASE WHEN schema_of_variant(p) = 'STRING' THEN try_variant_get(p, '$', 'string') ELSE coalesce(try_variant_get(p, '$.text', 'string'), '') END"
    return f"CASE WHEN startswith(schema_of_variant({c}), 'ARRAY') THEN array_join(transform(try_variant_get({c}, '$', 'array<variant>'), p -> {part}), '') ELSE coalesce(try_variant_get({c}, '$', 'string'), '') END"


def _list(path: str, role: str, text: str) -> str:
    who = f"coalesce(try_variant_get(m, '$.{role}', 'string'), '')"
    who = f"CASE {who} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE {who} END"
    content = f"try_variant_get(m, '$.{text}', 'variant')"
    return f"transform(try_variant_get(v, '$.{path}', 'array<variant>'), m -> named_struct('role', {who}, 'text', {_said(content)}))"


def _listed(path: str, role: str, text: str) -> tuple[tuple[str, ...], ...]:
    """A list's forms: contents are strings, lists of parts, or both."""
    return tuple((f"{path}[].{role}", f"{path}[].{text}{end}") for end in ("", "[]", "[].text"))


_ASKED = f"CASE WHEN {_pick('$.input')} = '' THEN {_pick('$.instruction')} ELSE concat({_pick('$.instruction')}, chr(10), chr(10), {_pick('$.input')}) END"

LAYOUTS = [
    Layout("messages", _listed("messages", "role", "content"), ("system", "prompt"), _list("messages", "role", "content")),
    Layout("conversations", _listed("conversations", "from", "value"), ("system",), _list("conversations", "from", "value")),
    Layout("conversations_by_role", _listed("conversations", "role", "content"), ("system",), _list("conversations", "role", "content")),
    Layout("instruction_output", (("instruction", "output"),), ("input", "system"), _pairs(("user", _ASKED), ("assistant", _pick("$.output")))),
    Layout("instruction_response", (("instruction", "response"),), ("input", "system"), _pairs(("user", _ASKED), ("assistant", _pick("$.response")))),
    Layout("prompt_response", (("prompt", "response"),), ("system",), _pairs(("user", _pick("$.prompt")), ("assistant", _pick("$.response")))),
    Layout("prompt_completion", (("prompt", "completion"),), ("system",), _pairs(("user", _pick("$.prompt")), ("assistant", _pick("$.completion")))),
    Layout("question_answer", (("question", "answer"),), ("system",), _pairs(("user", _pick("$.question")), ("assistant", _pick("$.answer")))),
]

#: All paths that a layout declares; others are no part of a fingerprint.
DECLARED = sorted({p for x in LAYOUTS for form in (*x.forms, x.more) for p in form})


def row_digest(value: Column) -> Column:
    """Fingerprint of a VARIANT value: SHA-256 of its declared paths, sorted."""
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(row_paths(value), F.array(*map(F.lit, DECLARED)))), "\n"), 256)


#: Tables with a row for each turn: field paths -> the columns of a canonical turn.
TURN_TABLES = {
    path_digest(["conv_id", "turn", "role", "text"]): ("conv_id", "turn", "role", "text"),
    path_digest(["conversation_id", "index", "role", "content"]): ("conversation_id", "index", "role", "content"),
    path_digest(["id", "position", "from", "value"]): ("id", "position", "from", "value"),
}


def turns_from_json(rows: DataFrame, key: str = "conv_id", json: str = "json") -> DataFrame:
    """Canonical turns of JSON rows of any known layout, after a field ``system`` as a turn of its own where it has text.

    Fields that no layout declares are ignored. Rows of unknown layouts or of fields of two, null and broken JSON give one row with a null turn.
    """
    v = rows.select(F.col(key).alias("conv_id"), F.try_parse_json(json).alias("v")).withColumn("layout", row_digest(F.col("v")))
    found = "CASE " + " ".join(f"WHEN layout IN ({', '.join(repr(d) for d in x.digests())}) THEN {x.turns}" for x in LAYOUTS) + " END"
    system = f"filter({_pairs(('system', _pick('$.system')))}, s -> s.text <> '')"
    return v.select("conv_id", F.posexplode_outer(F.expr(f"concat({system}, {found})")).alias("turn", "m")).select("conv_id", F.col("turn").cast("long"), "m.role", "m.text")


def canonical_turns(table: DataFrame) -> DataFrame:
    """Canonical turns of a table with a row for each turn, by the fingerprint of its schema; further columns are ignored, and a table that has the columns of no mapping or of two raises."""
    names = paths(table.schema)
    exact = TURN_TABLES.get(path_digest(names))
    fit = [exact] if exact else [m for m in TURN_TABLES.values() if set(m) <= set(names)]
    if len(fit) != 1:
        raise ValueError(f"no mapping for the field paths {sorted(names)}")
    return table.select(*(F.col(f"`{c}`").alias(a) for c, a in zip(fit[0], ("conv_id", "turn", "role", "text"))))


def format_turns(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points of each ``learn`` text as written), by turn; ties by role and text.

    A null role or text reads as empty; null conv_ids form one conversation. Offsets are running sums over the turns, in time that is linear in their number.
    A conversation is one row of output, so its turns meet in one task; texts of different conversations never do.
    """
    head = F.concat(F.lit(START), escape(F.coalesce("role", F.lit("")), role=True), F.lit("\n"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("start", before + F.length("head"))
    span = F.when(F.col("role") == learn, F.struct(F.col("start"), F.length("body").cast("long").alias("length")))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece"))).alias("p"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return grouped.select("conv_id", F.array_join("p.piece", "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_texts, from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    role = lambda p: F.substring_index(body(p), "\n", 1)
    text = lambda p: F.substring(body(p), F.length(role(p)) + 2, F.length(p))
    turns = F.transform(pieces, lambda p: F.struct(unescape(role(p), role=True).alias("role"), unescape(text(p)).alias("text")))
    learnt = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), learnt.alias("loss_texts"))
