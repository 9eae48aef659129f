"""Chat formatting: fingerprint a record's layout, map it to turns, render, read back.

A record's layout is the set of its nested field paths that hold a value, such as
``messages[].role``.  The sorted paths are hashed, and the hash selects a
declarative mapping to canonical turns (role, text).  One frame may hold
records of all layouts side by side (the union schema ``spark.read.json`` gives).
As null fields hold no value, the table of hashes also has each part of a layout's paths; it selects the
layout with the fewest paths that has them all, and the null fields are empty texts.  The fingerprint and the name of the layout are
part of the result, so records that fit none can be counted and their layout looked up.

Template: ``<|turn|>`` role newline text ``<|end|>`` newline.  Inside roles and texts
``&``, ``<`` and ``[`` (and a newline in a role) become ``&amp;``, ``&lt;``,
``&lb;`` and ``&nl;``, so no control string of this or of a bracket template survives in
a text, and replacing them back restores the text exactly.  The output keeps the rendered
string and its segments with the loss flag; the segments joined are the string.

Everything is DataFrame functions.  A conversation is one value, so its turns meet
in one task by nature; conversations are spread by their id.

Defined results: null roles and texts are empty; turns are ordered by (turn, role, text),
a null turn first, and repeated rows are repeated turns; a null id is a
conversation of its own; a record whose known fields fit no layout (fields of two layouts, or none) has no turns and a null layout; fields
outside the known layouts do not count, nor do columns a layout knows but the table lacks; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Field paths that a record of this layout has, and its turns: either ``listed`` (array, role
    field, text field) or ``fixed`` ((role, paths whose values are joined by an empty line), ...)."""
    name: str
    paths: tuple[str, ...]
    listed: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hash_of(self.paths)


def hash_of(paths: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def _list(name: str, array: str, role: str, text: str, *more: str) -> Layout:
    return Layout(name, tuple(f"{array}[].{f}" for f in (role, text, *more)), (array, role, text))


LAYOUTS: tuple[Layout, ...] = (
    _list("turn rows", "turns", "role", "text"),
    _list("messages", "messages", "role", "content"),
    _list("messages with names", "messages", "role", "content", "name"),
    _list("shared dialogs", "conversations", "from", "value"),
    _list("nested dialog", "dialog.turns", "speaker", "utterance"),
    Layout("prompt and response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", ("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system, prompt and response", ("system", "prompt", "response"),
           fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", ("instruction", "input", "output"),
           fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question and answer", ("question", "answer"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprints() -> dict[str, Layout]:
    """Fingerprint -> layout: of all its paths, and of every part of them, for the first layout with the fewest paths that has these."""
    found: dict[str, Layout] = {lay.fingerprint: lay for lay in LAYOUTS}
    for lay in sorted(LAYOUTS, key=lambda x: len(x.paths)):
        for n in range(len(lay.paths) - 1, 0, -1):
            for part in combinations(sorted(lay.paths), n):
                found.setdefault(hash_of(part), lay)
    return found


def _holds(field: str) -> Callable[[Column], Column]:
    return lambda x: x[field].isNotNull()


def field_paths(schema: T.StructType, prefix: str = "") -> dict[str, Column]:
    """Path -> whether a row has a value there, for every leaf of the schema (structs, and arrays of structs)."""
    found: dict[str, Column] = {}
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        ref = F.col(".".join(f"`{p}`" for p in path.split(".")))
        if isinstance(f.dataType, T.StructType):
            found |= field_paths(f.dataType, f"{path}.")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            for g in f.dataType.elementType.fields:
                found[f"{path}[].{g.name}"] = F.coalesce(F.exists(ref, _holds(g.name)), F.lit(False))
        else:
            found[path] = ref.isNotNull()
    return found


def fingerprint(schema: T.StructType) -> Column:
    """SHA-256 of the row's sorted field paths, of those that some layout knows."""
    known = {p for lay in LAYOUTS for p in lay.paths}
    has = {p: c for p, c in sorted(field_paths(schema).items()) if p in known}
    return F.sha2(F.concat_ws(",", *[F.when(c, p) for p, c in has.items()]), 256)


def layout_name(schema: T.StructType) -> Column:
    """The name of the layout that the row's fingerprint selects, else null."""
    mark = fingerprint(schema)
    by: dict[str, list[str]] = {}
    for f, lay in fingerprints().items():
        by.setdefault(lay.name, []).append(f)
    return F.coalesce(*[F.when(mark.isin(own), name) for name, own in by.items()])


def canonical_turns(records: DataFrame, layout: Column) -> Column:
    """array<struct<role, text>> by the layout of that name."""
    have = set(field_paths(records.schema))
    empty = F.expr("CAST(array() AS array<struct<role:string,text:string>>)")
    out = None

    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    for lay in LAYOUTS:
        if not set(lay.paths) & have:
            continue
        if lay.listed:
            array, role, text = lay.listed
            rename = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]) if role != "role" else None

            def field(m: Column, name: str, array: str = array) -> Column:
                return m[name].cast("string") if f"{array}[].{name}" in have else F.lit(None).cast("string")

            def named(m: Column, role: str = role, rename: Column | None = rename) -> Column:
                return field(m, role) if rename is None else F.coalesce(rename[F.coalesce(field(m, role), F.lit(""))], field(m, role))

            turns = F.transform(F.col(array), lambda m: turn(named(m), field(m, text)))
        else:
            turns = F.array(*[turn(F.lit(role), F.concat_ws("\n\n", *[F.col(p).cast("string") for p in paths if p in have])) for role, paths in lay.fixed])
        hit = layout == lay.name
        out = F.when(hit, turns) if out is None else out.when(hit, turns)
    return empty if out is None else out.otherwise(empty)


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def render(turns: Column, trained: str = "assistant") -> Column:
    """The turns as array<struct<text, loss>>: a head, the escaped text and a tail for each turn."""
    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    return F.flatten(F.transform(turns, lambda t: F.array(
        piece(F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&nl;")), F.lit("\n")), no),
        piece(escape(t["text"]), t["role"] == trained), piece(F.lit(CLOSE), no))))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a rendered string."""
    def turn(s: Column) -> Column:
        at = F.instr(s, "\n")
        role = unescape(F.replace(s.substr(F.lit(1), at - 1), F.lit("&nl;"), F.lit("\n")))
        return F.struct(role.alias("role"), unescape(s.substr(at + 1, F.length(s))).alias("text"))

    parts = F.split(formatted, r"<\|end\|>\n", -1)
    heads = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: s.substr(F.lit(len(OPEN) + 1), F.length(s)))
    return F.transform(heads, turn)


def format_chats(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, formatted, segments (array of text and loss flag), layout and fingerprint for each record; a record of no known
    layout has a null layout and an empty string."""
    turns = records.select(F.col(id_col), canonical_turns(records, layout_name(records.schema)).alias("canonical"),
                           layout_name(records.schema).alias("layout"), fingerprint(records.schema).alias("fingerprint"))
    done = turns.select(id_col, render(F.col("canonical")).alias("segments"), "layout", "fingerprint")
    return done.select(id_col, F.concat_ws("", F.col("segments.text")).alias("formatted"), "segments", "layout", "fingerprint")


def turn_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """Rows by turn gathered to one ``turns`` record per conversation."""
    none = F.lit("")
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), none).alias("role"),
                   F.coalesce(F.col(text_col), none).alias("text"))
    return rows.groupBy(id_col).agg(F.sort_array(F.collect_list(one)).alias("turns"))
