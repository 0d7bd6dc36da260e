"""Chat formatting of records in many layouts, with DataFrame functions only.

The nested field paths that a record fills are hashed into its fingerprint. A fingerprint selects
a declared mapping, which brings the record's prompt, instruction or message fields into one list
of turns. A template marks the turns; control strings inside texts are escaped so that reading
back is exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The control strings of the chat template.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """A mapping from a record's fields to turns.

    Either ``turns``, pairs of a role and the field with its text, in order, of which absent ones
    are left out; or ``items``, an array field of structs with the fields ``role`` and ``text``.
    ``names`` renames roles. ``required`` and ``optional`` paths make up its fingerprints.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    names: dict[str, str] = field(default_factory=dict)

    def path_sets(self) -> list[str]:
        extra = (c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n))
        return [path_text((*self.required, *c)) for c in extra]


LAYOUTS = (
    Layout("messages", ("messages[].role",), ("messages[].content",), items="messages", role="role", text="content"),
    Layout(
        "conversations",
        ("conversations[].from",),
        ("conversations[].value",),
        items="conversations",
        role="from",
        text="value",
        names={"human": "user", "gpt": "assistant"},
    ),
    Layout("prompt", ("prompt",), ("response",), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout(
        "instruction",
        ("instruction",),
        ("output", "system"),
        turns=(("system", "system"), ("user", "instruction"), ("assistant", "output")),
    ),
)


def path_text(paths) -> str:
    return "\n".join(sorted(paths))


def filled_paths(schema: T.StructType) -> dict[str, Column]:
    """For each leaf path of a schema whether a row fills it. Elements of an array count together:
    ``a[].b`` is filled if any element of ``a`` has a ``b``."""

    def walk(kind: T.DataType, path: str, value) -> dict[str, object]:
        # ``value`` wraps a test of the leaf into a test of the row.
        if isinstance(kind, T.StructType):
            out = {}
            for f in kind.fields:
                inner = f"{path}.{f.name}" if path else f.name
                out |= walk(f.dataType, inner, lambda test, n=f.name: value(lambda x: test(x[n])))
            return out
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, f"{path}[]", lambda test: value(lambda x: F.exists(x, test)))
        return {path: value(lambda x: x.isNotNull())}

    out: dict[str, Column] = {}
    for f in schema.fields:
        top = F.col(f"`{f.name}`")
        out |= walk(f.dataType, f.name, lambda test, c=top: test(c))
    return {path: F.coalesce(filled, F.lit(False)) for path, filled in out.items()}


def fingerprint(schema: T.StructType) -> Column:
    """Hash of the sorted nested field paths that a row fills."""
    filled = filled_paths(schema)
    return F.xxhash64(F.concat_ws("\n", *(F.when(filled[p], F.lit(p)) for p in sorted(filled))))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical_turns(layout: Layout) -> Column:
    if layout.items:

        def one(item: Column) -> Column:
            role = item[layout.role]
            for old, new in layout.names.items():
                role = F.when(role == old, F.lit(new)).otherwise(role)
            return _turn(role, item[layout.text])

        return F.transform(F.filter(F.col(layout.items), lambda x: x.isNotNull()), one)
    turns = (F.when(F.col(f).isNotNull(), _turn(F.lit(role), F.col(f))) for role, f in layout.turns)
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def escape(text: Column) -> Column:
    """Text without ``<|``: one backslash more between any ``<``, backslashes and ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role in one line; ``<nl|`` stands for a line break."""
    marked = F.regexp_replace(role, r"<(\\*)nl\|", r"<\\$1nl|")
    return escape(F.replace(marked, F.lit("\n"), F.lit("<nl|")))


def unescape_role(role: Column) -> Column:
    lines = F.replace(unescape(role), F.lit("<nl|"), F.lit("\n"))
    return F.regexp_replace(lines, r"<\\(\\*)nl\|", r"<$1nl|")


def format_chat(records: DataFrame, keep: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``keep`` columns, ``layout, fingerprint, turns, segments, formatted`` for each record.

    ``formatted`` is the concatenation of ``segments`` (``text, loss``); ``loss`` marks what is
    trained on, the assistant's texts. All columns but ``keep`` are the record. A record that
    fills the paths of no layout, an empty one too, gets a null layout and null texts; it is
    never dropped. A null role or text within a turn is empty. Repeated records stay repeated.
    """
    body = T.StructType([f for f in records.schema.fields if f.name not in keep])
    names = {f.name for f in body.fields}
    mark = fingerprint(body)
    usable = [x for x in layouts if {p.split("[")[0].split(".")[0] for p in x.required} <= names]
    chosen, layout = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    for x in usable:
        present = tuple(p for p in x.optional if p.split("[")[0].split(".")[0] in names)
        x = Layout(x.name, x.required, present, tuple(t for t in x.turns if t[1] in names), x.items, x.role, x.text, x.names)
        fits = F.col("fingerprint").isin(*(F.xxhash64(F.lit(p)) for p in x.path_sets()))
        chosen, layout = F.when(fits, canonical_turns(x)).otherwise(chosen), F.when(fits, F.lit(x.name)).otherwise(layout)
    marked = records.withColumn("fingerprint", mark).select(
        *keep, layout.alias("layout"), "fingerprint", chosen.alias("turns")
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(
                    F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")
                ),
                F.struct(escape(t["text"]).alias("text"), (t["role"] == TRAINED_ROLE).alias("loss")),
                F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return marked.withColumn("segments", segments).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_back(formatted: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``turns, loss_text, formatted_chars`` from formatted texts and segments."""
    start, end = START.replace("|", r"\|"), END.replace("|", r"\|")
    blocks = F.filter(F.split("formatted", start), lambda x: x != "")
    shape = rf"(?s)^([^\n]*)\n(.*){end}\n$"
    turns = F.transform(
        blocks,
        lambda x: F.struct(
            unescape_role(F.regexp_extract(x, shape, 1)).alias("role"),
            unescape(F.regexp_extract(x, shape, 2)).alias("text"),
        ),
    )
    trained = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select(
        *keep,
        turns.alias("turns"),
        F.array_join(trained, "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
