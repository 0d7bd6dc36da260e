"""Shredding of calls into nodes: one entry per position in the JSON value."""

from __future__ import annotations

from pyspark.sql import DataFrame

from callsieve.functions.jsontext import depth_bound, parse_strict
from callsieve.functions.sqltext import joined, loop, name
from callsieve.functions.variants import elements, fields, keys, kind_of

_NODE = "struct<path:array<string>,v:variant>"


def nodes_of(root: str, rounds: str) -> str:
    """The nodes of the VARIANT ``root``, each with ``path`` and value ``v``: a loop inside the row opens
    the nodes just found until there are none, at most ``rounds`` times."""

    def step(key: str, v: str) -> str:
        return f"named_struct('path', concat(n.path, array({key})), 'v', {v})"

    members = f"transform(map_entries({fields('n.v')}), e -> {step('e.key', 'e.value')})"
    places = f"transform({elements('n.v')}, (x, i) -> {step('string(i)', 'x')})"
    none = f"cast(array() AS array<{_NODE}>)"
    inside = f"cast(flatten(transform(b.open, n -> coalesce({members}, {places}, {none}))) AS array<{_NODE}>)"
    going = f"named_struct('open', {inside}, 'levels', {joined('b.levels', 'array(b.open)')})"
    start = f"cast(array(named_struct('path', array(), 'v', {root})) AS array<{_NODE}>)"
    return loop(rounds, start, going, f"cast(array() AS array<array<{_NODE}>>)", "flatten(acc.levels)")


def shred_calls(df: DataFrame, text: str = "call") -> DataFrame:
    """One row per node: path, JSON type, JSON text and child keys. No shuffle and no pass before it:
    each row takes as many rounds as its own call is deep.

    Text that is not strict JSON has no nodes.
    """
    others = [name(c) for c in df.columns if c != text]
    parsed = df.withColumns({"__root": parse_strict(text), "__rounds": depth_bound(text) + 1})
    nodes = f"if(__root IS NULL, NULL, {nodes_of('__root', '__rounds')})"
    # Outer, so that no filter on the array is inferred and copied below its definition.
    rows = parsed.selectExpr(*others, f"explode_outer({nodes}) AS __n").filter("__n IS NOT NULL")
    return rows.selectExpr(
        *others,
        "__n.path AS path",
        f"{kind_of('__n.v')} AS json_type",
        "to_json(__n.v) AS json",
        f"{keys('__n.v')} AS child_keys",
    )
