"""Small builders for Spark SQL expression text.

The checks are long expressions built from data (a schema's rules). Composing them as text
and parsing them once is much cheaper than one call into the JVM per function.
"""

from __future__ import annotations

from decimal import Decimal


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values) -> str:
    """An ARRAY<STRING> literal."""
    return "array(" + ", ".join(quote(v) for v in values) + ")" if values else "cast(array() AS array<string>)"


def number(value: int | float | Decimal | None, sql_type: str) -> str:
    return f"cast({'NULL' if value is None else quote(str(value))} AS {sql_type})"


def name(column: str) -> str:
    """A quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def any_of(tests: list[str]) -> str:
    """True if some test is true; NULL counts as false."""
    return "(" + " OR ".join(f"coalesce({t}, false)" for t in tests) + ")"


def let(value: str, variable: str, body: str) -> str:
    """``body`` with ``variable`` standing for ``value``, which is worked out once."""
    return f"transform(array({value}), {variable} -> {body})[0]"


def given(value: str, variable: str, body: str) -> str:
    """``let`` without copies: Spark copies what a transform gives, but not what the end of an aggregate does."""
    return f"aggregate(cast(array() AS array<int>), {value}, (_a, _i) -> _a, {variable} -> {body})"


def joined(*arrays: str) -> str:
    """One array of all."""
    return f"concat({', '.join(arrays)})"


#: So many rounds are run one after the other; more are run in blocks.
STRAIGHT_ROUNDS = 16


def loop(rounds: str, start: str, going: str, empty: str, levels: str = "acc.levels") -> str:
    """The ``levels`` of a loop that opens what the round before has found, until nothing is open.

    ``start`` is the open part, ``going`` the state ``(open, levels)`` after a round on the state ``b``, and
    ``empty`` an array without levels. Spark copies the whole state of an ``aggregate`` in every round, so that of
    many rounds is kept in blocks: a round copies the levels of its block, a block those of all before it.
    """
    state = "named_struct('open', {0}, 'levels', {1})"
    length = f"if({rounds} <= {STRAIGHT_ROUNDS}, {rounds}, int(ceil(sqrt({rounds}))))"
    block = (
        f"aggregate(sequence(1, {length}), {state.format('acc.open', empty)}, (b, j) -> if(size(b.open) = 0, b, {going}),"
        f" b -> {state.format('b.open', joined('acc.levels', 'b.levels'))})"
    )
    blocks = f"sequence(1, int(ceil({rounds} / {length})))"
    return (
        f"aggregate({blocks}, {state.format(start, empty)}, (acc, i) -> if(size(acc.open) = 0, acc, {block}), acc -> {levels})"
    )
