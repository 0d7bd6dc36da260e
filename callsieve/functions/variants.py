"""JSON kinds, canonical text and numbers of VARIANT values, as SQL expression text.

Each builder takes the text of an expression and returns the text of another.
"""

from __future__ import annotations

from callsieve.functions.sqltext import quote


def field(v: str, key: str) -> str:
    """Member of an object as VARIANT; NULL if there is none. JSON null is not NULL."""
    return f"try_variant_get({v}, {quote(json_path([key]))}, 'variant')"


def json_path(keys: list[str]) -> str | None:
    """Path to a nested member; NULL where a key cannot be written in a path."""
    steps = []
    for key in keys:
        mark = '"' if '"' not in key else "'"
        if mark in key:
            return None
        steps.append(f"[{mark}{key}{mark}]")
    return "$" + "".join(steps)


def fields(v: str) -> str:
    """``MAP<STRING, VARIANT>`` of an object, NULL for anything else."""
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def keys(v: str, path: str = "$") -> str:
    """Keys of an object, NULL for anything else; the member values are not copied."""
    return f"map_keys(try_variant_get({v}, {quote(path)}, 'map<string,struct<>>'))"


def elements(v: str) -> str:
    """``ARRAY<VARIANT>`` of an array, NULL for anything else."""
    return f"try_variant_get({v}, '$', 'array<variant>')"


def is_array(v: str) -> str:
    """Whether there is an array; the elements are not copied."""
    return f"try_variant_get({v}, '$', 'array<struct<>>') IS NOT NULL"


def string_of(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def double_of(v: str) -> str:
    return f"try_variant_get({v}, '$', 'double')"


def whole_of(v: str) -> str:
    return f"try_variant_get({v}, '$', 'decimal(38,0)')"


def shape_of(v: str) -> str:
    """Type text such as ``BIGINT``, ``DECIMAL(3,1)`` or ``OBJECT<a: STRING>``."""
    return f"schema_of_variant({v})"


def is_infinite(v: str) -> str:
    """A number too large for a double: its value is lost."""
    return f"abs({double_of(v)}) = double('Infinity')"


def kind_of(v: str, shape: str | None = None) -> str:
    """object, array, string, boolean, null, integer or number.

    A number without a fractional part is an integer however it is written, and booleans
    are not numbers.
    """
    s = shape or shape_of(v)
    d = double_of(v)
    return (
        f"CASE WHEN {s} = 'STRING' THEN 'string' WHEN {s} = 'BIGINT' THEN 'integer'"
        f" WHEN {s} = 'BOOLEAN' THEN 'boolean' WHEN {s} = 'VOID' THEN 'null'"
        f" WHEN startswith({s}, 'OBJECT') THEN 'object' WHEN startswith({s}, 'ARRAY') THEN 'array'"
        f" WHEN startswith({s}, 'DECIMAL') THEN if(endswith({s}, ',0)'), 'integer', 'number')"
        f" WHEN {s} = 'DOUBLE' THEN if({d} = rint({d}) AND NOT {is_infinite(v)}, 'integer', 'number') END"
    )


def canonical(v: str, kind: str) -> str:
    """Text that is equal for equal JSON values: 1, 1.0 and 1e0 share it, "1" and true do not.

    Strings are put in quotes without escapes. Numbers inside objects and arrays are
    normalised except for exponent notation.
    """
    return (
        f"CASE {kind} WHEN 'integer' THEN coalesce(string({whole_of(v)}), string({double_of(v)}))"
        f" WHEN 'number' THEN string({double_of(v)})"
        f" WHEN 'string' THEN concat('\"', {string_of(v)}, '\"') ELSE to_json({v}) END"
    )


def number_of(v: str, kind: str) -> str:
    """Exact whole value where there is one, and the double; NULL unless a JSON number."""
    return (
        f"CASE WHEN {kind} IN ('integer', 'number') THEN named_struct("
        f"'whole', if({kind} = 'integer', {whole_of(v)}, NULL), 'approx', {double_of(v)}) END"
    )


def exact_of(v: str, shape: str) -> str:
    """Value as DECIMAL(38, 18) where that is exact, else NULL."""
    wide = f"try_variant_get({v}, '$', 'decimal(38,18)')"
    scale = f"try_cast(regexp_extract({shape}, ',([0-9]+)', 1) AS int)"
    text = f"try_cast(string({double_of(v)}) AS decimal(38,18))"
    return (
        f"CASE WHEN {shape} = 'BIGINT' THEN {wide} WHEN startswith({shape}, 'DECIMAL') THEN if({scale} <= 18, {wide}, NULL)"
        f" WHEN {shape} = 'DOUBLE' THEN if(double({text}) = {double_of(v)}, {text}, NULL) END"
    )


def from_text(text: str) -> str:
    """A SQL string as a VARIANT string."""
    return f"variant_get(to_variant_object(named_struct('t', {text})), '$.t', 'variant')"
