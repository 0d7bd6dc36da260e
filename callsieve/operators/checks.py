"""The checks of one node against one rule, as SQL expression text.

A violation is a struct ordered so that the least one is the primary violation: definite
ones first, then the shallowest path, then keyword rank, then path and text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Row

from callsieve.functions.labels import KEYWORD_RANK, OTHER_RANK
from callsieve.functions.sqltext import number, quote, strings
from callsieve.functions.variants import canonical, double_of, exact_of, is_infinite, kind_of, shape_of, string_of, whole_of

UNSUPPORTED = "unsupported"
Text = Callable[[str], str]

VIOLATION = "struct<held:boolean,depth:int,rank:int,path:array<string>,keyword:string,detail:string>"
NO_VIOLATION = f"cast(NULL AS {VIOLATION})"
NO_VIOLATIONS = f"cast(array() AS array<{VIOLATION}>)"


@dataclass
class Node:
    """One position of a call: texts of path, value, type text, kind, keys and elements.

    ``declared`` counts the declared properties that are present, where that is known. Violations
    of a ``bare`` node have neither path nor detail.
    """

    path: str
    v: str
    shape: str
    kind: str
    keys: str
    parts: str
    declared: str | None = None
    bare: bool = False

    @property
    def json(self) -> str:
        return f"to_json({self.v})"


class Check(NamedTuple):
    """A test that is true where a node fails, and the violation it then has."""

    fails: str
    found: str

    @property
    def one(self) -> str:
        return f"if({self.fails}, {self.found}, NULL)"

    @property
    def listed(self) -> str:
        return f"if({self.fails}, array({self.found}), {NO_VIOLATIONS})"


def matches(key: str, patterns: str) -> str:
    """Some of the patterns is found in the key."""
    return f"exists({patterns}, q -> {key} RLIKE concat('(?Ud)', q))"


class JoinedRule:
    """A rule that comes with the row: every demand may be there or not."""

    def __init__(self, expression: str):
        self.expression = expression

    def get(self, demand: str) -> str | None:
        return f"{self.expression}.{demand}"

    def guard(self, demand: str) -> str:
        return f"{self.get(demand)} IS NOT NULL AND "

    def fits(self, kind: str) -> str:
        allowed = self.get("type")
        whole = f"{kind} = 'integer' AND array_contains({allowed}, 'number')"
        return f"(array_contains({allowed}, {kind}) OR ({whole}))"

    def uncovered(self, keys: str) -> str:
        """Keys that are neither declared nor match a pattern of keys."""
        rest, patterns = f"array_except({keys}, {self.get('property_names')})", self.get("patterns")
        return f"if(size({patterns}) = 0, {rest}, filter({rest}, k -> NOT {matches('k', patterns)}))"

    def among(self, demand: str, node: Node) -> str:
        listed = self.get("enum") if demand == "enum" else f"array({self.get('const')})"
        return f"array_contains({listed}, {canonical(node.v, node.kind)})"


class LiteralRule:
    """A rule known when the query is built: absent demands give no check at all."""

    def __init__(self, rule: Row):
        self.rule = rule

    def get(self, demand: str) -> str | None:
        value = self.rule[demand]
        if demand == "additional_allowed":
            return None if value else "false"
        if demand == "property_names":
            return strings(value)
        if value is None or value is False:
            return None
        if isinstance(value, list):
            return strings(value)
        if isinstance(value, Row):
            whole, approx = number(value["whole"], "decimal(38,0)"), number(value["approx"], "double")
            return f"named_struct('whole', {whole}, 'approx', {approx})"
        if isinstance(value, bool):
            return "true"
        if isinstance(value, Decimal):
            return number(f"{value:f}", "decimal(38,18)")
        return str(value) if isinstance(value, int) else quote(value)

    def guard(self, demand: str) -> str:
        return ""

    def fits(self, kind: str) -> str:
        allowed = [*self.rule["type"], *(["integer"] if "number" in self.rule["type"] else [])]
        return f"{kind} IN ({', '.join(quote(t) for t in allowed)})"

    def uncovered(self, keys: str) -> str:
        return f"array_except({keys}, {self.get('property_names')})"

    def among(self, demand: str, node: Node) -> str:
        values = self.rule["enum"] if demand == "enum" else [self.rule["const"]]
        if not values:
            return f"({node.kind} IS NULL)"
        if all(v.startswith('"') for v in values):
            listed = ", ".join(quote(v[1:-1]) for v in values)
            return f"({node.kind} = 'string' AND {string_of(node.v)} IN ({listed}))"
        return f"{canonical(node.v, node.kind)} IN ({', '.join(quote(v) for v in values)})"


def violation(node: Node, keyword: str, detail: str, held: bool = False) -> str:
    rank = KEYWORD_RANK.get(keyword, OTHER_RANK)
    path, detail = ("cast(array() AS array<string>)", "cast(NULL AS string)") if node.bare else (node.path, detail)
    return (
        f"named_struct('held', {str(held).lower()}, 'depth', size({path}), 'rank', {rank},"
        f" 'path', {path}, 'keyword', {quote(keyword)}, 'detail', {detail})"
    )


def missing_key(node: Node, key: str) -> str:
    return violation(node, "required", f"concat('\\'', {key}, '\\' is a required property')")


def branches_fail(path: str, least: str, keyword: str) -> str:
    """A violation of ``anyOf``, ``oneOf`` or ``not`` from the least violation of each branch,
    or NULL. A branch without one is valid; one that only has held ones may be valid or not."""

    def found(held: bool) -> str:
        node = Node(path, "", "", "", "", "")
        return violation(node, keyword, quote(f"the value does not comply with {keyword}"), held)

    valid, open_ = "size(filter(m, x -> x IS NULL))", "size(filter(m, x -> x.held))"
    cases = {
        "anyOf": f"WHEN {valid} > 0 THEN NULL WHEN {open_} > 0 THEN {found(True)} ELSE {found(False)}",
        "oneOf": f"WHEN {valid} > 1 THEN {found(False)} WHEN {open_} > 0 THEN {found(True)}"
        f" WHEN {valid} = 1 THEN NULL ELSE {found(False)}",
        "not": f"WHEN {valid} > 0 THEN {found(False)} WHEN {open_} > 0 THEN {found(True)}",
    }
    return f"transform(array({least}), m -> CASE {cases[keyword]} END)[0]"


def _quoted(names: str) -> str:
    return f"array_join(transform({names}, t -> concat('\\'', t, '\\'')), ', ')"


def _beyond(node: Node, bound: str, operator: str) -> str:
    """Compare exactly as whole numbers where possible, as doubles otherwise."""
    exact = f"if({node.kind} = 'integer', {whole_of(node.v)} {operator} {bound}.whole, NULL)"
    rough = f"if({node.kind} IN ('integer', 'number'), {double_of(node.v)} {operator} {bound}.approx, NULL)"
    return f"coalesce({exact}, {rough})"


def node_checks(node: Node, rule: JoinedRule | LiteralRule) -> list[Check]:
    """One check per keyword."""
    return [one for checks in checks_by_kind(node, rule).values() for one in checks]


#: Kinds that a keyword can find fault with; of other kinds it need not be looked at.
ALL, NUMERIC, NESTED = "", "integer number", "object array"
#: The demands that are looked at for values of these kinds; a switch demands something if it is on.
DEMANDS = {
    ALL: ("type", "enum", "const", "never", "unsupported"),
    NUMERIC: ("minimum", "maximum", "exclusive_minimum", "exclusive_maximum", "multiple_of", "judges_value"),
    "string": ("min_length", "max_length", "pattern"),
    "object": ("additional_allowed", "min_properties", "max_properties"),
    "array": ("min_items", "max_items", "distinct"),
    NESTED: ("has_container",),
}
SWITCHES = ("never", "unsupported", "judges_value", "distinct", "has_container")


def asks(rule: str, kinds: str) -> str:
    """Whether a rule that comes with the row has a demand for values of these kinds."""

    def test(demand: str) -> str:
        value = f"{rule}.{demand}"
        if demand == "additional_allowed":
            return f"NOT coalesce({value}, true)"
        return f"coalesce({value}, false)" if demand in SWITCHES else f"{value} IS NOT NULL"

    return "(" + " OR ".join(test(demand) for demand in DEMANDS[kinds]) + ")"


def checks_by_kind(node: Node, rule: JoinedRule | LiteralRule) -> dict[str, list[Check]]:
    """The checks of ``node_checks`` by the kinds of values that they can find fault with."""
    out: dict[str, list[Check]] = {}

    def check(demand: str, fails: Text, keyword: str, detail: Text, held: bool = False, kinds: str = ALL) -> None:
        """``fails`` and ``detail`` build their texts around that of the demand's value; nothing
        is ever replaced in a text that already holds values of a schema."""
        assert demand in DEMANDS[kinds], demand
        value = rule.get(demand)
        if value is not None:
            out.setdefault(kinds, []).append(Check(fails(value), violation(node, keyword, detail(value), held)))

    def check_if_present(demand: str, fails: Text, keyword: str, detail: Text, kinds: str = ALL) -> None:
        check(demand, lambda it: rule.guard(demand) + fails(it), keyword, detail, kinds=kinds)

    fits = f"NOT {rule.fits(node.kind)}" if rule.get("type") is not None else ""
    check("type", lambda it: fits, "type", lambda it: f"concat({node.json}, ' is not of type ', {_quoted(it)})")
    among = {d: f"NOT {rule.among(d, node)}" for d in ("enum", "const") if rule.get(d) is not None}
    check_if_present(
        "enum",
        lambda it: among["enum"],
        "enum",
        lambda it: f"concat({node.json}, ' is not one of [', array_join({it}, ', '), ']')",
    )
    check_if_present("const", lambda it: among["const"], "const", lambda it: f"concat({it}, ' was expected')")

    if rule.get("additional_allowed") is not None:
        extra = rule.uncovered(node.keys)
        surplus = f"size({node.keys}) > {node.declared}" if node.declared else f"size({extra}) > 0"
        check(
            "additional_allowed",
            lambda it: f"NOT {it} AND {node.kind} = 'object' AND {surplus}",
            "additionalProperties",
            lambda it: f"concat('Additional properties are not allowed (', {_quoted(f'array_sort({extra})')},"
            f" if(size({extra}) = 1, ' was', ' were'), ' unexpected)')",
            kinds="object",
        )

    sized = (
        ("items", "Items", "array", f"size({node.parts})", " is too short", " is too long"),
        ("length", "Length", "string", f"length({string_of(node.v)})", " is too short", " is too long"),
        (
            "properties",
            "Properties",
            "object",
            f"size({node.keys})",
            " does not have enough properties",
            " has too many properties",
        ),
    )
    for part, suffix, kind, size, few, many in sized:
        for side, operator, words in (("min", "<", few), ("max", ">", many)):
            check_if_present(
                f"{side}_{part}",
                lambda it, k=kind, n=size, o=operator: f"{node.kind} = '{k}' AND {n} {o} {it}",
                f"{side}{suffix}",
                lambda it, w=words: f"concat({node.json}, '{w}')",
                kind,
            )

    bounds = (
        ("minimum", "minimum", "<", "less than the minimum"),
        ("maximum", "maximum", ">", "greater than the maximum"),
        ("exclusive_minimum", "exclusiveMinimum", "<=", "less than or equal to the minimum"),
        ("exclusive_maximum", "exclusiveMaximum", ">=", "greater than or equal to the maximum"),
    )
    for demand, keyword, operator, words in bounds:
        check_if_present(
            demand,
            lambda it, o=operator: _beyond(node, it, o),
            keyword,
            lambda it, w=words: f"concat({node.json}, ' is {w} of ', coalesce(string({it}.whole), string({it}.approx)))",
            NUMERIC,
        )

    numeric = f"{node.kind} IN ('integer', 'number')"

    def uneven(it: str) -> str:
        """Whether division by ``it`` leaves a rest; NULL where the value is not exact."""
        exact = exact_of(node.v, node.shape)
        return (
            f"CASE WHEN {exact} IS NOT NULL THEN {exact} % {it} <> 0 WHEN {node.kind} = 'integer' AND {it} = floor({it})"
            f" THEN {whole_of(node.v)} % cast({it} AS decimal(38,0)) <> 0 END"
        )

    check_if_present(
        "multiple_of",
        lambda it: f"{numeric} AND {uneven(it)}",
        "multipleOf",
        lambda it: f"concat({node.json}, ' is not a multiple of ', string({it}))",
        NUMERIC,
    )
    values = f"transform({node.parts}, y -> {canonical('y', kind_of('y'))})"
    check(
        "distinct",
        lambda it: f"{it} AND {node.kind} = 'array' AND size(array_distinct({values})) < size({node.parts})",
        "uniqueItems",
        lambda it: f"concat({node.json}, ' has non-unique elements')",
        kinds="array",
    )

    # (?U): classes are Unicode; (?d): only a newline ends a line.
    check_if_present(
        "pattern",
        lambda it: f"{node.kind} = 'string' AND NOT {string_of(node.v)} RLIKE concat('(?Ud)', {it})",
        "pattern",
        lambda it: f"concat({node.json}, ' does not match ', {it})",
        "string",
    )
    check(
        "never",
        lambda it: f"{it} AND {node.kind} IS NOT NULL",
        "false",
        lambda it: f"concat('False schema does not allow ', {node.json})",
    )

    # A number lost in parsing gives no verdict, but never a pass.
    def unclear(it: str) -> str:
        return "'a keyword that is not judged, or a number out of range or not comparable'"

    check("unsupported", lambda it: f"{it} AND {node.kind} IS NOT NULL", UNSUPPORTED, unclear, True)
    check("multiple_of", lambda it: f"{rule.guard('multiple_of')}{numeric} AND ({uneven(it)}) IS NULL", "number", unclear, True, NUMERIC)
    nested = f"exists({node.parts}, y -> {kind_of('y')} IN ('object', 'array') AND contains({shape_of('y')}, 'DOUBLE'))"
    check("distinct", lambda it: f"{it} AND {node.kind} = 'array' AND {nested}", "number", unclear, True, "array")
    infinite = f"{node.shape} = 'DOUBLE' AND {is_infinite(node.v)}"
    check("judges_value", lambda it: f"{it} AND {infinite}", "number", unclear, True, NUMERIC)
    loose = f"{node.kind} IN ('object', 'array') AND contains({node.shape}, 'DOUBLE')"
    check("has_container", lambda it: f"{it} AND {loose}", "number", unclear, True, NESTED)
    return out
