"""Schema catalog and its compilation to rules.

Every row brings its own JSON Schema, but few of them differ. Each distinct schema gets an
id and is compiled once into an array of rules, one per place in its text that holds a schema. A place
is named by its JSON pointer and compiled once, however often it is referred to; rules are linked by
their numbers, so a schema that refers to itself is no larger than its text. Checking a call is then
a matter of following links.

Places are found by a loop inside the row, which opens the places just found until there are none:
no level of nesting is a level of the plan. References may name any pointer, an anchor or an ``$id``
of the same schema.

``at`` names the position of a call that a place applies to: ``/parameters/tags/*`` is any element of
``tags``. Keys are escaped, so dots, slashes and stars in a key are safe. Schemas that apply beside
another one have a step behind a star: ``*allOf:0``, ``*not``, ``*additional`` (members that are not
declared), ``*$defs:name`` and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.functions.jsontext import depth_bound, parse_strict
from callsieve.functions.sqltext import any_of, let, quote, strings
from callsieve.functions.variants import (
    canonical,
    double_of,
    elements,
    exact_of,
    field,
    fields,
    is_infinite,
    kind_of,
    number_of,
    shape_of,
    string_of,
)

NO_SCHEMA = "none"

# JSON Schema type names and keywords.
TYPE_NAMES = ("array", "boolean", "integer", "null", "number", "object", "string")
COUNT_KEYWORDS = {
    "minItems": "min_items",
    "maxItems": "max_items",
    "minLength": "min_length",
    "maxLength": "max_length",
    "minProperties": "min_properties",
    "maxProperties": "max_properties",
    "minContains": "min_contains",
    "maxContains": "max_contains",
}
BOUND_KEYWORDS = {
    "minimum": "minimum",
    "maximum": "maximum",
    "exclusiveMinimum": "exclusive_minimum",
    "exclusiveMaximum": "exclusive_maximum",
}
PLAIN_KEYWORDS = (
    "type",
    "enum",
    "const",
    "required",
    "properties",
    "additionalProperties",
    "items",
    "pattern",
    "uniqueItems",
    "multipleOf",
    "allOf",
    "anyOf",
    "oneOf",
    "not",
    "if",
    "then",
    "else",
    "$ref",
    "$anchor",
    "$id",
    "patternProperties",
    "propertyNames",
    "unevaluatedProperties",
    "dependentRequired",
    "dependentSchemas",
    "dependencies",
    "prefixItems",
    "additionalItems",
    "contains",
    "unevaluatedItems",
)
BRANCHED = ("allOf", "anyOf", "oneOf")
# Keywords that hold schemas: by name, in a list, or a single one.
SCHEMA_MAPS = ("properties", "patternProperties", "dependentSchemas", "dependencies", "$defs", "definitions")
SCHEMA_LISTS = (*BRANCHED, "prefixItems")
SCHEMA_ONES = (
    "items",
    "additionalItems",
    "contains",
    "additionalProperties",
    "propertyNames",
    "not",
    "if",
    "then",
    "else",
    "unevaluatedItems",
    "unevaluatedProperties",
)
# May be true or false without a schema.
SWITCHES = ("additionalProperties", "unevaluatedItems", "unevaluatedProperties")
# Keywords that apply schemas to the same value.
BESIDE = (*BRANCHED, "not", "if", "then", "else", "dependentSchemas", "$ref")
#: Number of each link from a rule to another, by the keyword that makes it.
EDGES = {
    keyword: number
    for number, keyword in enumerate(
        (
            *BESIDE,
            "properties",
            "patternProperties",
            "additionalProperties",
            "unevaluatedProperties",
            "propertyNames",
            "prefixItems",
            "items",
            "contains",
            "unevaluatedItems",
        )
    )
}
# Links that rules written out as expressions can follow.
PLAIN_EDGES = tuple(EDGES[k] for k in (*BRANCHED, "not", "$ref", "properties", "additionalProperties", "items"))
UNSUPPORTED_KEYWORDS = ("$dynamicRef", "$recursiveRef")
# Drafts whose integer and bound rules differ from the current ones.
OLD_DRAFTS = "draft-0[34]"
# Drafts in which a reference hides what stands beside it.
LONE_REF_DRAFTS = "draft-0[67]"
# Drafts in which a list of items stands for the first elements.
LISTED_ITEMS_DRAFTS = "draft-0[67]|2019-09"
# Keywords that some drafts do not know yet, or no longer.
UNKNOWN_IN = {
    **dict.fromkeys(("if", "then", "else"), "draft-06"),
    **dict.fromkeys(
        ("dependentRequired", "dependentSchemas", "unevaluatedItems", "unevaluatedProperties", "minContains", "maxContains"),
        LONE_REF_DRAFTS,
    ),
    "prefixItems": LISTED_ITEMS_DRAFTS,
}

# Patterns read alike by the common regex dialects: literals, classes, alternatives, look-ahead, greedy and
# lazy quantifiers, groups in groups. Anything else makes the schema unsupported.
_UNIT = r"\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}"
_CLASS = rf"\[\^?(?:[a-z]-[a-z]|[A-Z]-[A-Z]|[0-9]-[0-9]|\\[dwstnr./\-\[\]()*+?$|{{}}\\]|{_UNIT}|[^\[\]\\^&-])+-?\]"
_ATOM = rf"(?:[^\\\[\](){{}}*+?|^$]|\\[dwsDWStnr.\-/\\()\[\]{{}}*+?|^$]|{_UNIT}|{_CLASS})"
_QUANTIFIER = r"(?:(?:[*+?]|\{\d{1,3}(?:,\d{0,3})?\})\??)?"


def _alternatives(depth: int) -> str:
    """Text of alternatives whose groups nest up to ``depth`` deep."""
    inner = ""
    if depth:
        below = _alternatives(depth - 1)
        inner = rf"|\((?:\?:)?{below}\){_QUANTIFIER}|\(\?[=!]{below}\)"
    return rf"(?:[|^$]|{_ATOM}{_QUANTIFIER}{inner})*"


PORTABLE_PATTERN = rf"(?s)\A{_alternatives(3)}\z"

RULE_FIELDS = (
    "pointer",
    "path",
    "at",
    "type",
    "enum",
    "const",
    "required",
    "property_names",
    "additional_allowed",
    *COUNT_KEYWORDS.values(),
    *BOUND_KEYWORDS.values(),
    "pattern",
    "never",
    "judges_value",
    "has_container",
    "n_allOf",
    "n_anyOf",
    "n_oneOf",
    "negated",
    "referred",
    "rest",
    "unsupported",
    "multiple_of",
    "distinct",
    "patterns",
    "needs",
    "n_first",
    "counted",
    "conditional",
    "judges_members",
    "judges_elements",
    "closed_members",
    "closed_elements",
)
#: Groups of links that a rule keeps apart, and the keywords of each.
LINKED = {
    "beside": BESIDE,
    "wide": ("patternProperties", "unevaluatedProperties"),
    "inner": ("prefixItems", "items", "contains", "unevaluatedItems"),
}


def schema_key(schema: Column | str) -> Column:
    """Stable id of a schema text. A missing schema gets a fixed id, as NULL never joins."""
    s = F.col(schema) if isinstance(schema, str) else schema
    return F.coalesce(F.sha2(s, 256), F.lit(NO_SCHEMA))


def with_schema_id(df: DataFrame, schema: str = "schema") -> DataFrame:
    return df.withColumn("schema_id", schema_key(schema))


def schema_catalog(df: DataFrame, schema: str = "schema") -> DataFrame:
    """Distinct ``(schema_id, schema)``.

    Both columns are grouping keys, so the distinct is a hash aggregate that reduces before
    the shuffle, however often one schema occurs.
    """
    return df.select(schema_key(schema).alias("schema_id"), F.col(schema).alias("schema")).distinct()


def escape_key(key: str) -> str:
    return f"replace(replace(replace({key}, '~', '~0'), '/', '~1'), '*', '~2')"


def _pointer_key(key: str) -> str:
    return f"replace(replace({key}, '~', '~0'), '/', '~1')"


def _decoded(text: str) -> str:
    """Text of a fragment without percent signs' escapes; it may be malformed."""
    return f"if(contains({text}, '%'), coalesce(try_url_decode(replace({text}, '+', '%2B')), {text}), {text})"


def _resolved(base: str, link: str) -> str:
    """Address of ``link`` as seen from ``base``; neither has a fragment."""
    site = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)"
    return (
        f"CASE WHEN {link} = '' THEN {base} WHEN {link} RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:' THEN {link}"
        f" WHEN startswith({link}, '/') THEN concat({site}, {link})"
        f" ELSE concat(regexp_replace({base}, '[^/]*$', ''), {link}) END"
    )


# A place that holds a schema: its pointer, the position it applies to, the pointer and address of the
# resource it belongs to, and its value.
_PLACE = "struct<pointer:string,at:string,path:array<string>,base:string,address:string,v:variant>"
_NO_PLACES = f"cast(array() AS array<{_PLACE}>)"


def _addressed(places: str) -> str:
    """``places`` that inherit an address, with the one that their own ``$id`` gives them."""
    own = f"split_part({string_of(field('c.v', '$id'))}, '#', 1)"
    named = f"coalesce({own}, '') <> ''"
    return (
        f"transform({places}, c -> named_struct('pointer', c.pointer, 'at', c.at, 'path', c.path,"
        f" 'base', if({named}, c.pointer, c.base),"
        f" 'address', if({named}, {_resolved('c.address', own)}, c.address), 'v', c.v))"
    )


def _inside(node: str) -> str:
    """Places one step below ``node``."""

    def place(step: str, at: str, path: str, value: str) -> str:
        return (
            f"named_struct('pointer', concat({node}.pointer, '/', {step}), 'at', concat({node}.at, {at}), 'path', {path},"
            f" 'base', {node}.base, 'address', {node}.address, 'v', {value})"
        )

    def inner(step: str) -> str:
        return f"concat({node}.path, array({step}))"

    keyword = _pointer_key("e.key")
    by_name = place(
        f"concat({keyword}, '/', {_pointer_key('m.key')})",
        f"if(e.key = 'properties', concat('/', {escape_key('m.key')}), concat('/*', e.key, ':', {escape_key('m.key')}))",
        f"CASE e.key WHEN 'properties' THEN {inner('m.key')} WHEN 'patternProperties' THEN {inner(quote('*'))}"
        f" WHEN 'dependentSchemas' THEN {node}.path WHEN 'dependencies' THEN {node}.path END",
        "m.value",
    )
    schemas = f"filter(map_entries({fields('e.value')}), m -> e.key <> 'dependencies' OR {elements('m.value')} IS NULL)"
    in_list = place(
        f"concat({keyword}, '/', i)",
        "concat('/*', e.key, ':', i)",
        f"if(e.key IN ('prefixItems', 'items'), {inner(quote('[]'))}, {node}.path)",
        "b",
    )
    single = place(
        keyword,
        "CASE e.key WHEN 'items' THEN '/*' WHEN 'additionalProperties' THEN '/*additional' ELSE concat('/*', e.key) END",
        f"CASE WHEN e.key IN ('items', 'additionalItems', 'contains', 'unevaluatedItems') THEN {inner(quote('[]'))}"
        f" WHEN e.key IN ('additionalProperties', 'unevaluatedProperties') THEN {inner(quote('*'))} ELSE {node}.path END",
        "e.value",
    )
    held = (
        f"CASE WHEN e.key IN ({_listed(SCHEMA_MAPS)}) THEN transform({schemas}, m -> {by_name})"
        f" WHEN e.key IN ({_listed(SCHEMA_LISTS)}) OR {elements('e.value')} IS NOT NULL"
        f" THEN transform({elements('e.value')}, (b, i) -> {in_list})"
        f" WHEN e.key IN ({_listed(SWITCHES)}) AND coalesce(size({fields('e.value')}), 0) = 0 THEN NULL"
        f" ELSE array({single}) END"
    )
    known = f"filter(map_entries({fields(f'{node}.v')}), e -> e.key IN ({_listed((*SCHEMA_MAPS, *SCHEMA_LISTS, *SCHEMA_ONES))}))"
    return f"coalesce(flatten(transform({known}, e -> coalesce({held}, {_NO_PLACES}))), {_NO_PLACES})"


def _listed(names: tuple[str, ...]) -> str:
    return ", ".join(quote(n) for n in names)


def _pointed(pointers: str) -> str:
    """Places at ``pointers`` into the text that no keyword leads to, where there is a value."""
    step = let(
        _decoded("s"),
        "d",
        f"coalesce({fields('x.v')}[replace(replace(d, '~1', '/'), '~0', '~')], get({elements('x.v')}, try_cast(d AS int)))",
    )
    value = (
        f"aggregate(slice(split(p, '/'), 2, size(split(p, '/'))), named_struct('v', root),"
        f" (x, s) -> named_struct('v', {step}), x -> x.v)"
    )
    nowhere = "cast(NULL AS array<string>)"
    place = (
        f"transform({pointers}, p -> named_struct('pointer', p, 'at', concat('/*ref:', replace(p, '/', '~1')),"
        f" 'path', {nowhere}, 'base', '', 'address', '', 'v', {value}))"
    )
    return f"filter({place}, n -> n.v IS NOT NULL)"


def _places() -> str:
    """All places of ``root``: from the top downwards, then what references lead to, until nothing is new."""
    top = (
        f"cast(array(named_struct('pointer', '', 'at', '', 'path', cast(array() AS array<string>), 'base', '',"
        f" 'address', '', 'v', root)) AS array<{_PLACE}>)"
    )

    def state(opened: str, done: str, finished: str) -> str:
        return f"named_struct('open', {opened}, 'done', {done}, 'finished', {finished})"

    below = f"flatten(transform(acc.open, n -> {_addressed(_inside('n'))}))"
    new = let("transform(acc.done, d -> d.pointer)", "known", f"filter({below}, c -> NOT array_contains(known, c.pointer))")
    link = string_of(field("d.v", "$ref"))
    local = f"array_compact(transform(acc.done, d -> if(startswith({link}, '#/'), concat(d.base, {_decoded(f'substring({link}, 2)')}), NULL)))"
    targets = f"array_except(array_distinct({local}), transform(acc.done, d -> d.pointer))"
    going = (
        "CASE WHEN acc.finished THEN acc WHEN size(acc.open) > 0 THEN "
        + let(new, "n", state("n", "concat(acc.done, n)", "false"))
        + " ELSE "
        + let(_pointed(targets), "t", state("t", "concat(acc.done, t)", "size(t) = 0"))
        + " END"
    )
    rounds = "sequence(1, rounds)"
    start = let(f"cast({_addressed(top)} AS array<{_PLACE}>)", "t", state("t", "t", "false"))
    return f"aggregate({rounds}, {start}, (acc, i) -> {going}, acc -> acc.done)"


def _nodes(catalog: DataFrame) -> DataFrame:
    """One row per place of each schema; a schema that is not JSON keeps one empty row."""
    # Only what a reference to an odd place leads to takes rounds of its own.
    links = F.array_distinct(F.regexp_extract_all("schema", F.lit(r'"\$ref"\s*:\s*"([^"]*)"'), 1))
    odd = F.size(F.filter(links, lambda x: ~x.rlike(r"^#(/(\$defs|definitions)/[^/]+)?$")))
    rounds = (depth_bound("schema") + 2) * (1 + F.greatest(odd, F.lit(0)))
    df = catalog.select("schema_id", parse_strict("schema").alias("root"), rounds.alias("rounds"))
    df = df.selectExpr("schema_id", "root", f"explode_outer(if(root IS NULL, NULL, {_places()})) AS n")
    return df.selectExpr("schema_id", "root", "n.pointer", "n.path", "n.at", "n.base", "n.address", "n.v")


def _malformed() -> str:
    """A keyword holds a value of the wrong kind, so the schema itself is invalid."""
    names = ", ".join(quote(t) for t in TYPE_NAMES)
    type_list = (
        f"coalesce(size({elements('k_type')}) > 0 AND forall({elements('k_type')},"
        f" x -> {shape_of('x')} = 'STRING' AND {string_of('x')} IN ({names})), false)"
    )

    def texts(v: str) -> str:
        return (
            f"forall({elements(v)}, x -> {shape_of('x')} = 'STRING') AND"
            f" size(array_distinct(transform({elements(v)}, x -> {string_of('x')}))) = size({elements(v)})"
        )

    good = {
        "type": f"(t_type = 'string' AND {string_of('k_type')} IN ({names})) OR {type_list}",
        "enum": "t_enum = 'array'",
        "required": texts("k_required"),
        "properties": f"t_properties = 'object' AND forall(map_values({fields('k_properties')}),"
        f" x -> {shape_of('x')} = 'BOOLEAN' OR startswith({shape_of('x')}, 'OBJECT'))",
        "additionalProperties": "t_additionalProperties IN ('object', 'boolean')",
        "items": "t_items IN ('object', 'boolean', 'array')",
        "pattern": "t_pattern = 'string'",
        "uniqueItems": "t_uniqueItems = 'boolean'",
        "not": "t_not IN ('object', 'boolean')",
        "$ref": "`t_$ref` = 'string'",
        "multipleOf": f"t_multipleOf IN ('integer', 'number') AND {double_of('k_multipleOf')} > 0",
        "patternProperties": f"{fields('k_patternProperties')} IS NOT NULL",
        "dependentRequired": f"forall(map_values({fields('k_dependentRequired')}), y -> coalesce({texts('y')}, false))",
        "dependentSchemas": f"{fields('k_dependentSchemas')} IS NOT NULL",
        "dependencies": f"{fields('k_dependencies')} IS NOT NULL",
        "prefixItems": f"size({elements('k_prefixItems')}) > 0",
        "$anchor": f"{string_of('`k_$anchor`')} IS NOT NULL",
        "$id": f"{string_of('`k_$id`')} IS NOT NULL",
    }
    good |= {k: f"size({elements(f'k_{k}')}) > 0" for k in BRANCHED}
    good |= {k: f"t_{k} = 'integer' AND {double_of(f'k_{k}')} >= 0" for k in COUNT_KEYWORDS}
    good |= {k: f"t_{k} IN ('integer', 'number')" for k in BOUND_KEYWORDS}
    # That these hold schemas is seen at the places of these.
    good |= {k: f"{elements(f'k_{k}')} IS NULL" for k in ("if", "then", "else", "contains", "propertyNames")}
    good |= {
        k: f"{fields(f'k_{k}')} IS NOT NULL OR try_variant_get(k_{k}, '$', 'boolean') IS NOT NULL"
        for k in ("unevaluatedItems", "unevaluatedProperties")
    }
    wrong = [f"`k_{k}` IS NOT NULL AND NOT coalesce({test}, false)" for k, test in good.items()]
    return any_of(["v IS NULL", "t_self NOT IN ('object', 'boolean')", *wrong])


def _unsupported() -> str:
    """The place uses a keyword, or a value, that the rules cannot express."""
    return any_of(
        [
            f"arrays_overlap(map_keys(members), {strings(UNSUPPORTED_KEYWORDS)})",
            "t_items = 'array' AND NOT listed_items",
            "k_dependencies IS NOT NULL AND NOT lone_ref_draft",
            "odd_pattern",
            "odd_keys",
            "unclear",
            f"k_multipleOf IS NOT NULL AND {exact_of('k_multipleOf', 's_multipleOf')} IS NULL",
            *[f"t_{k} = 'number' AND {is_infinite(f'k_{k}')}" for k in BOUND_KEYWORDS],
        ]
    )


def _odd(pattern: str) -> str:
    def pairs(found: str, kind: str) -> str:
        """Some range of the pattern runs backwards."""
        low, high = (f"regexp_extract_all({pattern}, {quote(found)}, {i})" for i in (1, 2))
        return f"exists(zip_with({low}, {high}, (a, b) -> cast(a AS {kind}) > cast(b AS {kind})), t -> t)"

    turned = [pairs(r"\{(\d+),(\d+)\}", "int"), pairs(r"([a-zA-Z0-9])-([a-zA-Z0-9])", "string")]
    return any_of([f"NOT {pattern} RLIKE {quote(PORTABLE_PATTERN)}", *turned])


def _unclear() -> str:
    """Exponent notation cannot be compared inside containers, and overflow not at all."""
    return any_of(
        [
            f"exists(literals, x -> {kind_of('x')} IN ('object', 'array') AND contains({shape_of('x')}, 'DOUBLE'))",
            f"exists(literals, x -> {shape_of('x')} = 'DOUBLE' AND {is_infinite('x')})",
        ]
    )


_TEXTS = "cast(array() AS array<string>)"
_LINK = "struct<edge:int,key:string,to:string>"


def _links() -> str:
    """Links of a place to others, by pointer; that of a reference is found later."""

    def link(keyword: str, key: str, step: str) -> str:
        return f"named_struct('edge', {EDGES[keyword]}, 'key', {key}, 'to', concat(pointer, {step}))"

    def listed(keyword: str, source: str) -> str:
        one = link(keyword, "string(i)", f"'/{source}/', i")
        return f"transform({elements(f'k_{source}')}, (b, i) -> {one})"

    def named(keyword: str, source: str, chosen: str = "true") -> str:
        one = link(keyword, "e.key", f"'/{source}/', {_pointer_key('e.key')}")
        return f"transform(filter(map_entries({fields(f'k_{source}')}), e -> {chosen}), e -> {one})"

    def single(keyword: str, source: str, test: str = "true") -> str:
        one = link(keyword, "''", f"'/{source}'")
        return f"if(k_{source} IS NOT NULL AND {test}, array({one}), NULL)"

    found = [listed(k, k) for k in SCHEMA_LISTS]
    found += [named(k, k) for k in ("properties", "dependentSchemas")]
    found += [named("patternProperties", "patternProperties", "NOT odd_keys")]
    found += [named("dependentSchemas", "dependencies", f"{elements('e.value')} IS NULL")]
    found += [single(k, k) for k in ("not", "contains", "propertyNames", "if")]
    found += [single(k, k, "k_if IS NOT NULL") for k in ("then", "else")]
    found += [single(k, k, f"coalesce(size({fields(f'k_{k}')}), 0) > 0") for k in SWITCHES]
    found += [single("items", "items", "t_items <> 'array'")]
    found += [f"if(t_items = 'array' AND listed_items, {listed('prefixItems', 'items')}, NULL)"]
    found += [single("items", "additionalItems", "t_items = 'array' AND listed_items")]
    none = f"cast(array() AS array<{_LINK}>)"
    return f"concat({', '.join(f'coalesce({f}, {none})' for f in found)})"


def _everything(v: str) -> str:
    """A schema that everything fits: true or one without keywords."""
    return f"coalesce(try_variant_get({v}, '$', 'boolean'), size({fields(v)}) = 0, false)"


def _rule() -> str:
    """What one place demands; a NULL member demands nothing."""
    needs = "transform(map_entries({0}), e -> named_struct('key', e.key, 'needs', try_variant_get(e.value, '$', 'array<string>')))"
    none = "cast(array() AS array<struct<key:string,needs:array<string>>>)"
    listed = f"filter({needs.format(fields('k_dependencies'))}, x -> x.needs IS NOT NULL)"
    parts = {
        "pointer": "pointer",
        "path": "path",
        "at": "at",
        "type": "coalesce(try_variant_get(k_type, '$', 'array<string>'),"
        f" if(t_type = 'string', array({string_of('k_type')}), NULL))",
        "enum": f"if(unclear, NULL, transform({elements('k_enum')}, x -> {canonical('x', kind_of('x'))}))",
        "const": f"if(k_const IS NULL OR unclear, NULL, {canonical('k_const', 't_const')})",
        "required": "try_variant_get(k_required, '$', 'array<string>')",
        "property_names": f"coalesce(map_keys({fields('k_properties')}), {_TEXTS})",
        # With a pattern of keys that cannot be read, any member may be declared.
        "additional_allowed": "coalesce(try_variant_get(k_additionalProperties, '$', 'boolean'), true) OR odd_keys",
    }
    parts |= {f: f"try_variant_get(k_{k}, '$', 'bigint')" for k, f in COUNT_KEYWORDS.items()}
    parts |= {f: number_of(f"k_{k}", f"t_{k}") for k, f in BOUND_KEYWORDS.items()}
    judged = " OR ".join(f"k_{k} IS NOT NULL" for k in ("type", "enum", "const", *BOUND_KEYWORDS))
    parts |= {
        "pattern": f"if(odd_pattern, NULL, {string_of('k_pattern')})",
        "never": "t_self = 'boolean' AND NOT try_variant_get(v, '$', 'boolean')",
        "judges_value": judged,
        "has_container": f"exists(literals, x -> {kind_of('x')} IN ('object', 'array'))",
    }
    parts |= {f"n_{k}": f"coalesce(size({elements(f'k_{k}')}), 0)" for k in BRANCHED}
    parts |= {
        "negated": "k_not IS NOT NULL",
        "referred": "`k_$ref` IS NOT NULL",
        "rest": f"coalesce(size({fields('k_additionalProperties')}) > 0, false)",
        "unsupported": "unsupported",
        "multiple_of": exact_of("k_multipleOf", "s_multipleOf"),
        "distinct": "coalesce(try_variant_get(k_uniqueItems, '$', 'boolean'), false)",
        "patterns": f"coalesce(if(odd_keys, NULL, map_keys({fields('k_patternProperties')})), {_TEXTS})",
        "needs": f"concat(coalesce({needs.format(fields('k_dependentRequired'))}, {none}), coalesce({listed}, {none}))",
        "n_first": f"coalesce(size({elements('k_prefixItems')}), if(listed_items, size({elements('k_items')}), NULL), 0)",
        "counted": "k_contains IS NOT NULL",
        "conditional": "k_if IS NOT NULL",
        "judges_members": f"k_additionalProperties IS NOT NULL OR {_everything('k_unevaluatedProperties')}",
        "judges_elements": _everything("k_unevaluatedItems"),
        "closed_members": "coalesce(NOT try_variant_get(k_unevaluatedProperties, '$', 'boolean'), false)",
        "closed_elements": "coalesce(NOT try_variant_get(k_unevaluatedItems, '$', 'boolean'), false)",
    }
    fragment = f"split_part({string_of('`k_$ref`')}, '#', 2)"
    own = f"coalesce({string_of('`k_$anchor`')}, if(startswith({string_of('`k_$id`')}, '#'), substring({string_of('`k_$id`')}, 2), NULL))"
    parts = {f: parts[f] for f in RULE_FIELDS} | {
        "links": _links(),
        "ref_address": _resolved("address", f"split_part({string_of('`k_$ref`')}, '#', 1)"),
        "ref_fragment": _decoded(fragment),
        "address": "address",
        "is_base": "pointer = base",
        "anchor": own,
    }
    return "named_struct(" + ", ".join(f"'{f}', {e}" for f, e in parts.items()) + ")"


def _linked() -> str:
    """The sorted rules with links by number: those beside a rule, to members by pattern or to what is
    left of them, and to elements; to declared members in the order of their names."""

    def number(pointer: str) -> str:
        return f"int(array_position(z.pointers, {pointer})) - 1"

    def group(keywords: tuple[str, ...]) -> str:
        edges = ", ".join(str(EDGES[k]) for k in keywords)
        return (
            f"transform(filter(r.links, l -> l.edge IN ({edges})),"
            f" l -> named_struct('edge', l.edge, 'key', l.key, 'to', {number('l.to')}))"
        )

    def single(keyword: str) -> str:
        return f"coalesce(get({group((keyword,))}, 0).to, -1)"

    base = "get(filter(z.bases, b -> b.address = r.ref_address), 0).pointer"
    anchor = "get(filter(z.anchors, a -> a.address = r.ref_address AND a.anchor = r.ref_fragment), 0).pointer"
    target = (
        f"CASE WHEN r.ref_fragment IS NULL THEN NULL WHEN r.ref_fragment = '' THEN {base}"
        f" WHEN startswith(r.ref_fragment, '/') THEN concat({base}, r.ref_fragment) ELSE {anchor} END"
    )
    follow = f"if(y >= 0, array(named_struct('edge', {EDGES['$ref']}, 'key', '', 'to', y)), NULL)"
    none = "cast(array() AS array<struct<edge:int,key:string,to:int>>)"
    changed = {
        "referred": "y >= 0",
        "unsupported": "r.unsupported OR (r.referred AND y < 0)",
    }
    parts = [f"'{f}', {changed.get(f, f'r.{f}')}" for f in RULE_FIELDS]
    parts += [f"'{name}', {group(keywords)}" for name, keywords in LINKED.items() if name != "beside"]
    parts += [f"'beside', concat({group(LINKED['beside'])}, coalesce({follow}, {none}))"]
    parts += [f"'name_to', transform(r.property_names, k -> {number(f"concat(r.pointer, '/properties/', {_pointer_key('k')})")})"]
    parts += [f"'rest_to', {single('additionalProperties')}", f"'names_to', {single('propertyNames')}"]
    rule = let(f"coalesce({number(target)}, -1)", "y", f"named_struct({', '.join(parts)})")
    known = (
        "named_struct('pointers', transform(found, r -> r.pointer), 'bases', transform(filter(found, r -> r.is_base),"
        " r -> struct(r.address, r.pointer)), 'anchors', transform(filter(found, r -> r.anchor IS NOT NULL),"
        " r -> struct(r.address, r.anchor, r.pointer)))"
    )
    return let(known, "z", f"transform(found, r -> {rule})")


def longest_chain() -> str:
    """How many rules can apply to one value one after the other; a loop counts each of its rules once."""
    height = "1 + coalesce(array_max(transform(r.beside, l -> h[l.to])), 0)"
    return let(
        "size(filter(rules, r -> size(r.beside) > 0))",
        "n",
        f"if(n > 0, aggregate(sequence(1, n), transform(rules, r -> 1), (h, i) -> transform(rules, r -> {height}),"
        " h -> array_max(h)), 1)",
    )


def compile_schemas(catalog: DataFrame, at_most: int | None = None) -> DataFrame:
    """``(schema_id, status, tool, rules, chain)`` for each row of a schema catalog.

    ``status`` is ``ok``, ``partly`` (some place uses a keyword outside the rules; calls that
    have a value there get no verdict unless they fail elsewhere), ``unsupported_schema`` (a draft
    with other rules) or ``bad_schema`` (missing, not an object, or malformed). Rows are
    grouped by schema only here, so a group is as large as one schema. ``at_most`` is the number of
    schemas where it is known: more tasks than that would only set up the checks and find no row.
    """
    keywords = (*PLAIN_KEYWORDS, *COUNT_KEYWORDS, *BOUND_KEYWORDS)
    typed = (
        *("type", "enum", "const", "properties", "additionalProperties", "items", "pattern", "uniqueItems", "not", "$ref"),
        *("multipleOf", *COUNT_KEYWORDS, *BOUND_KEYWORDS),
    )
    # A catalog is small in bytes but costly per row: one shuffle by id spreads the work and
    # serves the grouping below. The number is given, or the few bytes would be coalesced.
    spark = catalog.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = min(tasks, max(at_most, 1)) if at_most is not None else tasks
    df = _nodes(catalog.repartition(tasks, "schema_id")).selectExpr(
        "*", f"{fields('v')} AS members", "try_variant_get(root, '$[\"$schema\"]', 'string') AS draft"
    )
    df = df.selectExpr(
        "*",
        f"coalesce(draft RLIKE '{OLD_DRAFTS}', false) AS old_draft",
        f"coalesce(draft RLIKE '{LONE_REF_DRAFTS}', false) AS lone_ref_draft",
        f"coalesce(draft RLIKE '{LISTED_ITEMS_DRAFTS}', false) AS listed_items",
    ).selectExpr("*", "lone_ref_draft AND members['$ref'] IS NOT NULL AS lone_ref")

    def keyword(k: str) -> str:
        unknown = [f"coalesce(draft RLIKE '{UNKNOWN_IN[k]}', false)"] if k in UNKNOWN_IN else []
        hidden = " OR ".join([*(["lone_ref"] if k != "$ref" else []), *unknown])
        return f"if({hidden}, NULL, members[{quote(k)}])" if hidden else f"members[{quote(k)}]"

    df = df.selectExpr("*", *[f"{keyword(k)} AS `k_{k}`" for k in keywords])
    df = df.selectExpr(
        "*",
        f"{kind_of('v')} AS t_self",
        f"concat(coalesce({elements('k_enum')}, array()), if(k_const IS NULL, array(), array(k_const))) AS literals",
        # Only keywords that occur are looked at: the kind of a missing one is NULL at once.
        *[f"if(`k_{k}` IS NULL, NULL, {shape_of(f'`k_{k}`')}) AS `s_{k}`" for k in typed],
    )
    pattern, keys = string_of("k_pattern"), f"map_keys({fields('k_patternProperties')})"
    df = df.selectExpr(
        "*",
        *[f"if(`s_{k}` IS NULL, NULL, {kind_of(f'`k_{k}`', f'`s_{k}`')}) AS `t_{k}`" for k in typed],
        f"{_odd(pattern)} AS odd_pattern",
        f"coalesce(exists({keys}, q -> {_odd('q')}), false) AS odd_keys",
        f"{_unclear()} AS unclear",
    ).selectExpr("*", f"{_unsupported()} AS unsupported")
    df = df.selectExpr(
        "schema_id",
        f"{_malformed()} AS malformed",
        "old_draft",
        "if(pointer = '', try_variant_get(v, '$.properties.tool.const', 'string'), NULL) AS tool",
        f"{_rule()} AS rule",
    )
    grouped = df.groupBy("schema_id").agg(
        F.bool_or("malformed").alias("malformed"),
        F.bool_or("old_draft").alias("old_draft"),
        F.max("tool").alias("tool"),
        F.array_sort(F.collect_list("rule")).alias("found"),
    )
    linked = grouped.selectExpr(
        "schema_id", "malformed", "old_draft", "tool", f"if(malformed OR old_draft, NULL, {_linked()}) AS rules"
    ).selectExpr("*", f"{longest_chain()} AS chain")
    status = (
        "CASE WHEN malformed THEN 'bad_schema' WHEN old_draft THEN 'unsupported_schema'"
        " WHEN exists(rules, r -> r.unsupported) THEN 'partly' ELSE 'ok' END"
    )
    return linked.selectExpr("schema_id", f"{status} AS status", "tool", "rules", "chain")


def constraint_table(compiled: DataFrame) -> DataFrame:
    """One row per ``(schema_id, path)`` with the demands at that position."""
    return compiled.select("schema_id", F.explode("rules").alias("rule")).select("schema_id", "rule.*")


def unsupported_schemas(compiled: DataFrame) -> DataFrame:
    """Schemas that give no verdict, or not always, and unusable ones."""
    return compiled.filter("status <> 'ok'").select("schema_id", "status")
