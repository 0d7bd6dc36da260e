"""Validation of calls against compiled schemas.

A call is checked inside its own row: the rules of its schema are brought to it, its nodes
are matched with them by position, and what fails is collected in an array. Nothing is
grouped back by call, so calls are never shuffled for a verdict, and a schema that covers a
third of the table is no hot key.

The rules reach the rows in one of three ways, chosen by the measured size of the catalog:

* a few schemas: their rules become plain expressions (no join at all);
* a catalog below the broadcast limit: broadcast join on ``schema_id``;
* anything larger: shuffle join on ``schema_id`` with the frequent ids salted.

All three share the same checks and give the same verdicts.
"""

from __future__ import annotations

from threading import Lock

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from callsieve.functions.jsontext import beyond_parser, depth_bound, lenient_text, parse_wrapped
from callsieve.functions.labels import OTHER, category_of, json_error_message, schema_error_message
from callsieve.functions.sqltext import given, joined, let, loop, name, quote, strings
from callsieve.functions.variants import elements, fields, from_text, is_array, json_path, keys, kind_of, shape_of
from callsieve.operators.checks import (
    ALL,
    DEMANDS,
    NO_VIOLATION,
    NO_VIOLATIONS,
    UNSUPPORTED,
    VIOLATION,
    Check,
    JoinedRule,
    LiteralRule,
    Node,
    asks,
    branches_fail,
    checks_by_kind,
    matches,
    missing_key,
    node_checks,
    violation,
)
from callsieve.operators.salting import join_unique
from callsieve.operators.schemas import BESIDE, BRANCHED, EDGES, NO_SCHEMA, PLAIN_EDGES, compile_schemas, longest_chain
from callsieve.session import materialise

# Fixed limits for choosing how rules reach the rows.
INLINE_SCHEMAS = 16
INLINE_RULES = 160
BROADCAST_BYTES = 64 * 1024 * 1024

# Up to so many results are scanned for those of one pair; among more they are found by halving.
FEW_RESULTS = 64

# In memory a rule takes about this much, however few demands it has.
RULE_BYTES = 512

# Rules of the few schemas that are written out as expressions, by id and text hash, so that
# scoring another table with the same tools does not compile them again.
REMEMBERED_SCHEMAS = 256
_COMPILED: dict[tuple[str, str], Row] = {}
_COMPILED_LOCK = Lock()


def _needs_keys(rule: Row) -> bool:
    """Objects are opened for their keys only, so that large values are not copied."""
    counted = rule["min_properties"] is not None or rule["max_properties"] is not None
    return bool(rule["required"] or rule["property_names"]) or not rule["additional_allowed"] or counted


def _movable(rule: Row) -> bool:
    """Below a star: in an array, or in a schema that applies beside another one."""
    return any(step.startswith("*") for step in rule["at"].split("/"))


def _directly_below(at: str, other: str) -> bool:
    """A member of ``at``, neither an element nor a schema beside it."""
    parent, slash, step = other.rpartition("/")
    return bool(slash) and parent == at and not step.startswith("*")


def _branched(rule: Row) -> bool:
    return bool(any(rule[f"n_{k}"] for k in BRANCHED) or rule["negated"] or rule["referred"] or rule["rest"])


def _literal_checks(node: Node, rule: Row, present: dict[str, str]) -> list[Check]:
    """``present`` gives a test for each key whose presence is already known."""
    checks = node_checks(node, LiteralRule(rule))
    for key in rule["required"] or []:
        has = present.get(key) or f"array_contains({node.keys}, {quote(key)})"
        gone = f"{node.kind} = 'object' AND NOT {has}"
        checks.append(Check(gone, missing_key(node, quote(key))))
    return checks


def _plain(rule: Row) -> bool:
    """Whether the rule can be written out as expressions."""
    links = [*rule["beside"], *rule["wide"], *rule["inner"]]
    closed = rule["closed_members"] or rule["closed_elements"]
    return not (closed or rule["needs"] or rule["names_to"] >= 0) and all(x["edge"] in PLAIN_EDGES for x in links)


def _positions(rules: list[Row], limit: int) -> list[Row] | None:
    """The rules at each position of a call, linked ones in full wherever they apply. None if there are
    more than ``limit``, as for a schema that refers to itself, or if one cannot be written out."""
    keyword_of = {number: keyword for keyword, number in EDGES.items()}
    queue, out = [(0, "", [])], []
    while queue and len(out) <= limit:
        number, at, path = queue.pop()
        rule = rules[number]
        if not _plain(rule):
            return None
        out.append(Row(**{**rule.asDict(), "at": at, "path": path}))
        for link in rule["beside"]:
            keyword = keyword_of[link["edge"]]
            step = {"$ref": "*ref"}.get(keyword, f"*{keyword}" + (f":{link['key']}" if keyword in BRANCHED else ""))
            queue.append((link["to"], f"{at}/{step}", path))
        for key, to in zip(rule["property_names"], rule["name_to"]):
            escaped = key.replace("~", "~0").replace("/", "~1").replace("*", "~2")
            queue.append((to, f"{at}/{escaped}", [*path, key]))
        if rule["rest_to"] >= 0:
            queue.append((rule["rest_to"], f"{at}/*additional", [*path, "*"]))
        queue += [(link["to"], f"{at}/*", [*path, "[]"]) for link in rule["inner"]]
    return out if len(out) <= limit else None


def _gather(checks: list[Check]) -> str:
    """What the checks find, inside of a lambda. Most nodes comply, so that only the tests are made."""
    if not checks:
        return NO_VIOLATIONS
    some = " OR ".join(f"({check.fails})" for check in checks)
    return f"if({some}, array_compact(array({', '.join([NO_VIOLATION, *[check.one for check in checks]])})), {NO_VIOLATIONS})"


def _together(arrays: list[str]) -> str:
    return joined(*arrays) if len(arrays) > 1 else arrays[0]


class _InlineRules:
    """Checks for a handful of schemas, written out as expressions on the parsed call."""

    def __init__(self, rows: list[Row], bare: bool):
        self.bare = bare
        self.statuses = {row["schema_id"]: row["status"] for row in rows}
        self.schemas = {
            row["schema_id"]: {rule["at"]: rule for rule in row["rules"]} for row in rows if row["rules"] is not None
        }
        fixed: dict[str, list[str]] = {}
        for schema_id, rules in self.schemas.items():
            for at, rule in rules.items():
                if not _movable(rule):
                    fixed.setdefault(at, []).append(schema_id)
        self.slots = {at: (i, ids) for i, (at, ids) in enumerate(fixed.items())}

    @classmethod
    def build(cls, catalog: DataFrame, schemas: int, rules: int, bare: bool) -> _InlineRules | None:
        """Only if there are few enough schemas, rules, and keys that a path can hold."""
        text_hash = F.coalesce(F.sha2("schema", 256), F.lit("")).alias("hash")
        found = catalog.select("schema_id", text_hash).limit(schemas + 1).collect() if schemas else []
        if not schemas or len(found) > schemas:
            return None
        keys = {row["schema_id"]: (row["schema_id"], row["hash"]) for row in found}
        with _COMPILED_LOCK:
            known = {schema_id: _COMPILED[key] for schema_id, key in keys.items() if key in _COMPILED}
        fresh = [schema_id for schema_id in keys if schema_id not in known]
        if fresh:
            compiled = compile_schemas(catalog.filter(F.col("schema_id").isin(fresh)), len(fresh)).collect()
            known |= {row["schema_id"]: row for row in compiled}
            with _COMPILED_LOCK:
                _COMPILED.update((keys[row["schema_id"]], row) for row in compiled)
                while len(_COMPILED) > REMEMBERED_SCHEMAS:
                    _COMPILED.pop(next(iter(_COMPILED)))
        rows, nodes = [], []
        for schema_id in keys:
            row = known[schema_id]
            here = _positions(row["rules"], rules) if row["rules"] is not None else []
            if here is None:
                return None
            nodes += here
            rows.append(Row(schema_id=schema_id, status=row["status"], rules=here if row["rules"] is not None else None))
        fits = len(nodes) <= rules and all(json_path(rule["path"]) for rule in nodes)
        return cls(rows, bare) if fits else None

    def attach(self, df: DataFrame) -> DataFrame:
        ids = f"coalesce(schema_id, {quote(NO_SCHEMA)})"
        cases = " ".join(f"WHEN {quote(i)} THEN {quote(s)}" for i, s in self.statuses.items())
        # Without any schema there is no rule to bring, as for an epoch of a stream in which all is known already.
        return df.selectExpr("*", f"CASE {ids} {cases} END AS __status" if cases else "cast(NULL AS string) AS __status")

    def find(self, df: DataFrame, text: str) -> DataFrame:
        """Type, keys or value of each fixed position once per row, then the checks."""
        opened, shapes, kinds = [], [], []
        for at, (i, ids) in self.slots.items():
            rules = [self.schemas[schema_id][at] for schema_id in ids]
            here = f"schema_id IN ({', '.join(quote(schema_id) for schema_id in ids)})"
            path = self._path(rules[0])
            value = f"try_variant_get(__w, {quote(path)}, 'variant')"
            shape = shape_of(f"__v{i}")
            if any(_needs_keys(rule) for rule in rules):
                opened.append(f"if({here}, {keys('__w', path)}, NULL) AS __o{i}")
                whole = any(rule["has_container"] for rule in rules)
                shape = f"if({here}, {shape_of(value)}, NULL)"
                shape = shape if whole else f"if(__o{i} IS NULL, {shape}, 'OBJECT')"
            else:
                opened.append(f"if({here}, {value}, NULL) AS __v{i}")
            shapes.append(f"{shape} AS __s{i}")
            v = value if shape != shape_of(f"__v{i}") else f"__v{i}"
            kinds.append(f"{kind_of(v, f'__s{i}')} AS __k{i}")
        for stage in (opened, shapes, kinds):
            df = df.selectExpr("*", *stage)
        first, found = [], []
        for schema_id, rules in self.schemas.items():
            single, several = self._checks(rules)
            least = ", ".join([NO_VIOLATION, NO_VIOLATION, *[c.one for c in single], *[f"array_min({s})" for s in several]])
            first.append(f"WHEN {quote(schema_id)} THEN least({least})")
            # Outside of lambdas: Spark compiles all of this, but would interpret what a filter of an array holds.
            every = joined(NO_VIOLATIONS, *[c.listed for c in single], *several)
            found.append(f"WHEN {quote(schema_id)} THEN {every}")

        def by_schema(cases: list[str], default: str) -> str:
            return f"CASE schema_id {' '.join(cases)} ELSE {default} END" if cases else default

        return df.selectExpr(
            "*", f"{by_schema(first, NO_VIOLATION)} AS __first", f"{by_schema(found, NO_VIOLATIONS)} AS __found"
        )

    @staticmethod
    def _path(rule: Row) -> str:
        return "$[0]" + json_path(rule["path"])[1:]

    def _checks(self, rules: dict[str, Row]) -> tuple[list[Check], list[str]]:
        single, several = [], []
        opened = {at for at, (_, ids) in self.slots.items() if any(_needs_keys(self.schemas[s][at]) for s in ids)}
        for at, rule in rules.items():
            if _movable(rule):
                continue
            i, _ = self.slots[at]
            value = f"try_variant_get(__w, {quote(self._path(rule))}, 'variant')"
            v, names = (value, f"__o{i}") if at in opened else (f"__v{i}", keys(f"__v{i}"))
            below = {r["path"][-1]: a for a, r in rules.items() if _directly_below(at, a)}
            present = {key: f"(__s{self.slots[a][0]} IS NOT NULL)" for key, a in below.items() if a in self.slots}
            declared = " + ".join(["0", *[f"int{test}" for test in present.values()]])
            node = Node(strings(rule["path"]), v, f"__s{i}", f"__k{i}", names, elements(v), declared, self.bare)
            single += _literal_checks(node, rule, present)
            if f"{at}/*" in rules:
                several.append(self._elements(rules, at, node.path, node.v, 0))
            if _branched(rule):
                known = self._known(f"filter(array({value}), m -> m IS NOT NULL)")
                applied = f"concat({', '.join(self._applied(rules, at, node.path, 'e0', 1))})"
                several.append(f"coalesce(flatten(transform({known}, e0 -> {applied})), {NO_VIOLATIONS})")
        return single, several

    def _applied(self, rules: dict[str, Row], at: str, path: str, e: str, level: int) -> list[str]:
        """Violation lists of the schemas that apply to ``e`` beside the one at ``at``."""
        rule, found = rules[at], []
        along = [f"*allOf:{i}" for i in range(rule["n_allOf"])] + (["*ref"] if rule["referred"] else [])
        found += [self._below(rules, f"{at}/{step}", path, e, level) for step in along]
        sides = [(k, [f"*{k}:{i}" for i in range(rule[f"n_{k}"])]) for k in ("anyOf", "oneOf")]
        for keyword, steps in [*sides, ("not", ["*not"] if rule["negated"] else [])]:
            if steps:
                least = ", ".join(f"array_min({self._below(rules, f'{at}/{step}', path, e, level)})" for step in steps)
                found.append(f"array_compact(array({branches_fail(path, f'array({least})', keyword)}))")
        if rule["rest"]:
            x = f"e{level}"
            declared = strings(rule["property_names"])
            others = f"filter(map_entries({fields(f'{e}.v')}), p -> NOT array_contains({declared}, p.key))"
            shaped = f"transform({others}, p -> named_struct('key', p.key, 'v', p.value, 's', {shape_of('p.value')}))"
            known = f"transform({shaped}, p -> named_struct('key', p.key, 'v', p.v, 's', p.s, 'k', {kind_of('p.v', 'p.s')}))"
            below = self._below(rules, f"{at}/*additional", f"concat({path}, array({x}.key))", x, level + 1)
            found.append(f"coalesce(flatten(transform({known}, {x} -> {below})), {NO_VIOLATIONS})")
        return found

    @staticmethod
    def _known(values: str) -> str:
        """Values with type text and kind, each worked out once."""
        shaped = f"transform({values}, x -> named_struct('v', x, 's', {shape_of('x')}))"
        return f"transform({shaped}, x -> named_struct('v', x.v, 's', x.s, 'k', {kind_of('x.v', 'x.s')}))"

    def _elements(self, rules: dict[str, Row], at: str, path: str, v: str, level: int) -> str:
        """Violations in the elements of the array ``v``, nested positions included."""
        e, i = f"e{level}", f"i{level}"
        inner = self._below(rules, f"{at}/*", f"concat({path}, array(string({i})))", e, level + 1)
        return f"coalesce(flatten(transform({self._known(elements(v))}, ({e}, {i}) -> {inner})), {NO_VIOLATIONS})"

    def _below(self, rules: dict[str, Row], at: str, path: str, e: str, level: int) -> str:
        rule = rules[at]
        v = f"{e}.v"
        node = Node(path, v, f"{e}.s", f"{e}.k", keys(v), elements(v), bare=self.bare)
        found = [_gather(_literal_checks(node, rule, {}))]
        found += self._applied(rules, at, path, e, level)
        for other, child in rules.items():
            if other == f"{at}/*":
                found.append(self._elements(rules, at, path, v, level))
            elif _directly_below(at, other):
                key = child["path"][-1]
                member = f"try_variant_get({v}, {quote(json_path([key]))}, 'variant')"
                present = self._known(f"filter(array({member}), m -> m IS NOT NULL)")
                inner = f"e{level}"
                below = self._below(rules, other, f"concat({path}, array({quote(key)}))", inner, level + 1)
                found.append(f"flatten(transform({present}, {inner} -> {below}))")
        return _together(found)


# A link followed from a pair of value and rule: the value it leads to and the rule for that. Spark copies
# structs at every level of a loop, so the rest is added only when all links of a pair are there.
_STEP = "edge:int,key:string,rule:int,v:variant"
_STEPS = f"array<struct<{_STEP}>>"
# A value of the call and a rule for it: the place of the pair it comes from among those one step
# before, the link and key that led here, and the rules met at this very value. Its path is one text, which
# is taken apart only where something fails: an array is copied step by step with every pair.
_TYPE = "struct<shape:string,kind:string,keys:array<string>>"
_PAIR = f"struct<parent:int,{_STEP},path:string,seen:array<int>,siblings:int,type:{_TYPE}>"
_NO_PAIRS = f"cast(array() AS array<{_PAIR}>)"
# What is kept of a pair on the way back: its own violations, and what its links' results need.
_SEEN = f"struct<parent:int,edge:int,key:string,siblings:int,rule:int,path:string,own:array<{VIOLATION}>,keys:array<string>,n:int,kind:string>"
# What a pair came to: its violations, and the members and elements it has judged; ``unsure`` if more of
# these may have been.
_RESULT = f"struct<parent:int,edge:int,key:string,siblings:int,found:array<{VIOLATION}>,members:array<string>,elements:array<string>,unsure:boolean>"
_NO_STEPS, _NO_RESULTS = f"cast(array() AS {_STEPS})", f"cast(array() AS array<{_RESULT}>)"
_NO_TEXTS = "cast(array() AS array<string>)"
_NO_KEYS = "cast(NULL AS array<string>)"


def _edge(*keywords: str) -> str:
    return ", ".join(str(EDGES[k]) for k in keywords)


def _further(path: str, key: str) -> str:
    """The text of a path with one more step."""
    return f"concat({path}, '/', replace(replace({key}, '~', '~0'), '/', '~1'))"


def _steps(path: str) -> str:
    """The steps of the text of a path."""
    return f"transform(slice(split({path}, '/'), 2, size(split({path}, '/'))), s -> replace(replace(s, '~1', '/'), '~0', '~'))"


#: What a rule asks for, by the kinds of values, as it is kept with the rule.
_ASKED = {kinds: f"asks_{kinds.split()[0] if kinds else 'any'}" for kinds in DEMANDS if len(DEMANDS[kinds]) > 1}
#: Groups of links that a rule may have, each a bit of its ``leads``.
_GROUPS = ("beside", "name_to", "wide", "rest_to", "names_to", "inner")
_LEADS = (
    "size(r.beside) > 0",
    "size(r.name_to) > 0",
    "size(r.wide) > 0",
    "r.rest_to >= 0",
    "r.names_to >= 0",
    "size(r.inner) > 0",
)


def _shortened(compiled: DataFrame) -> DataFrame:
    """The compiled rules with what a call would otherwise find out at each of its values.

    A rule that is nothing but a reference is passed over: links lead to what it stands for, so that a
    chain of references takes one step. References that only lead to each other stay as they are. Each rule
    also tells which demands and links it has at all; ``root`` is the rule that a call begins with.
    """
    kept = [f.name for f in compiled.schema["rules"].dataType.elementType.fields]
    kept = [f for f in kept if f not in ("pointer", "path", "at")]
    told = [f"'{f}', r.{f}" for f in kept] + [f"'{f}', {asks('r', kinds)}" for kinds, f in _ASKED.items()]
    leads = " + ".join(f"if({test}, {1 << bit}, 0)" for bit, test in enumerate(_LEADS))
    told.append(f"'leads', {leads}")
    df = compiled.selectExpr("schema_id", "status", "tool", f"transform(rules, r -> named_struct({', '.join(told)})) AS rules")

    asked = [f"r.{_ASKED.get(kinds, DEMANDS[kinds][0])}" for kinds in DEMANDS]
    asked = " OR ".join([*asked, "r.required IS NOT NULL", "size(r.needs) > 0"])
    apart = ("counted", "conditional", "judges_members", "judges_elements", "closed_members", "closed_elements")
    alias = (
        f"r.leads = 1 AND size(r.beside) = 1 AND r.beside[0].edge = {_edge('$ref')} AND NOT ({asked})"
        f" AND size(r.patterns) = 0 AND size(r.property_names) = 0 AND NOT ({' OR '.join(f'coalesce(r.{f}, false)' for f in apart)})"
    )
    first = f"transform(rules, (r, i) -> if(coalesce({alias}, false), r.beside[0].to, i))"
    df = df.selectExpr("*", f"if(size(rules) > 0, {first}, NULL) AS __next")
    # References in a ring have no end: what leads to one stays.
    ends = "transform(h, (x, i) -> if(coalesce(__next[x] <> x, true), i, x))"
    twice = "transform(h, x -> coalesce(get(h, x), x))"
    df = df.selectExpr("*", f"aggregate(sequence(0, int(log2(size(rules)))), __next, (h, i) -> {twice}, h -> {ends}) AS __ends")

    def ended(to: str) -> str:
        return f"coalesce(get(__ends, {to}), {to})"

    def links(of: str) -> str:
        return f"transform({of}, l -> named_struct('edge', l.edge, 'key', l.key, 'to', {ended('l.to')}))"

    changed = {
        "beside": links("r.beside"),
        "wide": links("r.wide"),
        "inner": links("r.inner"),
        "name_to": f"transform(r.name_to, x -> {ended('x')})",
        "rest_to": ended("r.rest_to"),
        "names_to": ended("r.names_to"),
    }
    fields_ = [f"'{f}', {changed.get(f, f'r.{f}')}" for f in [*kept, *_ASKED.values()]]
    fields_ += [f"'asks', {asked}", "'leads', r.leads"]
    # No link leads to a rule that is passed over any more, so it is left out.
    rules = f"transform(rules, (r, i) -> if(__ends[i] <> i, NULL, named_struct({', '.join(fields_)})))"
    df = df.selectExpr("schema_id", "status", "tool", f"{rules} AS rules", "coalesce(__ends[0], 0) AS root")
    return df.selectExpr("*", f"{longest_chain()} AS chain")


class _JoinedRules:
    """Rules brought by a join on ``schema_id``.

    A loop inside the row follows the links of rules and the members and elements of the call together,
    from the root downwards, until a step leads to no new pair of value and rule; what has no rule is
    not opened. A second loop goes back up the steps and judges each pair by what came of those it led
    to. The expression has the same size for all schemas, and a call costs as many rounds as it is deep.
    """

    def __init__(self, compiled: DataFrame, broadcast_bytes: int, bare: bool):
        self.bare = bare
        self.compiled = materialise(_shortened(compiled), "schemas")
        rule_bytes = F.coalesce(F.size("rules"), F.lit(0)) * RULE_BYTES
        apart = f"exists(r.beside, l -> l.edge NOT IN ({_edge('allOf', '$ref')})) OR r.counted OR r.names_to >= 0"
        loose = f"r.closed_members OR r.closed_elements OR exists(concat(r.wide, r.inner), l -> l.edge IN ({_edge('unevaluatedProperties', 'unevaluatedItems')}))"
        measured = self.compiled.agg(
            F.sum(F.length(F.to_json(F.struct("schema_id", "rules"))) + rule_bytes).alias("size"),
            F.bool_or(F.expr(f"exists(rules, r -> {apart})")).alias("apart"),
            F.bool_or(F.expr(f"exists(rules, r -> {loose})")).alias("loose"),
        ).first()
        self.broadcast = (measured["size"] or 0) <= broadcast_bytes
        self.loose = bool(measured["loose"])
        self.apart = bool(measured["apart"]) or self.loose

    def attach(self, df: DataFrame) -> DataFrame:
        rules = self.compiled.selectExpr("schema_id AS __sid", "status AS __status", "rules AS __rules", "chain AS __chain", "root AS __root")
        keyed = df.withColumn("__sid", F.coalesce(F.col("schema_id"), F.lit(NO_SCHEMA)))
        if self.broadcast:
            return keyed.join(F.broadcast(rules), "__sid", "left").drop("__sid")
        return join_unique(keyed, rules, "__sid", "left").drop("__sid")

    def find(self, df: DataFrame, text: str) -> DataFrame:
        # The loops copy what they hold in every round: as many rounds as the value can need, no more.
        df = df.withColumn("__rounds", (depth_bound(text) + 1) * F.coalesce("__chain", F.lit(1)))
        df = df.selectExpr("*", f"if(__w IS NOT NULL AND __status IN ('ok', 'partly'), {self._found()}, NULL) AS __found")
        return df.selectExpr("*", "array_min(__found) AS __first")

    def _found(self) -> str:
        value = "try_variant_get(__w, '$[0]', 'variant')"
        root = self._step("-1", "''", "__root", value)
        start = f"cast({self._opened(f'array({root})', '0', '1', quote(''), 'array(__root)')} AS array<{_PAIR}>)"
        own = given("get(__rules, t.rule)", "r", self._own("t", "r"))
        state = "named_struct('open', {0}, '{2}', {1})"
        if not self.apart:
            new = given(f"flatten(transform(acc.open, t -> {own}))", "n", f"if(size(n) = 0, acc.found, {joined('acc.found', 'n')})")
            going = state.format(self._below("acc.open"), new, "found")
            return (
                f"aggregate(sequence(1, __rounds), {state.format(start, NO_VIOLATIONS, 'found')},"
                f" (acc, i) -> if(size(acc.open) = 0, acc, {going}), acc -> acc.found)"
            )
        keys_ = "t.type.keys" if self.loose else "cast(NULL AS array<string>)"
        parts = f"if(t.type.kind = 'array', size({elements('t.v')}), 0)" if self.loose else "0"
        seen = (
            f"named_struct('parent', t.parent, 'edge', t.edge, 'key', t.key, 'siblings', t.siblings, 'rule', t.rule,"
            f" 'path', t.path, 'own', {own}, 'keys', {keys_}, 'n', {parts}, 'kind', t.type.kind)"
        )
        seen = joined("b.levels", f"array(cast(transform(b.open, t -> {seen}) AS array<{_SEEN}>))")
        going = state.format(self._below("b.open"), seen, "levels")
        levels = loop("__rounds", start, going, f"cast(array() AS array<array<{_SEEN}>>)")
        # Results of a step are in the order of the pairs they come from, so that each finds its own.
        level = given(
            "named_struct('below', below, 'parents', transform(below, x -> x.parent))",
            "b",
            f"transform(level, (t, p) -> {given(self._mine('b', 'p'), 'mine', given('get(__rules, t.rule)', 'r', self._result()))})",
        )
        up = f"aggregate(reverse({levels}), {_NO_RESULTS}, (below, level) -> cast({level} AS array<{_RESULT}>))"
        return f"{let(up, 'top', 'top[0].found')}"

    @staticmethod
    def _mine(b: str, p: str) -> str:
        """The results in ``b`` whose parent is ``p``: a slice, found by a scan of few and by halving of many."""
        halved = (
            f"aggregate(sequence(0, int(log2(1 + size({b}.below)))), named_struct('low', 0, 'high', size({b}.below)),"
            f" (s, i) -> CASE WHEN s.low >= s.high THEN s WHEN {b}.parents[(s.low + s.high) div 2] < {p}"
            f" THEN named_struct('low', int((s.low + s.high) div 2) + 1, 'high', s.high)"
            f" ELSE named_struct('low', s.low, 'high', int((s.low + s.high) div 2)) END, s -> s.low)"
        )
        place = f"if(size({b}.below) <= {FEW_RESULTS}, int(array_position({b}.parents, {p})) - 1, {halved})"
        own = f"if(get({b}.parents, first) = {p}, slice({b}.below, first + 1, {b}.below[first].siblings), {_NO_RESULTS})"
        return f"if(size({b}.below) = 0, {_NO_RESULTS}, {let(place, 'first', own)})"

    @staticmethod
    def _step(edge: str, key: str, rule: str, v: str) -> str:
        return f"named_struct('edge', {edge}, 'key', {key}, 'rule', {rule}, 'v', {v})"

    @staticmethod
    def _opened(steps: str, parent: str, siblings: str, path: str, seen: str) -> str:
        """Steps with path, rules met, keys, type text and kind of their values, in one pass."""

        def typed(shape: str, kind: str, names: str = _NO_KEYS) -> str:
            return f"named_struct('shape', {shape}, 'kind', {kind}, 'keys', {names})"

        # The type text of a large value is long, so it is asked for only where a rule or the kind needs it.
        whole = given(shape_of("c.v"), "s", typed("s", kind_of("c.v", "s"), "k"))
        needed = "coalesce(get(__rules, c.rule).has_container, false)"
        opened = given(keys("c.v"), "k", (
            f"CASE WHEN k IS NOT NULL AND NOT {needed} THEN {typed(quote('OBJECT'), quote('object'), 'k')}"
            f" WHEN {is_array('c.v')} AND NOT {needed} THEN {typed(quote('ARRAY'), quote('array'))} ELSE {whole} END"
        ))
        carried = ", ".join(f"'{f.split(':')[0]}', c.{f.split(':')[0]}" for f in _STEP.split(","))
        return (
            f"transform({steps}, c -> named_struct('parent', {parent}, {carried}, 'path', {path}, 'seen', {seen},"
            f" 'siblings', {siblings}, 'type', {opened}))"
        )

    def _below(self, pairs: str) -> str:
        """The pairs that ``pairs`` lead to, each one's after the other."""
        beside = self._step("l.edge", "l.key", "if(array_contains(t.seen, l.to), -1, l.to)", "t.v")
        applies = f"l.edge <> {_edge('dependentSchemas')} OR coalesce(array_contains(t.type.keys, l.key), false)"
        to = "get(r.name_to, int(array_position(r.property_names, e.key)) - 1)"
        declared = self._step(_edge("properties"), "e.key", to, "e.value")
        wide = self._step("l.edge", "e.key", "l.to", "e.value")
        rest = self._step(_edge("additionalProperties"), "e.key", "r.rest_to", "e.value")
        named = self._step(_edge("propertyNames"), "k", "r.names_to", from_text("k"))
        element = self._step("l.edge", "string(i)", "l.to", "x")
        fits = f"CASE l.edge WHEN {_edge('prefixItems')} THEN int(l.key) = i WHEN {_edge('items')} THEN i >= r.n_first ELSE true END"
        covered = f"array_contains(r.property_names, e.key) OR {matches('e.key', 'r.patterns')}"
        matching = f"l.edge = {_edge('unevaluatedProperties')} OR e.key RLIKE concat('(?Ud)', l.key)"
        members = f"map_entries({fields('t.v')})"
        # In the order of _LEADS; None of the members where the value is no object.
        found = [
            f"transform(filter(r.beside, l -> {applies}), l -> {beside})",
            f"if(t.type.keys IS NOT NULL, filter(transform({members}, e -> {declared}), c -> c.rule IS NOT NULL), NULL)",
            f"if(t.type.keys IS NOT NULL, flatten(transform({members}, e -> transform(filter(r.wide, l -> {matching}), l -> {wide}))), NULL)",
            f"if(t.type.keys IS NOT NULL, transform(filter({members}, e -> NOT ({covered})), e -> {rest}), NULL)",
            f"transform(t.type.keys, k -> {named})",
            f"flatten(transform({elements('t.v')}, (x, i) -> transform(filter(r.inner, l -> {fits}), l -> {element})))",
        ]
        several = joined(*[f"coalesce(if({test}, {f}, NULL), {_NO_STEPS})" for test, f in zip(_LEADS, found)])
        # Links beside a rule and to names stay at the path; all others lead to a member or an element.
        further, along, fresh = _further("t.path", "c.key"), joined("t.seen", "array(c.rule)"), "array(c.rule)"
        path = f"if(c.edge < {len(BESIDE)} OR c.edge = {_edge('propertyNames')}, t.path, {further})"
        seen = f"if(c.edge < {len(BESIDE)}, {along}, {fresh})"

        # Most rules have links of one group.
        single = " ".join(
            f"WHEN r.leads = {1 << _GROUPS.index(g)} THEN coalesce({found[_GROUPS.index(g)]}, {_NO_STEPS})" for g in ("name_to", "inner")
        )
        family = f"CASE {single} ELSE {several} END"
        pairs_ = self._opened("f", "p", "size(f)", path, seen)
        one = given(family, "f", f"if(size(f) = 0, {_NO_PAIRS}, {pairs_})")
        some = f"if(coalesce(r.leads, 0) = 0, {_NO_PAIRS}, {one})"
        return f"flatten(transform({pairs}, (t, p) -> {given('get(__rules, t.rule)', 'r', some)}))"

    def _own(self, t: str, r: str) -> str:
        """Violations of one pair by itself. Most have none, so it is first asked whether any demand is failed."""
        kind, names = f"{t}.type.kind", f"{t}.type.keys"
        node = Node(_steps(f"{t}.path"), f"{t}.v", f"{t}.type.shape", kind, names, elements(f"{t}.v"), bare=self.bare)

        def missing(needed: str) -> str:
            return f"transform(filter({needed}, k -> NOT array_contains({names}, k)), k -> {missing_key(node, 'k')})"

        needed = f"concat('\\'', k, '\\' is a dependency of \\'', d.key, '\\'')"
        needs = (
            f"flatten(transform(filter({r}.needs, d -> array_contains({names}, d.key)), d -> transform(filter(d.needs,"
            f" k -> NOT array_contains({names}, k)), k -> {violation(node, 'dependentRequired', needed)})))"
        )
        endless = violation(node, UNSUPPORTED, quote("a reference that leads back to itself"), True)
        whole = f"{kind} = 'object' AND "
        parts, failing = [], []
        for kinds, checks in checks_by_kind(node, JoinedRule(r)).items():
            some = " OR ".join(f"{kind} = {quote(k)}" for k in kinds.split()) or "true"
            asked = f"{r}.{_ASKED.get(kinds, DEMANDS[kinds][0])} AND ({some})"
            ones = ", ".join([NO_VIOLATION, *[check.one for check in checks]])
            parts.append(f"if({asked}, array_compact(array({ones})), {NO_VIOLATIONS})")
            failing.append(f"{asked} AND ({' OR '.join(f'({check.fails})' for check in checks)})")
        for asked, list_ in (
            (f"{whole}{r}.required IS NOT NULL", missing(f"{r}.required")),
            (f"{whole}size({r}.needs) > 0", needs),
        ):
            parts.append(f"if({asked}, {list_}, {NO_VIOLATIONS})")
        failing.append(f"{whole}{r}.required IS NOT NULL AND size(array_except({r}.required, {names})) > 0")
        failing.append(f"{whole}size({r}.needs) > 0")
        some = " OR ".join(f"({test})" for test in failing)
        return f"CASE WHEN {t}.rule < 0 THEN array({endless}) WHEN {r}.asks AND ({some}) THEN {joined(*parts)} ELSE {NO_VIOLATIONS} END"

    def _result(self) -> str:
        """What the pair ``t`` with rule ``r`` comes to, given the results ``mine``."""
        node = Node(_steps("t.path"), "", "", "", "", "", bare=self.bare)

        def fails(keyword: str, held: bool = False) -> str:
            return violation(node, keyword, quote(f"the value does not comply with {keyword}"), held)

        def of(*keywords: str) -> str:
            return f"filter(mine, c -> c.edge IN ({_edge(*keywords)}))"

        def least(*keywords: str) -> str:
            return f"transform({of(*keywords)}, c -> array_min(c.found))"

        def only(keyword: str) -> str:
            return f"coalesce(get({of(keyword)}, 0).found, {NO_VIOLATIONS})"

        through = ("allOf", "$ref", "dependentSchemas", "properties", "patternProperties", "additionalProperties")
        through += ("propertyNames", "prefixItems", "items")
        parts = ["t.own", f"flatten(transform({of(*through)}, c -> c.found))"]
        for keyword, asked in (("anyOf", "r.n_anyOf > 0"), ("oneOf", "r.n_oneOf > 0"), ("not", "r.negated")):
            parts.append(f"array_compact(array(if({asked}, {branches_fail(node.path, least(keyword), keyword)}, NULL)))")
        condition = let(f"get({least('if')}, 0)", "m", (
            f"CASE WHEN m IS NULL THEN {only('then')} WHEN NOT m.held THEN {only('else')}"
            f" WHEN size({only('then')}) + size({only('else')}) = 0 THEN {NO_VIOLATIONS} ELSE array({fails('if', True)}) END"
        ))
        parts.append(f"if(r.conditional, {condition}, {NO_VIOLATIONS})")
        counts = f"named_struct('n', size(filter(w, x -> x IS NULL)), 'open', size(filter(w, x -> x.held)), 'low', coalesce(r.min_contains, 1))"
        counted = let(let(least("contains"), "w", counts), "w", (
            f"CASE WHEN w.low > 0 AND w.n + w.open = 0 THEN {fails('contains')} WHEN w.n + w.open < w.low THEN {fails('minContains')}"
            f" WHEN w.n > r.max_contains THEN {fails('maxContains')}"
            f" WHEN w.n >= w.low AND coalesce(w.n + w.open <= r.max_contains, true) THEN NULL ELSE {fails('contains', True)} END"
        ))
        parts.append(f"array_compact(array(if(r.counted AND t.kind = 'array', {counted}, NULL)))")
        start = "'parent', t.parent, 'edge', t.edge, 'key', t.key, 'siblings', t.siblings"
        if not self.loose:
            # What led to nothing has its own violations only.
            found = f"if(size(mine) = 0 AND NOT r.counted, t.own, {joined(*parts)})"
            return f"named_struct({start}, 'found', {found}, 'members', {_NO_TEXTS}, 'elements', {_NO_TEXTS}, 'unsure', false)"

        # Of the schemas beside a rule, those that pass tell what they have judged.
        valid = "array_min(c.found) IS NULL"
        taken = f"coalesce(array_min({only('if')}).held, true)"
        told = (
            f"filter(mine, c -> {valid} AND (c.edge IN ({_edge('allOf', 'anyOf', 'oneOf', '$ref', 'dependentSchemas', 'if')})"
            f" OR (c.edge = {_edge('then')} AND size({only('if')}) = 0) OR (c.edge = {_edge('else')} AND NOT {taken})))"
        )
        unsure = f"exists(mine, c -> c.edge IN ({_edge(*[k for k in BESIDE if k != 'not'])}) AND (c.unsure OR coalesce(array_min(c.found).held, false)))"

        def judged(whole: str, every: str, edges: tuple[str, ...], field: str) -> str:
            own = f"transform({of(*edges)}, c -> c.key)"
            if field == "elements":
                own = f"concat({own}, transform(filter({of('contains')}, c -> {valid}), c -> c.key))"
            return f"array_distinct(concat(if({whole}, {every}, {_NO_TEXTS}), {own}, flatten(transform({told}, c -> c.{field}))))"

        names, places = "coalesce(t.keys, array())", f"if(t.n > 0, transform(sequence(0, t.n - 1), i -> string(i)), {_NO_TEXTS})"
        loose = "unevaluatedProperties", "unevaluatedItems"
        members = judged("r.judges_members", names, ("properties", "patternProperties", "additionalProperties"), "members")
        elements_ = judged("r.judges_elements", places, ("prefixItems", "items"), "elements")

        def left(keyword: str, closed: str, every: str, seen: str) -> str:
            """Violations of what nothing has judged; undecided if something may have."""
            strict = f"if({closed} AND size(array_except({every}, {seen})) > 0, array({fails(keyword)}), {NO_VIOLATIONS})"
            held = f"if({closed} AND size(array_except({every}, {seen})) > 0, array({fails(keyword, True)}), {NO_VIOLATIONS})"
            below = f"flatten(transform(filter({of(keyword)}, c -> NOT array_contains({seen}, c.key)), c -> c.found))"
            either = f"if(size({below}) > 0, array({fails(keyword, True)}), {NO_VIOLATIONS})"
            return f"if(u, concat({held}, {either}), concat({strict}, {below}))"

        seen = f"named_struct('m', {members}, 'e', {elements_})"
        parts += [left(loose[0], "r.closed_members", names, "j.m"), left(loose[1], "r.closed_elements", places, "j.e")]
        all_members = f"if(r.closed_members OR exists(r.wide, l -> l.edge = {_edge(loose[0])}), {names}, j.m)"
        all_elements = f"if(r.closed_elements OR exists(r.inner, l -> l.edge = {_edge(loose[1])}), {places}, j.e)"
        result = f"named_struct({start}, 'found', concat({', '.join(parts)}), 'members', {all_members}, 'elements', {all_elements}, 'unsure', u)"
        return let(seen, "j", let(unsure, "u", result))


class Checker:
    """Validates text columns of a table whose rows carry ``schema_id``.

    Creating one compiles the catalog and looks at its size (small actions on the catalog
    only); ``attach`` and ``check`` are lazy. With ``labels_only`` violations carry no path and
    no detail, so none is built.
    """

    def __init__(
        self,
        catalog: DataFrame,
        inline_schemas: int = INLINE_SCHEMAS,
        inline_rules: int = INLINE_RULES,
        broadcast_bytes: int = BROADCAST_BYTES,
        labels_only: bool = False,
    ):
        inline = _InlineRules.build(catalog, inline_schemas, inline_rules, labels_only)
        self.rules = inline or _JoinedRules(compile_schemas(catalog), broadcast_bytes, labels_only)

    def attach(self, df: DataFrame) -> DataFrame:
        """Bring the rules of each row's schema to the row."""
        return self.rules.attach(df)

    def check(
        self, df: DataFrame, text: str, verdict: str = "verdict", violations: str | None = None, strict: bool = True
    ) -> DataFrame:
        """Add a verdict struct for the column ``text`` of an attached table.

        ``violations`` names a column for the whole list. With ``strict=False`` an object
        is first extracted from surrounding text.
        """
        kept = [F.col(name(c)) for c in df.columns]
        if not strict:
            df = df.withColumn("__t", lenient_text(text))
        asked = text if strict else "__t"
        df = self.rules.find(df.withColumn("__w", parse_wrapped(asked)), asked)
        out = [*kept, self._verdict(text).alias(verdict)]
        if violations:
            out.append(F.coalesce("__found", F.expr(NO_VIOLATIONS)).alias(violations))
        return df.select(*out)

    @staticmethod
    def release(df: DataFrame, *structs: str) -> DataFrame:
        """Drop the attached rules and fix the finished columns ``structs``.

        The columns pass through a one-row generator, so that a later filter on them reads
        the finished value: pushed below their definition it would compute it a second time.
        The generator is an outer one because a filter is inferred below an inner one.
        """
        kept = [name(c) for c in df.columns if c not in ("__status", "__rules", "__chain", "__root", *structs)]
        packed = ", ".join(f"'{s}', {name(s)}" for s in structs)
        return df.selectExpr(*kept, f"explode_outer(array(named_struct({packed}))) AS __done").selectExpr(
            *kept, *[f"__done.{name(s)} AS {name(s)}" for s in structs]
        )

    @staticmethod
    def _verdict(text: str) -> Column:
        """Status first: text, then schema, then violations. Nothing passes by default."""
        first = F.col("__first")
        unread = F.when(beyond_parser(name(text)), "unsupported_text").otherwise("json_error")
        status = F.when(F.col("__w").isNull(), unread).otherwise(F.expr(
            "CASE WHEN __status IS NULL THEN 'unknown_schema'"
            " WHEN __status NOT IN ('ok', 'partly') THEN __status WHEN __first IS NULL THEN 'valid'"
            " WHEN __first.held AND __first.keyword <> 'number' THEN 'unsupported_schema'"
            " WHEN __first.held THEN 'unsupported_number' ELSE 'invalid' END"
        ))
        is_valid = F.when(status == "valid", True).when(status.isin("json_error", "bad_schema", "invalid"), False)
        keyword = F.when(status == "invalid", first["keyword"])
        category = (
            F.when(status == "json_error", "json_error")
            .when(status == "bad_schema", OTHER)
            .otherwise(category_of(keyword))
        )
        message = (
            F.when(status == "json_error", json_error_message(F.col(name(text))))
            .when(status == "bad_schema", "Unknown Error: the schema cannot be used")
            .when(status == "invalid", schema_error_message(first["detail"]))
        )
        return F.struct(
            is_valid.alias("is_valid"),
            status.alias("status"),
            category.alias("category"),
            keyword.alias("keyword"),
            F.when(status == "invalid", first["path"]).alias("path"),
            message.alias("message"),
        )


def validate_calls(
    calls: DataFrame, catalog: DataFrame, text: str = "call", strict: bool = True, **limits
) -> DataFrame:
    """Verdict per call: is_valid, status, category, keyword, path, message."""
    checker = Checker(catalog, **limits)
    checked = checker.check(checker.attach(calls), text, "__verdict", strict=strict)
    return checker.release(checked, "__verdict").select(*calls.columns, "__verdict.*")


def violation_table(calls: DataFrame, catalog: DataFrame, text: str = "call", **limits) -> DataFrame:
    """One row per violated demand, all of them, without the call text; with ``labels_only=True``
    ``path`` is empty and ``detail`` null."""
    checker = Checker(catalog, **limits)
    checked = checker.check(checker.attach(calls), text, "__verdict", "__violations")
    others = [name(c) for c in calls.columns if c != text]
    rows = checked.selectExpr(*others, "explode_outer(__violations) AS __one").filter("NOT __one.held")
    return rows.select(
        *others,
        F.col("__one.path").alias("path"),
        F.col("__one.keyword").alias("keyword"),
        category_of(F.col("__one.keyword")).alias("category"),
        F.col("__one.detail").alias("detail"),
    )
