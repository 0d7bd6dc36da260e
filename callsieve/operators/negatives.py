"""Hard negatives: break a valid call in exactly one known way.

Only calls that are valid to begin with are broken, so that nothing else is wrong with the
result. Four kinds: a parameter the schema does not know, an integer passed as text, a value outside
its enum, a required parameter left out. A row to which a kind does not apply gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.functions.jsontext import parse_strict
from callsieve.functions.sqltext import name, quote
from callsieve.functions.variants import field, fields, from_text, kind_of
from callsieve.operators.schemas import NO_SCHEMA, compile_schemas
from callsieve.operators.salting import join_unique
from callsieve.operators.validate import BROADCAST_BYTES, Checker
from callsieve.session import materialise

KIND_CATEGORY = {
    "hallucinated_param": "hallucinated_param",
    "type_mismatch": "type_mismatch",
    "enum_violation": "enum_violation",
    "missing_required": "missing_required",
}


def parameter_targets(compiled: DataFrame) -> DataFrame:
    """Per schema: which parameters each kind can break, by name."""
    direct = "size(r.path) = 2 AND r.path[0] = 'parameters' AND r.path[1] <> '[]'"
    closed = "filter(rules, r -> r.at = '/parameters')[0]"
    ints = f"filter(rules, r -> {direct} AND array_contains(r.type, 'integer') AND NOT array_contains(r.type, 'string'))"
    enums = (
        f"filter(rules, r -> {direct} AND r.enum IS NOT NULL AND size(r.enum) > 0 AND forall(r.enum,"
        " e -> startswith(e, '\"')) AND (r.type IS NULL OR array_contains(r.type, 'string')))"
    )
    return compiled.filter("status = 'ok'").selectExpr(
        "schema_id",
        f"if(coalesce({closed}.additional_allowed, true), NULL, {closed}.property_names) AS closed_names",
        f"array_sort(transform({ints}, r -> r.path[1])) AS integers",
        f"map_from_entries(transform({enums}, r -> struct(r.path[1], array_max(r.enum)))) AS enums",
        f"array_sort(coalesce({closed}.required, cast(array() AS array<string>))) AS required",
    )


def hard_negatives(
    calls: DataFrame,
    catalog: DataFrame,
    kind: str | list[str],
    text: str = "call",
    id_column: str = "example_id",
    target: str | None = None,
    extra_key: str = "zz",
    seed: int = 42,
) -> DataFrame:
    """Add ``rejected`` and ``kind`` to the valid calls that the kind applies to; of several
    kinds, one row for each.

    The parameter to break is picked by a hash of id and seed over the names in order, or
    fixed by ``target``. A key is added under ``extra_key``, or if the schema or the call knows
    that, under the greatest known key with ``_x`` behind it.
    """
    kinds = [kind] if isinstance(kind, str) else kind
    checker = Checker(catalog)
    checked = checker.release(checker.check(checker.attach(calls), text, "__verdict"), "__verdict")
    calls = checked.filter("__verdict.is_valid").drop("__verdict")
    targets = materialise(parameter_targets(compile_schemas(catalog)), "targets")
    size = targets.agg(F.sum(F.length(F.to_json(F.struct(*targets.columns))))).first()[0] or 0
    keyed = calls.withColumn("__sid", F.coalesce(F.col("schema_id"), F.lit(NO_SCHEMA)))
    targets = targets.withColumnRenamed("schema_id", "__sid")
    if size <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(targets), "__sid")
    else:
        joined = join_unique(keyed, targets, "__sid")
    present = "map_keys(__params)"
    options_of = {
        "hallucinated_param": "if(closed_names IS NULL, NULL, array(''))",
        "type_mismatch": f"filter(integers, k -> array_contains({present}, k)"
        f" AND {kind_of('__params[k]')} = 'integer')",
        "enum_violation": f"filter(array_sort(map_keys(enums)), k -> array_contains({present}, k))",
        "missing_required": f"filter(required, k -> array_contains({present}, k))",
    }
    if target is not None:
        for one in options_of.keys() - {"hallucinated_param"}:
            options_of[one] = f"filter({options_of[one]}, k -> k = {quote(target)})"
    taken = f"array_union(closed_names, {present})"
    new_key = (
        f"if(array_contains({taken}, {quote(extra_key)}), concat(array_max({taken}), '_x'), {quote(extra_key)})"
    )
    edits = {
        "hallucinated_param": f"map_concat(__params, map({new_key}, {from_text(quote('extra'))}))",
        "type_mismatch": "transform_values(__params, (k, v) -> if(k = p, "
        + from_text("try_variant_get(v, '$', 'string')")
        + ", v))",
        "enum_violation": "transform_values(__params, (k, v) -> if(k = p, "
        + from_text("concat(substring(enums[p], 2, length(enums[p]) - 2), '_x')")
        + ", v))",
        "missing_required": "map_filter(__params, (k, v) -> k <> p)",
    }
    opened = joined.withColumn("__v", parse_strict(text)).selectExpr(
        "*", f"{fields('__v')} AS __call", f"{fields(field('__v', 'parameters'))} AS __params"
    )
    broken = []
    for k in kinds:
        # One name of those that can be broken, as a list of one or none.
        place = f"pmod(xxhash64({name(id_column)}, {seed}), size(o))"
        picked = f"flatten(transform(array({options_of[k]}), o -> if(size(o) > 0, array(o[{place}]), array())))"
        call = (
            "to_json(map_concat(map_filter(__call, (k, v) -> k <> 'parameters'),"
            f" map('parameters', parse_json(to_json({edits[k]})))))"
        )
        broken.append(f"transform({picked}, p -> named_struct('rejected', {call}, 'kind', {quote(k)}))")
    every = f"if(__params IS NOT NULL, concat({', '.join(f'coalesce({b}, array())' for b in broken)}), NULL)"
    kept = [name(c) for c in calls.columns]
    rows = opened.selectExpr(*kept, f"explode_outer({every}) AS __b").filter("__b IS NOT NULL")
    return rows.selectExpr(*kept, "__b.rejected AS rejected", "__b.kind AS kind")
