"""A plain statement of the validation rules, for small fixtures only."""

import json
import math
import re
from fractions import Fraction
from urllib.parse import unquote

RANK = {"type": 0, "enum": 1, "const": 2, "required": 3, "additionalProperties": 4}
CATEGORY = {
    "type": "type_mismatch",
    "enum": "enum_violation",
    "required": "missing_required",
    "additionalProperties": "hallucinated_param",
}


def _no_constant(text):
    raise ValueError(text)


def strict_json(text):
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except ValueError:
        return False, None


def kind(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, (int, float)):
        return "integer" if isinstance(x, int) or (math.isfinite(x) and x == int(x)) else "number"
    return {str: "string", list: "array", dict: "object"}[type(x)]


def same(a, b):
    if kind(a) in ("integer", "number") and kind(b) in ("integer", "number"):
        return a == b
    if kind(a) != kind(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def _walk(schema):
    """All schemas within one, by keyword."""
    if isinstance(schema, dict):
        yield schema
        for k, v in schema.items():
            if k in ("properties", "patternProperties", "dependentSchemas", "$defs", "definitions"):
                for inner in v.values():
                    yield from _walk(inner)
            elif k in ("allOf", "anyOf", "oneOf", "prefixItems"):
                for inner in v:
                    yield from _walk(inner)
            elif k not in ("enum", "const", "default") and isinstance(v, dict):
                yield from _walk(v)


def target(link, root):
    """What a reference of a schema without nested addresses points to."""
    name, _, fragment = link.partition("#")
    if name:
        root = next(s for s in _walk(root) if s.get("$id") == name)
    if fragment and not fragment.startswith("/"):
        return next(s for s in _walk(root) if s.get("$anchor") == fragment)
    for step in unquote(fragment).split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        root = root[int(step)] if isinstance(root, list) else root[step]
    return root


def _fits(x, schema, root):
    return not violations(x, schema, (), root)


def _beside(x, schema, root):
    """Schemas that apply to ``x`` beside this one, passed or not judged at all ones left out."""
    out = [target(schema["$ref"], root)] if "$ref" in schema else []
    for k in ("allOf", "anyOf", "oneOf"):
        out += schema.get(k, [])
    if "if" in schema:
        fits = _fits(x, schema["if"], root)
        out += [schema["if"]] + [schema[k] for k in (["then"] if fits else ["else"]) if k in schema]
    if isinstance(x, dict):
        out += [s for k, s in schema.get("dependentSchemas", {}).items() if k in x]
    return [s for s in out if _fits(x, s, root)]


def judged_members(x, schema, root, own=False):
    """Members that a schema judges; with ``own`` all but what ``unevaluatedProperties`` does."""
    if isinstance(schema, bool):
        return set()
    if "additionalProperties" in schema or ("unevaluatedProperties" in schema and not own):
        return set(x)
    out = {k for k in x if k in schema.get("properties", {})}
    out |= {k for k in x if any(re.search(p, k) for p in schema.get("patternProperties", {}))}
    return out.union(*(judged_members(x, s, root) for s in _beside(x, schema, root)))


def judged_elements(x, schema, root, own=False):
    if isinstance(schema, bool):
        return set()
    if "items" in schema or ("unevaluatedItems" in schema and not own):
        return set(range(len(x)))
    out = set(range(min(len(x), len(schema.get("prefixItems", [])))))
    if "contains" in schema:
        out |= {i for i, e in enumerate(x) if _fits(e, schema["contains"], root)}
    return out.union(*(judged_elements(x, s, root) for s in _beside(x, schema, root)))


def violations(x, schema, path=(), root=None):
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [(path, "false", "")]
    out = []
    if "$ref" in schema:
        out += violations(x, target(schema["$ref"], root), path, root)
    for branch in schema.get("allOf", []):
        out += violations(x, branch, path, root)
    valid = {k: [not violations(x, b, path, root) for b in schema[k]] for k in ("anyOf", "oneOf") if k in schema}
    if "anyOf" in valid and not any(valid["anyOf"]):
        out.append((path, "anyOf", ""))
    if "oneOf" in valid and sum(valid["oneOf"]) != 1:
        out.append((path, "oneOf", ""))
    if "not" in schema and not violations(x, schema["not"], path, root):
        out.append((path, "not", ""))
    if "if" in schema:
        branch = schema.get("then" if _fits(x, schema["if"], root) else "else", True)
        out += violations(x, branch, path, root)
    k = kind(x)
    if "type" in schema:
        allowed = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if k not in allowed and not (k == "integer" and "number" in allowed):
            out.append((path, "type", ""))
    if "enum" in schema and not any(same(x, e) for e in schema["enum"]):
        out.append((path, "enum", ""))
    if "const" in schema and not same(x, schema["const"]):
        out.append((path, "const", ""))
    if k == "object":
        out += [(path, "required", r) for r in schema.get("required", []) if r not in x]
        known = schema.get("properties", {})
        patterns = schema.get("patternProperties", {})
        extra = {key for key in set(x) - set(known) if not any(re.search(p, key) for p in patterns)}
        others = schema.get("additionalProperties", True)
        if others is False and extra:
            out.append((path, "additionalProperties", ""))
        if isinstance(others, dict):
            for key in extra:
                out += violations(x[key], others, (*path, key), root)
        for pattern, child in patterns.items():
            for key in x:
                if re.search(pattern, key):
                    out += violations(x[key], child, (*path, key), root)
        for key in x if "propertyNames" in schema else ():
            out += violations(key, schema["propertyNames"], path, root)
        for key, needs in schema.get("dependentRequired", {}).items():
            out += [(path, "dependentRequired", n) for n in needs if key in x and n not in x]
        for key, child in schema.get("dependentSchemas", {}).items():
            out += violations(x, child, path, root) if key in x else []
        if "unevaluatedProperties" in schema:
            left = set(x) - judged_members(x, schema, root, own=True)
            if schema["unevaluatedProperties"] is False and left:
                out.append((path, "unevaluatedProperties", ""))
            elif not isinstance(schema["unevaluatedProperties"], bool):
                for key in left:
                    out += violations(x[key], schema["unevaluatedProperties"], (*path, key), root)
        for key, child in known.items():
            if key in x:
                out += violations(x[key], child, (*path, key), root)
    if k == "array":
        first = schema.get("prefixItems", [])
        for i, e in enumerate(x):
            child = first[i] if i < len(first) else schema.get("items", True)
            out += violations(e, child, (*path, str(i)), root)
        if "contains" in schema:
            n = sum(_fits(e, schema["contains"], root) for e in x)
            least = schema.get("minContains", 1)
            if n < least:
                out.append((path, "minContains" if n else "contains", ""))
            if n > schema.get("maxContains", math.inf):
                out.append((path, "maxContains", ""))
        if schema.get("uniqueItems") and any(same(a, b) for i, a in enumerate(x) for b in x[:i]):
            out.append((path, "uniqueItems", ""))
        if "unevaluatedItems" in schema:
            left = set(range(len(x))) - judged_elements(x, schema, root, own=True)
            if schema["unevaluatedItems"] is False and left:
                out.append((path, "unevaluatedItems", ""))
            elif not isinstance(schema["unevaluatedItems"], bool):
                for i in left:
                    out += violations(x[i], schema["unevaluatedItems"], (*path, str(i)), root)
    sizes = {"array": "Items", "string": "Length", "object": "Properties"}
    if k in sizes:
        if len(x) < schema.get(f"min{sizes[k]}", 0):
            out.append((path, f"min{sizes[k]}", ""))
        if len(x) > schema.get(f"max{sizes[k]}", math.inf):
            out.append((path, f"max{sizes[k]}", ""))
    if k in ("integer", "number"):
        for keyword, bad in (
            ("minimum", lambda a, b: a < b),
            ("maximum", lambda a, b: a > b),
            ("exclusiveMinimum", lambda a, b: a <= b),
            ("exclusiveMaximum", lambda a, b: a >= b),
        ):
            if keyword in schema and bad(x, schema[keyword]):
                out.append((path, keyword, ""))
        if "multipleOf" in schema and Fraction(repr(x)) % Fraction(repr(schema["multipleOf"])) != 0:
            out.append((path, "multipleOf", ""))
    if k == "string" and "pattern" in schema and not re.search(schema["pattern"], x):
        out.append((path, "pattern", ""))
    return out


def primary(found):
    """(path, keyword) of the primary violation, or None."""
    if not found:
        return None
    path, keyword, _ = min(found, key=lambda f: (len(f[0]), RANK.get(f[1], 5), f[0], f[1], f[2]))
    return list(path), keyword
