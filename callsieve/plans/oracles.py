"""Expected answers in SQL, reached another way: from the mutation rule and the source columns."""

from __future__ import annotations

import json

from callsieve.functions.chatml import SYSTEM_PROMPT
from callsieve.plans import derive


def _call(tool: str, *parameters: str) -> str:
    return f"CAST(json_object('tool', '{tool}', 'parameters', json_object({', '.join(parameters)})) AS VARCHAR)"


_C, _P = ("'customer'", "o_custkey"), ("'priority'", "o_orderpriority")
_R = ("'date'", "strftime(o_orderdate, '%Y-%m-%d')", "'total'", "o_totalprice")
GOOD = _call("create_order", *_C, *_P, *_R)
TYPE = _call("create_order", "'customer'", "CAST(o_custkey AS VARCHAR)", *_P, *_R)
ENUM = _call("create_order", *_C, "'priority'", "'urgent'", *_R)
EXTRA = _call("create_order", *_C, *_P, *_R, "'zz'", "1")
MISSING = _call("create_order", *_C, *_R)
TRAILING = f"{GOOD} || ' sure!'"
SIX = (
    f"CASE o_orderkey % 6 WHEN 0 THEN {TYPE} WHEN 1 THEN {ENUM} WHEN 2 THEN {EXTRA}"
    f" WHEN 3 THEN {MISSING} WHEN 4 THEN {TRAILING} ELSE {GOOD} END"
)
CATEGORY6 = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'type_mismatch' WHEN 1 THEN 'enum_violation' WHEN 2 THEN 'hallucinated_param'"
    " WHEN 3 THEN 'missing_required' WHEN 4 THEN 'json_error' END"
)
KEYWORD6 = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'type' WHEN 1 THEN 'enum' WHEN 2 THEN 'additionalProperties'"
    " WHEN 3 THEN 'required' END"
)
PATH6 = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'parameters/customer' WHEN 1 THEN 'parameters/priority'"
    " WHEN 2 THEN 'parameters' WHEN 3 THEN 'parameters' END"
)
STATUS6 = "CASE o_orderkey % 6 WHEN 4 THEN 'json_error' WHEN 5 THEN 'valid' ELSE 'invalid' END"
CATEGORY4 = (
    "CASE o_orderkey % 4 WHEN 0 THEN 'enum_violation' WHEN 1 THEN 'missing_required' WHEN 2 THEN 'json_error' END"
)
PROMPT = (
    "'Order for customer ' || o_custkey || ' with priority ' || o_orderpriority || '.' || chr(10) ||"
    " 'Tool: create_order(customer: int, priority: enum, date: str, total: float)'"
)


def _chat(user: str) -> str:
    return (
        f"'<|im_start|>system' || chr(10) || '{SYSTEM_PROMPT}' || '<|im_end|>' || chr(10) || '<|im_start|>user'"
        f" || chr(10) || {user} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
    )


CHOSEN = f"CASE WHEN o_orderstatus = 'P' THEN {MISSING} ELSE {GOOD} END"
REASON = (
    "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 6 = 5 THEN 'both' WHEN o_orderstatus = 'P' THEN 'chosen_invalid'"
    " WHEN o_orderkey % 6 = 5 THEN 'rejected_valid' END"
)
ITEMS = (
    "SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 10000000000 + o_orderkey ELSE o_orderkey // 5 END AS batch_id"
    " FROM orders"
)
PLACED = (
    f"SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY o_orderkey) - 1 AS pos,"
    f" o_orderkey AS example_id, CASE WHEN o_orderstatus = 'P' THEN 'malformed_item'"
    f" WHEN o_orderkey % 6 = 5 THEN 'rejected_valid' END AS discard_reason FROM ({ITEMS})"
)
SCORED = (
    f"SELECT 'A' AS model, o_orderkey AS example_id, {CATEGORY6} AS category FROM orders UNION ALL"
    f" SELECT 'B', o_orderkey, {CATEGORY4} FROM orders WHERE o_orderstatus <> 'P'"
)
CATEGORIES = (
    "(VALUES ('json_error'), ('hallucinated_param'), ('type_mismatch'), ('enum_violation'), ('missing_required'),"
    " ('other_schema_error')) AS c(category)"
)
BREAKDOWN = (
    f"WITH s AS ({SCORED}), t AS (SELECT model, count(*) AS total FROM s GROUP BY model)"
    " SELECT t.model, t.total, c.category, count(s.category) AS n,"
    " round(100.0 * count(s.category) / t.total, 1)::DOUBLE AS percent"
    f" FROM t CROSS JOIN {CATEGORIES} LEFT JOIN s ON s.model = t.model AND s.category = c.category"
    " GROUP BY t.model, t.total, c.category"
)
RATES = (
    f"SELECT model, count(*) AS total, count(*) FILTER (category IS NULL) AS passed, CAST(0 AS BIGINT) AS no_verdict,"
    f" count(*) FILTER (category IS NULL) / count(*)::DOUBLE AS pass_rate FROM ({SCORED}) GROUP BY model"
)
SCHEMA = "'" + json.dumps(json.loads(derive.ORDER_SCHEMA), sort_keys=True, separators=(",", ":")) + "'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_HOSTILE = "[" + ", ".join(map(_text, [*derive.HOSTILE, "other"])) + "]"
_SIZE = len(derive.HOSTILE) + 1
HOSTILE_VIOLATIONS = (
    f"SELECT o_orderkey AS example_id, '{{it}}' AS key, 'enum' AS keyword FROM orders WHERE o_orderkey % {_SIZE} = {_SIZE - 1}"
    " UNION ALL SELECT o_orderkey, 'it''s \"k\"', 'const' FROM orders WHERE o_orderkey % 2 = 1"
    f" AND ({_HOSTILE})[1 + (o_orderkey // 3) % {_SIZE}] <> {_text(derive.HOSTILE[2])}"
    " UNION ALL SELECT o_orderkey, 'p', 'pattern' FROM orders WHERE o_orderkey % 5 = 0"
)
# The same six ways against the composed schema: the priority fails its anyOf, and the extra
# member fails the type of undeclared ones.
COMPOSED = f"""
    SELECT o_orderkey AS example_id, o_orderkey % 6 = 5 AS is_valid, {STATUS6} AS status,
    CASE o_orderkey % 6 WHEN 0 THEN 'type_mismatch' WHEN 1 THEN 'other_schema_error' WHEN 2 THEN 'type_mismatch'
      WHEN 3 THEN 'missing_required' WHEN 4 THEN 'json_error' END AS category,
    CASE o_orderkey % 6 WHEN 0 THEN 'type' WHEN 1 THEN 'anyOf' WHEN 2 THEN 'type' WHEN 3 THEN 'required' END AS keyword,
    CASE o_orderkey % 6 WHEN 0 THEN 'parameters/customer' WHEN 1 THEN 'parameters/priority'
      WHEN 2 THEN 'parameters/zz' WHEN 3 THEN 'parameters' END AS path FROM orders"""
CITE = "CAST(json_object('tool', 'cite', 'parameters', json_object('doc', doc_id, 'lang', lang)) AS VARCHAR)"

# Schemas made from parts: the text itself, and what each position demands.
PART_SCHEMA = (
    "CAST(json_object('type', 'object', 'properties', json_object('tool', json_object('const', 'quote'),"
    " 'parameters', json_object('type', 'object', 'properties', json_object("
    "'size', json_object('type', 'integer', 'maximum', p_size), 'brand', json_object('enum', json_array(p_brand, 'any')),"
    " 'name', json_object('type', json_array('string', 'null'), 'minLength', length(p_name))),"
    " 'required', json_array('size'), 'additionalProperties', false))) AS VARCHAR)"
)
PART_SCHEMAS = f"SELECT DISTINCT {PART_SCHEMA} AS schema, p_size, p_brand, length(p_name) AS name_length FROM part"
MANY = (
    "SELECT p_partkey AS example_id, NOT (p_partkey % 3 = 0 OR p_partkey % 5 = 0) AS is_valid,"
    " CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'invalid' ELSE 'valid' END AS status,"
    " CASE WHEN p_partkey % 5 = 0 THEN 'enum_violation' WHEN p_partkey % 3 = 0 THEN 'other_schema_error' END AS category,"
    " CASE WHEN p_partkey % 5 = 0 THEN 'enum' WHEN p_partkey % 3 = 0 THEN 'maximum' END AS keyword,"
    " CASE WHEN p_partkey % 5 = 0 THEN 'parameters/brand' WHEN p_partkey % 3 = 0 THEN 'parameters/size' END AS path"
    " FROM part"
)
_NO = "CAST(NULL AS VARCHAR)"
LINE_FAULTS = " UNION ALL ".join(
    f"SELECT l_orderkey || '-' || l_linenumber AS call_id, '{path}' AS path, '{keyword}' AS keyword,"
    f" '{category}' AS category FROM lineitem WHERE {test}"
    for path, keyword, category, test in (
        ("parameters/line", "exclusiveMaximum", "other_schema_error", "l_linenumber >= 7"),
        ("parameters/amounts/0", "maximum", "other_schema_error", "l_quantity > 40"),
        ("parameters/flag", "enum", "enum_violation", "l_returnflag NOT IN ('A', 'N')"),
        ("parameters/ship", "pattern", "other_schema_error", "year(l_shipdate) NOT BETWEEN 1990 AND 2000"),
    )
)


def _customer_call(*parameters: str) -> str:
    return _call("open_account", *parameters)


def _part_call(size: str, kind: str) -> str:
    return _call("list_part", "'brand'", "p_brand", "'part'", "p_partkey", "'size'", size, "'type'", kind)


LINKED = """
        SELECT o_orderkey AS example_id, o_orderkey % 6 = 0 AS is_valid, CASE WHEN o_orderkey % 6 > 0 THEN 'type' END AS keyword,
        CASE o_orderkey % 6 WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' WHEN 4 THEN 'e' WHEN 5 THEN repeat('n/', 20) || 'n' END AS path
        FROM orders"""
WITH_GAPS = """
        SELECT conv_id, turn, CASE WHEN NOT (conv_id % 7 = 0 AND turn = 1) THEN role END AS role,
        CASE WHEN NOT (conv_id % 5 = 0 AND turn = 0) THEN text END AS text FROM conversations"""

STREAMED = f"""
    SELECT batch_id, pos, discard_reason FROM ({PLACED})
    UNION ALL SELECT -1 - doc_id, CASE WHEN doc_id % 4 = 3 THEN 0 END,
    CASE doc_id % 4 WHEN 0 THEN 'not_json' WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'not_a_list' ELSE 'malformed_item' END
    FROM documents
    UNION ALL SELECT NULL, NULL, 'not_a_record' FROM nation"""

ORACLES = {
    "strict_json_check": "SELECT o_orderkey AS example_id, o_orderkey % 6 <> 4 AS is_json FROM orders",
    "extract_json_cases": f"""
        SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN {CITE} END AS extracted,
        CASE WHEN doc_id % 5 < 4 THEN length({CITE}) ELSE 2 * length(text) + 10 END AS lenient_chars FROM documents""",
    "lenient_validation": """
        SELECT doc_id, doc_id % 5 < 4 AS is_valid, CASE WHEN doc_id % 5 = 4 THEN 'json_error' END AS category,
        doc_id % 5 = 0 AS strict_valid FROM documents""",
    "schema_catalog": f"SELECT sha256(schema) AS schema_id, length(schema) AS n_chars FROM ({PART_SCHEMAS})",
    "compile_constraints": f"""
        WITH s AS (SELECT *, sha256(schema) AS schema_id FROM ({PART_SCHEMAS}))
        SELECT schema_id, '' AS path, 'object' AS types, {_NO} AS enum_values, {_NO} AS const_value,
          {_NO} AS required_keys, 'parameters,tool' AS property_names, true AS additional_allowed,
          CAST(NULL AS DOUBLE) AS maximum, CAST(NULL AS BIGINT) AS min_length FROM s
        UNION ALL SELECT schema_id, 'tool', NULL, NULL, '"quote"', NULL, '', true, NULL, NULL FROM s
        UNION ALL SELECT schema_id, 'parameters', 'object', NULL, NULL, 'size', 'brand,name,size', false, NULL, NULL
          FROM s
        UNION ALL SELECT schema_id, 'parameters/size', 'integer', NULL, NULL, NULL, '', true, p_size::DOUBLE, NULL FROM s
        UNION ALL SELECT schema_id, 'parameters/brand', NULL, '"' || p_brand || '","any"', NULL, NULL, '', true, NULL,
          NULL FROM s
        UNION ALL SELECT schema_id, 'parameters/name', 'string,null', NULL, NULL, NULL, '', true, NULL, name_length
          FROM s""",
    "shred_call_nodes": f"""
        SELECT o_orderkey AS example_id, '' AS path, 'object' AS json_type, {_NO} AS text_json,
          CAST(NULL AS DOUBLE) AS number_value, 'parameters,tool' AS child_keys FROM orders
        UNION ALL SELECT o_orderkey, 'tool', 'string', '"create_order"', NULL, NULL FROM orders
        UNION ALL SELECT o_orderkey, 'parameters', 'object', NULL, NULL, 'customer,date,priority,total' FROM orders
        UNION ALL SELECT o_orderkey, 'parameters/customer', 'integer', NULL, o_custkey::DOUBLE, NULL FROM orders
        UNION ALL SELECT o_orderkey, 'parameters/priority', 'string', '"' || o_orderpriority || '"', NULL, NULL
          FROM orders
        UNION ALL SELECT o_orderkey, 'parameters/date', 'string', '"' || strftime(o_orderdate, '%Y-%m-%d') || '"', NULL,
          NULL FROM orders
        UNION ALL SELECT o_orderkey, 'parameters/total',
          CASE WHEN o_totalprice = floor(o_totalprice) THEN 'integer' ELSE 'number' END, NULL, o_totalprice, NULL
          FROM orders""",
    "validate_orders": f"""
        SELECT o_orderkey AS example_id, o_orderkey % 6 = 5 AS is_valid, {STATUS6} AS status, {CATEGORY6} AS category,
        {KEYWORD6} AS keyword, {PATH6} AS path FROM orders""",
    "violations_all": f"""
        SELECT o_orderkey::VARCHAR AS call_id, {PATH6} AS path, {KEYWORD6} AS keyword, {CATEGORY6} AS category
        FROM orders WHERE o_orderkey % 6 < 4 UNION ALL {LINE_FAULTS}""",
    "violation_counts": f"SELECT category, keyword, count(*) AS n FROM ({LINE_FAULTS}) GROUP BY category, keyword",
    "verdict_primary": """
        SELECT c_custkey AS example_id, c_custkey % 5 = 4 AS is_valid,
        CASE WHEN c_custkey % 5 = 4 THEN 'valid' ELSE 'invalid' END AS status,
        CASE c_custkey % 5 WHEN 0 THEN 'missing_required' WHEN 1 THEN 'type_mismatch' WHEN 2 THEN 'hallucinated_param'
          WHEN 3 THEN 'missing_required' END AS category,
        CASE c_custkey % 5 WHEN 0 THEN 'required' WHEN 1 THEN 'type' WHEN 2 THEN 'additionalProperties'
          WHEN 3 THEN 'required' END AS keyword,
        CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'parameters/customer' WHEN 2 THEN ''
          WHEN 3 THEN 'parameters' END AS path,
        'Schema Violation: ' || CASE c_custkey % 5 WHEN 0 THEN '''parameters'' is a required property'
          WHEN 1 THEN '"' || c_name || '" is not of type ''integer'''
          WHEN 2 THEN 'Additional properties are not allowed (''note'' was unexpected)'
          WHEN 3 THEN '''name'' is a required property' END AS message FROM customer""",
    "many_schemas_validation": MANY,
    "many_schemas_salted": MANY,
    "event_props_validation": """
        WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_id, k <= 49 AS is_valid, CASE WHEN k > 49 THEN 'other_schema_error' END AS category,
        CASE WHEN k > 49 THEN 'maximum' END AS keyword,
        CASE WHEN k > 49 THEN 'Schema Violation: ' || k || ' is greater than the maximum of 49' END AS message FROM e""",
    "unsupported_schema_guard": f"""
        SELECT o_orderkey AS example_id,
        CASE WHEN o_orderkey % 6 = 4 THEN false WHEN o_orderstatus = 'P' THEN NULL
          WHEN o_orderstatus = 'F' THEN false ELSE o_orderkey % 6 = 5 END AS is_valid,
        CASE WHEN o_orderkey % 6 = 4 THEN 'json_error' WHEN o_orderstatus = 'P' THEN 'unsupported_schema'
          WHEN o_orderstatus = 'F' THEN 'bad_schema' ELSE {STATUS6} END AS status,
        CASE WHEN o_orderkey % 6 = 4 THEN 'json_error' WHEN o_orderstatus = 'P' THEN NULL
          WHEN o_orderstatus = 'F' THEN 'other_schema_error' ELSE {CATEGORY6} END AS category FROM orders""",
    "pair_gate": f"""
        SELECT o_orderkey AS example_id, {CHOSEN} AS chosen, {SIX} AS rejected, {CATEGORY6} AS rejected_category,
        o_orderkey % 6 <> 4 AS rejected_is_json FROM orders WHERE {REASON} IS NULL""",
    "pair_gate_json_only": f"""
        SELECT o_orderkey AS example_id, {CATEGORY6} AS rejected_category FROM orders
        WHERE {REASON} IS NULL AND o_orderkey % 6 <> 4""",
    "gate_discards": f"SELECT o_orderkey AS example_id, {REASON} AS discard_reason FROM orders WHERE {REASON} IS NOT NULL",
    "gate_batches": PLACED,
    "gate_batches_drop_rest": f"""
        WITH p AS ({PLACED}), b AS (SELECT batch_id, min(pos) AS first_bad FROM p
          WHERE discard_reason = 'malformed_item' GROUP BY batch_id)
        SELECT p.* FROM p LEFT JOIN b USING (batch_id) WHERE first_bad IS NULL OR pos < first_bad""",
    "rejected_documents": """
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'not_json' WHEN 1 THEN 'not_an_object' ELSE 'not_a_list' END AS reason
        FROM documents WHERE doc_id % 4 <> 3""",
    "gate_cap": f"""
        SELECT batch_id, pos, example_id FROM ({PLACED}) WHERE discard_reason IS NULL
        ORDER BY batch_id, pos LIMIT 1000""",
    "gate_cap_whole_batch": f"""
        WITH a AS (SELECT batch_id, pos, example_id FROM ({PLACED}) WHERE discard_reason IS NULL),
        c AS (SELECT batch_id, count(*) AS rows FROM a GROUP BY batch_id),
        r AS (SELECT batch_id, coalesce(sum(rows) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING
          AND 1 PRECEDING), 0) AS before FROM c)
        SELECT a.* FROM a JOIN r USING (batch_id) WHERE before < 1000""",
    "pair_audit": f"SELECT count(*) FILTER ({REASON} IS NULL) AS valid_pairs, count(*) AS total_pairs FROM orders",
    "pair_offenders": f"""
        SELECT o_orderkey AS example_id, {PROMPT} AS prompt, {REASON} AS discard_reason FROM orders
        WHERE {REASON} IS NOT NULL""",
    "hard_negatives_hallucinated": f"""
        SELECT c_custkey AS example_id, {_customer_call("'customer'", 'c_custkey', "'name'", 'c_name', "'segment'",
        'c_mktsegment', "'zz'", "'extra'")} AS rejected, 'hallucinated_param' AS kind, 'hallucinated_param' AS category
        FROM customer""",
    "hard_negatives_type": f"""
        SELECT p_partkey AS example_id, {_part_call('CAST(p_size AS VARCHAR)', 'p_type')} AS rejected,
        'type_mismatch' AS kind, 'type_mismatch' AS category FROM part""",
    "hard_negatives_enum": f"""
        SELECT p_partkey AS example_id, {_part_call('p_size', "'STANDARD_x'")} AS rejected,
        'enum_violation' AS kind, 'enum_violation' AS category FROM part""",
    "hard_negatives_missing": f"""
        SELECT c_custkey AS example_id, {_customer_call("'customer'", 'c_custkey', "'segment'", 'c_mktsegment')}
        AS rejected, 'missing_required' AS kind, 'missing_required' AS category FROM customer""",
    "hard_negatives_hashed": """
        SELECT p_partkey AS example_id, kind, kind AS category, 1 AS n_broken FROM part
        CROSS JOIN (VALUES ('hallucinated_param'), ('type_mismatch'), ('enum_violation'), ('missing_required')) AS k(kind)""",
    "hard_negatives_six_ways": """
        SELECT o_orderkey AS example_id, kind, kind AS category, 1 AS n_broken FROM orders
        CROSS JOIN (VALUES ('hallucinated_param'), ('type_mismatch'), ('enum_violation'), ('missing_required')) AS k(kind)
        WHERE o_orderkey % 6 = 5""",
    "scored_responses": f"SELECT model, example_id, category IS NULL AS is_valid, category FROM ({SCORED})",
    "sspr_by_model": RATES,
    "sspr_overall": """
        SELECT count(*) AS total, count(*) FILTER (o_orderkey % 6 = 5) AS passed, CAST(0 AS BIGINT) AS no_verdict,
        count(*) FILTER (o_orderkey % 6 = 5) / count(*)::DOUBLE AS pass_rate FROM orders""",
    "failure_breakdown": BREAKDOWN,
    "failure_report": f"SELECT * FROM ({BREAKDOWN}) WHERE n > 0",
    "breakdown_rollup": f"""
        SELECT model, tool, outcome, GROUPING_ID(model, tool, outcome)::INTEGER AS level, count(*) AS n
        FROM (SELECT model, 'create_order' AS tool, coalesce(category, 'valid') AS outcome FROM ({SCORED}))
        GROUP BY ROLLUP (model, tool, outcome)""",
    "model_compare": f"""
        WITH b AS ({BREAKDOWN})
        SELECT a.category, a.n AS base_n, b.n AS new_n,
        CASE WHEN a.n > 0 THEN round(100.0 * (b.n - a.n) / a.n, 0)::DOUBLE END AS pct_change,
        round(100 * (b.n / b.total::DOUBLE - a.n / a.total::DOUBLE), 2) AS delta_pp,
        CASE WHEN a.n > 0 THEN round((b.n / b.total::DOUBLE) / (a.n / a.total::DOUBLE), 2) END AS ratio
        FROM b AS a JOIN b AS b ON a.category = b.category AND a.model = 'A' AND b.model = 'B'""",
    "model_gain": f"""
        WITH r AS ({RATES}), w AS (SELECT max(pass_rate) FILTER (model = 'A') AS base_rate,
          max(pass_rate) FILTER (model = 'B') AS new_rate FROM r)
        SELECT base_rate, new_rate, round(100 * (new_rate - base_rate), 2) AS delta_pp,
        round(new_rate / base_rate, 1) AS ratio FROM w""",
    "paired_outcomes": """
        SELECT o_orderkey % 6 = 5 AS pass_a, o_orderkey % 4 = 3 AS pass_b, count(*) AS n FROM orders
        WHERE o_orderstatus <> 'P' GROUP BY 1, 2""",
    "missing_responses": "SELECT o_orderkey AS example_id, 'B' AS model FROM orders WHERE o_orderstatus = 'P'",
    "batched_responses": f"""
        SELECT o_orderkey AS example_id, 'stub' AS model, sha256(upper({_chat(PROMPT)})) AS response_hash FROM orders""",
    "pref_pairs_chatml": f"""
        SELECT o_orderkey AS example_id, {_chat(PROMPT)} AS prompt, {CHOSEN} || '<|im_end|>' AS chosen,
        {SIX} || '<|im_end|>' AS rejected FROM orders""",
    "sft_text": f"SELECT o_orderkey AS example_id, {_chat(PROMPT)} || {CHOSEN} || '<|im_end|>' AS text FROM orders",
    "inference_prompt": f"SELECT o_orderkey AS example_id, {_chat(PROMPT)} AS model_prompt FROM orders",
    "conversation_chatml": """
        SELECT conv_id, count(*) AS n_turns,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id""",
    "length_budget": r"""
        SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_tokens,
        len(regexp_extract_all(text, '\S+')) > 2048 AS over_total FROM documents""",
    "truncated_texts": r"""
        WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ' || chr(10) || text || chr(9) || ' ' WHEN 1 THEN ''
          ELSE text END AS text FROM documents),
        w AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS n FROM d)
        SELECT doc_id, CASE WHEN n > 100 THEN regexp_extract(text, '^(\s*\S+){100}') ELSE text END AS text,
        least(n, 100) AS n_words FROM w""",
    "pair_budget": r"""
        WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_prompt FROM documents)
        SELECT doc_id, n_prompt + greatest(doc_id % 2000, doc_id % 1500) AS n_tokens,
        n_prompt + greatest(doc_id % 2000, doc_id % 1500) > 2048 AS over_total, n_prompt > 768 AS over_prompt FROM w""",
    "unrenderable_pairs": f"""
        WITH r AS (SELECT o_orderkey AS example_id, CASE WHEN o_orderkey % 7 <> 0 THEN {CHOSEN} END AS chosen,
          o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 AS bad FROM orders)
        SELECT example_id, CASE WHEN bad THEN chosen ELSE chosen || '<|im_end|>' END AS chosen,
        CASE WHEN bad THEN 'quarantined' ELSE 'rendered' END AS side FROM r""",
    "length_budget_kept": rf"""
        WITH d AS (SELECT doc_id, text, len(regexp_extract_all({_chat('text')} || lang || '<|im_end|>', '\S+'))
          AS n_tokens FROM documents)
        SELECT doc_id, n_tokens FROM d WHERE n_tokens <= 2048 AND len(regexp_extract_all(text, '\S+')) <= 768""",
    "inspect_outputs": f"""
        SELECT o_orderkey AS example_id, left({PROMPT}, 100) || '...' AS prompt_head,
        left({GOOD}, 150) || '...' AS expected_head, {SIX} AS response, o_orderkey % 6 <> 4 AS is_json
        FROM orders ORDER BY o_orderkey LIMIT 50""",
    "read_jsonl": f"SELECT {PROMPT} AS prompt, {CHOSEN} AS chosen, {SIX} AS rejected, {SCHEMA} AS schema FROM orders",
    "read_jsonl_permissive": f"""
        WITH r AS (SELECT o_orderkey % 6 = 4 AS broken, {PROMPT} AS p, {CHOSEN} AS c, {SIX} AS r FROM orders)
        SELECT CASE WHEN NOT broken THEN p END AS prompt, CASE WHEN NOT broken THEN c END AS chosen,
        CASE WHEN NOT broken THEN r END AS rejected, CASE WHEN NOT broken THEN {SCHEMA} END AS schema,
        CASE WHEN broken THEN r END AS _corrupt_record FROM r""",
    "export_roundtrip": f"""
        SELECT o_orderkey AS example_id, {_chat(PROMPT)} AS prompt, {CHOSEN} || '<|im_end|>' AS chosen, {SIX} || '<|im_end|>' AS rejected
        FROM orders WHERE {REASON} IS NULL""",
    "stream_gate": STREAMED,
    "stream_gate_repeated": STREAMED,
    "stream_gate_until": f"""
        SELECT count(*) >= 100 AS reached, true AS none_too_many, true AS batches_whole FROM ({PLACED})
        WHERE discard_reason IS NULL""",
    "deep_schema_validation": """
        SELECT o_orderkey AS example_id, o_orderkey % 3 <> 0 AS is_valid,
        CASE WHEN o_orderkey % 3 = 0 THEN 'invalid' ELSE 'valid' END AS status,
        CASE WHEN o_orderkey % 3 = 0 THEN 'type_mismatch' END AS category,
        CASE WHEN o_orderkey % 3 = 0 THEN 'type' END AS keyword,
        CASE WHEN o_orderkey % 3 = 0 THEN 'n/n/n/n/n/n/n/n/n/n' END AS path FROM orders""",
    "shred_deep_calls": """
        SELECT o_orderkey AS example_id, d AS depth, CASE WHEN d < 10 THEN 'object' WHEN o_orderkey % 3 = 0 THEN 'string'
        ELSE 'integer' END AS json_type FROM orders, range(11) AS r(d)""",
    "composed_schema_validation": COMPOSED,
    "composed_schema_joined": COMPOSED,
    "partly_judged_schema": f"""
        SELECT o_orderkey AS example_id, CASE WHEN o_orderkey % 6 <> 5 THEN false END AS is_valid,
        CASE o_orderkey % 6 WHEN 5 THEN 'unsupported_schema' WHEN 4 THEN 'json_error' ELSE 'invalid' END AS status,
        {CATEGORY6} AS category FROM orders""",
    "hostile_literals": HOSTILE_VIOLATIONS,
    "hostile_literals_joined": HOSTILE_VIOLATIONS,
    "hostile_literals_salted": HOSTILE_VIOLATIONS,
    "stream_tally": f"""
        SELECT model, coalesce(category, 'valid') AS outcome, count(*) AS n FROM ({SCORED})
        GROUP BY model, coalesce(category, 'valid')""",
    "recursive_schema_validation": """
        WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 9 + 1 AS INT) AS d FROM orders)
        SELECT k AS example_id, k % 4 IN (0, 3) AS is_valid,
        CASE k % 4 WHEN 1 THEN 'type' WHEN 2 THEN 'additionalProperties' END AS keyword,
        CASE k % 4 WHEN 1 THEN repeat('next/', d) || 'v' WHEN 2 THEN rtrim(repeat('next/', d), '/') END AS path FROM o""",
    "linked_schema_validation": LINKED,
    "linked_schema_joined": LINKED,
    "pattern_members_validation": """
        WITH o AS (SELECT o_orderkey AS example_id, ['ab', 'ax', 'cb', 'o', 'long'][o_orderkey % 5 + 1] AS key,
          ['1', 's', 'null', 'true'][o_orderkey % 4 + 1] AS val FROM orders),
        f AS (SELECT *, CASE WHEN key = 'long' THEN 'maxLength'
          WHEN key = 'ab' AND val <> '1' OR key = 'ax' AND val NOT IN ('1', 's') OR key = 'cb' AND val NOT IN ('1', 'null')
            OR key = 'o' AND val <> 'true' THEN 'type' END AS keyword FROM o)
        SELECT example_id, keyword IS NULL AS is_valid, keyword, CASE keyword WHEN 'type' THEN key WHEN 'maxLength' THEN '' END AS path
        FROM f""",
    "conditional_schema_validation": """
        SELECT o_orderkey AS example_id, o_orderkey % 6 IN (0, 5) AS is_valid,
        CASE o_orderkey % 6 WHEN 1 THEN 'required' WHEN 2 THEN 'false' WHEN 3 THEN 'dependentRequired' WHEN 4 THEN 'pattern' END AS keyword,
        CASE o_orderkey % 6 WHEN 1 THEN '' WHEN 2 THEN 'number' WHEN 3 THEN '' WHEN 4 THEN 'expiry' END AS path FROM orders""",
    "open_condition_validation": """
        SELECT o_orderkey AS example_id, CASE WHEN o_orderkey % 3 = 0 THEN true END AS is_valid,
        CAST(NULL AS VARCHAR) AS keyword, CAST(NULL AS VARCHAR) AS path FROM orders""",
    "unevaluated_members_validation": """
        SELECT o_orderkey AS example_id, o_orderkey % 5 < 2 AS is_valid,
        CASE o_orderkey % 5 WHEN 2 THEN 'unevaluatedProperties' WHEN 3 THEN 'unevaluatedProperties' WHEN 4 THEN 'unevaluatedProperties' END AS keyword,
        CASE WHEN o_orderkey % 5 >= 2 THEN '' END AS path FROM orders""",
    "array_keywords_validation": """
        WITH o AS (SELECT o_orderkey AS example_id, ['uniqueItems', NULL, NULL, 'false', 'type', 'contains', 'minContains', 'maxContains',
          NULL, NULL, 'type'][o_orderkey % 11 + 1] AS keyword, ['set', NULL, NULL, 'row/2', 'row/0', 'some', 'some', 'some', NULL, NULL,
          'rest/2'][o_orderkey % 11 + 1] AS path FROM orders)
        SELECT example_id, keyword IS NULL AS is_valid, keyword, path FROM o""",
    "multiple_of_validation": """
        SELECT o_orderkey AS example_id, path, 'multipleOf' AS keyword FROM orders, (VALUES ('total'), ('key'), ('long')) AS p(path)
        WHERE CASE path WHEN 'total' THEN CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS BIGINT) % 5 <> 0
          WHEN 'key' THEN o_orderkey % 3 <> 0 ELSE (o_orderkey + 1) % 11 <> 0 END""",
    "pattern_dialect_validation": """
        SELECT o_orderkey AS example_id, path, 'pattern' AS keyword FROM orders, (VALUES ('total'), ('day'), ('key')) AS p(path)
        WHERE CASE path WHEN 'total' THEN right(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), 1) = '7'
          WHEN 'day' THEN year(o_orderdate) NOT BETWEEN 1990 AND 1994 AND year(o_orderdate) < 2000
          ELSE NOT (NOT contains(CAST(o_orderkey AS VARCHAR), '0') OR o_orderkey % 2 = 0
            OR left(CAST(o_orderkey AS VARCHAR), 1) IN ('1', '3', '5')) END""",
    "shred_uneven_calls": """
        SELECT o_orderkey AS example_id, CASE WHEN o_orderkey % 4999 = 1 THEN 501 ELSE 7 END AS n,
        CASE WHEN o_orderkey % 4999 = 1 THEN 500 ELSE 2 END AS depth FROM orders""",
    "complete_conversations": f"""
        WITH g AS ({WITH_GAPS})
        SELECT conv_id, count(*) AS n_turns,
        length(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn)) AS n_chars
        FROM g GROUP BY conv_id HAVING count(role) = count(*) AND count(text) = count(*)""",
    "incomplete_conversations": f"""
        WITH g AS ({WITH_GAPS})
        SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role IS NULL OR text IS NULL) AS n_lacking
        FROM g GROUP BY conv_id HAVING n_lacking > 0""",
    "truncated_long_texts": r"""
        WITH d AS (SELECT doc_id, repeat(trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ', 40) AS text FROM documents),
        w AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS n FROM d)
        SELECT doc_id, md5(CASE WHEN n > 2048 THEN array_to_string(string_split(text, ' ')[1:2048], ' ') ELSE text END) AS digest,
        least(n, 2048) AS n_words FROM w""",
}
