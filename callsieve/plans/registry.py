"""Queries over the given tables, by name. Each takes the session and a folder of tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.functions import jsontext
from callsieve.operators import cap, formatting, gate, metrics, negatives, nodes, schemas
from callsieve.operators import responses as answers
from callsieve.operators.validate import Checker, validate_calls, violation_table
from callsieve.plans import derive
from callsieve.session import configure, materialise, scratch_path
from callsieve.sources import batches as batch_source
from callsieve.sources import jsonl
from callsieve.streaming import gate as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register ``function`` under its name, with the session options set."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


PATH = "array_join(path, '/') AS path"
VERDICT = ["is_valid", "status", "category", "keyword", PATH]


def _order_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = derive.schemas_of(spark, derive.ORDER_SCHEMA)
    return validate_calls(derive.order_calls(spark, sf_dir), catalog)


# -- JSON text ---------------------------------------------------------------------------


@query
def strict_json_check(spark, sf_dir):
    calls = derive.order_calls(spark, sf_dir)
    return calls.select("example_id", jsontext.is_strict_json("call").alias("is_json"))


@query
def extract_json_cases(spark, sf_dir):
    found = derive.wrapped_calls(spark, sf_dir).select(
        "doc_id",
        jsontext.extract_object("response").alias("extracted"),
        F.length(jsontext.lenient_text("response")).cast("long").alias("lenient_chars"),
    )
    return found


@query
def lenient_validation(spark, sf_dir):
    schema = (
        '{"type":"object","required":["tool"],"properties":{"parameters":{"type":"object","required":["doc","lang"]}}}'
    )
    calls = schemas.with_schema_id(derive.wrapped_calls(spark, sf_dir).withColumn("schema", F.lit(schema)))
    catalog = derive.schemas_of(spark, schema)
    checker = Checker(catalog)
    checked = checker.check(checker.attach(calls), "response", "strict")
    done = checker.release(checker.check(checked, "response", "lenient", strict=False), "strict", "lenient")
    return done.select("doc_id", "lenient.is_valid", "lenient.category", F.col("strict.is_valid").alias("strict_valid"))


# -- schemas and validation ---------------------------------------------------------------


@query
def schema_catalog(spark, sf_dir):
    catalog = schemas.schema_catalog(derive.part_schemas(spark, sf_dir))
    return catalog.select("schema_id", F.length("schema").cast("long").alias("n_chars"))


@query
def compile_constraints(spark, sf_dir):
    catalog = schemas.schema_catalog(derive.part_schemas(spark, sf_dir))
    rules = schemas.constraint_table(schemas.compile_schemas(catalog))
    return rules.selectExpr(
        "schema_id",
        PATH,
        "array_join(type, ',') AS types",
        "array_join(enum, ',') AS enum_values",
        "const AS const_value",
        "array_join(required, ',') AS required_keys",
        "array_join(array_sort(property_names), ',') AS property_names",
        "additional_allowed",
        "maximum.approx AS maximum",
        "min_length",
    )


@query
def shred_call_nodes(spark, sf_dir):
    shredded = nodes.shred_calls(derive.order_calls(spark, sf_dir, mutated=False).drop("schema_id"))
    return shredded.selectExpr(
        "example_id",
        PATH,
        "json_type",
        "if(json_type = 'string', json, NULL) AS text_json",
        "if(json_type IN ('integer', 'number'), double(json), NULL) AS number_value",
        "array_join(array_sort(child_keys), ',') AS child_keys",
    )


@query
def validate_orders(spark, sf_dir):
    return _order_verdicts(spark, sf_dir).selectExpr("example_id", *VERDICT)


@query
def violations_all(spark, sf_dir):
    catalog = derive.schemas_of(spark, derive.ORDER_SCHEMA, derive.LINE_SCHEMA)
    orders = derive.order_calls(spark, sf_dir).selectExpr("string(example_id) AS call_id", "call", "schema_id")
    found = violation_table(orders.unionByName(derive.line_calls(spark, sf_dir)), catalog)
    return found.selectExpr("call_id", PATH, "keyword", "category")


@query
def violation_counts(spark, sf_dir):
    catalog = derive.schemas_of(spark, derive.LINE_SCHEMA)
    found = violation_table(derive.line_calls(spark, sf_dir), catalog, labels_only=True)
    return found.groupBy("category", "keyword").agg(F.count("*").alias("n"))


@query
def verdict_primary(spark, sf_dir):
    catalog = derive.schemas_of(spark, derive.CUSTOMER_SCHEMA)
    verdicts = validate_calls(derive.many_faults(spark, sf_dir), catalog)
    return verdicts.selectExpr("example_id", *VERDICT, "message")


@query
def many_schemas_validation(spark, sf_dir):
    calls = derive.part_schemas(spark, sf_dir)
    catalog = materialise(schemas.schema_catalog(calls), "catalog")
    return validate_calls(calls, catalog).selectExpr("example_id", *VERDICT)


@query
def many_schemas_salted(spark, sf_dir):
    calls = derive.part_schemas(spark, sf_dir)
    catalog = materialise(schemas.schema_catalog(calls), "catalog")
    verdicts = validate_calls(calls, catalog, broadcast_bytes=0)
    return verdicts.selectExpr("example_id", *VERDICT)


@query
def deep_schema_validation(spark, sf_dir):
    verdicts = validate_calls(derive.deep_calls(spark, sf_dir), derive.schemas_of(spark, derive.DEEP_SCHEMA))
    return verdicts.selectExpr("example_id", *VERDICT)


@query
def shred_deep_calls(spark, sf_dir):
    shredded = nodes.shred_calls(derive.deep_calls(spark, sf_dir).drop("schema_id"))
    return shredded.selectExpr("example_id", "bigint(size(path)) AS depth", "json_type")


def _composed(spark, sf_dir, **limits):
    calls = schemas.with_schema_id(
        derive.order_calls(spark, sf_dir).withColumn("schema", F.lit(derive.COMPOSED_SCHEMA))
    ).drop("schema")
    verdicts = validate_calls(calls, derive.schemas_of(spark, derive.COMPOSED_SCHEMA), **limits)
    return verdicts.selectExpr("example_id", *VERDICT)


@query
def composed_schema_validation(spark, sf_dir):
    return _composed(spark, sf_dir)


@query
def composed_schema_joined(spark, sf_dir):
    return _composed(spark, sf_dir, inline_schemas=0)


@query
def partly_judged_schema(spark, sf_dir):
    """A keyword that is not judged leaves definite failures definite, and the rest open."""
    schema = json.loads(derive.ORDER_SCHEMA)
    schema["properties"]["parameters"]["properties"]["total"] = {"$dynamicRef": "#amount"}
    text = json.dumps(schema)
    calls = schemas.with_schema_id(derive.order_calls(spark, sf_dir).withColumn("schema", F.lit(text))).drop("schema")
    return validate_calls(calls, derive.schemas_of(spark, text)).select("example_id", "is_valid", "status", "category")


def _linked(spark, sf_dir, call, schema, **limits):
    calls = derive.calls_of(spark, sf_dir, call, schema)
    verdicts = validate_calls(calls, derive.schemas_of(spark, schema), **limits)
    return verdicts.selectExpr("example_id", "is_valid", "keyword", PATH)


@query
def recursive_schema_validation(spark, sf_dir):
    return _linked(spark, sf_dir, derive.RECURSIVE_CALL, derive.RECURSIVE_SCHEMA)


@query
def linked_schema_validation(spark, sf_dir):
    """References by pointer, anchor and address, and a chain of 20 definitions."""
    return _linked(spark, sf_dir, derive.LINKED_CALL, derive.LINKED_SCHEMA)


@query
def linked_schema_joined(spark, sf_dir):
    return _linked(spark, sf_dir, derive.LINKED_CALL, derive.LINKED_SCHEMA, inline_schemas=0)


@query
def pattern_members_validation(spark, sf_dir):
    return _linked(spark, sf_dir, derive.PATTERN_CALL, derive.PATTERN_SCHEMA)


@query
def conditional_schema_validation(spark, sf_dir):
    return _linked(spark, sf_dir, derive.in_turn(derive.CONDITIONAL_CALLS), derive.CONDITIONAL_SCHEMA)


@query
def open_condition_validation(spark, sf_dir):
    """A condition that cannot be judged gives a verdict only where both branches agree."""
    call = derive.in_turn(('{"a":1,"b":2}', '{"a":1,"b":2,"c":3}', '{"a":1,"b":2,"c":3,"d":4}'))
    return _linked(spark, sf_dir, call, derive.OPEN_CONDITION_SCHEMA)


@query
def unevaluated_members_validation(spark, sf_dir):
    return _linked(spark, sf_dir, derive.in_turn(derive.UNEVALUATED_CALLS), derive.UNEVALUATED_SCHEMA)


@query
def array_keywords_validation(spark, sf_dir):
    return _linked(spark, sf_dir, derive.in_turn(derive.ARRAY_CALLS), derive.ARRAY_SCHEMA)


@query
def multiple_of_validation(spark, sf_dir):
    calls = derive.calls_of(spark, sf_dir, derive.MULTIPLE_CALL, derive.MULTIPLE_SCHEMA)
    found = violation_table(calls, derive.schemas_of(spark, derive.MULTIPLE_SCHEMA))
    return found.selectExpr("example_id", PATH, "keyword")


@query
def pattern_dialect_validation(spark, sf_dir):
    calls = derive.calls_of(spark, sf_dir, derive.DIALECT_CALL, derive.DIALECT_SCHEMA)
    found = violation_table(calls, derive.schemas_of(spark, derive.DIALECT_SCHEMA))
    return found.selectExpr("example_id", PATH, "keyword")


@query
def shred_uneven_calls(spark, sf_dir):
    """A few calls nested 500 deep among flat ones."""
    calls = derive.calls_of(spark, sf_dir, derive.UNEVEN_CALL, "{}").drop("schema_id")
    depth = F.size("path").cast("long")
    return nodes.shred_calls(calls).groupBy("example_id").agg(F.count("*").alias("n"), F.max(depth).alias("depth"))


def _hostile(spark, sf_dir, **limits):
    catalog = derive.schemas_of(spark, derive.HOSTILE_SCHEMA)
    found = violation_table(derive.hostile_calls(spark, sf_dir), catalog, **limits)
    return found.selectExpr("example_id", "path[0] AS key", "keyword")


@query
def hostile_literals(spark, sf_dir):
    return _hostile(spark, sf_dir)


@query
def hostile_literals_joined(spark, sf_dir):
    return _hostile(spark, sf_dir, inline_schemas=0)


@query
def hostile_literals_salted(spark, sf_dir):
    return _hostile(spark, sf_dir, inline_schemas=0, broadcast_bytes=0)


@query
def event_props_validation(spark, sf_dir):
    events = derive.spread(spark, sf_dir, "events").select("event_id", F.col("props").alias("call"))
    calls = schemas.with_schema_id(events.withColumn("schema", F.lit(derive.EVENT_SCHEMA)))
    verdicts = validate_calls(calls, derive.schemas_of(spark, derive.EVENT_SCHEMA))
    return verdicts.selectExpr("event_id", "is_valid", "category", "keyword", "message")


@query
def unsupported_schema_guard(spark, sf_dir):
    schema = (
        F.when(F.col("o_orderstatus") == "P", derive.REFERENCE_SCHEMA)
        .when(F.col("o_orderstatus") == "O", derive.ORDER_SCHEMA)
        .alias("schema")
    )
    calls = derive.spread(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("example_id"), F.expr(derive.SIX_WAYS).alias("call"), schema
    )
    catalog = derive.schemas_of(spark, derive.REFERENCE_SCHEMA, derive.ORDER_SCHEMA, None)
    verdicts = validate_calls(schemas.with_schema_id(calls), catalog)
    return verdicts.select("example_id", "is_valid", "status", "category")


# -- gate ---------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.judge_pairs(derive.triplets(spark, sf_dir), derive.schemas_of(spark, derive.ORDER_SCHEMA))


def _judged_batches(spark: SparkSession, sf_dir: str, drop_rest: bool = False) -> DataFrame:
    items = batch_source.explode_batches(derive.batches(spark, sf_dir), drop_rest_of_batch=drop_rest, schema_texts=not drop_rest)
    triplets = batch_source.items_to_triplets(
        items.withColumn("example_id", F.expr("try_variant_get(item, '$.example_id', 'bigint')"))
    ).drop("item")
    # Stored once: the catalog then reads their schemas only, and nothing is parsed again.
    return gate.judge_pairs(materialise(triplets, "triplets"))


@query
def pair_gate(spark, sf_dir):
    return gate.accepted(_judged(spark, sf_dir)).select(
        "example_id", "chosen", "rejected", "rejected_category", "rejected_is_json"
    )


@query
def pair_gate_json_only(spark, sf_dir):
    kept = gate.accepted(_judged(spark, sf_dir), require_json_rejected=True)
    return kept.select("example_id", "rejected_category")


@query
def gate_discards(spark, sf_dir):
    return gate.discarded(_judged(spark, sf_dir)).select("example_id", "discard_reason")


@query
def gate_batches(spark, sf_dir):
    judged = _judged_batches(spark, sf_dir)
    return judged.select("batch_id", F.col("pos").cast("long").alias("pos"), "example_id", "discard_reason")


@query
def gate_batches_drop_rest(spark, sf_dir):
    judged = _judged_batches(spark, sf_dir, drop_rest=True)
    return judged.select("batch_id", F.col("pos").cast("long").alias("pos"), "example_id", "discard_reason")


@query
def rejected_documents(spark, sf_dir):
    documents = derive.itemless_documents(spark, sf_dir)
    return batch_source.rejected_documents(documents).select("doc_id", "reason")


@query
def gate_cap(spark, sf_dir):
    accepted = materialise(gate.accepted(_judged_batches(spark, sf_dir)).select("batch_id", "pos", "example_id"), "accepted")
    kept = cap.first_n(accepted, 1000)
    return kept.select("batch_id", F.col("pos").cast("long").alias("pos"), "example_id")


@query
def gate_cap_whole_batch(spark, sf_dir):
    accepted = materialise(gate.accepted(_judged_batches(spark, sf_dir)).select("batch_id", "pos", "example_id"), "accepted")
    kept = cap.first_n(accepted, 1000, whole_batch=True)
    return kept.select("batch_id", F.col("pos").cast("long").alias("pos"), "example_id")


@query
def pair_audit(spark, sf_dir):
    return gate.pair_audit(_judged(spark, sf_dir))


@query
def pair_offenders(spark, sf_dir):
    return gate.pair_offenders(_judged(spark, sf_dir), ["example_id", "prompt"])


def _negatives(calls: DataFrame, schema: str, kind: str, target: str | None) -> DataFrame:
    """Derived negatives with the category a check finds in them."""
    catalog = derive.schemas_of(calls.sparkSession, schema)
    broken = negatives.hard_negatives(calls, catalog, kind, target=target)
    verdicts = validate_calls(broken, catalog, "rejected")
    return verdicts.select("example_id", "rejected", "kind", "category")


@query
def hard_negatives_hallucinated(spark, sf_dir):
    calls = derive.customer_calls(spark, sf_dir)
    return _negatives(calls, derive.CUSTOMER_SCHEMA, "hallucinated_param", None)


@query
def hard_negatives_type(spark, sf_dir):
    return _negatives(derive.part_calls(spark, sf_dir), derive.PART_SCHEMA, "type_mismatch", "size")


@query
def hard_negatives_enum(spark, sf_dir):
    return _negatives(derive.part_calls(spark, sf_dir), derive.PART_SCHEMA, "enum_violation", "type")


@query
def hard_negatives_missing(spark, sf_dir):
    calls = derive.customer_calls(spark, sf_dir)
    return _negatives(calls, derive.CUSTOMER_SCHEMA, "missing_required", "name")


@query
def hard_negatives_hashed(spark, sf_dir):
    return _all_negatives(derive.part_calls(spark, sf_dir), derive.PART_SCHEMA)


@query
def hard_negatives_six_ways(spark, sf_dir):
    return _all_negatives(derive.order_calls(spark, sf_dir), derive.ORDER_SCHEMA)


def _all_negatives(calls: DataFrame, schema: str) -> DataFrame:
    """Negatives of every kind, with the category and the number of demands that each breaks."""
    catalog = derive.schemas_of(calls.sparkSession, schema)
    broken = negatives.hard_negatives(calls, catalog, list(negatives.KIND_CATEGORY))
    checker = Checker(catalog)
    checked = checker.check(checker.attach(broken), "rejected", "__verdict", "__found")
    done = checker.release(checked, "__verdict", "__found")
    return done.selectExpr("example_id", "kind", "__verdict.category AS category", "bigint(size(__found)) AS n_broken")


# -- scores -------------------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = answers.join_responses(derive.responses(spark, sf_dir), derive.examples(spark, sf_dir))
    return validate_calls(joined, derive.schemas_of(spark, derive.ORDER_SCHEMA), "response")


@query
def scored_responses(spark, sf_dir):
    return _scored(spark, sf_dir).select("model", "example_id", "is_valid", "category")


@query
def sspr_by_model(spark, sf_dir):
    return metrics.pass_rate(_scored(spark, sf_dir))


@query
def sspr_overall(spark, sf_dir):
    return metrics.pass_rate(_order_verdicts(spark, sf_dir), by=())


@query
def failure_breakdown(spark, sf_dir):
    return metrics.failure_breakdown(_scored(spark, sf_dir))


@query
def failure_report(spark, sf_dir):
    return metrics.shown(metrics.failure_breakdown(_scored(spark, sf_dir)))


@query
def breakdown_rollup(spark, sf_dir):
    tools = schemas.compile_schemas(derive.schemas_of(spark, derive.ORDER_SCHEMA)).select("schema_id", "tool")
    outcome = F.coalesce("category", "status").alias("outcome")
    labelled = _scored(spark, sf_dir).join(tools, "schema_id").select("model", "tool", outcome)
    return metrics.breakdown_rollup(labelled)


@query
def model_compare(spark, sf_dir):
    return metrics.compare_breakdowns(metrics.failure_breakdown(_scored(spark, sf_dir)), "A", "B")


@query
def model_gain(spark, sf_dir):
    return metrics.compare_rates(metrics.pass_rate(_scored(spark, sf_dir)), "A", "B")


@query
def paired_outcomes(spark, sf_dir):
    return metrics.paired_outcomes(_scored(spark, sf_dir), "A", "B")


@query
def missing_responses(spark, sf_dir):
    return answers.missing_responses(derive.responses(spark, sf_dir), derive.examples(spark, sf_dir), ["A", "B"])


@query
def batched_responses(spark, sf_dir):
    def shout(prompts):
        return prompts.str.upper()

    replies = answers.respond(derive.examples(spark, sf_dir), shout, "stub")
    return replies.select("example_id", "model", F.sha2("response", 256).alias("response_hash"))


# -- rendering ----------------------------------------------------------------------------


@query
def pref_pairs_chatml(spark, sf_dir):
    pairs = formatting.preference_pairs(derive.triplets(spark, sf_dir))
    return pairs.select("example_id", "prompt", "chosen", "rejected")


@query
def sft_text(spark, sf_dir):
    return formatting.supervised_texts(derive.triplets(spark, sf_dir)).select("example_id", "text")


@query
def unrenderable_pairs(spark, sf_dir):
    rows = derive.triplets(spark, sf_dir).withColumns(
        {"chosen": F.expr("if(example_id % 7 = 0, NULL, chosen)"), "prompt": F.expr("if(example_id % 11 = 0, NULL, prompt)")}
    )
    kept, rest = formatting.renderable(rows, "prompt", "chosen", "rejected")
    rendered = formatting.preference_pairs(kept).select("example_id", "chosen", F.lit("rendered").alias("side"))
    return rendered.unionByName(rest.select("example_id", "chosen", F.lit("quarantined").alias("side")))


@query
def inference_prompt(spark, sf_dir):
    return answers.inference_prompts(derive.examples(spark, sf_dir)).select("example_id", "model_prompt")


@query
def conversation_chatml(spark, sf_dir):
    return formatting.conversation_texts(derive.table(spark, sf_dir, "conversations"))


def _with_gaps(spark, sf_dir):
    return derive.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "if(conv_id % 7 = 0 AND turn = 1, NULL, role) AS role", "if(conv_id % 5 = 0 AND turn = 0, NULL, text) AS text"
    )


@query
def complete_conversations(spark, sf_dir):
    rendered = formatting.conversation_texts(_with_gaps(spark, sf_dir))
    return rendered.select("conv_id", "n_turns", F.length("text").cast("long").alias("n_chars"))


@query
def incomplete_conversations(spark, sf_dir):
    return formatting.incomplete_conversations(_with_gaps(spark, sf_dir))


@query
def length_budget(spark, sf_dir):
    documents = derive.table(spark, sf_dir, "documents").select("doc_id", "text")
    return formatting.length_budget(documents).selectExpr("doc_id", "bigint(n_tokens) AS n_tokens", "over_total")


@query
def length_budget_kept(spark, sf_dir):
    rendered = formatting.supervised_texts(
        derive.table(spark, sf_dir, "documents").selectExpr("doc_id", "text AS prompt", "lang AS chosen")
    )
    kept = formatting.length_budget(rendered, prompt="prompt", drop=True)
    return kept.selectExpr("doc_id", "bigint(n_tokens) AS n_tokens")


@query
def truncated_texts(spark, sf_dir):
    documents = derive.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE doc_id % 5 WHEN 0 THEN concat(' \\n', text, '\\t ') WHEN 1 THEN '' ELSE text END AS text"
    )
    cut = formatting.truncate_to_budget(documents, {"text": 100})
    return cut.select(
        "doc_id", "text", formatting.word_count("text").cast("long").alias("n_words")
    )


@query
def truncated_long_texts(spark, sf_dir):
    """Texts of thousands of words, cut at the trainers' own limit."""
    documents = derive.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "repeat(concat(trim(regexp_replace(text, '[\\\\s]+', ' ')), ' '), 40) AS text"
    )
    cut = formatting.truncate_to_budget(documents, {"text": formatting.MAX_TOTAL_TOKENS})
    return cut.select("doc_id", F.md5("text").alias("digest"), formatting.word_count("text").cast("long").alias("n_words"))


@query
def pair_budget(spark, sf_dir):
    rows = derive.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text AS prompt", "repeat('w ', int(doc_id % 2000)) AS chosen", "repeat(' v', int(doc_id % 1500)) AS rejected"
    )
    flagged = formatting.pair_budget(rows)
    return flagged.selectExpr("doc_id", "bigint(n_tokens) AS n_tokens", "over_total", "over_prompt")


@query
def inspect_outputs(spark, sf_dir):
    # Only the examples that are shown are joined with their replies.
    examples = derive.examples(spark, sf_dir).select("example_id", "prompt", "chosen").orderBy("example_id").limit(50)
    replies = derive.order_calls(spark, sf_dir).selectExpr("example_id", "call AS response")
    return formatting.inspect_outputs(examples.join(replies, "example_id"), 50)


# -- files and streams --------------------------------------------------------------------


@query
def read_jsonl(spark, sf_dir):
    path = scratch_path(spark, "triplets")
    jsonl.write_triplets(derive.triplets(spark, sf_dir), path)
    back = jsonl.read_triplets(spark, path)
    return back.select("prompt", "chosen", "rejected", "schema")


@query
def read_jsonl_permissive(spark, sf_dir):
    path = scratch_path(spark, "lines")
    lines = derive.triplets(spark, sf_dir).select(
        F.when(F.col("example_id") % 6 == 4, F.col("rejected")).otherwise(jsonl.triplet_line()).alias("value")
    )
    lines.write.text(path)
    return jsonl.read_triplets_permissive(spark, path)


@query
def export_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "pairs")
    accepted = gate.accepted(_judged(spark, sf_dir))
    pairs = formatting.preference_pairs(accepted)
    jsonl.export_training_set(pairs, path, ["example_id", "prompt", "chosen", "rejected"])
    return spark.read.parquet(path).select("example_id", "prompt", "chosen", "rejected")


def _batch_files(spark: SparkSession, sf_dir: str) -> str:
    """Generator batches, documents without items, and lines that are no record at all."""
    path = scratch_path(spark, "arrivals")
    stream.write_batches(derive.batches(spark, sf_dir), path)
    stream.write_batches(derive.itemless_documents(spark, sf_dir).selectExpr("-1 - doc_id AS batch_id", "doc"), path)
    lines = derive.table(spark, sf_dir, "nation").selectExpr("concat('{', n_name)")
    lines.write.mode("append").text(path)
    return path


@query
def stream_gate(spark, sf_dir):
    arrivals = stream.read_batches(spark, _batch_files(spark, sf_dir))
    judged, rejected, state = (scratch_path(spark, n) for n in ("judged", "rejected", "gate-state"))
    stream.start_gate(arrivals, judged, rejected, state).awaitTermination()
    decided = spark.read.parquet(judged).select("batch_id", F.col("pos").cast("long").alias("pos"), "discard_reason")
    reasons = spark.read.parquet(rejected).selectExpr("batch_id", "cast(NULL AS bigint) AS pos", "reason AS discard_reason")
    return decided.unionByName(reasons)


@query
def stream_gate_repeated(spark, sf_dir):
    """Two thirds of the batches arrive again, in files of their own."""
    path = _batch_files(spark, sf_dir)
    stream.write_batches(derive.batches(spark, sf_dir).filter("batch_id % 3 > 0"), path)
    stream.write_batches(derive.batches(spark, sf_dir).filter("batch_id % 3 > 1"), path)
    arrivals = stream.read_batches(spark, path, files_per_trigger=12)
    judged, rejected, state = (scratch_path(spark, n) for n in ("judged", "rejected", "gate-state"))
    stream.start_gate(arrivals, judged, rejected, state).awaitTermination()
    decided = spark.read.parquet(judged).select("batch_id", F.col("pos").cast("long").alias("pos"), "discard_reason")
    reasons = spark.read.parquet(rejected).selectExpr("batch_id", "cast(NULL AS bigint) AS pos", "reason AS discard_reason")
    return decided.unionByName(reasons)


@query
def stream_gate_until(spark, sf_dir):
    arrivals = stream.read_batches(spark, _batch_files(spark, sf_dir), files_per_trigger=1)
    judged, rejected, state = (scratch_path(spark, n) for n in ("judged", "rejected", "gate-state"))
    running = stream.start_gate(arrivals, judged, rejected, state, stop_at=100)
    stream.stop_after(running, spark, judged, 100)
    rows = spark.read.parquet(judged)
    epochs = rows.groupBy("epoch").agg(F.count_if(F.col("discard_reason").isNull()).alias("n"))
    earlier = F.sum(F.when(F.col("epoch") < F.col("last"), F.col("n")).otherwise(0))
    stopped = epochs.crossJoin(epochs.agg(F.max("epoch").alias("last"))).agg(
        (F.sum("n") >= 100).alias("reached"), (earlier < 100).alias("none_too_many")
    )
    # Batches are written whole: all items of a batch that is there are there.
    items = rows.groupBy("batch_id").agg(F.count("*").alias("items"), F.max("pos").alias("last_pos"))
    return stopped.crossJoin(items.agg(F.bool_and(F.col("items") == F.col("last_pos") + 1).alias("batches_whole")))


@query
def stream_tally(spark, sf_dir):
    arrivals, table_path, state = (scratch_path(spark, n) for n in ("responses", "tally", "tally-state"))
    joined = answers.join_responses(derive.responses(spark, sf_dir), derive.examples(spark, sf_dir))
    joined.select("example_id", "model", "schema_id", "response").write.json(arrivals)
    source = spark.readStream.schema(stream.RESPONSE_SCHEMA).json(arrivals)
    checker = Checker(derive.schemas_of(spark, derive.ORDER_SCHEMA))
    stream.start_tally(stream.running_tally(source, checker), table_path, state).awaitTermination()
    return spark.read.parquet(table_path)
