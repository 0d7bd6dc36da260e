import json

import pytest
from pyspark.sql import functions as F

from callsieve.functions.chatml import SYSTEM_PROMPT
from callsieve.operators import cap, formatting, gate, metrics, negatives
from callsieve.operators import responses as answers
from callsieve.operators.schemas import schema_catalog, with_schema_id
from callsieve.operators.validate import validate_calls
from callsieve.plans import derive
from callsieve.plans.registry import QUERIES
from callsieve.sources import batches, jsonl
from callsieve.streaming import gate as stream
from test_validate import TASK, TITLE, wrap

GOOD, BAD = wrap(TITLE), wrap({**TITLE, "priority": "urgent"})


def triplets_of(spark, rows):
    data = [(i, "p", c, r, json.dumps(s) if s is not None else None) for i, (c, r, s) in enumerate(rows)]
    return spark.createDataFrame(data, "i int, prompt string, chosen string, rejected string, schema string")


def test_gate_reasons(spark):
    rows = [
        (GOOD, BAD, TASK, None),
        (BAD, BAD, TASK, "chosen_invalid"),
        (GOOD, GOOD, TASK, "rejected_valid"),
        (BAD, GOOD, TASK, "both"),
        (GOOD, "not json", TASK, None),
        (GOOD, BAD, {"$ref": "#"}, "unsupported_schema"),
        (GOOD, BAD, None, "chosen_invalid"),
    ]
    judged = gate.judge_pairs(triplets_of(spark, [r[:3] for r in rows]))
    assert [r["discard_reason"] for r in judged.orderBy("i").collect()] == [r[3] for r in rows]
    assert gate.accepted(judged).count() == 2
    assert gate.accepted(judged, require_json_rejected=True).count() == 1
    assert gate.pair_audit(judged).first().asDict() == {"valid_pairs": 2, "total_pairs": 7}
    assert gate.pair_offenders(judged, ["i"]).count() == 5
    with pytest.raises(AssertionError):
        gate.assert_all_valid(judged)
    gate.assert_all_valid(gate.judge_pairs(triplets_of(spark, [rows[0][:3]])))


def test_batches(spark):
    item = {"prompt": "p", "chosen": {"a": 1}, "rejected": "x", "schema": {}, "note": 7}
    docs = [
        json.dumps({"examples": [item, {"prompt": "p"}, item]}),
        json.dumps({"triplets": [item]}),
        json.dumps(item),
        json.dumps({"examples": None, "triplets": [item]}),
        json.dumps({"examples": []}),
        "[1]",
        "{} x",
        json.dumps({"triplets": ["text", item]}),
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "batch_id int, doc string")
    items = batches.explode_batches(df)
    got = sorted((r["batch_id"], r["pos"], r["malformed"]) for r in items.drop("item").collect())
    assert got == [
        (0, 0, False),
        (0, 1, True),
        (0, 2, False),
        (1, 0, False),
        (2, 0, False),
        (7, 0, True),
        (7, 1, False),
    ]
    cut = batches.explode_batches(df, drop_rest_of_batch=True).drop("item", "malformed").collect()
    assert sorted(map(tuple, cut)) == [(0, 0), (1, 0), (2, 0)]
    refused = {r["batch_id"]: r["reason"] for r in batches.rejected_documents(df).collect()}
    assert refused == {3: "not_a_list", 5: "not_an_object", 6: "not_json"}
    row = batches.items_to_triplets(items).filter("batch_id = 2").first()
    assert (row["chosen"], row["rejected"], row["schema"]) == ('{"a":1}', "x", "{}")


def test_jsonl_round_trip_keeps_other_keys(spark, tmp_path):
    lines = [
        {"prompt": 'q "x"', "chosen": GOOD, "rejected": BAD, "schema": TASK, "note": {"k": [1]}},
        {"prompt": "é😀", "chosen": "a\nb", "rejected": "c", "schema": {}},
    ]
    source = tmp_path / "in.jsonl"
    source.write_text("\n".join([json.dumps(lines[0]), "   ", "", json.dumps(lines[1]), " "]))
    read = jsonl.read_triplets(spark, str(source))
    assert read.count() == 2
    items = spark.createDataFrame([(json.dumps(x),) for x in lines], "doc string")
    exploded = batches.items_to_triplets(batches.explode_batches(items))
    jsonl.write_triplets(exploded, str(tmp_path / "out"), extra="item")
    back = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    key = lambda x: x["prompt"]
    assert sorted(back, key=key) == sorted(lines, key=key)


def test_bad_line_aborts_or_is_kept(spark, tmp_path):
    source = tmp_path / "bad.jsonl"
    source.write_text('{"prompt":"p"}\n{"prompt":"p"} x\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_triplets(spark, str(source)).collect()
    rows = jsonl.read_triplets_permissive(spark, str(source)).collect()
    assert sorted(str(r["_corrupt_record"]) for r in rows) == ["None", "[1]", '{"prompt":"p"} x']


@pytest.mark.parametrize("n", [0, 1, 7, 250, 499, 10_000])
def test_first_n_equals_sorted_limit(spark, n):
    rows = [(b * b * 1_000_003, p) for b in range(60) for p in range(b % 17)]
    rows += [(5, p) for p in range(0, 400, 2)]
    df = spark.createDataFrame(rows, "batch_id bigint, pos int").distinct()
    ordered = sorted(set(rows))
    assert sorted(map(tuple, cap.first_n(df, n).collect())) == ordered[:n]
    whole = sorted(map(tuple, cap.first_n(df, n, whole_batch=True).collect()))
    last = ordered[:n][-1][0] if n else -1
    assert whole == [r for r in ordered if r[0] <= last]


@pytest.mark.parametrize("kind", negatives.KIND_CATEGORY)
def test_negatives_break_exactly_one_rule(spark, sf_dir, kind):
    calls = derive.order_calls(spark, sf_dir, mutated=False)
    catalog = derive.schemas_of(spark, derive.ORDER_SCHEMA)
    broken = negatives.hard_negatives(calls, catalog, kind)
    rows = validate_calls(broken, catalog, "rejected").groupBy("category").count().collect()
    assert [tuple(r) for r in rows] == [(negatives.KIND_CATEGORY[kind], calls.count())]
    again = negatives.hard_negatives(calls.repartition(5), catalog, kind)
    assert broken.select("example_id", "rejected").exceptAll(again.select("example_id", "rejected")).isEmpty()


def test_negatives_where_a_kind_does_not_apply(spark):
    schema = {"properties": {"parameters": {"properties": {"title": {"type": "string"}}}}}
    call = json.dumps({"tool": "t", "parameters": {"title": "x"}})
    calls = with_schema_id(
        spark.createDataFrame([(1, call, json.dumps(schema))], "example_id bigint, call string, schema string")
    )
    for kind in negatives.KIND_CATEGORY:
        assert negatives.hard_negatives(calls, schema_catalog(calls), kind).count() == 0


# A published evaluation of two models on 802 samples.
PUBLISHED = {
    "base": (60, {"missing_required": 711, "enum_violation": 24, "json_error": 3, "hallucinated_param": 2,
                  "type_mismatch": 1, "other_schema_error": 0}),
    "tuned": (186, {"missing_required": 557, "enum_violation": 51, "json_error": 1, "hallucinated_param": 3,
                    "type_mismatch": 1, "other_schema_error": 3}),
}


def test_published_figures(spark):
    rows = [(m, 802, c, n) for m, (_, counts) in PUBLISHED.items() for c, n in counts.items()]
    breakdown = metrics.with_percent(
        spark.createDataFrame(rows, "model string, total bigint, category string, n bigint")
    )
    percent = {(r["model"], r["category"]): r["percent"] for r in breakdown.collect()}
    assert percent[("base", "missing_required")] == 88.7 and percent[("tuned", "missing_required")] == 69.5
    assert percent[("base", "enum_violation")] == 3.0 and percent[("tuned", "enum_violation")] == 6.4
    assert percent[("base", "json_error")] == 0.4 and percent[("tuned", "json_error")] == 0.1
    rates = spark.createDataFrame(
        [(m, passed / 802) for m, (passed, _) in PUBLISHED.items()], "model string, pass_rate double"
    )
    gain = metrics.compare_rates(rates, "base", "tuned").first()
    assert round(100 * gain["base_rate"], 2) == 7.48 and round(100 * gain["new_rate"], 2) == 23.19
    assert (gain["delta_pp"], gain["ratio"]) == (15.71, 3.1)
    change = {r["category"]: r["pct_change"] for r in metrics.compare_breakdowns(breakdown, "base", "tuned").collect()}
    assert (change["missing_required"], change["json_error"], change["enum_violation"]) == (-22, -67, 113)
    assert change["hallucinated_param"] == 50 and change["other_schema_error"] is None


def test_empty_input_scores_zero(spark):
    empty = spark.createDataFrame([], "model string, is_valid boolean")
    assert metrics.pass_rate(empty, by=()).first().asDict() == {
        "total": 0, "passed": 0, "no_verdict": 0, "pass_rate": 0.0,
    }


def test_chat_rendering(spark):
    df = spark.createDataFrame(
        [("p", "c", "r", "{}"), (None, "c", "r", "{}"), ("p", None, "r", "{}")],
        "prompt string, chosen string, rejected string, schema string",
    )
    pair = formatting.preference_pairs(df).collect()
    head = f"<|im_start|>system\n{SYSTEM_PROMPT}<|im_end|>\n<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\n"
    assert [tuple(r) for r in pair] == [(head, "c<|im_end|>", "r<|im_end|>", "{}")]
    assert formatting.supervised_texts(df).select("text").collect() == [(head + "c<|im_end|>",)]
    assert answers.inference_prompts(df).filter("prompt = 'p'").first()["model_prompt"] == head
    assert formatting.incomplete_rows(df, "prompt", "chosen", "rejected").count() == 2
    plan = formatting.preference_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_long_conversation_is_one_text(spark):
    df = spark.range(25).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "string(id) AS text")
    (whole,) = formatting.conversation_texts(df.repartition(3), turns_per_part=10).collect()
    assert whole["n_turns"] == 25
    assert whole["text"] == "\n".join(f"<|im_start|>user\n{i}<|im_end|>" for i in range(25))


def test_words_are_counted_and_cut(spark):
    df = spark.createDataFrame([(" a ",), ("",), ("a\t b\nc d ",), (None,)], "text string")
    cut = df.select(formatting.word_count("text").alias("n"), formatting.truncate_words("text", 2).alias("t")).collect()
    assert [tuple(r) for r in cut] == [(1, " a "), (0, ""), (4, "a\t b"), (None, None)]


@pytest.mark.parametrize("most", [1, 2048, 100_000])
def test_long_texts_are_cut(spark, most):
    df = spark.range(1).selectExpr("repeat('a b\n', 60000) AS text")
    (row,) = df.select(formatting.truncate_words("text", most).alias("t")).collect()
    assert row["t"] == ("a b\n" * 60_000)[: most * 2 - 1]


def test_conversations_that_lack_a_text_are_set_apart(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, None, "b"), (3, 0, "user", "c"), (3, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r["conv_id"], r["n_turns"]) for r in formatting.conversation_texts(df).collect()] == [(3, 2)]
    lacking = {tuple(r) for r in formatting.incomplete_conversations(df).collect()}
    assert lacking == {(1, 2, 1), (2, 1, 1)}


def test_paired_outcomes_count_each_example_once(spark):
    rows = [("A", 1, True), ("B", 1, False), ("A", 2, True), ("A", 2, False), ("B", 2, True), ("A", 3, True)]
    df = spark.createDataFrame(rows, "model string, example_id int, is_valid boolean")
    got = {(r["pass_a"], r["pass_b"]): r["n"] for r in metrics.paired_outcomes(df, "A", "B").collect()}
    assert got == {(True, False): 1, (False, True): 1}


def test_stream_equals_batch_and_replay_is_safe(spark, sf_dir, tmp_path):
    arrivals, judged, rejected = (str(tmp_path / n) for n in ("arrivals", "judged", "rejected"))
    derive.batches(spark, sf_dir).repartition(4).write.json(arrivals)
    odd = [("[1]",), ("{not a record",), (json.dumps({"batch_id": -1, "doc": "not json"}),)]
    spark.createDataFrame(odd, "value string").write.mode("append").text(arrivals)
    columns = ["batch_id", "pos", "discard_reason"]

    def run(checkpoint):
        source = stream.read_batches(spark, arrivals, files_per_trigger=2)
        query = stream.start_gate(source, judged, rejected, str(tmp_path / checkpoint))
        query.awaitTermination()
        lost = sorted((r["reason"], r["raw"]) for r in spark.read.parquet(rejected).collect())
        assert lost == [("not_a_record", "[1]"), ("not_a_record", "{not a record"), ("not_json", "not json")]
        return sorted(map(str, spark.read.parquet(judged).select(*columns).collect()))

    items = batches.items_to_triplets(batches.explode_batches(derive.batches(spark, sf_dir))).drop("item")
    expected = sorted(map(str, gate.judge_pairs(items).select(*columns).collect()))
    assert run("one") == expected
    assert run("two") == expected


def test_stream_counts_a_repeated_batch_once(spark, sf_dir, tmp_path):
    """In the same file, in a later file, and in a later run; lines without an id all stay."""
    arrivals, judged, rejected = (str(tmp_path / n) for n in ("arrivals", "judged", "rejected"))
    once = derive.batches(spark, sf_dir)
    lines = spark.createDataFrame([("{no",), ("{no",)], "value string")

    def run():
        source = stream.read_batches(spark, arrivals, files_per_trigger=1)
        stream.start_gate(source, judged, rejected, str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(rejected).count() == 2
        return spark.read.parquet(judged).groupBy("batch_id").agg(F.count("*").alias("n"), F.max("pos").alias("last")).collect()

    once.unionByName(once).repartition(3).write.json(arrivals)
    lines.coalesce(1).write.mode("append").text(arrivals)
    first = sorted(run())
    assert len(first) == once.count() and all(r["n"] == r["last"] + 1 for r in first)
    once.write.mode("append").json(arrivals)
    assert sorted(run()) == first


def test_stream_stops_after_enough(spark, sf_dir, tmp_path):
    arrivals, judged, rejected = (str(tmp_path / n) for n in ("arrivals", "judged", "rejected"))
    derive.batches(spark, sf_dir).repartition(30).write.json(arrivals)
    source = stream.read_batches(spark, arrivals, files_per_trigger=1)
    query = stream.start_gate(source, judged, rejected, str(tmp_path / "state"), available_now=False, stop_at=20)
    count = stream.stop_after(query, spark, judged, 20)
    assert count >= 20 and not query.isActive
    assert count < gate.accepted(
        gate.judge_pairs(batches.items_to_triplets(batches.explode_batches(derive.batches(spark, sf_dir))).drop("item"))
    ).count()


@pytest.mark.parametrize("name", ["validate_orders", "pref_pairs_chatml", "deep_schema_validation"])
def test_queries_over_stored_tables_shuffle_nothing(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Scan parquet" in plan
