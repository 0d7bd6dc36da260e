import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from callsieve.llm import exact, language, leaks, near, queries
from compare import difference


def test_all_queries_are_registered():
    names = entry_points.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), sf_dir, queries.ORACLES[name]) == ""


def test_stages_by_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    judged = language.identify(docs, queries.language_model(docs)).collect()
    steps = [
        lambda d: {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE},
        lambda d: {r.doc_id for r in exact.exact_groups(d).collect() if r.kept},
        lambda d: {r.doc_id for r in near.near_groups(d).collect() if r.kept},
        lambda d: {
            r.doc_id
            for r in leaks.contamination(d, queries.table(spark, sf_dir, "benchmark")).collect()
            if not r.contaminated
        },
    ]
    for (_, stage), step in zip(corpus_pipeline.STAGES, steps):
        kept = step(docs)
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns
        got = [r.doc_id for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == kept and kept <= ids
        docs, ids = out, kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == ids


def test_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept_key int"
    text = "the cat sat on the mat and looked at the dog in the house near the river"
    rows = [(1, text), (1, text), (2, text + " "), (3, None), (4, ""), (5, "12 34"), (None, text + " again"), (6, "chat")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "r", 2) for i, t in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
    got = sorted(r.text for r in docs.collect())
    assert len(got) == len(set(got)) and not {"", "12 34"} & set(got) and "chat" in got
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, sf_dir)
        assert empty_out.count() == 0
