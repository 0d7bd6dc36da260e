import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsieve.llm import quality, queries

DOCS = "doc_id long, text string, label string, share double"
LABELS = "doc_id long, quality int, text string"


def prose(draw, words):
    stems = ["an", "the", "er", "tion", "ing", "re", "ou"]
    return " ".join("".join(draw.choices(stems, k=draw.randrange(1, 4))) for _ in range(words)) + "."


def corpus(n=240):
    draw = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        text, good = prose(draw, draw.randrange(5, 200)), i % 3 > 0
        docs.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "clash", 1.0))
        labels.append((i, int(good), "clash"))
    return docs, labels


def fitted(frame, docs, labels):
    return quality.train(frame(docs, DOCS), frame(labels, LABELS), F.col("doc_id") % 2 == 0)


def test_held_out_accuracy(frame):
    docs, labels = corpus()
    found = quality.score(frame(docs, DOCS), fitted(frame, docs, labels))
    assert found.columns == ["doc_id", "score", "predicted"]
    rows, truth = found.collect(), {i: y for i, y, _ in labels}
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["doc_id"] % 2]
    assert np.mean(held) > 0.95


def test_held_out_accuracy_on_the_given_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op13_quality(spark, sf_dir).filter("held_out").select("doc_id", "predicted")
    both = found.join(queries.table(spark, sf_dir, "labels"), "doc_id").collect()
    right = {y: np.mean([r["predicted"] == y for r in both if r["quality"] == y]) for y in (0, 1)}
    assert right[0] > 0.85 and right[1] > 0.97


def test_odd_texts_and_labels(frame):
    docs, labels = corpus(60)
    labels += [(None, 1, "x"), (0, None, "x"), (1, 7, "x"), (9999, 1, "x"), (2, 1, "x"), (2, 1, "x")]
    model = fitted(frame, docs, labels)
    draw = random.Random(8)
    long = " ".join([prose(draw, 50)] * 4000)
    odd = [(None, "x", "a", 0.0), (1, None, "a", 0.0), (2, "", "a", 0.0), (3, long, "a", 0.0), (3, long, "a", 0.0), (4, "é", "a", 0.0)]
    rows = quality.score(frame(odd, DOCS), model).orderBy("doc_id").collect()
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 6 and by_id[1] == by_id[2] and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["score"] for r in rows if r["doc_id"] == 3] == [by_id[3]] * 2


@pytest.mark.parametrize("kept, score", [([], 0.5), ([1], None), ([0], None)])
def test_missing_classes(frame, kept, score):
    docs, labels = corpus(30)
    model = fitted(frame, docs, [r for r in labels if r[1] in kept])
    rows = quality.score(frame(docs, DOCS), model).collect()
    if score is not None:
        assert {r["score"] for r in rows} == {score}
    else:
        assert {r["predicted"] for r in rows} == set(kept)


def test_empty_tables(frame):
    model = quality.train(frame([], DOCS), frame([], LABELS), F.lit(True))
    assert quality.score(frame([], DOCS), model).count() == 0


def test_dictionaries_help_their_own_class():
    draw = random.Random(2)
    one, other = ([" ".join(draw.choices(words, k=60)).encode() for _ in range(300)] for words in (["aba", "xyzzy", "qua"], ["!!", "##", "LOUD"]))
    first, second = (quality.Compressor(quality.dictionary(x)) for x in (one, other))
    assert first.size(one[0]) < second.size(one[0]) and second.size(other[0]) < first.size(other[0])
    small = quality.Compressor(quality.dictionary([b"short"]))
    assert small.size(b"") == 0 and small.size(b"short" * 1000) > 0
