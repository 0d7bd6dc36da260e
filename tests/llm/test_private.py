import hashlib
import random
import re

import numpy as np
import pytest

from callsieve.llm import private, queries

SCHEMA = "doc_id long, text string, spans int, n_ip string"

# The four patterns as stated, matched without any shortcut.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def expected(text):
    def n(m):
        return len(re.sub("[^0-9]", "", m[0]))

    out = {"email": [m.span() for m in EMAIL.finditer(text)]}
    out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in CARD.finditer(text) if 13 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))]
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= n(m) <= 15]
    return out


CASES = [
    "",
    "a@b.c x@y a@b.c.d@e.f @x.y a@@b.c a@b@c.d .%+-@a-.b- a@b..c",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 1..2.3.4 0000255.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 41111111111111111111",
    "+1 (269) 555-3296 +1234 +12345678 9 +(1)234567890 ++123456789 +1 234 567 890 123 456",
    "é@b.c ñ1.2.3.4é x+y@z.w+1 23 456 7890 a" + "b" * 2000 + "@c.d",
    "4111111111111111@1.2.3.4 +1.2.3.4.567890",
]


@pytest.mark.parametrize("text", CASES)
def test_base_patterns(text):
    assert private.base_spans(text) == expected(text)


def test_base_patterns_on_random_texts():
    draw = random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choices("a1.+@ -()2é4", k=draw.randrange(30)))
        assert private.base_spans(text) == expected(text), text


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 200_000, "a@b." * 50_000):
        private.base_spans(text)
        list(private.candidates(text))


def phone(draw):
    return f"+1 ({draw.randrange(200, 999)}) 555-{draw.randrange(10_000):04d}"


def corpus(n):
    draw, rows = random.Random(3), []
    for i in range(n):
        texts = [f"call {phone(draw)} now", f"from 10.{draw.randrange(256)}.3.{draw.randrange(256)} here"]
        texts += [f"order {draw.randrange(10**7, 10**8)} of 2024-05-{draw.randrange(10, 28)}", "nothing at all"]
        rows.append((i, draw.choice(texts)))
    return rows


def test_trees_add_what_looks_alike_and_leave_the_rest(frame):
    rows = [*corpus(1200), (5000, "call 1 (415) 555-2671 now"), (5001, "order 12345678 of 2024-05-11"), (5002, None)]
    found = private.find_private(frame([(d, t, 0, "") for d, t in rows], SCHEMA))
    got = {r.doc_id: r for r in found.collect()}
    assert got[5000].spans == "phone:5:21" and got[5000].n_phone == 0
    assert got[5001].spans == "" and got[5002].spans == ""
    for doc_id, text in rows:
        base, row = expected(text or ""), got[doc_id]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(len(base[k]) for k in private.KINDS)
        spans = private.joined(base)
        assert row.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) - {""} <= set(row.spans.split(","))


def test_trees_learn_from_every_row(frame):
    """A third of the rows would hold too few phone numbers to calibrate a threshold."""
    draw = random.Random(5)
    rows = [(i, f"order {i:08d} of 2024-05-11") for i in range(60_000)]
    rows += [(70_000 + i, f"call {phone(draw)} now") for i in range(100)]
    every = frame([(d, t, 0, "") for d, t in rows], SCHEMA)
    found = private._examples(every.select("doc_id", "text").toArrow().to_batches())
    hits = sum(n for b in found for x, n in zip(b.column("label").to_pylist(), b.column("times").to_pylist()) if x)
    trees, limits = private.train(every.select("doc_id", "text"))
    assert hits == 100 and limits["phone"] <= 1


def test_printed_trees_score_as_the_model_does(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    draw = np.random.default_rng(1)
    values = draw.integers(0, 4, (300, 3)).astype(float)
    labels = ((values[:, 0] > 1) ^ (values[:, 1] > 2)).astype(float)
    rows = spark.createDataFrame([(v.tolist(), float(x)) for v, x in zip(values, labels)], "v array<double>, label double")
    table = rows.select(array_to_vector("v").alias("features"), "v", "label")
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(table)
    for r in model.transform(table).select("v", "probability").limit(50).collect():
        assert abs(private.Trees(model).scores(np.array([r.v]))[0] - r.probability[1]) < 1e-9


def test_no_training_data_and_empty_table(frame):
    got = private.find_private(frame([(1, "no data", 0, ""), (1, "x 12345678 y", 0, "")], SCHEMA)).collect()
    assert [(r.doc_id, r.spans) for r in got] == [(1, ""), (1, "")]
    assert private.find_private(frame([], SCHEMA)).count() == 0


def test_redaction():
    assert private.redact("to a@b.c, 1.2.3.4!", "email:3:8,ip:10:17") == "to [email], [ip]!"
    assert private.redact("ab", "") == "ab"
    assert private.redact("abcdef", "card:1:4,phone:2:5") == "a[card]ef"


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_private_spans(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(private.joined(expected(docs[r.doc_id])).encode()).hexdigest()
