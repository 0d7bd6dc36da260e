import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callsieve.llm import bloom_lm, queries

SCHEMA = "doc_id long, text string, held boolean, n_known int, row string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def check(got, docs):
    """``docs``: id, text, held out; got rows are compared with counts made one by one."""
    counts = Counter(w for _, t, held in docs if not held for w in tokens(t))
    total, types = sum(counts.values()), len(counts)
    want = []
    for doc_id, text, held in docs:
        own = tokens(text)
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in own)
        want.append((doc_id, bool(held), len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)))
    rows = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)


DOCS = [
    (1, "The cat sat on the mat. the cat", False),
    (2, "a dog sat\ton the mat", False),
    (3, "a bird\nsat on THE cat", True),
    (4, None, False),
    (5, "", True),
    (5, "É é the", None),
    (None, "the dog", True),
    (6, "w " * 50_000 + "x" * 20_000, False),
]


@pytest.mark.parametrize("exact_words", [0, 3, 1 << 20])
def test_base_scores(frame, exact_words):
    table = frame([(d, t, h, 1, "x") for d, t, h in DOCS], SCHEMA)
    check(bloom_lm.score(table, F.col("held"), exact_words=exact_words).collect(), DOCS)


def test_nothing_to_learn_from(frame):
    docs = [(d, t, True) for d, t, _ in DOCS]
    check(bloom_lm.score(frame([(*d, 1, "x") for d in docs], SCHEMA), F.col("held")).collect(), docs)
    assert bloom_lm.score(frame([], SCHEMA), F.col("held")).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = queries.op3_bloom_lm(spark, sf_dir).collect()
    check(rows, [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in docs])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filter_reads_back_levels():
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = np.maximum(3, (3 * draw.pareto(0.7, 20_000) + 3)).astype(np.int64)
    bloom = bloom_lm.LogBloom(hashes, counts, 3)
    got = bloom.counts(hashes)
    # Levels are never read too low, and seldom too high.
    assert (bloom_lm.greatest(got) >= counts).all()
    assert (got > counts * 2).mean() < 0.03
    assert (bloom.counts(draw.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.02
    assert len(bloom_lm.LogBloom(hashes[:0], counts[:0], 1).counts(hashes)) == 20_000


def test_probabilities_of_followers_add_up_to_one_at_most():
    """Of the model's words and one for all others, after each history."""
    text = "a b a c a b b a c c a b " * 40
    column = pa.array([text])
    (_, _, hashes, bounds), = bloom_lm.tokens(column)
    words = bloom_lm.merge([np.unique(hashes, return_counts=True)])
    pairs = np.unique(bloom_lm.pair_hashes(bloom_lm.before(hashes, bounds), hashes), return_counts=True)
    bloom = bloom_lm.LogBloom(np.concatenate((words[0], pairs[0])), np.concatenate((words[1], pairs[1])), 1)
    total = len(hashes)
    model = bloom_lm.Model(bloom, *words, 1, total, len(words[0]), 0, 0)
    for history in words[0]:
        chance = 0.0
        for word in words[0]:
            chance += 10 ** model.score(np.array([history, word], np.uint64), np.array([0, 2]))[1]
        # A pair is read too high only by a false hit; there are 9 pairs, all of them held.
        assert chance <= 1


def test_unseen_ngrams_are_not_given_the_least_count():
    """The least count of the broadcast filter grows with the corpus; what is not in it stays unseen."""
    draw = np.random.default_rng(2)
    hashes = draw.integers(0, 2**63, 50_000).astype(np.uint64)
    counts = (970 * (draw.pareto(0.7, 50_000) + 1)).astype(np.int64)
    unseen = draw.integers(0, 2**63, 200_000).astype(np.uint64)
    bloom = bloom_lm.LogBloom(hashes, counts, 970, confirmed=True)
    assert (bloom.counts(hashes) >= 970).all() and not bloom.lacks(hashes).any()
    assert (bloom.counts(unseen) == 0).all() and bloom.lacks(unseen).all()
    assert (bloom_lm.LogBloom(hashes, counts, 970).counts(unseen) > 0).any()
    assert (bloom.counts(hashes) <= counts * 1.0001).mean() > 0.97
    assert (bloom_lm.greatest(bloom.counts(hashes)) >= counts).all()


def test_rare_words_and_pairs_are_held(frame):
    """However great the share from which on n-grams are broadcast, scores are the same."""
    # Counts are 1 or at least 64 times a power of two, so that levels do not depend on the filter.
    docs = [(1, "q r s t u v " * 64, False), (2, "one rare pair of words", False), (3, "one rare pair of words", True)]
    docs += [(4, "one pair rare words of", True), (5, "never seen", True)]
    table = frame([(*d, 1, "x") for d in docs], SCHEMA)
    got = {share: {r.doc_id: r.score for r in bloom_lm.score(table, F.col("held"), share=share).collect()} for share in (1e-9, 0.05, 1.0)}
    assert got[1e-9][3] > got[1e-9][4] + 1
    for share in (0.05, 1.0):
        for doc_id, score in got[1e-9].items():
            assert abs(got[share][doc_id] - score) < 0.1 * abs(score), (share, doc_id)
        assert got[share][3] > got[share][4] + 1
