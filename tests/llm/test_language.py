import itertools
import math
import zlib

import numpy as np

from callsieve.llm import language, queries
from callsieve.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, score string, row int"
PATH = tokenizer_path("piece_bpe_32k.model")


def all_ways(word, chances):
    """Sum over all segmentations, one by one."""
    total = 0.0
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, cut in enumerate(cuts) if cut), len(word)]
        total += math.prod(chances.get(word[a:b], 0.0) for a, b in zip(at, at[1:]))
    return total


def test_scores_sum_over_all_segmentations():
    pieces = sorted([b"a", b"b", b"ab", b"ba", b"aba", b" ", b" a"])
    draw = np.random.default_rng(1)
    chances = draw.random((len(pieces), 2)) / 10
    words = [b" abab", b"a", b" ", b"babaab", b" abaabab", b"bb"]
    got = language.word_scores(words, language.Pieces(pieces), chances)
    for row, word in zip(got, words):
        for k in range(2):
            assert math.isclose(row[k], math.log(all_ways(word, dict(zip(pieces, chances[:, k])))), rel_tol=1e-9)


def test_long_words_are_scored_whole():
    """Against the sum over all segmentations in logs, prefix by prefix."""
    pieces = sorted([b"a", b"b", b"\xc3", b"\xa9", "é".encode(), b"ab", b"abab" * 9, b" ", b" a"])
    draw = np.random.default_rng(3)
    chances = draw.random((len(pieces), 3)) ** 8 / 10 + 1e-8
    words = [b" " + b"ab" * 100, ("é" * 400).encode(), b" a" + b"abab" * 2000, b"b" * 33, b"ab"]
    got = language.word_scores(words, language.Pieces(pieces), chances)
    for row, word in zip(got, words):
        for k in range(3):
            logs = [0.0]
            for end in range(1, len(word) + 1):
                ways = [logs[end - len(p)] + math.log(c) for p, c in zip(pieces, chances[:, k]) if word[:end].endswith(p)]
                logs.append(np.logaddexp.reduce(ways))
            assert math.isclose(row[k], logs[-1], rel_tol=1e-9)


def test_all_labels_are_learned(frame):
    names = [f"l{i:02}" for i in range(70)]
    rows = [(j * 100 + i, f"zz{chr(97 + i % 26)}{chr(97 + i // 26)}q " * 20, name, "", 1) for i, name in enumerate(names) for j in range(2)]
    model = language.train(frame(rows, SCHEMA), PATH)
    assert model.languages == names
    got = {r.doc_id: r.lang_pred for r in language.identify(frame(rows, SCHEMA), model).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) > 0.9 * len(rows)


def test_parts_are_cut_between_characters():
    word = (" " + "é漢" * 40).encode()
    parts = list(language._parts(word))
    assert b"".join(parts) == word and all(len(p) <= language.RUN and p.decode() for p in parts)


def test_a_round_counts_pieces_as_expected(monkeypatch):
    monkeypatch.setattr(language, "SHARED", 0.0)
    monkeypatch.setattr(language, "EVEN", 0.0)
    pieces = sorted([b"a", b"b", b"ab"])
    fitted = language.fit([b"ab", b"a"], np.array([[3.0], [1.0]]), language.Pieces(pieces), rounds=1)
    # ab: as one piece with chance 1/3 against 1/9 as two, so three quarters of the time.
    counts = {b"a": 1 + 3 / 4, b"ab": 9 / 4, b"b": 3 / 4}
    want = np.array([counts[p] for p in pieces]) / sum(counts.values())
    assert np.allclose(fitted[:, 0], want)


def test_vocabulary_is_public_and_covers_all_bytes():
    pieces = language.read_pieces(PATH)
    assert len(pieces) > 30_000 and all(bytes([b]) in set(pieces) for b in range(256))


LABELLED = [(i, t, lang, "x", 1) for i, (t, lang) in enumerate(
    [("the cat and the dog went to the house", "en"), ("where is the small house of the cat", "en"),
     ("le chat et le chien vont à la maison", "fr"), ("où est la petite maison du chat", "fr")] * 10
)]


def test_edge_cases(frame):
    model = language.train(frame(LABELLED, SCHEMA), PATH)
    assert model.languages == ["en", "fr"]
    rows = [
        (1, "The dog, and the house", None, "", 0),
        (2, "LE chien; la maison", "en", "", 0),
        (3, None, "en", "", 0),
        (4, "", "en", "", 0),
        (5, "123 ... !?", "fr", "", 0),
        (6, "x" * 100_000, None, "", 0),
        (7, "the house " * 20_000, None, "", 0),
        (None, "le chat " + "é" * 50, None, "", 0),
        (1, "你好", None, "", 0),
    ]
    got = {(r.doc_id, r.lang_pred): r.score for r in language.identify(frame(rows, SCHEMA), model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    for key in [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (7, "en"), (None, "fr")]:
        assert key in got
    assert all(s == 0 for (_, lang), s in got.items() if lang == "und")
    kept = language.recognised(frame(rows, SCHEMA), model, 0.5)
    assert kept.columns == ["doc_id", "text", "lang", "score", "row"] and kept.count() == 6


def test_no_labels_and_empty_table(frame):
    model = language.train(frame([(1, "a", None, "", 0), (2, None, "en", "", 0)], SCHEMA), PATH)
    assert [r.lang_pred for r in language.identify(frame(LABELLED[:1], SCHEMA), model).collect()] == ["und"]
    model = language.train(frame(LABELLED, SCHEMA), PATH)
    assert language.identify(frame([], SCHEMA), model).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    rows = queries.op7_language(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.97 * len(held)
