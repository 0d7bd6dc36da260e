import hashlib
import random
import re

import pytest

from callsieve.llm import leaks

SCHEMA = "doc_id long, text string, items string, n_hit int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(docs, items, window=10):
    windows = {}
    for item_id, text in items:
        own = words(text)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for n in range(1, window + 1):
            for i in range(len(own) - n + 1):
                if ids := windows.get(tuple(own[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        found = sorted(found)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), found, digest, bool(hit)))
    return sorted(out, key=repr)


def longest(docs, items, window=10):
    """Longest match of each document, its first place and least item, by comparing all places."""
    tests = [("" if i is None else str(i), own) for i, t in items if (own := words(t))]
    least = min([4, window, *(len(own) for _, own in tests)])
    out = []
    for doc_id, text in docs:
        own, best = words(text), (0, None, None)
        for at in range(len(own)):
            for item, test in tests:
                for start in range(len(test)):
                    n = 0
                    while at + n < len(own) and start + n < len(test) and own[at + n] == test[start + n]:
                        n += 1
                    if n >= least and (n > best[0] or n == best[0] and at == best[1] and item < best[2]):
                        best = (n, at, item)
        out.append((doc_id, *best))
    return sorted(out, key=repr)


def check(frame, docs, items, **options):
    table = frame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    got = leaks.contamination(table, frame(items, "item_id long, text string"), **options)
    rows = got.collect()
    window = options.get("window", 10)
    found = [(*r[:6], r.contaminated) for r in rows]
    assert sorted(found, key=repr) == expected(docs, items, window)
    if sum(len(t or "") for _, t in docs) < 50_000:
        matches = [(r.doc_id, r.longest, r.longest_at, r.longest_item) for r in rows]
        assert sorted(matches, key=repr) == longest(docs, items, window)


def passage(draw, n, size=12):
    return [f"w{draw.randrange(size)}" for _ in range(n)]


def case(seed, size=12):
    draw = random.Random(seed)
    items = [(i, " ".join(passage(draw, draw.choice([1, 3, 9, 10, 11, 25]), size))) for i in range(25)]
    docs = []
    for i in range(60):
        own = passage(draw, draw.randrange(40), size)
        for _ in range(draw.randrange(3)):
            item = draw.choice(items)[1].split()
            at, cut = draw.randrange(len(own) + 1), draw.randrange(len(item))
            own[at:at] = item[cut:] if draw.random() < 0.5 else item
        docs.append((i, " -- ".join(own).upper()))
    return docs, items


@pytest.mark.parametrize("seed,size", [(1, 3), (2, 12), (3, 300)])
def test_random_texts(frame, seed, size):
    check(frame, *case(seed, size))


def test_blocks_and_shards_change_nothing(frame):
    check(frame, *case(4, 40), block_bytes=200, shard_bytes=300)


def test_edge_cases(frame):
    ten = "a b c d e f g h i j"
    docs = [(1, None), (2, ""), (3, "... !"), (4, ten), (4, ten), (None, f"x {ten} y"), (5, "short"), (6, f"{ten} " * 3000)]
    items = [(1, ten), (1, ten), (2, None), (3, ""), (None, f"{ten} k"), (4, "Short"), (5, "é ñ"), (6, "?")]
    check(frame, docs, items)
    check(frame, docs, [(2, None)])


def test_empty_tables(frame):
    check(frame, [], [(1, "a b c")])
    check(frame, [(1, "a b c")], [])


def test_longest_matches(frame):
    docs, items = case(5, 6)
    got = leaks.longest_matches(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"))
    tokens = {d: words(t) for d, t in docs}
    shortest = min(4, min(len(words(t)) for _, t in items))
    rows = {(r.item_id, r.item_at): r for r in got.collect()}
    for item_id, text in items:
        own = words(text)
        for at in range(len(own)):
            best = 0
            for doc in tokens.values():
                for i in range(len(doc)):
                    n = 0
                    while at + n < len(own) and i + n < len(doc) and own[at + n] == doc[i + n]:
                        n += 1
                    best = max(best, n)
            row = rows.get((str(item_id), at))
            if row is None:
                assert best < shortest
            else:
                assert row.length == best
                assert tokens[row.doc_id][row.doc_at : row.doc_at + best] == own[at : at + best]


def test_documents_with_hits_leave(frame):
    docs = frame([(1, "clean text", "x", 1), (2, "a b c d", "x", 1)], SCHEMA)
    kept = leaks.without_leaks(docs, frame([(1, "b c")], "item_id long, text string"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "clean text", "x", 1)]


def test_shards_are_as_large_as_the_benchmark_asks(spark):
    assert [leaks._shard_bytes(n << 20) for n in (0, 1, 5, 100)] == [2 << 20, 2 << 20, 5 << 20, 8 << 20]
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    leaks.contamination(docs, spark.createDataFrame([("x", "a b c")], "item_id string, text string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{2 << 20}b"
