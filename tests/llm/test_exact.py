import hashlib
import random
import re

import pytest

from callsieve.llm import exact

SCHEMA = "doc_id long, text string, kept string, term int"


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        text = text or ""
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text), []).append((doc_id, text))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(d, keep, len(members), d == keep, digest) for d, _ in members]
    return sorted(out, key=repr)


def check(frame, rows, **options):
    table = frame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = exact.exact_groups(table, **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


ROWS = [
    (1, "a b"),
    (2, "ab"),
    (3, "a\n\tb "),
    (4, None),
    (5, ""),
    (6, " \x0b"),
    (7, "é ß" * 3),
    (7, "é ß" * 3),
    (None, "ab"),
    (None, "only"),
    (8, "x" * 300_000),
    (9, "x" * 299_999 + " x"),
    (10, "abc"),
]


def test_edge_cases(frame):
    check(frame, ROWS)


@pytest.mark.parametrize("hash_bytes", [0, 1])
def test_colliding_hashes_are_told_apart_by_the_trie(frame, hash_bytes):
    check(frame, ROWS, hash_bytes=hash_bytes)


def test_spilled_subtrees_and_random_texts(frame):
    draw = random.Random(1)
    rows = [(i, "".join(draw.choice("ab \n") for _ in range(draw.randrange(9)))) for i in range(600)]
    check(frame, rows, trie_bytes=40)


def test_empty_table(frame):
    assert exact.exact_groups(frame([], SCHEMA)).count() == 0


def test_trie_keeps_every_key():
    draw = random.Random(2)
    keys = {bytes(draw.choices(b"abc", k=draw.randrange(7))) for _ in range(300)}
    trie = exact.Trie()
    for number, key in enumerate(sorted(keys, key=lambda k: hash(k))):
        node = trie.terminal(key)
        assert node.owner is None
        node.owner = number
    assert all(trie.terminal(k).owner is not None for k in keys)
    spilled = dict(trie.spill())
    kept = dict(trie.drain())
    assert spilled.keys() | kept.keys() == keys and not spilled.keys() & kept.keys()
    assert trie.size == 0
