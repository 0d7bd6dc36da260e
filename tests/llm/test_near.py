import random
import re

import numpy as np
import pyarrow as pa
import pytest

from callsieve.llm import near
from callsieve.llm.components import components

SCHEMA = "doc_id long, text string, node string, root int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def expected(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = doc_id if not sets[i] else least.get(find(i))
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def check(frame, rows, **options):
    got = near.near_groups(frame([(d, t, "x", 1) for d, t in rows], SCHEMA), **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, options.get("percent", 85))


def corpus(seed, bases=6, copies=12, words=80):
    """Copies of a few texts with up to a third of their words changed."""
    draw, rows = random.Random(seed), []
    for base in range(bases):
        text = [f"w{base}x{draw.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            own = list(text)
            for _ in range(draw.randrange(words // 8)):
                own[draw.randrange(words)] = f"n{draw.randrange(10**6)}"
            rows.append(" ".join(own))
    draw.shuffle(rows)
    return list(enumerate(rows, 10))


def test_edge_cases(frame):
    long = " ".join(f"v{i}" for i in range(30_000))
    check(
        frame,
        [
            (9, None),
            (8, ""),
            (7, " \n"),
            (6, "one two"),
            (5, "One\ttwo"),
            (4, "two one"),
            (3, long),
            (2, long + " more"),
            (2, "one two"),
            (None, "one two"),
            (None, "alone and without any id here"),
            (1, "a a a a a a a a"),
            (11, "a a a a a"),
            (12, "é ß x É"),
        ],
    )


def test_groups_of_near_copies(frame):
    check(frame, corpus(1))


def test_dense_regions(frame):
    check(frame, corpus(2, bases=2, copies=40), small_region=3)


def test_overfull_regions_go_deeper(frame):
    check(frame, corpus(3, bases=2, copies=40), region_rows=8, small_region=3)


def test_equal_signatures_without_end(frame):
    """Texts so long and alike that all their signatures agree are linked on the deepest rung."""
    words = [f"v{i}" for i in range(3000)]
    rows = [(i, " ".join([*words, f"tail{i}"])) for i in range(12)]
    check(frame, rows, region_rows=2, small_region=2)


def test_copies_that_no_depth_parts(frame):
    """A template with one slot, beside texts that only some of its copies are near to."""
    draw = random.Random(4)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(60):
        own = list(words)
        own[draw.randrange(400)] = f"slot{i}"
        rows.append((i, " ".join(own)))
    # Less and less like the template, on both sides of 85 percent.
    for i in range(10):
        own = list(words)
        for at in range(0, 5 * (4 + i), 5):
            own[at] = f"far{i}x{at}"
        rows.append((100 + i, " ".join(own)))
    check(frame, rows, region_rows=8, small_region=3)


def test_empty_table_and_no_links(frame):
    assert near.near_groups(frame([], SCHEMA)).count() == 0
    check(frame, [(1, "all alone in this small table here")])


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 2**63, 1000).astype(np.uint64)
    one, two = np.sort(values[:900]), np.sort(values[100:])
    a, b = near.minhash([one, two], 512)
    assert abs((a == b).mean() - 0.8) < 0.06


def test_shingles_are_whole_texts():
    text = " ".join(map(str, range(5000)))
    sets = list(near.shingle_sets(pa.array([text, None, "a b", text.upper()])))
    assert [len(s) for s in sets] == [4996, 0, 1, 4996]


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (5, 4), (5, 5), (3, 1)], [(i, i + 1) for i in range(40)]])
def test_components(frame, links):
    got = {r.node: r.root for r in components(frame(links, "a long, b long")).collect()}
    want = {}
    for a, b in links:
        if a != b:
            want.setdefault(a, a)
            want.setdefault(b, b)
    for _ in range(50):
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
