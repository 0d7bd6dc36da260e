import hashlib
import random
import zlib

import pytest

from callsieve.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, key string, n int"


def turn_digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def told(rows):
    """Turns of each conversation in order."""
    found = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            key = (turn is not None, turn or 0, turn_digest(role, text))
            found.setdefault(conv_id, []).append((key, (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in found.items()}


def rebuilt(rows):
    own, out = told(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def expected(stories):
    members = {}
    for c, turns in stories.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        ends = sorted(c for c in inside if len(stories[c]) == len(path))
        out.append(
            (
                min(inside),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(inside),
                sum(len(p) == len(path) + 1 for p in below),
                len(leaves),
                sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def random_rows(seed, conversations=60, longest=9):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-250, 450), conversations):
        for turn in range(draw.randrange(1, longest)):
            number = draw.choice([turn, turn, turn, None, 2])
            rows.append((c, number, draw.choice(["user", "a", None, ""]), draw.choice(["x", "yé", "x", None, "zzz" * 9])))
    rows += [(0, t, "user", "same") for t in range(6)] + [(100, t, "user", "same") for t in range(7)] + [(None, 1, "u", "x")]
    return rows + rows[:5]


def table(frame, rows):
    return frame([(*r, "clash", 1) for r in rows], SCHEMA)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed, limit", [(1, 100_000), (2, 12), (3, 1)])
def test_nodes_of_rebuilt_conversations(frame, seed, limit):
    rows = random_rows(seed)
    got = prefixes.prefix_nodes(prefixes.rebuilt(table(frame, rows)), trie_digests=limit)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rebuilt(rows))


def test_nodes_of_whole_conversations_and_long_ones(frame):
    rows = [(c, t, "user", "t" * (t % 5)) for c in (1, 2, 3) for t in range(300 - c % 2)] + [(9, 0, "user", "é" * 200_000)]
    got = prefixes.prefix_nodes(prefixes.turns(table(frame, rows)), trie_digests=400)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(told(rows))


def test_empty_table(frame):
    assert prefixes.prefix_nodes(prefixes.rebuilt(table(frame, []))).count() == 0


def _walk(trie, path):
    """Exit node by plain descent."""
    node = trie.root
    while node.depth < len(path) - 1:
        child = node.children.get(path[node.depth + 1])
        if child is None:
            return node
        node = child
        if node.depth > len(path) - 1 or node.path[node.depth] != path[node.depth]:
            return node
    return node


def test_fat_binary_search_finds_the_exit_node():
    draw = random.Random(4)
    trie = prefixes.ZFastTrie()

    def path(word):
        out = [prefixes.ROOT]
        for letter in word:
            out.append(hashlib.md5(out[-1] + letter.encode()).digest())
        return out

    words = ["".join(draw.choices("ab", k=draw.randrange(0, 40))) for _ in range(400)]
    words += [w[: len(w) // 2] for w in words] + ["a" * n for n in range(0, 70, 7)]
    for n, word in enumerate(words):
        assert trie.locate(path(word)) is _walk(trie, path(word))
        trie.insert(path(word), [0] + [1] * len(word), 1, n)
    for word in words + ["".join(draw.choices("abc", k=30)) for _ in range(200)]:
        assert trie.locate(path(word)) is _walk(trie, path(word))
    assert {trie.handles[node.handle] for node in trie.handles.values()} == set(trie.handles.values())
    beginnings = {word[:d] for word in words for d in range(len(word) + 1)}
    rows = list(trie.expand())
    assert len(rows) == len(beginnings) and rows[0][5] == len(words)


def test_fattest():
    for low in range(40):
        for high in range(low + 1, 40):
            best = max(range(low + 1, high + 1), key=lambda n: n & -n)
            assert prefixes.fattest(low, high) == best
