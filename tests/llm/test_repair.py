import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import numpy as np
import pytest

from callsieve.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, cost string"
sys.setrecursionlimit(20_000)
NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def best_edits(rows):
    """Cheapest edits of ``(initial, must go, truncated)`` rows, the least letters of these."""

    @lru_cache(None)
    def go(at, state, inserted):
        found = [(0, "")] if at == len(rows) and state in ("", "a") else []
        forward = NEXT[state][0]

        def add(cost, letter, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1]))

        if inserted < 3:
            add(5, "I", go(at, forward, inserted + 1))
        if at < len(rows):
            initial, gone, cut = rows[at]
            add(2, "D", go(at + 1, state, 0))
            if not gone:
                more = 5 if cut else 0
                if initial == forward or (initial == "s" and not state):
                    add(more, "K", go(at + 1, initial, 0))
                add(1 + more, "R", go(at + 1, forward, 0))
        return min(found, default=None)

    return go(0, "", 0)


def symbols(rows):
    return np.array([0 if gone else repair.symbol_of(initial, cut) for initial, gone, cut in rows], np.uint8)


def test_block_tables_against_all_edits():
    draw = random.Random(5)
    kinds = [(i, False, cut) for i in ("u", "a", "s", "t", "") for cut in (False, True)] + [("u", True, False)]
    cases = [c for n in range(4) for c in itertools.product(kinds, repeat=n)]
    cases += [tuple(draw.choices(kinds, k=draw.randrange(4, 26))) for _ in range(1500)]
    for rows in cases:
        assert repair.cheapest(symbols(rows)) == best_edits(rows), rows


def test_tables_hold_every_vector():
    t = repair.tables()
    assert t.step.max() < len(t.vectors) and t.block_step.shape == (len(t.vectors), 9**repair.BLOCK)
    for v, block in ((0, 17), (len(t.vectors) - 1, 9**repair.BLOCK - 2), (3, 1234)):
        at, paid = v, 0
        for place in range(repair.BLOCK):
            symbol = block // 9**place % 9
            paid, at = paid + t.off[at, symbol], t.step[at, symbol]
        assert (at, paid) == (t.block_step[v, block], t.block_off[v, block])


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv_id, turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def expected(rows, damage=True):
    known = list(dict.fromkeys(r[0] for r in rows))
    rows = damaged(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv_id in known:
        own = sorted(
            (r for r in rows if r[0] == conv_id),
            key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()),
        )
        seen, faults = set(), []
        for _, _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        cost, audit = best_edits(tuple((r[2][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(own, faults)))
        at, state, kept = 0, "", []
        for letter in audit:
            if letter == "D":
                at += 1
                continue
            role, text = (own[at][2], own[at][3]) if letter != "I" else ("", "")
            at += letter != "I"
            role = role if letter == "K" else NEXT[state]
            state = role[0]
            kept.append(f"{role}:{text}")
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((conv_id, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=repr)


ROLES = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "unknown"]
TEXTS = ["Fine.", "cut", "", " \t\x0b", "Why? ", None, "é!", "Fine.", "no\n"]


def random_rows(seed):
    draw = random.Random(seed)
    rows = []
    for conv_id in [*range(-3, 60), None]:
        for turn in range(draw.randrange(1, 9)):
            rows.append((conv_id, draw.choice([turn, turn, turn + 3, None]), draw.choice(ROLES), draw.choice(TEXTS)))
    return rows + rows[:9]


@pytest.mark.parametrize("seed, damage", [(1, True), (2, False)])
def test_conversations(frame, seed, damage):
    rows = random_rows(seed)
    got = repair.repair(frame([(*r, "x", "clash") for r in rows], SCHEMA), damage)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, damage)


def test_long_conversation_and_long_text(frame):
    rows = [(1, t, ROLES[t % 3], f"{t}.") for t in range(400)] + [(2, 0, "user", "x" * 300_000 + "!"), (2, 1, "assistant", "y.")]
    got = repair.repair(frame([(*r, "x", "clash") for r in rows], SCHEMA, 5))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_repaired_rows_follow_the_pattern(frame):
    rows = frame([(*r, "x", "clash") for r in random_rows(3)], SCHEMA)
    kept = repair.damaged(rows)
    found = repair.repaired_rows(kept, repair.judge(rows, kept)).orderBy("conv_id", "place").collect()
    stories = {}
    for r in found:
        stories.setdefault(r["conv_id"], []).append(r["role"][0])
    assert stories and all(re.fullmatch("s?(ua)+", "".join(s)) for s in stories.values())


def test_empty_table(frame):
    assert repair.repair(frame([], SCHEMA)).count() == 0
