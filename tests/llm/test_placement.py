import hashlib
from collections import Counter

import pytest

from callsieve.llm import placement, queries


def filled(shards, slots):
    """Turn by turn, with each shard's whole permutation written out."""
    orders = {}
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        first, step = int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
        orders[name] = iter([(first + i * step) % slots for i in range(slots)])
    table = {}
    while True:
        for name in sorted(shards):
            for _ in range(shards[name]):
                table[next(s for s in orders[name] if s not in table)] = name
                if len(table) == slots:
                    return [table[i] for i in range(slots)]


@pytest.mark.parametrize("shards", [{"a": 1}, {"a": 1, "b": 1, "c": 3}, {f"s{i}": 1 + i % 2 for i in range(9)}])
def test_table(shards):
    assert placement.fill_table(shards, 101) == filled(shards, 101)


def test_shares_and_stability():
    table = placement.fill_table(queries.SHARDS)
    shares, weight = Counter(table), sum(queries.SHARDS.values())
    assert all(abs(shares[s] - placement.SLOTS * w / weight) <= w for s, w in queries.SHARDS.items())
    fewer = placement.fill_table({s: w for s, w in queries.SHARDS.items() if s != "shard-07"})
    moved = sum(a != b for a, b in zip(table, fewer)) / placement.SLOTS
    assert moved < 0.08


@pytest.mark.parametrize("shards", [{}, {"a": 0}, {"a": 60, "b": 60}])
def test_impossible_tables(shards):
    with pytest.raises(ValueError):
        placement.fill_table(shards, 101)


def test_places_keep_rows(frame):
    rows = [(1, "x", "old"), (1, "y", None), (None, None, "z"), (2, "x" * 100_000, "")]
    table = frame(rows, "id long, text string, shard string")
    got = placement.place(table, "id", {"a": 1, "b": 1}).collect()
    assert sorted((r.id or 0, r.text or "") for r in got) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert len({r.shard for r in got if r.id == 1}) == 1 and all(r.shard in "ab" for r in got)
    assert placement.place(frame([], "id long"), "id", {"a": 1}).count() == 0


def test_query(spark, sf_dir):
    table = placement.fill_table(queries.SHARDS)
    rows = queries.op5_shard_table(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(table[r.slot] == r.shard for r in rows)
