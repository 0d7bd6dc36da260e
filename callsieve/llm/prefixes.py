"""Shared beginnings of conversations, by z-fast tries.

A conversation is the string of its turns. Its prefixes are named by chained digests, so a trie of
conversations needs no texts. Each task inserts its conversations in batches into a z-fast trie: a
compacted trie whose nodes are hashed by the digest at their two-fattest depth, the depth with most
trailing zeros on their edge. Fat binary search over these handles finds the node at which a
conversation leaves the trie in as many probes as its length has bits. A full trie is drained: its edges
are expanded to one row per depth, with the counts of its subtree.

Rows of several tries with the same digest are one node; counts add up. Who is the smallest member
then decides in which trie a node is owned, and a second walk over each drained trie adds up what must
count once for each node: children, leaves and text. No group is larger than one trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.llm.arrays import bounded_batches
from callsieve.session import materialise

#: Digests that a task's trie holds before it is drained; a longer conversation is a trie of its own.
TRIE_DIGESTS = 100_000
#: Digest of no turns.
ROOT = bytes(16)
#: Turns that a conversation takes from the first one of its hundred at most, plus one.
HEADS = 6


def fattest(low: int, high: int) -> int:
    """The number in ``(low, high]`` with the most trailing zeros."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """Edge and end of a compacted node: depths ``(start, depth]`` of the prefixes in ``path``."""

    __slots__ = ("start", "depth", "path", "sizes", "children", "ends", "least", "parent")

    def __init__(self, start: int, depth: int, path: list[bytes], sizes: list[int], parent: Node | None):
        self.start, self.depth, self.path, self.sizes, self.parent = start, depth, path, sizes, parent
        self.children: dict[bytes, Node] = {}
        self.ends, self.least = 0, None

    @property
    def handle(self) -> bytes:
        return self.path[fattest(self.start, self.depth)]

    @property
    def text(self) -> int:
        """Code points along the edge."""
        return sum(self.sizes[self.start + 1 : self.depth + 1])


class ZFastTrie:
    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.root = Node(0, 0, [ROOT], [0], None)
        self.handles: dict[bytes, Node] = {}
        self.digests = 0

    def locate(self, path: list[bytes]) -> Node:
        """The deepest node whose edge ``path`` enters; it may end or leave within it."""
        low, high, best = 0, len(path) - 1, self.root
        last = high
        while low < high:
            middle = fattest(low, high)
            node = self.handles.get(path[middle])
            if node is None:
                high = middle - 1
            elif node.depth <= last and node.path[node.depth] == path[node.depth]:
                low, best = node.depth, node
            else:
                return node
        return best.children.get(path[best.depth + 1], best) if best.depth < last else best

    def insert(self, path: list[bytes], sizes: list[int], ends: int, least: int) -> None:
        """Add ``ends`` equal conversations, ``least`` being their smallest id."""
        node, last = self.locate(path), len(path) - 1
        # Digests agree up to a depth and differ from there on.
        low, high = node.start, min(node.depth, last)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if node.path[middle] == path[middle] else (low, middle - 1)
        if low < node.depth:
            node = self._split(node, low)
        if low < last:
            leaf = Node(low, last, path, sizes, node)
            node.children[path[low + 1]] = leaf
            self.handles[leaf.handle] = leaf
            self.digests += len(path)
            node = leaf
        node.ends += ends
        node.least = least if node.least is None else min(node.least, least)

    def _split(self, node: Node, depth: int) -> Node:
        """A node in the middle of the edge of ``node``."""
        upper = Node(node.start, depth, node.path, node.sizes, node.parent)
        del self.handles[node.handle]
        node.start, node.parent = depth, upper
        upper.children[node.path[depth + 1]] = node
        upper.parent.children[node.path[upper.start + 1]] = upper
        self.handles[upper.handle], self.handles[node.handle] = upper, node
        return upper

    def expand(self) -> Iterator[tuple]:
        """One row per depth of every edge, parents first: ``number, parent, key, depth, size`` and, of
        the subtree, ``n`` members, ``least`` member and ``total`` text, then whether it is ``inner``."""
        order, queue = [], [self.root]
        while queue:
            order.append(queue.pop())
            queue.extend(order[-1].children.values())
        under = {}
        for node in reversed(order):
            known = [node.least] if node.least is not None else []
            node.least = min(known + [child.least for child in node.children.values()])
            node.ends += sum(child.ends for child in node.children.values())
            under[node] = sum(under[child] + child.ends * child.text for child in node.children.values())
        last, number = {None: None}, 0
        for node in order:
            above, total = last[node.parent], under[node] + node.ends * node.text
            for depth in range(node.start + 1 if node.parent else 0, node.depth + 1):
                inner, size = depth < node.depth or bool(node.children), node.sizes[depth]
                yield number, above, node.path[depth], depth, size, node.ends, node.least, total, inner
                above, total, number = number, total - node.ends * size, number + 1
            last[node] = above


# -- tasks ---------------------------------------------------------------------------------

_UNITS = {
    "trie": ("long", pa.int64()),
    "number": ("long", pa.int64()),
    "above": ("long", pa.int64()),
    "key": ("binary", pa.binary()),
    "depth": ("long", pa.int64()),
    "size": ("long", pa.int64()),
    "n": ("long", pa.int64()),
    "least": ("long", pa.int64()),
    "total": ("long", pa.int64()),
    "inner": ("boolean", pa.bool_()),
}
_SHARES = {
    "key": ("binary", pa.binary()),
    "children": ("long", pa.int64()),
    "leaves": ("long", pa.int64()),
    "once": ("long", pa.int64()),
    "conv_id": ("long", pa.int64()),
    "parent_conv_id": ("long", pa.int64()),
    "depth": ("long", pa.int64()),
    "n_convs": ("long", pa.int64()),
    "total": ("long", pa.int64()),
}


def _schema(columns: dict) -> str:
    return ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items())


def _table(rows: list[tuple], columns: dict) -> pa.RecordBatch:
    data = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.RecordBatch.from_pydict({c: pa.array(x, k) for (c, (_, k)), x in zip(columns.items(), data)})


def _conversations(batch: pa.RecordBatch, state: list) -> Iterator[tuple]:
    """Finished conversations of sorted turns: ``conv_id, path, sizes``; ``state`` holds the open one."""
    names = ("conv_id", "head", "skipped", "turn_key", "n_chars")
    for conv_id, head, skipped, key, size in zip(*(batch.column(c).to_pylist() for c in names)):
        if not state or state[0] != conv_id:
            if state:
                yield state[0], state[1], state[2]
            state[:] = [conv_id, [ROOT], [0], 0]
        if not head:
            state[3] += 1
            if state[3] <= skipped:
                continue
        state[1].append(hashlib.md5(state[1][-1] + key).digest())
        state[2].append(size)


def _build(batches, limit: int):
    """Sorted turns to the rows of drained tries, and a row without ``trie`` for the end of each
    conversation."""
    trie, drained, state = ZFastTrie(), 0, []
    task = TaskContext.get().partitionId() << 32

    def rows() -> Iterator[pa.RecordBatch]:
        nonlocal drained
        found = [(task + drained, *row) for row in trie.expand()] if trie.root.children or trie.root.ends else []
        trie.clear()
        drained += 1
        for first in range(0, len(found), 20_000):
            yield _table(found[first : first + 20_000], _UNITS)

    def insert(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A batch: equal conversations are located once."""
        equal: dict[bytes, list] = {}
        for conv_id, path, sizes in done:
            one = equal.setdefault(path[-1], [path, sizes, 0, conv_id])
            one[2], one[3] = one[2] + 1, min(one[3], conv_id)
        for path, sizes, ends, least in equal.values():
            trie.insert(path, sizes, ends, least)
            if trie.digests >= limit:
                yield from rows()
        ends = [(None, None, None, path[-1], None, None, None, conv_id, None, None) for conv_id, path, _ in done]
        yield _table(ends, _UNITS)

    for batch in batches:
        yield from insert(list(_conversations(batch, state)))
    if state:
        yield from insert([tuple(state[:3])])
    yield from rows()


def _walk(units: list[tuple]) -> list[tuple]:
    """What one trie adds to the nodes: children, leaves and text of the nodes that it owns."""
    children, leaves, once = [0] * len(units), [0] * len(units), [0] * len(units)
    for number in range(len(units) - 1, -1, -1):
        above, key, depth, size, least, owner, leaf = units[number][:7]
        if owner == least:
            once[number] += size
            leaves[number] += leaf
            if above is not None:
                children[above] += 1
        if above is not None:
            once[above] += once[number]
            leaves[above] += leaves[number]
    out = []
    for number, (above, key, depth, _, least, owner, _, n, total) in enumerate(units):
        own = (owner, units[above][5] if above is not None else None, depth, n, total)
        named = own if owner == least else (None,) * 5
        out.append((key, children[number], leaves[number], once[number], *named))
    return out


def _share(batches):
    """Sorted rows of tries, whole tries one after the other, to what each adds to its nodes."""
    trie, units = None, []
    names = ("trie", "above", "key", "depth", "size", "least", "owner", "leaf", "n_convs", "all_text")
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if row[0] != trie and units:
                yield _table(_walk(units), _SHARES)
                units = []
            trie = row[0]
            units.append(row[1:])
    if units:
        yield _table(_walk(units), _SHARES)


def _digest(batches):
    """Sorted ``key, least`` to the digest of each key's ids, read one after the other."""
    key, hashed = None, None
    columns = {"ends_key": ("binary", pa.binary()), "ends_sha256": ("string", pa.string())}
    for batch in batches:
        done = []
        for one, conv_id in zip(batch.column("key").to_pylist(), batch.column("least").to_pylist()):
            if one != key:
                done += [(key, hashed.hexdigest())] if hashed else []
                key, hashed = one, hashlib.sha256(str(conv_id).encode())
            else:
                hashed.update(f",{conv_id}".encode())
        yield _table(done, columns)
    if hashed:
        yield _table([(key, hashed.hexdigest())], columns)


# -- tables --------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as ``conv_id, head, turn, turn_key, n_chars, skipped``: a digest stands for
    role and text, nulls being empty. Rows without a ``conv_id`` belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.lit(False).alias("head"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("turn_key"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.lit(0).cast("long").alias("skipped"),
    ).filter("conv_id IS NOT NULL")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Turns of conversations that begin alike: the first ``crc32(conv_id) % 6`` turns of a conversation
    are replaced by those of the first one of its hundred (``conv_id - conv_id % 100``)."""
    own = turns(conversations)
    skipped = F.crc32(F.col("conv_id").cast("string")) % HEADS
    own = own.withColumn("skipped", skipped)
    first = own.filter("conv_id % 100 = 0").selectExpr(
        "conv_id AS base", "turn", "turn_key", "n_chars",
        "row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, turn_key) AS place",
    ).filter(F.col("place") < HEADS)
    takers = own.select("conv_id", "skipped").distinct().withColumn("taken", F.expr("conv_id - conv_id % 100"))
    heads = takers.join(first, (F.col("taken") == F.col("base")) & (F.col("place") <= F.col("skipped")))
    heads = heads.select("conv_id", F.lit(True).alias("head"), "turn", "turn_key", "n_chars", "skipped")
    return own.unionByName(heads)


def prefix_nodes(rows: DataFrame, trie_digests: int = TRIE_DIGESTS) -> DataFrame:
    """One row per distinct beginning of the conversations in ``rows`` (of ``turns`` or ``rebuilt``).

    A node is named by its smallest member ``conv_id`` and its ``depth``; ``parent_conv_id`` names its
    parent (null for the root). ``n_convs`` counts its members, ``n_children`` and ``n_leaves`` the nodes
    below; ``saved_tokens`` is the text (code points) that members need not repeat in its subtree, and
    ``ends_sha256`` digests the sorted ids of the members that end there. Turns go by number, nulls
    first, equal ones by digest; repeated turns stay apart. A conversation without turns ends at the
    root; without conversations there is no node. Other columns are not read.
    """
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), "turn", "turn_key")
    built = bounded_batches(dealt).mapInArrow(partial(_build, limit=trie_digests), _schema(_UNITS))
    built = materialise(built, "tries")
    units = built.filter("trie IS NOT NULL")
    nodes = units.groupBy("key").agg(
        F.sum("n").alias("n_convs"),
        F.min("least").alias("owner"),
        F.sum("total").alias("all_text"),
        (~F.bool_or("inner")).cast("long").alias("leaf"),
    )
    known = units.join(nodes.withColumnRenamed("key", "node"), F.col("key") == F.col("node")).drop("node")
    whole = known.repartition("trie").sortWithinPartitions("trie", "number")
    shares = bounded_batches(whole).mapInArrow(_share, _schema(_SHARES))
    summed = shares.groupBy("key").agg(
        *(F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "total")),
        *(F.sum(c).alias(c) for c in ("children", "leaves", "once")),
    )
    ends = built.filter("trie IS NULL").select("key", "least").repartition("key").sortWithinPartitions("key", "least")
    digests = bounded_batches(ends).mapInArrow(_digest, "ends_key binary, ends_sha256 string")
    joined = summed.join(digests, F.col("key") == F.col("ends_key"), "left")
    return joined.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
