"""Exact deduplication by compressed radix tries whose terminal nodes own their copies.

Every task that reads documents keeps a Patricia trie of the normalised texts it has met. A
terminal node stands for one text and holds its owner, the best row so far, and a count. Only
terminals travel, to partitions by length and content hash, where a second trie over whole byte
strings joins the terminals of equal texts. A row refers to the terminal of its own task, so a
group of any size is never brought together: it meets as one terminal of each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.llm.arrays import bounded_batches
from callsieve.session import materialise

#: Characters that do not count: ``[\x20\x09-\x0D]``.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes that a task's trie may hold before it spills its heaviest subtree, and those of a node beside
#: its edge (measured: node, table of children, owner).
TRIE_BYTES = 48 << 20
NODE_BYTES = 450
#: Bytes of a batch here: texts are taken one by one, and whole texts come back as well.
BATCH_BYTES = "2m"


class Node:
    __slots__ = ("children", "edge", "owner")

    def __init__(self, edge: bytes, owner=None):
        self.edge, self.owner, self.children = edge, owner, {}


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, found by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class Trie:
    """Patricia trie over byte strings. ``size`` counts the bytes of its nodes and edges."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def terminal(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if there is none."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(key) - at + NODE_BYTES
                return child
            if not key.startswith(child.edge, at):
                common = shared_prefix(child.edge, key[at : at + len(child.edge)])
                upper = Node(child.edge[:common])
                self.size += NODE_BYTES
                child.edge = child.edge[common:]
                upper.children[child.edge[0]] = child
                node.children[key[at]] = child = upper
            node, at = child, at + len(child.edge)
        return node

    def spill(self) -> Iterator[tuple[bytes, Node]]:
        """Take out the heaviest subtree below the root, terminal by terminal, and forget it."""
        weights = {first: subtree_bytes(child) for first, child in self.root.children.items()}
        heaviest = max(weights, key=weights.get)
        self.size -= weights[heaviest]
        yield from terminals(self.root.children.pop(heaviest), b"")

    def drain(self) -> Iterator[tuple[bytes, Node]]:
        yield from terminals(self.root, b"")
        self.root, self.size = Node(b""), 0


def subtree_bytes(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        node = stack.pop()
        total += len(node.edge) + NODE_BYTES
        stack.extend(node.children.values())
    return total


def terminals(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        key = prefix + node.edge
        if node.owner is not None:
            yield key, node
        stack.extend((child, key) for child in node.children.values())


def better(a: tuple, b: tuple) -> tuple:
    """Of two rows (code points, id), the longer, then the one with the smaller id; null ids are last."""
    rank_a, rank_b = ((-x[0], x[1] is None, x[1] or 0) for x in (a, b))
    return a if rank_a <= rank_b else b


def _map_side(batches, limit: int):
    from pyspark import TaskContext

    task, made, trie = TaskContext.get().partitionId() << 36, 0, Trie()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("term", pa.int64()), ("n_bytes", pa.int64()), ("hash", pa.binary())]
        + [("norm", pa.binary()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("copies", pa.int64())]
    )

    def closed(found):
        """Rows of terminals that have left the trie, a few at a time."""
        rows, size = [], 0
        for key, node in found:
            term, best, copies = node.owner
            rows.append((None, term, len(key), hashlib.sha256(key).digest(), key, best[0], best[1], copies))
            size += len(key)
            if size > 1 << 20:
                yield pack(rows)
                rows, size = [], 0
        if rows:
            yield pack(rows)

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        members = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            node = trie.terminal(text.encode().translate(None, SPACES))
            row = (len(text), doc_id)
            if node.owner is None:
                node.owner = [task + made, row, 0]
                made += 1
            node.owner[1] = better(node.owner[1], row)
            node.owner[2] += 1
            members.append((doc_id, node.owner[0]))
            if trie.size > limit:
                yield from closed(trie.spill())
        if members:
            yield pack([(d, t, None, None, None, None, None, None) for d, t in members])
    yield from closed(trie.drain())


def _reduce_side(batches):
    """Join terminals of equal texts. Input is sorted by length and hash, so one such bucket is
    in the trie at a time; its rows leave when the next bucket begins."""
    schema = pa.schema(
        [("term", pa.int64()), ("class", pa.int64()), ("best_chars", pa.int64()), ("best_id", pa.int64())]
        + [("copies", pa.int64()), ("sha", pa.binary())]
    )
    bucket, trie = None, Trie()
    for batch in batches:
        rows = []
        for term, n_bytes, digest, norm, chars, doc_id, copies, sha in zip(
            *(batch.column(i).to_pylist() for i in range(batch.num_columns))
        ):
            if (n_bytes, digest) != bucket:
                bucket, trie = (n_bytes, digest), Trie()
            node = trie.terminal(norm)
            if node.owner is None:
                node.owner = term
            rows.append((term, node.owner, chars, doc_id, copies, sha))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 32, trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each row of ``docs``.

    Texts are equal when they are the same without spaces and line breaks; null counts as empty.
    The row with the most characters stays, then the one with the smallest id; null ids come
    last. Rows with equal ids are separate rows of the group, and all of them are ``kept`` if
    their id is. Other columns are not read. ``hash_bytes`` shortens the hash by which texts are
    dealt out; a trie compares whole texts, so even one byte gives the same groups.
    """
    rows = bounded_batches(docs, BATCH_BYTES).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    mapped = rows.mapInArrow(
        partial(_map_side, limit=trie_bytes),
        "doc_id long, term long, n_bytes long, hash binary, norm binary, best_chars long, best_id long, copies long",
    )
    stored = materialise(mapped, "exact")
    members = stored.filter("n_bytes IS NULL").select("doc_id", "term")
    keyed = stored.filter("n_bytes IS NOT NULL").select(
        "term", "n_bytes", F.col("hash").substr(1, hash_bytes).alias("hash"), "norm", "best_chars", "best_id", "copies",
        F.col("hash").alias("sha"),
    )
    joined = (
        keyed.repartition("n_bytes", "hash")
        .sortWithinPartitions("n_bytes", "hash")
        .mapInArrow(_reduce_side, "term long, class long, best_chars long, best_id long, copies long, sha binary")
    )
    terms = materialise(joined, "exact-terms")
    bounded_batches(docs)
    classes = terms.groupBy("class").agg(
        F.min(F.struct((-F.col("best_chars")).alias("r"), F.col("best_id").isNull().alias("n"), "best_id")).alias("b"),
        F.sum("copies").alias("group_size"),
    )
    kept = (
        terms.select("term", "class", "sha")
        .join(classes.select("class", "b.best_id", "group_size"), "class")
        .select("term", F.col("best_id").alias("keep_id"), "group_size", F.lower(F.hex("sha")).alias("text_sha256"))
    )
    return members.join(kept, "term").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
