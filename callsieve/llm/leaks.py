"""Benchmark decontamination by suffix arrays of the training documents.

Each task cuts its documents into shards and sorts a suffix array over each shard's words. Every
suffix of the benchmark is looked up in it by binary search: the neighbours of its place give its
longest verbatim match and where that is, and the range that shares its window gives all
occurrences of the window. Suffixes of the shard that begin with words of no benchmark item can
match nothing and are left out of the array. Nothing is shuffled.

Each document gets its longest match from the same search. The benchmark reaches the tasks in blocks of bounded size, each of which all shards look up.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsieve.llm.arrays import ALNUM, bounded_batches, chunks, coefficients, find_words, mix, ranges

WINDOW = 10
#: Text bytes of a shard, and of a batch: as many as the benchmark has, but no less and no more than these.
#: All suffixes of the benchmark are searched in every shard, so a large one is worth large shards.
LEAST_SHARD_BYTES, SHARD_BYTES = 2 << 20, 8 << 20
#: Text bytes of benchmark items that travel in one broadcast.
BLOCK_BYTES = 16 << 20
#: First words by which suffixes that match nothing are left out, unless an item is shorter.
LEAD = 4


class Items:
    """A block of benchmark items as numbers: words, suffixes, windows."""

    def __init__(self, rows: pa.Table, window: int, shortest: int):
        ids, hashes, counts = [str(i) if i is not None else "" for i in rows.column("item_id").to_pylist()], [], []
        for _, _, data, offsets in chunks(rows.column("text").combine_chunks()):
            words = find_words(data, offsets, ALNUM)
            hashes.append(words.hashes())
            counts.append(words.counts)
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.vocabulary = np.unique(hashes)
        # A last 0, at which every comparison ends, follows each item.
        size = counts.sum() + len(counts)
        self.words = np.zeros(size + LEAD, np.int32)
        bounds = np.concatenate(([0], np.cumsum(counts + 1)))
        places = ranges(bounds[:-1], counts)
        self.words[places] = np.searchsorted(self.vocabulary, hashes) + 1
        self.suffixes = places
        self.item_of = np.repeat(np.arange(len(counts)), counts)
        self.within = places - bounds[self.item_of]
        self.ids = ids
        self.left = counts[self.item_of] - self.within
        self.longest = int(counts.max(initial=0))
        self.lead = min(LEAD, window, shortest)
        self.array = suffix_array(self.words, self.suffixes, self.longest)
        # Places in ``suffixes`` of the sorted suffixes; equal ids are one item, ranked as strings.
        self.order = np.searchsorted(self.suffixes, self.array)
        self.names, rank = np.unique(np.array(ids, object), return_inverse=True) if ids else (np.zeros(0, object), self.item_of)
        self.rank_of = rank[self.item_of] if ids else self.item_of
        # Windows: every suffix that is long enough, and the whole of a shorter item; equal ones are neighbours.
        length = np.minimum(window, counts[self.item_of])[self.order]
        held = self.left[self.order] >= length
        starts, lengths, ranks = self.array[held], length[held], self.rank_of[self.order][held]
        same, _ = compare(self.words, starts[1:], self.words, starts[:-1], np.minimum(lengths[1:], lengths[:-1]))
        new = np.append(np.ones(min(len(starts), 1), bool), same < np.maximum(lengths[1:], lengths[:-1]))
        self.starts, self.lengths = starts[new], lengths[new]
        owned = np.unique(np.column_stack((np.cumsum(new) - 1, ranks)), axis=0).astype(np.int64)
        # Windows of the same items share one list.
        firsts = np.flatnonzero(np.diff(owned[:, 0], prepend=-1))
        sizes = np.diff(np.append(firsts, len(owned)))
        self.owners = [(name,) for name in self.names]
        self.owner_list = owned[firsts, 1].copy()
        lists: dict[bytes, int] = {}
        for i in np.flatnonzero(sizes > 1).tolist():
            members = owned[firsts[i] : firsts[i] + sizes[i], 1]
            at = lists.setdefault(members.tobytes(), len(self.owners))
            if at == len(self.owners):
                self.owners.append(tuple(self.names[members]))
            self.owner_list[i] = at
        # Suffixes with fewer words than a lead left match less than one.
        self.leads = np.unique(lead_hashes(self.words, self.suffixes[self.left >= self.lead], self.lead))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Words by number, 0 for those of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def lead_hashes(words: np.ndarray, places: np.ndarray, lead: int) -> np.ndarray:
    total = np.zeros(len(places), np.uint64)
    for k, factor in enumerate(coefficients(lead, seed=13)):
        total += words[places + k].astype(np.uint64) * factor
    return mix(total)


def suffix_array(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` sorted by the words that follow each, ``depth`` of them at most.

    ``words`` ends in zeros, and a zero ends every comparison. Each pass sorts by two words, and
    only what is still tied goes on to the next.
    """
    out = places.copy()
    tied = np.arange(len(places))  # where tied suffixes stand in ``out``
    group = np.zeros(len(places), np.int64)
    for at in range(0, depth, 2):
        if not len(tied):
            break
        suffixes = out[tied]
        first, second = words[np.minimum(suffixes + at, len(words) - 1)], words[np.minimum(suffixes + at + 1, len(words) - 1)]
        key = first.astype(np.int64) << 32 | np.where(first == 0, 0, second)
        ranks = np.lexsort((key, group))
        out[tied] = suffixes[ranks]
        key, group = key[ranks], group[ranks]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        number = np.cumsum(new) - 1
        sizes = np.bincount(number)
        # A suffix that has met a zero has ended; it ties with its like for good.
        more = (sizes[number] > 1) & (key & 0xFFFFFFFF > 0)
        tied, group = tied[more], number[more]
    return out


def compare(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, lengths: np.ndarray):
    """How many words agree from ``a[at]`` and ``b[bt]`` on, up to ``lengths``, and the sign of
    ``a`` against ``b`` at the first other word (0 if all agree)."""
    same = np.zeros(len(at), np.int64)
    sign = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    k = 0
    while len(live):
        live = live[lengths[live] > k]
        one, two = a[np.minimum(at[live] + k, len(a) - 1)], b[np.minimum(bt[live] + k, len(b) - 1)]
        equal = (one == two) & (one > 0)
        sign[live[~equal]] = np.sign(one[~equal].astype(np.int64) - two[~equal])
        live = live[equal]
        same[live] += 1
        k += 1
    return same, sign


def search(array: np.ndarray, words: np.ndarray, test: np.ndarray, starts: np.ndarray, lengths: np.ndarray, right: bool):
    """First place in the suffix array whose suffix is not before (or, ``right``: is after) the
    test words; all test suffixes are halved at once."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live]) // 2
        _, sign = compare(words, array[middle], test, starts[live], lengths[live])
        before = sign <= 0 if right else sign < 0
        low[live[before]] = middle[before] + 1
        high[live[~before]] = middle[~before]


class Shard:
    """Suffix array of some documents against a block of items."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, items: Items):
        counts = np.diff(bounds)
        self.bounds = np.concatenate(([0], np.cumsum(counts + 1)))
        self.words = np.zeros(self.bounds[-1] + LEAD, np.int32)
        self.words[ranges(self.bounds[:-1], counts)] = items.numbers(hashes)
        known = self.words > 0
        begins = known.copy()
        for k in range(1, items.lead):
            begins[:-k] &= known[k:]
            begins[-k:] = False
        places = np.flatnonzero(begins)
        if len(places):
            leads = lead_hashes(self.words, places, items.lead)
            at = np.minimum(np.searchsorted(items.leads, leads), len(items.leads) - 1)
            places = places[items.leads[at] == leads] if len(items.leads) else places[:0]
        self.array = suffix_array(self.words, places, max(items.longest, 1))
        self.items = items

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, "right") - 1

    def occurrences(self):
        """Places of windows in the shard: start, length, and the number of its list of items."""
        items = self.items
        if not len(self.array) or not len(items.starts):
            return (np.zeros(0, np.int64),) * 3
        low = search(self.array, self.words, items.words, items.starts, items.lengths, right=False)
        high = search(self.array, self.words, items.words, items.starts, items.lengths, right=True)
        n = high - low
        return self.array[ranges(low, n)], np.repeat(items.lengths, n), np.repeat(items.owner_list, n)

    def longest(self):
        """Longest match of every test suffix, and a place of it; length 0 if there is none. Then the
        same of every suffix of the array: its length, and the sorted test suffix it is with.

        Each test suffix is searched once. Its neighbours in the array are the best for it, and the
        test suffixes that come to stand next to a suffix of the array are the best for that.
        """
        items = self.items
        best, where = np.zeros(len(items.suffixes), np.int64), np.zeros(len(items.suffixes), np.int64)
        own, other = np.zeros(len(self.array), np.int64), np.zeros(len(self.array), np.int64)
        if not len(self.array):
            return best, where, own, other
        at = search(self.array, self.words, items.words, items.suffixes, items.left, right=False)
        for near in (at - 1, at):
            inside = (near >= 0) & (near < len(self.array))
            place = self.array[np.clip(near, 0, len(self.array) - 1)]
            same, _ = compare(self.words, place, items.words, items.suffixes, items.left)
            good = inside & (same > best)
            best[good], where[good] = same[good], place[good]
        after = np.searchsorted(at[items.order], np.arange(len(self.array)), "right")
        for near in (after - 1, after):
            inside = (near >= 0) & (near < len(items.array))
            near = np.clip(near, 0, len(items.array) - 1)
            same, _ = compare(self.words, self.array, items.words, items.array[near], items.left[items.order[near]])
            good = inside & (same > own)
            own[good], other[good] = same[good], near[good]
        return best, where, own, other

    def longest_of_documents(self):
        """Document, length, place and least item of each document's longest match, its first one."""
        items = self.items
        _, _, own, other = self.longest()
        some = np.flatnonzero(own >= items.lead)
        if not len(some):
            return (np.zeros(0, np.int64),) * 4
        places, lengths, tests = self.array[some], own[some], other[some]
        rows = self.document(places)
        ranks = np.lexsort((places, -lengths, rows))
        ranks = ranks[np.flatnonzero(np.diff(rows[ranks], prepend=-1))]
        rows, places, lengths, tests = rows[ranks], places[ranks], lengths[ranks], tests[ranks]
        # All test suffixes that begin with the match stand together.
        starts = items.array[tests]
        low = search(items.array, items.words, items.words, starts, lengths, right=False)
        high = search(items.array, items.words, items.words, starts, lengths, right=True)
        ends = np.column_stack((low, high)).ravel()
        least = np.minimum.reduceat(np.append(items.rank_of[items.order], len(items.names)), ends)[::2]
        return rows, lengths, places - self.bounds[rows], least


def _blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> tuple[list, int]:
    """The benchmark in broadcast blocks, and its text bytes."""
    rows = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    n_words = F.size(F.filter(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    size, shortest = rows.agg(F.sum(F.octet_length("text")), F.min(F.when(n_words > 0, n_words))).first()
    n = 1 + (size or 0) // block_bytes
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    send = items.sparkSession.sparkContext.broadcast
    # Only one block is on the driver at a time.
    return [send(Items(rows.filter(share == k).toArrow(), window, shortest or window)) for k in range(n)], size or 0


def _shard_bytes(size: int) -> int:
    return min(SHARD_BYTES, max(LEAST_SHARD_BYTES, size))


def _judge(batches, blocks, shard_bytes: int, place: int | None = None):
    for batch in batches:
        text = batch.column("text") if place is None else batch.column("row").field(place).cast(pa.string())
        for first, end, data, offsets in chunks(text, shard_bytes):
            words = find_words(data, offsets, ALNUM)
            hashes, counts = words.hashes(), words.counts
            bounds = np.concatenate(([0], np.cumsum(counts + 1)))
            edges = np.zeros(bounds[-1] + 1, np.int64)
            lists: list[set] = [set() for _ in counts]
            # Of each document: words of its longest match, less its place, item.
            longest: list[tuple] = [(0, 0, None)] * len(counts)
            for block in blocks:
                shard = Shard(hashes, words.bounds, block.value)
                starts, lengths, owners = shard.occurrences()
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + lengths, -1)
                for row, owner in set(zip(shard.document(starts).tolist(), owners.tolist())):
                    lists[row].update(block.value.owners[owner])
                for row, n, at, item in zip(*(x.tolist() for x in shard.longest_of_documents())):
                    match = (n, -at, block.value.names[item])
                    if match[:2] > longest[row][:2] or match[:2] == longest[row][:2] and match[2] < longest[row][2]:
                        longest[row] = match
            hit = np.cumsum(edges)[:-1] > 0
            n_hit = np.add.reduceat(hit.astype(np.int64), bounds[:-1]) if len(counts) else []
            found = [sorted(x) for x in lists]
            own = batch.slice(first, end - first)
            columns = {
                "doc_id": own.column("doc_id"),
                "n_words": pa.array(counts, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array([len(x) for x in found], pa.int64()),
                "items": pa.array(found, pa.list_(pa.string())),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]),
                "longest": pa.array([n for n, _, _ in longest], pa.int64()),
                "longest_at": pa.array([-at if n else None for n, at, _ in longest], pa.int64()),
                "longest_item": pa.array([item for _, _, item in longest], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns | {c: own.column(c) for c in ("row",) if c in own.schema.names})


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_bytes: int | None = None,
    block_bytes: int = BLOCK_BYTES,
    carry: bool = False,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, items_sha256, longest, longest_at, longest_item,
    contaminated`` for each row of ``docs``.

    Words are runs of digits, letters a-z (A-Z count as small) and non-ASCII characters. A window
    is ``window`` consecutive words of an item, or all words of a shorter one. A word of a
    document is hit if it lies in an occurrence of a window; ``items`` are the items with one,
    sorted as strings. Null texts have no words; items without words have no window; items of
    equal ids count as one, and a null item id as ''. ``longest`` is the number of words of the longest
    verbatim match with any item, ``longest_at`` the first word of its first place in the document and
    ``longest_item`` the least item that holds it; matches of fewer words than the least of four, the
    window and the shortest item count as none (0, null, null). Repeated rows are judged one by one. Other
    columns are not read, unless ``carry`` adds the whole row as a struct ``row``.
    """
    blocks, size = _blocks(items, item_col, item_text_col, window, block_bytes)
    shard_bytes = shard_bytes or _shard_bytes(size)
    rows = bounded_batches(docs, f"{_shard_bytes(size)}b").select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.struct("*").alias("row") if carry else F.col(text_col).cast("string").alias("text"),
    )
    out = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_hit", "long").add("n_items", "long")
    out = out.add("items", T.ArrayType(T.StringType())).add("items_sha256", "string")
    out = out.add("longest", "long").add("longest_at", "long").add("longest_item", "string")
    return rows.mapInArrow(
        partial(_judge, blocks=blocks, shard_bytes=shard_bytes, place=docs.columns.index(text_col) if carry else None),
        out.add("row", docs.schema) if carry else out,
    ).withColumn("contaminated", F.col("n_hit") > 0)


def _longest(batches, blocks, shard_bytes: int):
    for batch in batches:
        for first, _, data, offsets in chunks(batch.column("text"), shard_bytes):
            words = find_words(data, offsets, ALNUM)
            hashes = words.hashes()
            for block in blocks:
                items = block.value
                shard = Shard(hashes, words.bounds, items)
                best, where, _, _ = shard.longest()
                good = np.flatnonzero(best >= items.lead)
                rows = shard.document(where[good])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([items.ids[i] for i in items.item_of[good]], pa.string()),
                        pa.array(items.within[good], pa.int64()),
                        pa.array(best[good], pa.int64()),
                        batch.column("doc_id").take(pa.array(rows + first)),
                        pa.array(where[good] - shard.bounds[rows], pa.int64()),
                    ],
                    ["item_id", "item_at", "length", "doc_id", "doc_at"],
                )


def longest_matches(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``item_id, item_at, length, doc_id, doc_at``: the longest verbatim match of every benchmark
    suffix in ``docs`` (``doc_id, text``), in words, and one place of it. Suffixes that match
    fewer words than the least of four and the shortest window are left out."""
    blocks, size = _blocks(items, "item_id", "text", window, block_bytes)
    shard_bytes = shard_bytes or _shard_bytes(size)
    rows = bounded_batches(docs, f"{_shard_bytes(size)}b").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = rows.mapInArrow(
        partial(_longest, blocks=blocks, shard_bytes=shard_bytes),
        "item_id string, item_at long, length long, doc_id long, doc_at long",
    )
    best = found.groupBy("item_id", "item_at").agg(F.max(F.struct("length", "doc_id", "doc_at")).alias("m"))
    return best.select("item_id", "item_at", "m.length", "m.doc_id", "m.doc_at")


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: those without any hit word."""
    return contamination(docs, items, carry=True, **options).filter("NOT contaminated").select("row.*")
