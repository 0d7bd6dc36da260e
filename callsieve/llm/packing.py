"""Best-fit packing of token sequences, from the leaves of a tree to its root.

A task tokenises its documents, cuts what is longer than a sequence, and packs the pieces best
fit, the longest first. Bins that are full, or nearly so, leave at once. The others are items of
the next round, in which an eighth of the tasks packs them again, and so on. A bin holds one
piece or more of at least one token, so no row is longer than a sequence.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.llm.arrays import bounded_batches, ranges, text_bytes
from callsieve.session import materialise

CAPACITY = 2048
#: Free tokens with which a bin counts as nearly full.
SPARE = 4
#: Tasks whose bins meet in one task of the next round, and bins that a task packs in the last round.
FAN_IN = 8
LAST_BINS = 20_000
#: Words whose tokens a worker remembers, at some 150 bytes each.
REMEMBERED = 600_000
#: Bytes of text that are tokenised at once.
CHUNK = 1 << 20
END_ID = 0

#: A run of letters that have one lower-case form and no composition, then ASCII signs other than
#: the apostrophe: such a word splits into these two parts under the tokenizer's pattern.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

MEMBER = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>"
BIN = f"total int, members array<{MEMBER}>"
_MEMBER = pa.struct(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
    + [("ids_crc32", pa.int64()), ("offset", pa.int64())]
)
_BIN = pa.schema([("total", pa.int32()), ("members", pa.list_(_MEMBER))])


class Words:
    """Token ids by word. White space parts words before anything else, so equal words between
    ASCII spaces have equal tokens wherever they stand."""

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.starts, self.lengths, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.met, self.used = np.zeros(1024, bool), 0
        self.put([b" "], np.array([END_ID]), np.array([1]))  # stands for the end of a document

    def forget(self) -> None:
        """Makes room: only words that were met again stay, if they are no more than half."""
        met = self.met[: len(self.numbers)].copy()
        met[0] = False  # the end of a document, which is put anew
        kept = np.flatnonzero(met)
        words = [word for word, again in zip(self.numbers, met.tolist()) if again]
        lengths, ids = self.lengths[kept], self.ids[ranges(self.starts[kept], self.lengths[kept])]
        self.clear()
        if len(words) <= REMEMBERED // 2:
            self.put(words, ids, lengths)

    def put(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, end = len(self.numbers), len(self.numbers) + len(words)
        for name, need in (("starts", end), ("lengths", end), ("met", end), ("ids", self.used + len(ids))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate((held, np.zeros(max(need - len(held), len(held) // 2), held.dtype))))
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[first:end] = lengths
        self.met[first:end] = False
        self.starts[first:end] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.numbers.update(zip(words, range(first, end)))

    def drop(self, count: int) -> None:
        """Forgets the words that were put last."""
        for _ in range(count):
            self.numbers.popitem()
        if count:
            self.used = int(self.starts[len(self.numbers)])

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        """Tokens of new words; letters are tokenised many at a time, and parted where words end."""
        letters: dict[str, int] = {}
        signs: dict[str, int] = {"": 0}
        others: list[str] = []
        heads, tails = [], []
        for word in words:
            text = word.decode()
            match = PLAIN(text) if len(word) <= 64 else None
            if match:
                heads.append(letters.setdefault(match[1].lower(), len(letters)))
                tails.append(signs.setdefault(match[2], len(signs)))
            else:
                others.append(text)
                heads.append(-len(others))
                tails.append(0)
        pool, sizes = [], []
        names = list(letters)
        for at in range(0, len(names), 2000):
            some = names[at : at + 2000]
            ids = self._encode(" ".join(some))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                pool.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                pool += (each := [self._encode(x) for x in some])
                sizes.append(np.array([len(x) for x in each]))
        pool += (each := [self._encode(x) for x in (*signs, *others)])
        sizes.append(np.array([len(x) for x in each]))
        ids, sizes = np.concatenate(pool), np.concatenate(sizes)
        # A word is its letters and its signs, or the whole of another word and no signs.
        heads = np.array(heads, np.int64)
        heads[heads < 0] = len(letters) + len(signs) - 1 - heads[heads < 0]
        parts = np.column_stack((heads, len(letters) + np.array(tails, np.int64))).ravel()
        starts = np.cumsum(sizes) - sizes
        self.put(words, ids[ranges(starts[parts], sizes[parts])], sizes[parts].reshape(-1, 2).sum(axis=1))

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and where each text's ids start."""
        words, counts = [], []
        for text in texts:
            own = text.split()
            words += own
            words.append(b" ")
            counts.append(len(own) + 1)
        new = set(words).difference(self.numbers)
        if len(self.numbers) + len(new) > REMEMBERED:
            self.forget()
            new = set(words).difference(self.numbers)
        known = len(self.numbers)
        if new:
            self.learn(list(new))
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[numbers]
        ids = self.ids[ranges(self.starts[numbers], lengths)]
        self.met[numbers[numbers < known]] = True
        self.drop(max(0, len(self.numbers) - REMEMBERED))
        total = np.concatenate(([0], np.cumsum(lengths)))
        return ids, total[np.concatenate(([0], np.cumsum(counts)))]


#: Of the tokenizer used last, by a hash of its file.
_WORDS: dict[str, Words] = {}


def best_fit(items: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Best fit, the longest first. Items are (tokens, members); members move behind those that
    are in the bin before. Free rooms are bits of one number, so a room is found at once."""
    bins: list[tuple[int, list]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for size, members in sorted(items, key=lambda x: -x[0]):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            total, held = bins[number]
            held.extend((*m[:5], m[5] + total) for m in members)
            bins[number] = (total + size, held)
        else:
            number, room = len(bins), capacity
            bins.append((size, list(members)))
        left = room - size
        if left:
            by_room[left].append(number)
            rooms |= 1 << left
    return bins


def _rows(bins, size: int = 2048):
    for at in range(0, len(bins), size):
        some = bins[at : at + size]
        totals = pa.array([t for t, _ in some], pa.int32())
        names = [f.name for f in _MEMBER]
        members = pa.array([[dict(zip(names, m)) for m in held] for _, held in some], _BIN.field(1).type)
        yield pa.RecordBatch.from_arrays([totals, members], schema=_BIN)


def _leaf(batches, model, key: str, capacity: int):
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(model.value)
    words, items = _WORDS[key], []
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        raw, doc_ids, at = data.tobytes(), batch.column("doc_id").to_pylist(), 0
        full = []
        while at < len(doc_ids):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            end = min(end, len(doc_ids))
            ids, bounds = words.tokens([raw[offsets[i] : offsets[i + 1]] for i in range(at, end)])
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            for doc_id, first, last in zip(doc_ids[at:end], bounds[:-1].tolist(), bounds[1:].tolist()):
                for piece, start in enumerate(range(first, last, capacity)):
                    size = min(capacity, last - start)
                    crc = zlib.crc32(view[4 * start : 4 * (start + size)])
                    made = (size, [(doc_id, piece, start - first, size, crc, 0)])
                    (full if size == capacity else items).append(made)
            at = end
        yield from _rows(full)
    yield from _rows(best_fit(items, capacity))
    # The worker goes on to other stages: what the texts took is given back.
    pa.default_memory_pool().release_unused()


def _merge(batches, capacity: int):
    items = []
    for batch in batches:
        for total, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            items.append((total, [tuple(m.values()) for m in members]))
    yield from _rows(best_fit(items, capacity))


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    spare: int = SPARE,
    fan_in: int = FAN_IN,
    last_bins: int = LAST_BINS,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row for each piece.

    A document is its token ids and one end id; null counts as empty and so is one end id. It is
    cut only if longer than ``capacity``. A null id or a repeated one does no harm: each row is a
    document of its own. Other columns are not read. An empty table gives no pieces.
    ``tokenizer`` is the path of a tokenizer file whose words end in ``</w>``, read on the driver.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    model, key = spark.sparkContext.broadcast(content), hashlib.sha256(content.encode()).hexdigest()
    rows = bounded_batches(docs, "2m").select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    leaves = rows.mapInArrow(partial(_leaf, model=model, key=key, capacity=capacity), BIN)
    bins = materialise(leaves, "bins")
    full = F.col("total") >= capacity - spare
    done, tasks = [], rows.rdd.getNumPartitions()
    while True:
        open_bins = bins.filter(~full)
        least = -(-open_bins.count() // last_bins)
        if tasks <= max(1, least):
            break
        done.append(bins.filter(full))
        tasks = max(1, least, tasks // fan_in)
        bins = materialise(open_bins.repartition(tasks).mapInArrow(partial(_merge, capacity=capacity), BIN), "bins")
    for part in done:
        bins = bins.unionByName(part)
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.select("sequence_id", F.explode("members").alias("m")).select(
        *(f"m.{c}" for c in ("doc_id", "piece", "start", "length", "ids_crc32")), "sequence_id", "m.offset"
    )
