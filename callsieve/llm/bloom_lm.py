"""Language-model scores from a log-frequency Bloom filter.

Words and word pairs of the training rows are counted over the whole corpus and go into Bloom
filters with their counts quantised on a log scale: an n-gram of level q is inserted q times, with
1 to q beside it, and its level is read back by probing until the first miss. Those that make up at
least a fixed share of all tokens are in one filter, which the share bounds and which is broadcast.
Its least count grows with the corpus, so what it seems to hold at a low level is confirmed by the
hashes that are there; a false hit at a higher level needs as many false levels in a row. In a shard's
filter a false hit is a count of 1.
All others are in filters of shards of hashes, in the shared folder. Texts are scored in groups: a
group's distinct n-grams that the broadcast filter lacks are sent to their shards, and what these
answer comes back to the group.

Exact counts are needed for the add-one base score. The most frequent words, as many as a bound
allows, are broadcast with their counts; the others are joined.
"""

from __future__ import annotations

import math
import pickle
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.llm.arrays import NOT_SPACE, bounded_batches, chunks, find_words, mix
from callsieve.session import materialise

#: An n-gram is broadcast from this share of all training tokens on. At most 2 ** 22 words and as
#: many pairs can reach it.
SHARE = 2.0**-22
#: Base of the count levels, probes of a level, and bits for each insertion.
BASE, PROBES, BITS = math.sqrt(2), 6, 10
#: Levels up to which hits of the broadcast filter are confirmed.
CONFIRMED = 5
#: Weight of the pair's own probability where its first word is kept.
PAIR_WEIGHT = 0.3
#: Words whose exact counts are broadcast.
EXACT_WORDS = 1 << 20
#: Distinct n-grams that a task holds before it sends them off.
HELD = 4_000_000

END = np.uint64(0x9D8A3C5EF1B20467)
NONE = np.zeros(0, np.uint64)


def tokens(column: pa.Array):
    """Token hashes of chunks of texts, each text closed by its end: first and end text of the
    chunk, the tokens, and the bounds of each text's tokens."""
    for first, end, data, offsets in chunks(column):
        words = find_words(data, offsets, NOT_SPACE)
        bounds = words.bounds + np.arange(len(words.bounds))
        out = np.empty(bounds[-1], np.uint64)
        ends = np.zeros(bounds[-1], bool)
        ends[bounds[1:] - 1] = True
        out[ends], out[~ends] = END, words.hashes()
        yield first, end, out, bounds


def before(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each one; the end stands before a text's first token."""
    out = np.concatenate(([END], hashes[:-1]))
    out[bounds[:-1]] = END
    return out


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(second))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes; sorting takes a small part of the time of ``np.unique``, which hashes."""
    hashes = np.sort(hashes)
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))] if len(hashes) else hashes


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the number of each hash among them."""
    ranks = np.argsort(hashes)
    ordered = hashes[ranks]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(hashes) else np.zeros(0, bool)
    numbers = np.empty(len(hashes), np.int64)
    numbers[ranks] = np.cumsum(new) - 1
    return ordered[new], numbers


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of counted parts and their counts."""
    hashes, counts = np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts])
    ranks = np.argsort(hashes)
    hashes, counts = hashes[ranks], counts[ranks]
    new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return hashes[new], np.add.reduceat(counts, new) if len(new) else counts


_PART = pa.schema([("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _cut(hashes: np.ndarray, counts: np.ndarray, shards: int):
    """A row for each shard; shards are ranges of hashes."""
    step = 2**64 // shards + 1
    at = np.searchsorted(hashes, np.arange(shards, dtype=np.uint64) * np.uint64(step))
    at = np.concatenate((at, [len(hashes)]))
    rows = [k for k in range(shards) if at[k + 1] > at[k]]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(rows, pa.int32()),
            pa.array([hashes[at[k] : at[k + 1]].tobytes() for k in rows], pa.binary()),
            pa.array([counts[at[k] : at[k + 1]].astype(np.int64).tobytes() for k in rows], pa.binary()),
        ],
        schema=_PART,
    )


def _count(batches, shards: int, pairs: bool):
    """Counts of words or of pairs, for each shard."""
    parts, held = [], 0
    for batch in batches:
        for _, _, hashes, bounds in tokens(batch.column("text")):
            if pairs:
                hashes = pair_hashes(before(hashes, bounds), hashes)
            parts.append(np.unique(hashes, return_counts=True))
            held += len(parts[-1][0])
            if held > HELD:
                parts = [merge(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield from _cut(*parts[0], shards)
                    parts, held = [], 0
    if parts:
        yield from _cut(*merge(parts), shards)


def _shards(batches):
    """Counts of one shard after the other, of rows sorted by shard."""
    current, parts = None, []
    for batch in batches:
        for shard, hashes, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if shard != current and parts:
                yield current, *merge(parts)
                parts = []
            current = shard
            parts.append((np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int64)))
            if len(parts) > 64:
                parts = [merge(parts)]
    if parts:
        yield current, *merge(parts)


def _merge_words(batches):
    for shard, hashes, counts in _shards(batches):
        sizes = np.bincount(np.frexp(counts)[1], minlength=65)
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "types": pa.array([len(hashes)], pa.int64()),
                "tokens": pa.array([int(counts.sum())], pa.int64()),
                "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
                "hashes": pa.array([hashes.tobytes()], pa.binary()),
                "counts": pa.array([counts.tobytes()], pa.binary()),
            }
        )


_FILTERS = "shard int, hashes binary, counts binary, filter binary"


def _filter_row(shard: int, hashes: np.ndarray, counts: np.ndarray, least: int) -> pa.RecordBatch:
    """A shard's n-grams from ``least`` on, and the filter of its others."""
    good = counts >= least
    bloom = LogBloom(hashes[~good], counts[~good], 1)
    columns = [[shard], [hashes[good].tobytes()], [counts[good].tobytes()], [pickle.dumps(bloom)]]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "hashes", "counts", "filter"]
    )


def _pair_filters(batches, least: int, shards: int):
    """Filters of pairs are numbered after those of words."""
    for shard, hashes, counts in _shards(batches):
        yield _filter_row(shards + shard, hashes, counts, least)


def _word_filters(batches, least: int):
    for batch in batches:
        for shard, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "hashes", "counts"))):
            yield _filter_row(shard, np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int64), least)


def _word_rows(batches, least: int, below: int | None):
    """Rows of words with counts from ``least`` to below ``below``."""
    for batch in batches:
        for hashes, counts in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist()):
            hashes, counts = np.frombuffer(hashes, np.int64), np.frombuffer(counts, np.int64)
            good = counts >= least if below is None else (counts >= least) & (counts < below)
            yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes[good]), "n": pa.array(counts[good])})


class LogBloom:
    """Bloom filter of n-grams with quantised counts of at least ``least``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, least: int, confirmed: bool = False):
        self.least = least
        levels = 1 + np.floor(np.log(counts / least) / math.log(BASE) + 1e-9).astype(np.int64)
        self.top = int(levels.max(initial=0))
        self.bits = max(64, int(levels.sum()) * BITS)
        table = np.zeros(self.bits, bool)
        for level in range(1, self.top + 1):
            steps = self._steps(hashes[levels >= level], level)
            for probe in range(PROBES):
                table[self._place(*steps, probe)] = True
        self.table = np.packbits(table, bitorder="little")
        #: Hashes of low levels, to confirm hits by; only where they are told apart from counts of 1.
        self.low = np.sort(hashes[levels <= CONFIRMED]) if confirmed else None

    def _steps(self, hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First place and step of each n-gram's probes at a level, before they are cut to the table."""
        one = mix(hashes + np.uint64(level * 0xD6E8FEB86659FD93 % 2**64))
        return one, (one >> np.uint64(32)) | np.uint64(1)

    def _place(self, one: np.ndarray, two: np.ndarray, probe: int) -> np.ndarray:
        return ((one + np.uint64(probe) * two) % np.uint64(self.bits)).astype(np.int64)

    def _at(self, hashes: np.ndarray, level: int) -> np.ndarray:
        """Places of the n-grams whose probes all hit at a level."""
        live = np.arange(len(hashes))
        one, two = self._steps(hashes, level)
        for probe in range(PROBES):
            at = self._place(one, two, probe)
            hit = np.flatnonzero((self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            live, one, two = live[hit], one[hit], two[hit]
        return live

    def _raw(self, hashes: np.ndarray, top: int) -> np.ndarray:
        levels, live = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        for level in range(1, top + 1):
            live = live[self._at(hashes[live], level)]
            if not len(live):
                break
            levels[live] = level
        return levels

    def _confirmed(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.low):
            return np.zeros(len(hashes), bool)
        return self.low[np.minimum(np.searchsorted(self.low, hashes), len(self.low) - 1)] == hashes

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        levels = self._raw(hashes, self.top)
        if self.low is not None:
            near = np.flatnonzero((levels > 0) & (levels <= CONFIRMED))
            levels[near[~self._confirmed(hashes[near])]] = 0
        return levels

    def lacks(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the level is 0; higher levels are only probed where they decide."""
        out = np.ones(len(hashes), bool)
        if self.top:
            hits = self._at(hashes, 1)
            if self.low is not None:
                sure = self._confirmed(hashes[hits])
                doubtful = hits[~sure]
                high = doubtful[self._raw(hashes[doubtful], min(self.top, CONFIRMED + 1)) > CONFIRMED]
                hits = np.concatenate((hits[sure], high))
            out[hits] = False
        return out

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Estimated counts, 0 for n-grams that are not in the filter."""
        return count_of(self.levels(hashes), self.least)


def count_of(levels: np.ndarray, least: int) -> np.ndarray:
    """The least of the counts that share a level, so that sums of them are never above what was counted."""
    return np.where(levels > 0, np.ceil(least * BASE ** (levels - 1) * (1 - 1e-9)), 0.0)


def greatest(counts: np.ndarray) -> np.ndarray:
    """The greatest count that may share a level with the least one, which is given."""
    return np.where(counts > 0, np.ceil((counts + 0.0) * BASE * (1 - 1e-9)) - 1, 0.0)


class Model:
    """What a task needs to score: the broadcast filter, the exact frequent counts, and totals."""

    def __init__(self, bloom, words, counts, exact_from, total, types, rare_tokens=0, rare_types=0):
        self.bloom, self.words, self.counts, self.exact_from = bloom, words, counts, exact_from
        self.total, self.types = total, types
        #: Mean count of words that are in no filter, one unseen word included.
        self.rare = rare_tokens / (rare_types + 1)

    def exact(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words have exact counts here, and these."""
        if not len(self.words):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return self.words[at] == hashes, self.counts[at].astype(np.float64)

    def score(self, hashes: np.ndarray, bounds: np.ndarray, answer=None) -> np.ndarray:
        """Log10 probability of each token after the one before it. ``answer`` gives the counts of
        sorted distinct words, the end included, and pairs that the broadcast filter lacks."""
        previous = before(hashes, bounds)
        # The tokens before are the tokens themselves, one place on, or the end.
        words, places = numbered(np.append(hashes, END))
        pairs, pair_places = numbered(pair_hashes(previous, hashes))
        counts, pair_counts = self.bloom.counts(words), self.bloom.counts(pairs)
        if answer is not None:
            lacking = counts == 0, pair_counts == 0
            found = answer(int(lacking[0].sum()), int(lacking[1].sum()))
            counts[lacking[0]], pair_counts[lacking[1]] = found
        exact, of = self.exact(words)
        least, most = np.where(exact, of, counts), np.where(exact, of, greatest(counts))
        back = np.concatenate((places[-1:], places[:-2]))
        back[bounds[:-1]] = places[-1]
        word, history, pair = least[places[:-1]], most[back], pair_counts[pair_places]
        even = self.total + self.types + 1
        # Words and pairs are read as the least count of their level and histories as the greatest,
        # or exactly where that is known: followers of a history never share out more than its count.
        alone = np.minimum((np.where(word > 0, word, self.rare) + 1) / even, 1.0)
        after = np.minimum(pair, history) / np.maximum(history, 1)
        weight = np.where(history > 0, PAIR_WEIGHT, 0.0)
        return np.log10(weight * after + (1 - weight) * alone)


_GROUPED = "group long, row long, doc_id long, held_out boolean, text string"


def _groups(batches):
    """Each batch is a group, named by its first row."""
    for batch in batches:
        if batch.num_rows:
            group = pa.array(np.full(batch.num_rows, batch.column("row")[0].as_py(), np.int64))
            columns = {c: batch.column(c) for c in ("row", "doc_id", "held_out", "text")}
            yield pa.RecordBatch.from_pydict({"group": group} | columns)


def _whole(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and text bounds of all parts of a group."""
    sizes = np.cumsum([0, *(len(hashes) for _, _, hashes, _ in parts)])
    bounds = [bounds[1:] + size for (_, _, _, bounds), size in zip(parts, sizes)]
    return np.concatenate([NONE, *(h for _, _, h, _ in parts)]), np.concatenate([np.zeros(1, np.int64), *bounds])


def _ask(batches, model, shards: int):
    """For each shard, what a group asks of it."""
    for batch in _groups(batches):
        hashes, bounds = _whole(list(tokens(batch.column("text"))))
        ngrams = distinct(np.append(hashes, END)), distinct(pair_hashes(before(hashes, bounds), hashes))
        for first, known in zip((0, shards), ngrams):
            asked = known[model.value.bloom.lacks(known)]
            for cut in _cut(asked, asked.view(np.int64), shards):
                if cut.num_rows:
                    shard = pa.array(cut.column("shard").to_numpy() + np.int32(first), pa.int32())
                    group = pa.array([batch.column("group")[0].as_py()] * cut.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([shard, group, cut.column("hashes")], ["shard", "group", "hashes"])


def _answer(batches):
    """Levels of what groups ask of shards, in turn; a shard's filter comes before what is asked of
    it. Shards without n-grams have no filter."""
    current, bloom = None, None
    for batch in batches:
        for shard, group, hashes, pickled in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if pickled is not None:
                current, bloom = shard, pickle.loads(pickled)
                continue
            hashes = np.frombuffer(hashes, np.uint64)
            levels = bloom.levels(hashes) if shard == current else np.zeros(len(hashes), np.int64)
            columns = [[shard], [group], [levels.astype(np.uint8).tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "group", "levels"])


def _score_groups(batches, model):
    """Scores of groups; rows are sorted by group and shard, and texts have no shard."""
    current, levels, texts = None, [], []

    def close():
        # A group is one batch of texts, so its tokens are few enough to hold.
        hashes, bounds = _whole([part for text in texts for part in tokens(text.column("text"))])
        found = count_of(np.frombuffer(b"".join(levels), np.uint8).astype(np.int64), 1)

        def answer(words: int, pairs: int) -> list[np.ndarray]:
            if len(found) != words + pairs:
                raise ValueError("rows differ from those that were asked for; store the input first")
            # Shards are ranges of hashes, first of words and then of pairs.
            return np.split(found, [words])

        yield _scored(pa.Table.from_batches(texts), hashes, bounds, model.value, answer)

    for batch in batches:
        groups = batch.column("group").to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]))
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if end == start:
                continue
            if groups[start] != current:
                if current is not None:
                    yield from close()
                current, levels, texts = groups[start], [], []
            some = batch.slice(start, end - start)
            levels += some.column("levels").drop_null().to_pylist()
            own = some.filter(some.column("levels").is_null())
            if own.num_rows:
                texts.append(own)
    if current is not None:
        yield from close()


def _scored(texts: pa.Table, hashes: np.ndarray, bounds: np.ndarray, own: Model, answer) -> pa.RecordBatch:
    """A row for each text of a group; words without an exact count here are listed with their numbers."""
    known, count = own.exact(hashes)
    base = np.where(known, np.log10(count + 1.0), 0.0)
    sizes = np.diff(bounds)
    owners = np.repeat(np.arange(len(sizes)), sizes)[~known]
    ranks = np.lexsort((hashes[~known], owners))
    owners, rest = owners[ranks], hashes[~known][ranks].view(np.int64)
    new = np.flatnonzero(
        np.concatenate(([True], (rest[1:] != rest[:-1]) | (owners[1:] != owners[:-1]))) if len(rest) else []
    )
    times = np.diff(np.append(new, len(rest)))
    lists = pa.array(np.searchsorted(owners[new], np.arange(len(sizes) + 1)), pa.int32())
    sums = np.add.reduceat(own.score(hashes, bounds, answer), bounds[:-1])
    base_sums = np.add.reduceat(base, bounds[:-1]) - sizes * math.log10(own.total + own.types + 1)
    columns = {c: texts.column(c).combine_chunks() for c in ("row", "doc_id", "held_out")} | {
        "n_tokens": pa.array(sizes, pa.int64()),
        "n_known": pa.array(np.add.reduceat(known.astype(np.int64), bounds[:-1])),
        "base": pa.array(base_sums),
        "score": pa.array(sums),
        "rare": pa.ListArray.from_arrays(lists, pa.array(rest[new], pa.int64())),
        "rare_n": pa.ListArray.from_arrays(lists, pa.array(times, pa.int64())),
    }
    return pa.RecordBatch.from_pydict(columns)


def _counted(rows: DataFrame, shards: int, pairs: bool) -> DataFrame:
    parts = rows.mapInArrow(partial(_count, shards=shards, pairs=pairs), "shard int, hashes binary, counts binary")
    return parts.repartition(shards, "shard").sortWithinPartitions("shard")


def _table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts; the caller has bounded the rows."""
    found = rows.toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    ranks = np.argsort(hashes)
    return hashes[ranks], found.column("n").to_numpy()[ranks]


def _frequent(filters: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that go into the broadcast filter; the share bounds them."""
    found = filters.select("hashes", "counts").toArrow()
    hashes, counts = (b"".join(found.column(c).to_pylist()) for c in ("hashes", "counts"))
    return np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int64)


def train(rows: DataFrame, share: float = SHARE, exact_words: int = EXACT_WORDS):
    """The model of ``rows`` (``text``), the filters of the n-grams and the words whose exact counts
    it does not hold, and the number of shards."""
    spark = rows.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    words = materialise(
        _counted(rows, shards, False).mapInArrow(
            _merge_words, "shard int, types long, tokens long, sizes array<long>, hashes binary, counts binary"
        ),
        "words",
    )
    types, total = words.agg(F.sum("types"), F.sum("tokens")).first()
    types, total = types or 0, total or 0
    sizes = dict(words.select(F.posexplode("sizes")).groupBy("pos").agg(F.sum("col")).collect())
    # The least power of two from which on there are few enough words to broadcast.
    power = 64
    while power > 0 and sum(sizes.get(p, 0) for p in range(power, 65)) <= exact_words:
        power -= 1
    exact_from = 2**power
    least = max(1, math.ceil(total * share))
    numbers = "hash long, n long"
    exact = _table(words.mapInArrow(partial(_word_rows, least=exact_from, below=None), numbers))
    of_words = words.mapInArrow(partial(_word_filters, least=least), _FILTERS)
    of_pairs = _counted(rows, shards, True).mapInArrow(partial(_pair_filters, least=least, shards=shards), _FILTERS)
    filters = materialise(of_words.unionByName(of_pairs), "filters")
    model = Model(LogBloom(*_frequent(filters), least, confirmed=least > 1), *exact, exact_from, total, types)
    rest = words.mapInArrow(partial(_word_rows, least=1, below=exact_from), numbers)
    return model, filters.select("shard", "filter"), rest, shards


def score(
    docs: DataFrame,
    held_out: F.Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = SHARE,
    exact_words: int = EXACT_WORDS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Tokens are runs of anything but spaces and line breaks, A-Z as small letters, and one end for
    each text; null texts are empty and so are the end alone. Rows for which ``held_out`` holds
    (null: does not) are scored but not learned from. ``base_score`` adds log10 of add-one
    probabilities of single tokens with exact counts; ``score`` is the model's. Without training
    rows every token is unknown. Ids may be null or repeated: each row is scored by itself.
    Other columns are not read.
    """
    rows = bounded_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    model, filters, rest, shards = train(rows.filter("NOT held_out").select("text"), share, exact_words)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text")
    requests = numbered.mapInArrow(partial(_ask, model=sent, shards=shards), "shard int, group long, hashes binary")
    nothing = F.lit(None).cast("binary")
    sources = filters.select("shard", F.lit(None).cast("long").alias("group"), nothing.alias("hashes"), "filter")
    answers = (
        sources.unionByName(requests.withColumn("filter", nothing))
        .repartition(2 * shards, "shard")
        .sortWithinPartitions("shard", "group")
        .mapInArrow(_answer, "shard int, group long, levels binary")
    )
    texts = numbered.mapInArrow(_groups, _GROUPED)
    scored = materialise(
        answers.unionByName(texts, allowMissingColumns=True)
        .repartition(shards, "group")
        .sortWithinPartitions("group", F.col("shard").asc_nulls_last())
        .mapInArrow(
            partial(_score_groups, model=sent),
            "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double,"
            " rare array<long>, rare_n array<long>",
        ),
        "scored",
    )
    asked = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
    found = (
        asked.select("row", F.col("r.rare").alias("hash"), F.col("r.rare_n").alias("times"))
        .join(rest, "hash")
        .groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_base"))
    )
    return scored.drop("rare", "rare_n").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
