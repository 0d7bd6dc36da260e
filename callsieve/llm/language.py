"""Language identification by unigram models summed over all segmentations.

Every language has a probability for each piece of one fixed public vocabulary. The probability
of a word is the sum, over all ways to cut it into pieces, of the products of their
probabilities; a forward pass finds it. Pieces do not cross white space, so a text's
log-probability is the sum of its words', and a word met before need not be segmented again.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsieve.llm.arrays import NOT_SPACE, bounded_batches, chunks, coefficients, find_words, ranges

#: Longest part of a word, in bytes, from which the model is fitted; words are scored whole.
RUN = 32
#: Labelled rows and words of each language from which the model is fitted.
SAMPLE_ROWS = 1500
SAMPLE_WORDS = 75_000
ROUNDS = 4
#: Share of a piece's probability that comes from all languages together, and from all pieces alike.
SHARED, EVEN = 0.02, 0.001
#: Words whose probabilities a worker remembers.
REMEMBERED = 200_000
#: Factor for each byte that keeps the chances of long words near one.
STEP = 1e3
#: Bytes that are segmented side by side.
BLOCK = 1 << 16


def read_pieces(model_file: str) -> list[bytes]:
    """Pieces of a public sentencepiece model as bytes, a leading space for the word mark, and
    all single bytes, so that anything can be segmented."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    pieces = {model.id_to_piece(i).replace("▁", " ").encode() for i in plain}
    return sorted(p for p in pieces | {bytes([b]) for b in range(256)})


class Pieces:
    """Finds pieces by a hash of their bytes, for many places at once."""

    def __init__(self, pieces: list[bytes]):
        self.count = len(pieces)
        self.lengths = np.array([len(p) for p in pieces])
        self.longest = max(map(len, pieces))
        self.factors = coefficients(self.longest, seed=17)
        self.by_length = {}
        for length in sorted({len(p) for p in pieces}):
            numbers = np.array([i for i, p in enumerate(pieces) if len(p) == length])
            chars = np.array([list(pieces[i]) for i in numbers], np.uint64) + np.uint64(1)
            hashes = (chars * self.factors[:length]).sum(axis=1, dtype=np.uint64)
            ranks = np.argsort(hashes)
            self.by_length[length] = (hashes[ranks], numbers[ranks])

    def find(self, chars: np.ndarray) -> dict[int, np.ndarray]:
        """For each length the pieces that begin at each place of the rows, -1 for none."""
        out, hashes = {}, np.zeros(chars.shape, np.uint64)
        wide = chars.astype(np.uint64) + np.uint64(1)
        for length in range(1, min(self.longest, chars.shape[1]) + 1):
            n = chars.shape[1] - length + 1
            hashes = hashes[:, :n] + wide[:, length - 1 :] * self.factors[length - 1]
            if length in self.by_length:
                known, numbers = self.by_length[length]
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out[length] = np.where(known[at] == hashes, numbers[at], -1)
        return out


def _forward(found: dict[int, np.ndarray], lengths: np.ndarray, chances: np.ndarray, width: int) -> np.ndarray:
    """Chance of each prefix, for rows, places and languages."""
    alpha = np.zeros((width + 1, len(lengths), chances.shape[1]))
    alpha[0] = 1
    for end in range(1, width + 1):
        for length, pieces in found.items():
            if length <= end:
                own = pieces[:, end - length]
                rows = np.flatnonzero((own >= 0) & (lengths >= end))
                if len(rows):
                    alpha[end, rows] += alpha[end - length, rows] * chances[own[rows]]
    return alpha


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    chars = np.zeros((len(words), lengths.max()), np.uint8)
    chars[np.repeat(np.arange(len(words)), lengths), ranges(np.zeros(len(words), np.int64), lengths)] = np.frombuffer(
        b"".join(words), np.uint8
    )
    return chars, lengths


def _blocks(words: list[bytes], size: int = 2048):
    """Rows of words of like length, with their places in ``words``; as few as keep a block small."""
    ranks = sorted(range(len(words)), key=lambda i: len(words[i]), reverse=True)
    at = 0
    while at < len(ranks):
        some = ranks[at : at + max(1, min(size, BLOCK // max(1, len(words[ranks[at]]))))]
        at += len(some)
        yield np.array(some), *_padded([words[i] for i in some])


def _log_forward(found: dict[int, np.ndarray], lengths: np.ndarray, scaled: np.ndarray, longest: int) -> np.ndarray:
    """Log chance of each row's whole word. Only as many prefixes are held as the longest piece has
    bytes; ``scaled`` chances hold ``STEP`` for each byte, and what is held is scaled to the newest prefix."""
    ring = np.zeros((longest + 1, len(lengths), scaled.shape[1]))
    ring[0] = 1
    logs, out = np.zeros(ring.shape[1:]), np.empty(ring.shape[1:])
    for end in range(1, int(lengths.max()) + 1):
        newest = np.zeros(ring.shape[1:])
        for length, pieces in found.items():
            if length <= end:
                own = pieces[:, end - length]
                rows = np.flatnonzero((own >= 0) & (lengths >= end))
                if len(rows):
                    newest[rows] += ring[(end - length) % (longest + 1), rows] * scaled[own[rows]]
        ring[end % (longest + 1)] = newest
        done = np.flatnonzero(lengths == end)
        if len(done):
            out[done] = np.log(newest[done]) + logs[done] - end * np.log(STEP)
        if end % 8 == 0:
            scale = np.where(newest > 0, newest, 1)
            ring /= scale
            logs += np.log(scale)
    return out


def word_scores(words: list[bytes], pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability in every language, over all segmentations of the whole
    word, however long."""
    out = np.empty((len(words), chances.shape[1]))
    scaled = chances * (STEP ** pieces.lengths.astype(np.float64))[:, None]
    for places, chars, lengths in _blocks(words):
        out[places] = _log_forward(pieces.find(chars), lengths, scaled, pieces.longest)
    return out


def fit(words: list[bytes], counts: np.ndarray, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities from word counts (one column for each language) by expectation
    maximisation: a round counts each piece as often as it is expected over all segmentations."""
    chances = np.full((pieces.count, counts.shape[1]), 1 / pieces.count)
    for _ in range(rounds):
        expected = np.zeros_like(chances)
        for places, chars, lengths in _blocks(words):
            width, found = chars.shape[1], pieces.find(chars)
            alpha = _forward(found, lengths, chances, width)
            beta = np.zeros_like(alpha)
            rows = np.arange(len(places))
            beta[lengths, rows] = 1
            weight = counts[places] / alpha[lengths, rows]
            for start in range(width - 1, -1, -1):
                for length, own_pieces in found.items():
                    if start + length <= width:
                        own = own_pieces[:, start]
                        some = np.flatnonzero((own >= 0) & (lengths >= start + length))
                        if len(some):
                            ways = chances[own[some]] * beta[start + length, some]
                            beta[start, some] += ways
                            np.add.at(expected, own[some], ways * alpha[start, some] * weight[some])
        total = expected.sum(axis=0)
        own = expected / np.where(total > 0, total, 1)
        shared = own.mean(axis=1, keepdims=True)
        chances = (1 - SHARED - EVEN) * own + SHARED * shared + EVEN / pieces.count
    return chances


def _parts(word: bytes):
    """A word in parts of at most ``RUN`` bytes, cut between characters."""
    while len(word) > RUN:
        cut = RUN
        while cut > 1 and word[cut] & 0xC0 == 0x80:
            cut -= 1
        yield word[:cut]
        word = word[cut:]
    yield word


def _distinct(data: np.ndarray, offsets: np.ndarray):
    """Distinct words as hashes and a way to their bytes, where each word's is, and text bounds."""
    words = find_words(data, offsets, NOT_SPACE)
    known, where, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
    raw = words.data.tobytes()

    def text(i: int) -> bytes:
        return b" " + raw[words.starts[where[i]] : words.ends[where[i]]]

    return known, text, inverse, words.bounds


def _count_words(batches):
    """Word counts of each language in the rows of a task."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        counts: dict[tuple[str, bytes], int] = {}
        for first, end, data, offsets in chunks(batch.column("text")):
            known, text, inverse, bounds = _distinct(data, offsets)
            own = np.repeat(langs[first:end], np.diff(bounds))
            for lang in set(own.tolist()):
                sums = np.bincount(inverse[own == lang], minlength=len(known))
                for i in np.flatnonzero(sums).tolist():
                    for part in _parts(text(i)):
                        counts[lang, part] = counts.get((lang, part), 0) + int(sums[i])
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([k[0] for k in counts], pa.string()),
                "word": pa.array([k[1] for k in counts], pa.binary()),
                "n": pa.array(list(counts.values()), pa.int64()),
            }
        )


class Model:
    def __init__(self, languages: list[str], pieces: Pieces, chances: np.ndarray):
        self.languages, self.pieces, self.chances = languages, pieces, chances


def train(
    labelled: DataFrame, model_file: str, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS
) -> Model:
    """A model of all labels of ``labelled`` (``doc_id, text, lang``).

    It is fitted on about ``sample_rows`` rows of each label, taken by a hash of id and text, and on
    the ``sample_words`` most frequent words of these; long words are learned from in parts of
    ``RUN`` bytes.
    """
    held = bounded_batches(labelled).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = held.groupBy("lang").count().collect()
    pieces = Pieces(read_pieces(model_file))
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return Model([], pieces, np.zeros((pieces.count, 0)))
    shares = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_rows / r["count"]))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = held.filter(place < shares[F.col("lang")]).select("lang", "text")
    words = sample.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")
    )
    ranks = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    frequent = words.withColumn("rank", ranks).filter(F.col("rank") <= sample_words).drop("rank")
    rows = frequent.orderBy("lang", F.desc("n"), "word").toArrow().to_pydict()
    number: dict[bytes, int] = {}
    at = [number.setdefault(w, len(number)) for w in rows["word"]]
    counts = np.zeros((len(number), len(names)))
    counts[at, [names.index(x) for x in rows["lang"]]] = rows["n"]
    return Model(names, pieces, fit(list(number), counts, pieces))


class _Scores:
    """Log-probabilities of the words that a worker has met."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.numbers: dict[int, int] = {}
        self.table = np.zeros((1 << 12, len(self.model.languages)), np.float32)

    def of(self, hashes: np.ndarray, text) -> np.ndarray:
        keys = hashes.tolist()
        new = [i for i, key in enumerate(keys) if key not in self.numbers]
        if len(self.numbers) + len(new) > REMEMBERED and self.numbers:
            self.clear()
            new = range(len(keys))
        if new:
            scores = word_scores([text(i) for i in new], self.model.pieces, self.model.chances)
            first = len(self.numbers)
            while first + len(scores) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[first : first + len(scores)] = scores
            self.numbers.update(zip((keys[i] for i in new), range(first, first + len(scores))))
        return self.table[np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))]


#: Of the model used last.
_CACHE: dict[str, _Scores] = {}


def _predict(batches, model, key: str, place: int | None = None):
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = _Scores(model.value)
    scores, names = _CACHE[key], model.value.languages
    for batch in batches:
        best, sure = [], []
        text_column = batch.column("text") if place is None else batch.column("row").field(place).cast(pa.string())
        for _, _, data, offsets in chunks(text_column):
            known, text, inverse, bounds = _distinct(data, offsets)
            own = scores.of(known, text)[inverse].astype(np.float64)
            sums = np.vstack((np.zeros((1, len(names))), np.cumsum(own, axis=0)))
            logs = sums[bounds[1:]] - sums[bounds[:-1]]
            odds = np.exp(logs - logs.max(axis=1, keepdims=True))
            at = logs.argmax(axis=1)
            best += [names[i] for i in at]
            sure += (odds.max(axis=1) / odds.sum(axis=1)).tolist()
        letters = batch.column("letters").to_pylist()
        columns = {
            "doc_id": batch.column("doc_id"),
            "lang_pred": pa.array([x if ok else "und" for x, ok in zip(best, letters)], pa.string()),
            "score": pa.array([x if ok else 0.0 for x, ok in zip(sure, letters)], pa.float64()),
        }
        yield pa.RecordBatch.from_pydict(columns | {c: batch.column(c) for c in ("row",) if c in batch.schema.names})
    # The worker goes on to other stages: what the texts took is given back.
    pa.default_memory_pool().release_unused()


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs``, from its text alone.

    ``score`` is the probability of the language among all learned ones. A text that is null or
    holds no letter is ``und`` with score 0, as is every text if no language was learned; ties go to
    the first language by name. Ids may be null or repeated; other columns are not read, unless
    ``carry`` adds the whole row as a struct ``row``.
    """
    text = F.col(text_col).cast("string")
    rows = bounded_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        *([] if carry else [text.alias("text")]),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    if not model.languages:
        return rows.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0)).drop("text", "letters").select(
            "doc_id", "lang_pred", "score", *(["row"] if carry else [])
        )
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType().add("doc_id", "long").add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(
        partial(_predict, model=sent, key=uuid.uuid4().hex, place=docs.columns.index(text_col) if carry else None),
        out.add("row", docs.schema) if carry else out,
    )


def recognised(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of ``docs`` in a learned language with a score of ``least_score`` or more."""
    found = identify(docs, model, carry=True)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row.*")
