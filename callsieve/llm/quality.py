"""Quality of texts by compression: a text that a dictionary of good texts compresses better than a
dictionary of bad ones is likely good.

Each class gets a zstandard dictionary, built from blocks of labelled texts. A text is cut into blocks
of ``BLOCK`` bytes, so that a long one is not its own dictionary; all of them are compressed with both
dictionaries, and the difference of the two sums over their total is the text's evidence. Labelled
texts that no dictionary was built from turn it into a probability by logistic calibration, together
with the share of its bytes that the text keeps at all, which tells endless repetition from prose.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.llm.arrays import bounded_batches, text_bytes

#: Labelled rows of each class that are used at most, taken by a hash of the id.
SAMPLE_ROWS = 20_000
#: Blocks of each class that its dictionary is built from at most, taken by a hash of their bytes.
SAMPLE_BLOCKS = 16_384
#: Bytes of a text that are compressed at once.
BLOCK = 512
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
#: Of this many labelled rows, one is for calibration.
CALIBRATED = 3
#: Weights where the rows for calibration do not hold both classes.
UNFITTED = (20.0, 0.0, 0.0)


@dataclass(frozen=True)
class Model:
    """Dictionaries of the two classes and the weights of difference, kept share and 1 in the log-odds.
    Without dictionaries (a class without texts) all texts get the odds of the labels."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]


def _blocks(text: bytes) -> Iterator[bytes]:
    for at in range(0, len(text), BLOCK):
        yield text[at : at + BLOCK]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Compressor:
    """Sizes of texts when compressed with one dictionary, without frame headers."""

    def __init__(self, content: bytes):
        trained = content[:4] == zstandard.MAGIC_NUMBER.to_bytes(4, "little") or content[:4] == b"\x37\xa4\x30\xec"
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        held = zstandard.ZstdCompressionDict(content, dict_type=kind)
        options = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False
        )
        self.one = zstandard.ZstdCompressor(dict_data=held, compression_params=options)

    def size(self, text: bytes) -> int:
        return sum(len(self.one.compress(block)) for block in _blocks(text))


def _evidence_of(column: pa.Array, good: Compressor, bad: Compressor) -> np.ndarray:
    """``(bad - good) / (bad + good)`` of the compressed sizes, and the logarithm of their mean as a
    share of the text's own size; 0 and 0 for an empty text."""
    data, at = text_bytes(column)
    raw = data.tobytes()
    out = np.zeros((len(at) - 1, 2))
    for i in range(len(out)):
        text = raw[at[i] : at[i + 1]]
        if text:
            g, b = good.size(text), bad.size(text)
            out[i] = (b - g) / (b + g), np.log((b + g) / (2 * len(text)))
    return out


def _cut(batches):
    for batch in batches:
        label = batch.column("label").to_pylist()
        data, at = text_bytes(batch.column("text"))
        raw = data.tobytes()
        for i, y in enumerate(label):
            blocks = list(_blocks(raw[at[i] : at[i + 1]]))
            for first in range(0, len(blocks), 4096):
                part = blocks[first : first + 4096]
                yield pa.RecordBatch.from_pydict(
                    {"label": pa.array([y] * len(part), pa.int32()), "block": pa.array(part, pa.binary())}
                )


def _weigh(batches, sent, kept: list[str]):
    model = sent.value
    pair = (Compressor(model.good), Compressor(model.bad)) if model.good else None
    for batch in batches:
        text = batch.column("text")
        x = _evidence_of(text, *pair) if pair else np.zeros((len(text), 2))
        columns = {c: batch.column(c) for c in kept}
        yield pa.RecordBatch.from_pydict(columns | {"difference": pa.array(x[:, 0]), "share": pa.array(x[:, 1])})


def _weighed(rows: DataFrame, model: Model, kept: dict[str, str]) -> DataFrame:
    """``kept`` columns (name and type) and the evidence of each row's ``text``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{c} {t}" for c, t in kept.items()) + ", difference double, share double"
    return rows.mapInArrow(partial(_weigh, sent=sent, kept=list(kept)), schema)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of the columns of ``x`` and of 1 in a logistic model, by Newton steps; a small ridge
    keeps them finite where the classes can be parted."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    rows = np.column_stack(((x - centre) / scale, np.ones(len(x))))
    weights, ridge = np.zeros(3), np.diag([1e-1, 1e-1, 1e-6])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (y - p) - ridge @ weights
        step = np.linalg.solve((rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows + ridge, slope)
        weights += np.clip(step, -2.0, 2.0)
        if np.abs(step).max() < 1e-9:
            break
    own = weights[:2] / scale
    return float(own[0]), float(own[1]), float(weights[2] - own @ centre)


def _share(column: str, seed: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(parts))


def train(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Learn from the labelled rows that ``learnable`` (a condition on the id) selects.

    At most ``sample_rows`` labels of each class are used, those with the least hash of the id; an id
    with several labels counts once for each distinct one. Ids or labels that are null, labels other
    than 0 and 1, and labels without a document are left out.
    """
    given = labels.select(F.col(id_col).alias(id_col), F.col(label_col).cast("int").alias("label")).distinct()
    given = given.filter(learnable & F.col("label").isin(0, 1) & F.col(id_col).isNotNull())
    order = F.xxhash64(F.lit("rows"), id_col)
    picked = [given.filter(F.col("label") == y).orderBy(order, id_col).limit(sample_rows) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1]).withColumnRenamed(id_col, "__id")
    text = docs.select(F.col(id_col).alias("__key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = bounded_batches(text).join(F.broadcast(picked), F.col("__key") == F.col("__id"))
    fitted = rows.filter(_share("__id", "split", CALIBRATED) != 0).select("label", "text")
    blocks = fitted.mapInArrow(_cut, "label int, block binary").withColumn("place", F.xxhash64("block"))
    samples = []
    for y in (1, 0):
        one = blocks.filter(F.col("label") == y).orderBy("place", "block").limit(SAMPLE_BLOCKS)
        samples.append([r["block"] for r in one.select("block").toLocalIterator()])
    held = rows.filter(_share("__id", "split", CALIBRATED) == 0).select("label", "text")
    if not samples[0] or not samples[1]:
        n = dict(rows.groupBy("label").count().collect())
        return Model(b"", b"", (0.0, 0.0, float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)))))
    model = Model(dictionary(samples[0]), dictionary(samples[1]), UNFITTED)
    found = _weighed(held, model, {"label": "int"}).toPandas()
    if found["label"].nunique() < 2:
        return model
    weights = calibrate(found[["difference", "share"]].to_numpy(float), found["label"].to_numpy(float))
    return Model(model.good, model.bad, weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``, from its whole text alone.

    ``score`` is the probability of label 1; ``predicted`` is 1 from 0.5 on. A null text counts as
    empty; empty texts get the score of no evidence. Ids may be null or repeated; other columns are
    not read.
    """
    rows = bounded_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    slope, share, offset = model.weights
    line = F.col("difference") * slope + F.col("share") * share + offset
    chance = 1.0 / (1.0 + F.exp(-F.greatest(F.least(line, F.lit(500.0)), F.lit(-500.0))))
    found = _weighed(rows, model, {"doc_id": "long"}).select("doc_id", chance.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
