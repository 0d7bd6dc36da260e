"""Personal data by boosted trees over candidate spans.

Four base patterns decide strictly. Beside them, generators of high recall propose spans, which
may overlap, for e-mail addresses, IP addresses, card and phone numbers. Gradient-boosted trees
are trained on all candidates of two thirds of the texts: those that are base matches against the others, with
the sign that tells them apart in form left out of the features. A threshold for each kind is
calibrated on rows that the trees have not seen; candidates above it are added, best first, where
they overlap nothing found before.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsieve.llm.arrays import bounded_batches
from callsieve.session import materialise

KINDS = ("email", "ip", "card", "phone")

TREES, DEPTH = 10, 3
#: Share of right ones that candidates above a threshold must have on the calibration rows, and
#: how many such candidates must be there.
PRECISION, LEAST = 0.99, 20
CONTEXT = 24

# Patterns of the base matches.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = re.compile(r"@|[\[({] ?at ?[\])}]", re.IGNORECASE)
_NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?\Z")
_LOOSE_DOMAIN = re.compile(
    r" ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[A-Za-z0-9-]+)*", re.IGNORECASE
)
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9])++")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(number)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_emails(text: str):
    """Leftmost matches: a name reaches back from its @ as far as it can, but not into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_NAME.match(text, start - 1):
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": list(base_emails(text)) if "@" in text else [], "ip": [], "card": [], "phone": []}
    for m in IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        number = digits(m[0]) if m.end() - m.start() <= 37 else ""
        if 13 <= len(number) <= 19 and luhn(number):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def candidates(text: str):
    """Proposed ``kind, start, end``; kinds and spans may overlap."""
    for m in _AT.finditer(text):
        name = _NAME_BEFORE.search(text, max(0, m.start() - 65), m.start())
        domain = _LOOSE_DOMAIN.match(text, m.end())
        if name and domain:
            yield "email", name.start(), domain.end()
    for m in _NUMBER.finditer(text):
        number = digits(m[0]) if m.end() - m.start() <= 80 else ""
        if 7 <= len(number) <= 16:
            yield "phone", m.start(), m.end()
        if 12 <= len(number) <= 20:
            first = m.start() + re.search("[0-9]", m[0]).start()
            yield "card", first, m.end()
        if m[0].count(".") >= 3 and 4 <= len(number) <= 16:
            yield "ip", m.start(), m.end()


FEATURES = 16


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span. The plus of phone numbers is left out."""
    span = text[start:end]
    groups = re.findall("[0-9]+", span)
    lengths = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    number = "".join(groups)
    return [
        float(KINDS.index(kind)),
        float(end - start - span.startswith("+")),
        float(len(number)),
        float(len(groups)),
        float(max(lengths)),
        float(lengths[-1]),
        float(span.count(" ")),
        float(span.count("-")),
        float(span.count(".")),
        float(span.count("(")),
        float(luhn(number)),
        float(bool(groups) and all(len(g) < 4 and int(g) < 256 for g in groups)),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(any(c in before[-3:] for c in "=\"':/#")),
        float(sum(c.isdigit() for c in before + after)),
    ]


def _examples(batches):
    """Features and weak labels of the candidates, those alike in a batch once with their number."""
    for batch in batches:
        found = Counter()
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = {(k, *s) for k, spans in base_spans(text).items() for s in spans}
            part = zlib.crc32(text.encode()) % 3
            for kind, start, end in candidates(text):
                found[(*features(text, kind, start, end), float((kind, start, end) in base), part)] += 1
        yield pa.RecordBatch.from_pydict(
            {
                "values": pa.array([row[:FEATURES] for row in found], pa.list_(pa.float64())),
                "label": pa.array([row[FEATURES] for row in found], pa.float64()),
                "part": pa.array([row[-1] for row in found], pa.int32()),
                "times": pa.array(list(found.values()), pa.int64()),
            }
        )


class Trees:
    """Boosted trees as arrays, from their printed form."""

    def __init__(self, model):
        self.weights = list(model.treeWeights)
        self.trees = [self._parse(iter(t.toDebugString.split("\n")[1:])) for t in model.trees]

    def _parse(self, lines):
        line = next(lines).strip()
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        number, limit = re.match(r"If \(feature (\d+) <= ([^)]+)\)", line).groups()
        left = self._parse(lines)
        next(lines)  # the matching Else
        return int(number), float(limit), left, self._parse(lines)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        for weight, tree in zip(self.weights, self.trees):
            out = np.empty(len(rows))
            stack = [(tree, np.arange(len(rows)))]
            while stack:
                node, own = stack.pop()
                if isinstance(node, float):
                    out[own] = node
                else:
                    low = rows[own, node[0]] <= node[1]
                    stack += [(node[2], own[low]), (node[3], own[~low])]
            margin += weight * out
        return 1 / (1 + np.exp(-2 * margin))


def _scored(batches, trees):
    for batch in batches:
        values = np.array(batch.column("values").to_pylist() or np.zeros((0, FEATURES)), float).reshape(-1, FEATURES)
        columns = [pa.array(values[:, 0].astype(int), pa.int64()), pa.array(trees.scores(values), pa.float64())]
        right = np.asarray(batch.column("label")) * np.asarray(batch.column("times"))
        yield pa.RecordBatch.from_arrays(
            [*columns, batch.column("times"), pa.array(right.astype(int), pa.int64())], ["kind", "score", "times", "hits"]
        )


def calibrate(held: DataFrame, trees: Trees) -> dict[str, float]:
    """For each kind the least score from which on the share of right ones is high enough; above 1 if none is."""
    rows = held.select("values", "label", "times").mapInArrow(
        partial(_scored, trees=trees), "kind long, score double, times long, hits long"
    )
    scores = rows.groupBy("kind", "score").agg(F.sum("times").alias("times"), F.sum("hits").alias("hits"))
    best_first = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = scores.select("kind", "score", *[F.sum(c).over(best_first).alias(c) for c in ("times", "hits")])
    good = sums.filter((F.col("hits") >= PRECISION * F.col("times")) & (F.col("times") >= LEAST))
    found = {r["kind"]: r["least"] for r in good.groupBy("kind").agg(F.min("score").alias("least")).collect()}
    return {kind: found.get(number, 2.0) for number, kind in enumerate(KINDS)}


def train(rows: DataFrame):
    """Trees and thresholds from ``doc_id, text``; None if there is but one class."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    every = rows.mapInArrow(_examples, "values array<double>, label double, part int, times long")
    # Candidates alike in all features count as one with a weight.
    alike = every.groupBy("values", "label", "part").agg(F.sum("times").alias("times"))
    found = materialise(alike, "spans")
    # A third of the texts is kept for calibration.
    fitting = found.filter("part > 0")
    seen = fitting.agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("times").alias("n")).first()
    if seen["low"] == seen["high"]:
        return None
    vectors = fitting.select(array_to_vector("values").alias("features"), "label", F.col("times").cast("double").alias("weight"))
    # A leaf holds five candidates at least, whatever their weights.
    share = min(5 / seen["n"], 0.49)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, weightCol="weight", minWeightFractionPerNode=share).fit(vectors)
    trees = Trees(model)
    return trees, calibrate(found.filter("part = 0"), trees)


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], model) -> dict[str, list[tuple[int, int]]]:
    """Candidates above their threshold, best first, that overlap no span taken before."""
    out = {k: [] for k in KINDS}
    proposed = list(candidates(text)) if model else []
    if not proposed:
        return out
    trees, limits = model
    taken = sorted(s for spans in base.values() for s in spans)
    scores = trees.scores(np.array([features(text, *c) for c in proposed]))
    for at in np.argsort(-scores, kind="stable"):
        kind, start, end = proposed[at]
        if scores[at] >= limits[kind] and not any(s < end and start < e for s, e in taken):
            out[kind].append((start, end))
            taken.append((start, end))
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in sorted(spans[kind]))


def _find(batches, model):
    for batch in batches:
        out = {k: [] for k in (*KINDS, "sha", "spans")}
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            more = added_spans(text, base, model.value)
            for kind in KINDS:
                out[kind].append(len(base[kind]))
            out["sha"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined({k: base[k] + more[k] for k in KINDS}))
        columns = [pa.array(out[k], pa.int64()) for k in KINDS] + [pa.array(out["sha"]), pa.array(out["spans"])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        )


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row of ``docs``.

    Counts and hash are of the base spans, ``spans`` of these and the added ones, each as
    ``kind:start:end`` in characters, the end not included. Null texts are empty and have none;
    rows of equal ids are found by themselves. Without base matches nothing is
    added. Other columns are not read.
    """
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(partial(_find, model=model), f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """``text`` with each of its ``spans`` replaced by the kind in brackets; of overlapping ones,
    the first and longest."""
    parts, done = [], 0
    found = (s.split(":") for s in spans.split(",") if s)
    for start, end, kind in sorted((int(s), -int(e), k) for k, s, e in found):
        if start >= done:
            parts += [text[done:start], f"[{kind}]"]
            done = -end
    return "".join(parts) + text[done:]
