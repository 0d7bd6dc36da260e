"""Near-duplicate groups by an LSH forest over MinHash signatures.

Texts with the same shingle set are one node, named by a digest of the set. A forest holds
several orders of the signature's places. Nodes whose signatures agree on the first places of an
order form a region of it. Within a region, nodes are sorted by the order's further places, so
that neighbours share the longest prefixes.

* Few nodes in a region: all pairs whose signatures agree well enough are candidates.
* Dense regions: first each node with its sorted neighbours and with the node that agrees most
  with all others, which links most of a group of copies in linear work. Then only pairs that
  the links so far have not joined, as longer signatures tell them apart more sharply.
* Regions of more than ``region_rows`` nodes are dealt out in parts, each linked like a dense
  region. Once the links are known, a region whose nodes have been joined is done. Where few have
  not been joined with the rest, these are compared with all parts. Otherwise the nodes go to a
  deeper rung of the forest: longer prefixes, which part them, and more orders, which keep the
  chance of missing a link as low as before. The deepest rung compares all that is not joined,
  part by part.

Candidates are confirmed on whole shingle sets made from the texts.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.llm.arrays import NOT_SPACE, bounded_batches, chunks, coefficients, find_words, mix
from callsieve.llm.components import components
from callsieve.session import materialise

SHINGLE = 5
#: Places of a signature, each a byte, and of the longer one that nodes of dense regions get.
PLACES, LONG_PLACES = 128, 512
#: Prefix lengths of the forest's rungs.
DEPTHS = (5, 8, 12, 16, 24)
#: Texts are worked on a piece at a time anyway; larger batches would only be held.
BATCH_BYTES = "2m"
#: Chance that all orders of a rung part two nodes of exactly the asked similarity.
MISS = 1e-4
REGION_ROWS = 2000
SMALL_REGION = 12
#: Standard errors that a signature's estimate may be below the asked similarity.
SLACK = 3.5


def orders_of(depth: int, similarity: float, miss: float = MISS) -> int:
    """Orders for which a link is missed with a chance of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**depth))


@lru_cache(maxsize=4096)
def order(number: int, depth: int) -> np.ndarray:
    """The places of a signature as the order ``number`` of a rung has them."""
    return np.random.default_rng([depth, number]).permutation(PLACES)


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """For each text of the column, in turn, its sorted distinct shingle hashes."""
    weights = coefficients(size, seed=7)
    for _, _, data, offsets in chunks(column):
        words = find_words(data, offsets, NOT_SPACE)
        hashes, bounds = words.hashes(), words.bounds
        for first, end in zip(bounds[:-1], bounds[1:]):
            own = hashes[first:end]
            if len(own) == 0:
                yield np.zeros(0, np.uint64)
            elif len(own) < size:
                yield mix(np.array([(own * weights[: len(own)]).sum() + np.uint64(len(own))], np.uint64))
            else:
                n = len(own) - size + 1
                total = own[:n] * weights[0]
                for k in range(1, size):
                    total = total + own[k : k + n] * weights[k]
                total = np.sort(mix(total))
                yield total[np.concatenate(([True], total[1:] != total[:-1]))]


_SALTS = (coefficients(LONG_PLACES, seed=3) >> np.uint64(32)).astype(np.uint32)
_FACTORS = (coefficients(LONG_PLACES, seed=5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def least_agreement(places: int, similarity: float) -> int:
    """Places on which the signatures of a linked pair agree, but for a small chance."""
    return math.floor(places * (similarity - SLACK * math.sqrt(similarity * (1 - similarity) / places)))


def minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures of non-empty sets, one row of bytes each."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), places), np.uint8)
    for k in range(places):
        least = np.minimum.reduceat((values ^ _SALTS[k]) * _FACTORS[k], starts)
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


class _Signer:
    """Signatures of a batch's rows; sets are worked on many at a time."""

    def __init__(self, rows: int, places: int):
        self.places, self.signatures = places, [None] * rows
        self.waiting, self.held = [], 0

    def add(self, row: int, shingles: np.ndarray) -> None:
        self.waiting.append((row, shingles))
        self.held += len(shingles)
        if self.held > 1 << 17:
            self.close()

    def close(self) -> list[bytes | None]:
        if self.waiting:
            made = minhash([s for _, s in self.waiting], self.places)
            for (row, _), signature in zip(self.waiting, made):
                self.signatures[row] = signature.tobytes()
        self.waiting, self.held = [], 0
        return self.signatures


def _sign(batches):
    for batch in batches:
        counts, digests, signer = [], [], _Signer(batch.num_rows, PLACES)
        for row, shingles in enumerate(shingle_sets(batch.column("text"))):
            counts.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            if len(shingles):
                signer.add(row, shingles)
        signatures = signer.close()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(signatures, pa.binary()),
                batch.column("text"),
            ],
            ["doc_id", "n_shingles", "node", "signature", "text"],
        )


def _sign_long(batches):
    for batch in batches:
        signer = _Signer(batch.num_rows, LONG_PLACES)
        for row, shingles in enumerate(shingle_sets(batch.column("text"))):
            signer.add(row, shingles)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(signer.close(), pa.binary())], ["node", "signature"]
        )


def _keys(batches, depth: int, count: int, fat: bool):
    """A row for each node and order, with the key of its region."""
    weights = coefficients(depth, seed=11)
    for batch in batches:
        signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, PLACES)
        # A few thousand nodes at a time keep the rows of all orders small.
        for at in range(0, len(signatures), 2048):
            some = batch.slice(at, 2048)
            for number in range(count):
                prefix = signatures[at : at + 2048, order(number, depth)[:depth]].astype(np.uint64)
                keys = mix((prefix * weights).sum(axis=1, dtype=np.uint64) + np.uint64(number)).view(np.int64)
                columns = {"key": pa.array(keys), "number": pa.array(np.full(len(keys), number, np.int32))}
                if fat:
                    columns |= {c: some.column(c) for c in ("node", "signature", "root")}
                yield pa.RecordBatch.from_pydict(columns)


def _agreement(signatures: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.count_nonzero(signatures == one, axis=1)


def _met_before(matrix: np.ndarray, i: int, others: np.ndarray, number: int, depth: int) -> np.ndarray:
    """Which of ``others`` share a region with ``i`` in an earlier order, where they are dealt with."""
    met = np.zeros(len(others), bool)
    for earlier in range(number):
        places = order(earlier, depth)[:depth]
        met |= (matrix[others][:, places] == matrix[i, places]).all(axis=1)
    return met


def _asked_pairs(matrix: np.ndarray, group: np.ndarray, asked: np.ndarray, number: int, depth: int, least: int):
    """Pairs of asked rows with the other rows that agree well enough and are of another group."""
    own = np.flatnonzero(~asked)
    for i in np.flatnonzero(asked):
        others = own[(_agreement(matrix[own], matrix[i]) >= least) & (group[own] != group[i])]
        yield np.minimum(others, i), np.maximum(others, i)


def _pairs(matrix: np.ndarray, group: np.ndarray | None, number: int, depth: int, least: int):
    """All pairs of a region that agree well enough, for each row with later ones."""
    for i in range(len(matrix) - 1):
        good = _agreement(matrix[i + 1 :], matrix[i]) >= least
        if group is not None:
            good &= group[i + 1 :] != group[i]
        others = np.flatnonzero(good) + i + 1
        if len(others):
            others = others[~_met_before(matrix, i, others, number, depth)]
            yield np.full(len(others), i), others


def _close_ones(matrix: np.ndarray, number: int, depth: int, least: int):
    """Pairs of a dense region that link most of it: sorted neighbours, and all with the hub."""
    ranks = np.lexsort(matrix[:, order(number, depth)[::-1]].T)
    near = np.count_nonzero(matrix[ranks[1:]] == matrix[ranks[:-1]], axis=1) >= least
    yield np.minimum(ranks[1:], ranks[:-1])[near], np.maximum(ranks[1:], ranks[:-1])[near]
    cells = matrix.astype(np.int64) + np.arange(PLACES) * 256
    votes = np.bincount(cells.ravel(), minlength=PLACES * 256)
    hub = int(np.argmax(votes[cells].sum(axis=1)))
    others = np.flatnonzero(_agreement(matrix, matrix[hub]) >= least)
    others = others[others != hub]
    yield np.minimum(others, hub), np.maximum(others, hub)


def _regions(batches, depth: int, least: int, small: int, cross: bool):
    """Rows of all regions, gathered to batches of some size."""
    held, rows = [], 0
    for batch in _region_rows(batches, depth, least, small, cross):
        held.append(batch)
        rows += batch.num_rows
        if rows > 8192:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _region_rows(batches, depth: int, least: int, small: int, cross: bool):
    """Candidate pairs of each region or part of one; input is sorted by key, number, part and node.

    A row with ``b`` null says that the node is in a dense region or in a part, of which only some
    pairs have been given; ``parts`` is 0 for whole regions. With ``cross``, all pairs of nodes
    with different roots are given instead, or those of asked nodes with the others if there are
    asked ones. A pair of several regions is given by the first.
    """
    current, nodes, signatures, roots, asked = None, [], [], [], []

    def close():
        n, (key, number, part, parts) = len(nodes), current
        if n < 2 and (cross or not parts):
            return
        named = partial(_pair_rows, *current)
        ids = pa.array(nodes, pa.binary())
        matrix = np.frombuffer(b"".join(signatures), np.uint8).reshape(n, -1)
        dense = not cross and n > small
        if cross:
            numbers = {root: k for k, root in enumerate(dict.fromkeys(roots))}
            if len(numbers) == 1:
                return
            group = np.array([numbers[r] for r in roots])
            if parts:
                found = _asked_pairs(matrix, group, np.array(asked), number, depth, least)
            else:
                found = _pairs(matrix, group, number, depth, least)
        elif dense:
            found = _close_ones(matrix, number, depth, least)
        else:
            found = _pairs(matrix, None, number, depth, least)
        if dense or (parts and not cross):
            yield named(ids, pa.nulls(n, pa.binary()))
        firsts, seconds, held = [], [], 0
        for first, second in found:
            firsts.append(first)
            seconds.append(second)
            held += len(first)
            if held > 8192:
                yield named(ids.take(np.concatenate(firsts)), ids.take(np.concatenate(seconds)))
                firsts, seconds, held = [], [], 0
        if held:
            yield named(ids.take(np.concatenate(firsts)), ids.take(np.concatenate(seconds)))

    for batch in batches:
        for *place, node, signature, root, asks in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if place != current:
                if current is not None:
                    yield from close()
                current, nodes, signatures, roots, asked = place, [], [], [], []
            nodes.append(node)
            signatures.append(signature)
            roots.append(root)
            asked.append(asks)
    if current is not None:
        yield from close()


def _pair_rows(key: int, number: int, part: int, parts: int, a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(a), key, np.int64))]
    columns += [pa.array(np.full(len(a), x, np.int32)) for x in (number, part, parts)]
    return pa.RecordBatch.from_arrays([*columns, a, b], ["key", "number", "part", "parts", "a", "b"])


_FAT = "key long, number int, node binary, signature binary, root binary"
_PAIRS = "key long, number int, part int, parts int, a binary, b binary"


def _in_regions(rows: DataFrame, depth: int, least: int, small: int, cross: bool) -> DataFrame:
    dealt = rows.select("key", "number", "part", "parts", "node", "signature", "root", "asked")
    return (
        dealt.repartition("key", "number", "part")
        .sortWithinPartitions("key", "number", "part", "node")
        .mapInArrow(partial(_regions, depth=depth, least=least, small=small, cross=cross), _PAIRS)
    )


def _whole(rows: DataFrame) -> DataFrame:
    """Rows of regions that are not dealt out in parts."""
    return rows.withColumns({"part": F.lit(0), "parts": F.lit(0), "asked": F.lit(False)})


def _open_parts(members: DataFrame, roots: DataFrame, region_rows: int) -> DataFrame:
    """Rows of crowded regions that links have not joined to one. Nodes outside a region's largest
    group are ``asked``; ``rest`` is their number."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("key", "number", "root").agg(F.count("*").alias("n"), F.first("parts").alias("all"))
    regions = groups.groupBy("key", "number").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"), F.first("all").alias("all")
    )
    # A row for each part, so that no region is met in one place.
    regions = regions.filter("rest > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("all") - 1))).drop("all")
    found = rooted.join(regions, ["key", "number", "part"])
    asked_parts = F.ceil(F.col("rest") / region_rows).cast("int")
    return found.select(
        "key", "number", "part", "parts", "node", "rest", (F.col("root") != F.col("main")).alias("asked"), asked_parts.alias("asked_parts")
    )


def _crossed(rows: DataFrame) -> DataFrame:
    """Every part of a region beside every part of its asked nodes."""
    mine = F.pmod(F.xxhash64("node"), F.col("asked_parts")).cast("int")
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = rows.withColumn("other", upto("asked_parts")).withColumn("asked", F.lit(False))
    asked = rows.filter("asked").withColumn("other", mine).drop("part").withColumn("part", upto("parts"))
    both = own.unionByName(asked)
    return both.withColumn("part", F.col("part") * F.col("asked_parts") + F.col("other"))


def _confirm(batches, share: float):
    """Links among pairs of texts: intersection and union of whole shingle sets."""
    for batch in batches:
        good, last, own = [], None, None
        pairs = zip(
            batch.column("a").to_pylist(), shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b"))
        )
        for _, one, other in pairs:
            common = len(np.intersect1d(one, other, assume_unique=True))
            good.append(100 * common >= share * (len(one) + len(other) - common))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"]
        )


def _links(pairs: DataFrame, texts: DataFrame, percent: float) -> DataFrame:
    """Confirmed ones of distinct node pairs."""
    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    links = both.select("a", "b", "text_a", "text_b").mapInArrow(partial(_confirm, share=percent), "a binary, b binary")
    return materialise(links, "near-links")


def _likely_in(nodes: DataFrame) -> Column:
    """A test of ``node`` that holds for all ``nodes`` and for few others, so that most texts that
    are not asked for are never shuffled. It marks the buckets of a hash in one byte each, at
    most 4 MB; beyond that it only lets more rows through."""
    buckets = 1 << min(22, max(12, (16 * nodes.count()).bit_length()))
    bucket = F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int")
    marks = np.zeros(buckets, np.uint8)
    marks[nodes.select(bucket.alias("b")).distinct().toArrow().column("b").to_numpy()] = 1
    return F.substring(F.lit(marks.tobytes()), bucket + 1, F.lit(1)) == F.lit(b"\x01")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: float = 85,
    region_rows: int = REGION_ROWS,
    small_region: int = SMALL_REGION,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Words are runs of anything but spaces and line breaks, in lower case for A-Z. A set holds the
    distinct shingles of five words; of a shorter text, the whole sequence. Rows are linked when
    their sets overlap by ``percent`` or more; a component holds all that links reach, and
    ``component_id`` is its smallest id. Null or empty texts are linked with nothing, not with each other.
    A null id is never the smallest unless all ids of a component are null. Rows with equal ids
    are separate rows. An empty table gives an empty table; other columns are not read.
    """
    similarity = percent / 100
    least = least_agreement(PLACES, similarity)
    rows = bounded_batches(docs, BATCH_BYTES).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(
        rows.mapInArrow(_sign, "doc_id long, n_shingles long, node binary, signature binary, text string"),
        "signed",
        compression="zstd",
    )
    nodes = materialise(
        signed.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least_id"), F.first("signature").alias("signature")),
        "nodes",
    )
    active = nodes.select("node", "signature", F.col("node").alias("root"))
    links, dense, crowds, texts = [], [], [], None
    for depth in DEPTHS:
        count = orders_of(depth, similarity)
        regions = partial(_keys, depth=depth, count=count)
        inside = active.mapInArrow(partial(regions, fat=True), _FAT)
        sizes = active.mapInArrow(partial(regions, fat=False), "key long, number int").groupBy("key", "number").count()
        parts = F.ceil(F.col("count") / region_rows).cast("int")
        hot = materialise(sizes.filter(F.col("count") > region_rows).select("key", "number", parts.alias("parts")), "hot")
        crowded = not hot.isEmpty()
        if crowded:
            # Other parts in every order, so that orders tie the parts together.
            part = F.pmod(F.xxhash64("node", "number"), F.greatest("parts", F.lit(1))).cast("int")
            inside = inside.join(hot, ["key", "number"], "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
            inside = inside.withColumn("part", part).withColumn("asked", F.lit(False))
        else:
            inside = _whole(inside)
        found = materialise(_in_regions(inside, depth, least, small_region, False), "candidates")
        dense.append((depth, found.filter("b IS NULL AND parts = 0").select("key", "number", F.col("a").alias("node"))))
        pairs = materialise(found.filter("b IS NOT NULL").select("a", "b").distinct(), "pairs")
        if texts is None:
            # Nodes of deeper rungs are among these.
            ends = materialise(found.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
            likely = signed.select("node", "text").filter(_likely_in(ends))
            texts = materialise(likely.join(ends, "node", "left_semi").dropDuplicates(["node"]), "pair-texts")
        links.append(_links(pairs, texts, percent))
        roots = components(_all(links))
        if not crowded:
            break
        members = found.filter("b IS NULL AND parts > 0").select("key", "number", "part", "parts", F.col("a").alias("node"))
        unjoined = materialise(_open_parts(members, roots, region_rows), "unjoined")
        few = F.lit(True) if depth == DEPTHS[-1] else F.col("rest") <= region_rows
        crowds.append((depth, unjoined.filter(few)))
        further = unjoined.filter(~few).select("node").distinct()
        active = materialise(active.join(further, "node", "left_semi"), "crowded")
        if active.isEmpty():
            break
    cross, least = [], least_agreement(LONG_PLACES, similarity)
    crowd = _all([members.select("node") for _, members in dense + crowds]).distinct()
    longer = materialise(
        texts.join(crowd, "node", "left_semi").mapInArrow(_sign_long, "node binary, signature binary"), "long-signed"
    )
    for depth, members in [(d, _whole(rows)) for d, rows in dense] + [(d, _crossed(rows)) for d, rows in crowds]:
        known = members.join(longer, "node").join(roots, "node", "left")
        known = known.withColumn("root", F.coalesce("root", "node"))
        cross.append(_in_regions(known, depth, least, small_region, True))
    more = _links(materialise(_all(cross).select("a", "b").distinct(), "pairs"), texts, percent)
    if not more.isEmpty():
        roots = components(_all([*links, more]))
    rooted = nodes.select("node", "least_id").join(roots, "node", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "node")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = materialise(rooted.select("node", "root").join(named, "root").select("node", "component_id"), "ids")
    out = signed.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
