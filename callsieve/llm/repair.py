"""Repair of broken conversations by cheapest edits, with Four-Russians block tables.

A conversation is a string of row symbols; edits keep, rerole, delete or insert rows until the roles
read ``(s?(ua)+)?``. The state after a prefix is one of four, so the costs still to pay from each state
are a vector of four numbers. Their differences are bounded: normalised to a least entry of 0, few
vectors exist. For each of them and each block of ``BLOCK`` symbols, a table gives the vector before the
block and what was taken off. A conversation is processed from its end, block by block, by lookup; then
blocks are expanded backward again, from the vector kept at their end, so that going forward always
the least edit letter on a cheapest way can be taken.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.llm.arrays import bounded_batches
from callsieve.session import materialise

#: Costs of the edits; a row that must go cannot be kept, a truncated one that stays costs extra.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Symbols of a block.
BLOCK = 4

#: States: nothing yet, after s, after u, after a. The next role of each is fixed, but that s may come first.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FORWARD = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLE_OF = {AFTER_U: "user", AFTER_A: "assistant"}

#: Symbols: 0 must go; 1 to 4 are roles u, a, s and others; 5 to 8 the same with a truncated text.
GONE, SYMBOLS = 0, 9
INITIALS = "uas"


def symbol_of(initial: str, truncated: bool) -> int:
    place = INITIALS.find(initial) if len(initial) == 1 else -1
    return 1 + (place if place >= 0 else 3) + (4 if truncated else 0)


def _kept_state(state: int, symbol: int) -> int | None:
    """State after keeping a row with its own role, if its role fits."""
    role = (symbol - 1) % 4
    if role == 2:
        return AFTER_S if state == START else None
    return FORWARD[state] if role < 2 and FORWARD[state] == (AFTER_U, AFTER_A)[role] else None


def _edits(state: int, symbol: int) -> list[tuple[int, str, int, bool]]:
    """``cost, letter, next state, whether the row is used up`` of each edit."""
    out = [(DELETE, "D", state, True), (INSERT, "I", FORWARD[state], False)]
    if symbol != GONE:
        more = TRUNCATED if symbol > 4 else 0
        kept = _kept_state(state, symbol)
        if kept is not None:
            out.append((KEEP + more, "K", kept, True))
        out.append((REROLE + more, "R", FORWARD[state], True))
    return out


#: Costs after the last row.
END = (0, 2 * INSERT, INSERT, 0)


def _before(vector: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs before a row of ``symbol`` from those after it."""
    out = [min(c + vector[to] for c, _, to, used in _edits(s, symbol) if used) for s in range(4)]
    for _ in range(3):
        out = [min(out[s], INSERT + out[FORWARD[s]]) for s in range(4)]
    return tuple(out)


@dataclass(frozen=True)
class Tables:
    """``step`` and ``off`` by vector and symbol, ``block_step`` and ``block_off`` by vector and block;
    ``way[vector after][symbol][state]`` is the least edits that use a row up, and the state they lead to."""

    vectors: list[tuple[int, ...]]
    step: np.ndarray
    off: np.ndarray
    block_step: np.ndarray
    block_off: np.ndarray
    way: list[list[list[tuple[str, int]]]]
    last: list[str]


def _way(after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    before, letters = _before(after, symbol), ""
    while True:
        # Deletes sort before inserts, keeps and reroles: the first fitting letter is the least.
        fitting = [
            (letter, to, used)
            for cost, letter, to, used in _edits(state, symbol)
            if cost + (after if used else before)[to] == before[state]
        ]
        letter, state, used = min(fitting)
        letters += letter
        if used:
            return letters, state


@lru_cache(maxsize=1)
def tables() -> Tables:
    """All reachable vectors, numbered from the one after the last row, and their transitions."""
    number, queue, step, off = {END: 0}, [END], [], []
    for vector in queue:
        steps, offs = [], []
        for symbol in range(SYMBOLS):
            costs = _before(vector, symbol)
            least = min(costs)
            normal = tuple(c - least for c in costs)
            if normal not in number:
                number[normal] = len(queue)
                queue.append(normal)
            steps.append(number[normal])
            offs.append(least)
        step.append(steps)
        off.append(offs)
    step, off = np.array(step), np.array(off)
    # A block's number has its first symbol as the highest digit; it is crossed from its last one.
    block_step, block_off = step, off
    for _ in range(BLOCK - 1):
        # One more symbol in front of the blocks so far.
        crossed, paid = step[block_step], off[block_step]
        block_off = (block_off[:, None, :] + paid.transpose(0, 2, 1)).reshape(len(queue), -1)
        block_step = crossed.transpose(0, 2, 1).reshape(len(queue), -1)
    way = [[[_way(v, x, s) for s in range(4)] for x in range(SYMBOLS)] for v in queue]
    last = ["", "II", "I", ""]
    return Tables(queue, step, off, block_step, block_off, way, last)


_DIGITS = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)


def cheapest(symbols: np.ndarray) -> tuple[int, str]:
    """Least cost of a conversation and, of all cheapest edits, the ASCII-least letters."""
    t = tables()
    odd = len(symbols) % BLOCK
    blocks = (symbols[odd:].reshape(-1, BLOCK).astype(np.int64) @ _DIGITS).tolist()
    vector, cost, ends = 0, 0, []
    for block in reversed(blocks):
        ends.append(vector)
        cost += int(t.block_off[vector, block])
        vector = int(t.block_step[vector, block])
    letters, state = [], START

    def expand(part: list[int], vector: int, state: int) -> tuple[int, int, int]:
        """Go back through the symbols of a block, then forward along its ways."""
        after, paid = [], 0
        for symbol in reversed(part):
            after.append(vector)
            paid += int(t.off[vector, symbol])
            vector = int(t.step[vector, symbol])
        for symbol, v in zip(part, reversed(after)):
            found, state = t.way[v][symbol][state]
            letters.append(found)
        return state, vector, paid

    state, front, paid = expand(symbols[:odd].tolist(), vector, state)
    cost += paid + t.vectors[front][START]
    for number, end in enumerate(reversed(ends)):
        first = odd + number * BLOCK
        state, _, _ = expand(symbols[first : first + BLOCK].tolist(), end, state)
    return cost, "".join(letters) + t.last[state]


# -- rows ----------------------------------------------------------------------------------

_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def _filled(column: str, fill: str = " ") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(fill))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conv_id, turn, role, text`` after damage, nulls of role and text being one space.

    By crc32 of ``conv_id:turn`` (a null id or turn counts as one space there), modulo 20: 0 drops a
    row, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4 makes
    its role user.
    """
    fate = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _filled("role").alias("role"),
        _filled("text").alias("text"),
        fate.alias("fate"),
    ).filter("fate <> 0")
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = (
        F.when(F.col("fate") == 1, "")
        .when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def marked(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, key, place, initial, fault`` for each row; ``fault`` is the first that applies,
    else empty. A row without ``fault`` names a conversation of ``conversations``.

    ``key`` is a digest of role and text. Rows of a conversation go by turn, nulls first, and equal
    turns by key; a row is a duplicate if one before it has its key. Only digests are shuffled, and once:
    rows are dealt out by conversation, which serves the window here and the sort that follows.
    """
    body = F.rtrim("text", F.lit(_SPACES))
    last = F.substring(body, -1, 1)
    plain = rows.select(
        "conv_id",
        "turn",
        digest("role", "text").alias("key"),
        F.substring("role", 1, 1).alias("initial"),
        (F.length(body) == 0).alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
    )
    named = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    empty = {f.name: F.lit(None).cast(f.dataType) for f in plain.schema.fields[1:]}
    numbered = plain.unionByName(named.withColumns(empty)).repartition("conv_id").selectExpr(
        "*", "row_number() OVER (PARTITION BY conv_id, key ORDER BY turn ASC NULLS FIRST) AS place"
    )
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > 1, "duplicate").when(F.col("cut"), "truncated")
    fault = F.when(F.col("initial").isNotNull(), F.coalesce(fault, F.lit("")))
    return numbered.select("conv_id", "turn", "key", "place", "initial", fault.alias("fault"))


def digest(role: str, text: str) -> Column:
    """16 bytes that tell pairs of role and text apart."""
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), F.col(role), F.col(text))))


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)
_FAULTS = ("blank", "duplicate", "truncated")
_LEGAL = {"su", "ua", "au"}


class _Story:
    """What is known of the conversation that is being read: a byte for each row, and numbers."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.symbols = bytearray()
        self.count = dict.fromkeys(_FAULTS, 0)
        self.illegal = self.distinct = 0
        self.least = self.most = self.before = None

    def add(self, turn, initial: str, fault: str) -> None:
        if turn is not None:
            self.distinct += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.before is not None:
            self.illegal += self.before + initial not in _LEGAL
        self.before = initial
        if fault:
            self.count[fault] += 1
        gone = fault in ("blank", "duplicate")
        self.symbols.append(GONE if gone else symbol_of(initial, fault == "truncated"))

    def report(self) -> tuple:
        cost, audit = cheapest(np.frombuffer(bytes(self.symbols), np.uint8))
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.distinct
        return (self.conv_id, gaps, *self.count.values(), self.illegal, cost, audit)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_pydict({n: pa.array(list(c), k) for n, k, c in zip(names, kinds, columns)})


_REPORT_NAMES = [part.split()[0] for part in REPORT.split(", ")]
_REPORT_KINDS = [pa.int64()] * 7 + [pa.string()]


def _judge(batches):
    """Sorted rows to one report for each conversation; rows without ``fault`` only name one."""
    story = None
    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")]
        for conv_id, turn, initial, fault in zip(*columns):
            if story is None or story.conv_id != conv_id:
                done += [story.report()] if story is not None else []
                story = _Story(conv_id)
            if fault is not None:
                story.add(turn, initial, fault)
        yield _table(done, _REPORT_NAMES, _REPORT_KINDS)
    if story is not None:
        yield _table([story.report()], _REPORT_NAMES, _REPORT_KINDS)


def judge(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A report for each conversation of ``conversations`` on its ``rows``: faults, cost and cheapest edits."""
    ordered = marked(rows, conversations).sortWithinPartitions("conv_id", "turn", "key", "place")
    return bounded_batches(ordered).mapInArrow(_judge, REPORT)


def _rebuild(batches, sha: bool):
    """Sorted rows, each conversation's edits before them, to its repaired rows or to their digest."""
    names, kinds = ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()]
    if not sha:
        names, kinds = ["conv_id", "place", "role", "text", "edit"], [pa.int64(), pa.int64(), *[pa.string()] * 3]
    hashed = conv_id = None
    audit, at, place, state, done = "", 0, 0, START, []

    def leave(role: str, text: str, letter: str) -> None:
        nonlocal place
        if sha:
            hashed.update((("\n" if place else "") + f"{role}:{text}").encode())
        else:
            done.append((conv_id, place, role, text, letter))
        place += 1

    def insert() -> None:
        """Insertions up to the next edit that uses a row up."""
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, FORWARD[state]
            leave(ROLE_OF[state], "", "I")

    def close() -> None:
        if hashed is not None:
            insert()
            if sha:
                done.append((conv_id, hashed.hexdigest()))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")]
        for conv, own, role, text in zip(*columns):
            if own is not None:
                close()
                conv_id, audit, at, place, state, hashed = conv, own, 0, 0, START, hashlib.sha256()
                continue
            insert()
            letter = audit[at]
            at += 1
            if letter != "D":
                first = letter == "K" and state == START and role.startswith("s")
                state = AFTER_S if first else FORWARD[state]
                leave(role if letter == "K" else ROLE_OF[state], text, letter)
        if done:
            yield _table(done, names, kinds)
            done = []
    close()
    yield _table(done, names, kinds)


def _edited(rows: DataFrame, reports: DataFrame, sha: bool) -> DataFrame:
    texts = rows.select(
        "conv_id", F.lit(1).alias("kind"), "turn", digest("role", "text").alias("key"),
        F.lit(None).cast("string").alias("audit"), "role", "text",
    )
    plans = reports.selectExpr(
        "conv_id", "0 AS kind", "cast(NULL AS long) AS turn", "cast(NULL AS binary) AS key", "audit",
        "cast(NULL AS string) AS role", "cast(NULL AS string) AS text",
    )
    ordered = texts.unionByName(plans).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "key")
    out = "conv_id long, repaired_sha256 string" if sha else "conv_id long, place long, role string, text string, edit string"
    return bounded_batches(ordered).mapInArrow(lambda batches: _rebuild(batches, sha), out)


def repaired_rows(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The rows that the edits leave: ``conv_id, place, role, text`` and the ``edit`` each came from."""
    return _edited(rows, reports, sha=False)


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """The report of each conversation with ``repaired_sha256``, the digest of its repaired rows.

    Every distinct ``conv_id`` of the input has one row, null too. Equal turns are ordered by a digest
    of role and text; repeated rows stay apart. A conversation without rows has zeros, empty edits
    and the digest of nothing. Null roles and texts are one space; an empty table gives no rows. Other
    columns are not read. Rows of a conversation are streamed in order through one task, which keeps a
    byte and a letter of each, however many there are.
    """
    kept = conversations.select("conv_id", "turn", "role", "text")
    rows = damaged(kept) if damage else kept.withColumns({c: _filled(c) for c in ("role", "text")})
    reports = materialise(judge(kept, rows), "repairs")
    digests = _edited(rows, reports, sha=True).withColumnRenamed("conv_id", "__conv")
    joined = reports.join(digests, F.col("conv_id").eqNullSafe(F.col("__conv")))
    return joined.drop("__conv")
