"""Conversation structure repair by run-length dynamic programming (operator 12).

Edits keep a turn (K), change its role (R), delete it (D) or insert an empty one (I), so that
the initials of the roles read (s?(ua)+)? at least cost.

1. Rows without their texts, one per (conversation, turn, role, digest of the text) and count,
   tell which turns are blank, repeated or cut off. They are sorted by range, so that a
   conversation of any length is spread over tasks, and packed to one byte per turn.
2. The bytes of a conversation, one symbol of role and fault each and no longer than its
   audit, meet in one task. Equal symbols in a row are one run. A symbol is a 4 x 4 matrix over
   (min, +) between what stands last: nothing, s, u or a; inserts are part of it. A run of n
   is the n-th power, from cached binary powers. From the end this gives the cost to go at
   the runs' borders; from the beginning each run is unrolled, taking the least letter that
   keeps to the cost.
3. The texts are shuffled once, sorted behind their conversation's bytes, and pass as a
   stream. No conversation's texts are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.arrow import by_bytes

NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
ROLE, DROP, INSERT, CUT_OFF = 3, 4, 3, 3
#: What stands last, and kinds of roles; a symbol is kind + 4 * fault.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 0
GOOD, CUT, REPEATED, BLANK = range(4)
#: What stands last after the next turn of the pattern, by what stands last.
NEXT = [USER, USER, ASSISTANT, USER]
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 50
PIECE = 1 << 16
#: Audits that a task keeps, and the most turns of such a conversation.
KEPT_AUDITS, KEPT_TURNS = 100_000, 64
REPORT = ("struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>")
REPAIRED = f"conv_id bigint, position bigint, edit string, role string, text string, report {REPORT}"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrices over (min, +)."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), FAR)


def insertions() -> np.ndarray:
    """Least cost of any number of inserts between two states."""
    one = np.full((4, 4), FAR, np.int64)
    for state, after in enumerate(NEXT):
        one[state, after] = INSERT
    np.fill_diagonal(one, 0)
    return product(product(one, one), product(one, one))


def takes(symbol: int) -> tuple[bool, int, int]:
    """(whether it must go, what a turn that stays costs besides, its kind)."""
    kind, fault = symbol & 3, symbol >> 2
    return fault >= REPEATED, CUT_OFF if fault == CUT else 0, kind


def fits(state: int, kind: int) -> bool:
    return kind == SYSTEM and state == EMPTY or kind != SYSTEM and NEXT[state] == kind


def transition(symbol: int) -> np.ndarray:
    """Least cost from state to state over one turn of this symbol and inserts before it."""
    gone, extra, kind = takes(symbol)
    step = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(step, DROP)
    if not gone:
        for state, after in enumerate(NEXT):
            step[state, after] = min(step[state, after], ROLE + extra)
            if fits(state, kind):
                step[state, kind] = min(step[state, kind], extra)
    return product(INSERTIONS, step)


INSERTIONS = insertions()
#: Cost to go behind the last turn: nothing or an assistant's turn may stand there.
AT_END = product(INSERTIONS, np.array([[0], [FAR], [FAR], [0]]))[:, 0]


class Repair:
    """Cached binary powers of the symbols' matrices, and audits of short conversations."""

    def __init__(self):
        self.powers: dict[int, list[np.ndarray]] = {}
        self.audits: dict[bytes, tuple[int, str]] = {}

    def power(self, symbol: int, bit: int) -> np.ndarray:
        """The matrix of 2 ** bit turns."""
        known = self.powers.setdefault(symbol, [])
        while len(known) <= bit:
            known.append(product(known[-1], known[-1]) if known else transition(symbol))
        return known[bit]

    def before(self, symbol: int, length: int, togo: np.ndarray) -> np.ndarray:
        """Cost to go in front of a run, from the cost to go behind it."""
        for bit in range(length.bit_length()):
            if length >> bit & 1:
                togo = product(self.power(symbol, bit), togo[:, None])[:, 0]
        return togo

    def inside(self, symbol: int, length: int, togo: np.ndarray) -> list[list[int]]:
        """Cost to go in front of each turn of a run, and behind the run."""
        found = togo[None, :]  # by number of turns up to the run's end
        bit = 0
        while len(found) <= length:
            found = np.concatenate([found, product(self.power(symbol, bit)[None], found[:, :, None])[:, :, 0]])
            bit += 1
        return found[length::-1].tolist()

    def audit(self, symbols: bytes) -> tuple[int, str]:
        """(least cost, least of the audits that have it)."""
        known = self.audits.get(symbols)
        if known is None:
            known = self._audit(symbols)
            if len(symbols) <= KEPT_TURNS and len(self.audits) < KEPT_AUDITS:
                self.audits[symbols] = known
        return known

    def _audit(self, symbols: bytes) -> tuple[int, str]:
        row = np.frombuffer(symbols, np.uint8)
        first = np.flatnonzero(np.diff(row, prepend=255))
        # the costs inside one run are held at a time
        edges = np.unique(np.concatenate([first, np.arange(0, len(row), PIECE)])) if len(row) else first
        runs = list(zip(row[edges].tolist(), np.diff([*edges, len(row)]).tolist()))
        behind = [AT_END]
        for symbol, length in reversed(runs):
            behind.append(self.before(symbol, length, behind[-1]))
        behind.reverse()
        letters, state = [], EMPTY
        for (symbol, length), togo in zip(runs, behind[1:]):
            letters, state = self._unroll(symbol, self.inside(symbol, length, togo), letters, state)
        while state in (SYSTEM, USER):
            letters.append("I")
            state = NEXT[state]
        return int(behind[0][EMPTY]), "".join(letters)

    @staticmethod
    def _unroll(symbol: int, togo: list[list[int]], letters: list[str], state: int):
        gone, extra, kind = takes(symbol)
        for here, after in zip(togo, togo[1:]):
            while True:
                left, follow = here[state], NEXT[state]
                if DROP + after[state] == left:
                    letters.append("D")
                    break
                if INSERT + here[follow] == left:
                    letters.append("I")
                    state = follow
                    continue
                if not gone and fits(state, kind) and extra + after[kind] == left:
                    letters.append("K")
                    state = kind
                    break
                letters.append("R")
                state = follow
                break
        return letters, state


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, kind, blank, again, cut, n) to pieces of conversations."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, turn = batch.column(0), batch.column(1)
        turns, timed = turn.fill_null(0).to_numpy(zero_copy_only=False), turn.is_valid().to_numpy(zero_copy_only=False)
        kind, blank, again, cut, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 7))
        first = np.where(blank, BLANK, np.where(again, REPEATED, np.where(cut, CUT, GOOD)))
        other = np.where(blank, BLANK, REPEATED)
        ids, named = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_valid().to_numpy(zero_copy_only=False)
        fresh = np.ones(n, bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (named[1:] != named[:-1])
        begins = np.flatnonzero(fresh)
        out = []
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), n]):
            seen = turns[lo:hi][timed[lo:hi]]
            span = (int(seen[0]), int(seen[-1]), int((np.diff(seen) != 0).sum()) + 1) if len(seen) else (None, None, 0)
            total = int(times[lo:hi].sum())
            ends = np.cumsum(times[lo:hi])
            for at in range(0, max(total, 1), PIECE):
                place = np.arange(at, min(at + PIECE, total))
                row = np.searchsorted(ends, place, side="right")
                head = place == (ends - times[lo:hi])[row]
                fault = np.where(head, first[lo:hi][row], other[lo:hi][row])
                symbols = (kind[lo:hi][row] + 4 * fault).astype(np.uint8).tobytes()
                out.append((ids[lo] if named[lo] else None, part << 32 | number, symbols, *(span if not at else (None, None, 0))))
                number += 1
        columns = list(zip(*out))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()),
             *[pa.array(c, pa.int64()) for c in columns[3:]]], ["conv_id", "place", "symbols", "low", "high", "turns"])


PIECES = "conv_id bigint, place bigint, symbols binary, low bigint, high bigint, turns bigint"
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_LAWFUL = np.array([[(a, b) in _LEGAL for b in range(4)] for a in range(4)])


class Talk:
    """One conversation as it passes: its pieces first, then its turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols, self.spans, self.letters = conv_id, [], [], None

    def piece(self, symbols: bytes, low: int | None, high: int | None, turns: int) -> None:
        self.symbols.append(symbols)
        if turns:
            self.spans.append((low, high, turns))

    def report(self, repair: Repair) -> dict:
        symbols = b"".join(self.symbols)
        self.symbols = []
        row = np.frombuffer(symbols, np.uint8)
        cost, self.letters = repair.audit(symbols)
        self.at, self.state, self.count = 0, EMPTY, 0
        faults = np.bincount(row >> 2, minlength=4)
        kind = row & 3
        distinct = sum(n for _, _, n in self.spans) - sum(a[1] == b[0] for a, b in zip(self.spans, self.spans[1:]))
        gaps = self.spans[-1][1] - self.spans[0][0] + 1 - distinct if self.spans else 0
        return {"gaps": gaps, "blank": int(faults[BLANK]), "duplicate": int(faults[REPEATED]), "truncated": int(faults[CUT]),
                "illegal": int((~_LAWFUL[kind[:-1], kind[1:]]).sum()), "cost": cost, "audit": self.letters}

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield self._row("I", NAMES[self.state], "")

    def turn(self, role: str, text: str, kind: int) -> Iterator[tuple]:
        yield from self.inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "D":
            return
        self.state = kind if letter == "K" else NEXT[self.state]
        yield self._row(letter, role if letter == "K" else NAMES[self.state], text)

    def _row(self, letter: str, role: str, text: str) -> tuple:
        self.count += 1
        return self.conv_id, self.count, letter, role, text, None


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces and turns to reports (position 0) and repaired turns, in order."""
    repair, talk, schema = Repair(), None, pa.schema([
        ("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
        ("report", pa.struct([(n, pa.string() if n == "audit" else pa.int64()) for n in
                              ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")]))])

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def told(talk: Talk) -> tuple:
        return talk.conv_id, 0, None, None, None, talk.report(repair)

    def rest(talk: Talk) -> list[tuple]:
        return ([told(talk)] if talk.letters is None else []) + list(talk.inserts())

    for batch in by_bytes(batches):
        rows = []
        columns = [column.to_pylist() for column in batch.columns]
        for conv_id, is_turn, symbols, low, high, turns, role, text, kind in zip(*columns):
            if talk is None or conv_id != talk.conv_id:
                if talk is not None:
                    rows += rest(talk)
                talk = Talk(conv_id)
            if not is_turn:
                talk.piece(symbols, low, high, turns)
                continue
            if talk.letters is None:
                rows.append(told(talk))
            rows += talk.turn(role, text, kind)
        if rows:
            yield frame(rows)
    rows = rest(talk) if talk is not None else []
    if rows:
        yield frame(rows)


def read_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of role and text as one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Turns damaged by crc32 of `conv_id:turn` modulo 20, a null as one space: 0 drops the
    turn, 1 empties it, 2 takes its . ! ? away, 3 repeats it, 4 makes it the user's."""
    rows = read_turns(conversations)
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    code = F.crc32(name.cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.withColumn("code", code).where("code <> 0").select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """REPAIRED: per conversation a report at position 0, and from 1 on the repaired turns.

    Turns stand in the order of turn (nulls first), role and SHA-256 of the text; equal rows
    are equal turns. Null roles and texts are one space. Rows with a null conv_id are one
    conversation. A turn's first fault counts: blank, repeated (an earlier turn of the
    conversation has its role and text), cut off (its last character is none of . ! ?).
    `gaps` are the numbers missing between the least and the greatest turn. Of `ids` (a column
    conv_id) those without turns get an empty report. Other columns are not read. All rows of
    a conversation stand together, in order, in one partition of the result.
    """
    rows = read_turns(conversations)
    digest = F.unhex(F.sha2("text", 256))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    rows = rows.withColumns({"digest": digest, "kind": kind})
    counted = rows.groupBy(
        "conv_id", "turn", "role", "digest", "kind", (~F.col("text").rlike(NOT_BLANK)).alias("blank"),
        (~F.col("text").rlike(ENDED)).alias("cut")).agg(F.count("*").alias("n"))
    # only texts that stand at several turns can be repeated by another turn
    several = counted.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct("turn")).alias("least"), F.count("*").alias("places")).where("places > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "least")
    marked = counted.join(several, F.expr("conv_id <=> c AND role = r AND digest = d"), "left").select(
        "conv_id", "turn", "kind", "blank", F.expr("least IS NOT NULL AND NOT (turn <=> least.turn)").alias("again"), "cut", "n",
        "role", "digest")
    # ids without turns pass as marks without copies
    if ids is not None:
        marked = marked.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().selectExpr(
            "conv_id", "cast(NULL AS bigint) AS turn", "0 AS kind", "false AS blank", "false AS again", "false AS cut",
            "0L AS n", "'' AS role", "cast('' AS binary) AS digest"))
    order = ["conv_id", "turn", "role", "digest"]
    pieces = (marked.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("conv_id", "turn", "kind", "blank", "again", "cut", "n").mapInArrow(pack, PIECES))
    stream = pieces.selectExpr(
        "conv_id", "false AS is_turn", "symbols", "low", "high", "turns", "cast(NULL AS string) AS role",
        "cast(NULL AS string) AS text", "0 AS kind", "place", "cast(NULL AS bigint) AS turn", "cast(NULL AS binary) AS digest")
    stream = stream.unionByName(rows.selectExpr(
        "conv_id", "true AS is_turn", "cast(NULL AS binary) AS symbols", "cast(NULL AS bigint) AS low",
        "cast(NULL AS bigint) AS high", "0L AS turns", "role", "text", "kind", "0L AS place", "turn", "digest"))
    return (stream.repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", "place", "turn", "role", "digest")
            .drop("place", "turn", "digest").mapInArrow(follow, REPAIRED))


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of repair() to conv_id, report and the SHA-256 of `role:text` lines."""
    held, digest, lines = None, None, 0
    report = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([held], pa.int64()), report, pa.array([digest.hexdigest()])], ["conv_id", "report", "repaired_sha256"])

    for batch in batches:
        ready = []
        for at, (conv_id, position, role, text) in enumerate(zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)])):
            if position == 0:
                if digest is not None:
                    ready.append(done())
                held, digest, lines, report = conv_id, hashlib.sha256(), 0, batch.column(5).slice(at, 1)
                continue
            digest.update((("\n" if lines else "") + role + ":" + text).encode())
            lines += 1
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
    if digest is not None:
        yield done()


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of repair()'s result: the report and the digest of the turns."""
    return repaired.mapInArrow(fold, f"conv_id bigint, report {REPORT}, repaired_sha256 string").select(
        "conv_id", "report.*", "repaired_sha256")
