"""Prefix trie of conversations in perfect-hash node tables (operator 11).

A node is a distinct sequence of first turns. Its digest is two 64-bit numbers, each the XOR of
one number per turn that depends on the turn's SHA-256 and on its position, so the digests
of a long conversation's parts can be found apart.

1. Turns without their texts, one row per (conversation, turn, digest) and count, are sorted by
   range and packed to pieces of at most `piece` turns; a conversation of any length is many
   pieces. First turns are exchanged between conversations, then pieces get the digest of
   what is before them from running XORs over pieces.
2. A shard is a bounded number of pieces. It enumerates the distinct digests of its prefixes,
   gives each a slot of a minimal perfect hash table, where the digest is kept and compared,
   and scatters counts, depths and parents' slots into flat arrays. Shards send one row per
   node, so a hot prefix leaves a shard once. Per digest the counts add up, and depth,
   parent and turn must agree: two sequences of one digest are an error, not a result.
3. The totals return to the shards. A node's smallest member owns it. Shards scatter what owned
   nodes count, and add it up through the parents' slots, deepest nodes first. What arrives at
   the beginning of a later piece is handed to the earlier pieces of one of its conversations
   and added up there in a second pass. The shards' sums add up per digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.sources.scratch import shared_dir

PIECE = 1 << 15
SHARD = 1 << 17
#: Most turns that a conversation takes from another one's beginning.
HEAD = 8
#: Bytes of a packed turn: three numbers of its digest, and the length of its text.
TURN = np.dtype([("one", "<u8"), ("two", "<u8"), ("check", "<u8"), ("size", "<i8")])
#: Members of a node whose ids are joined to one text.
ENDS = 8192
_MARK = np.uint64(0x5851F42D4C957F2D)
_WORD = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectTable:
    """A minimal perfect hash over distinct pairs of numbers, with the pairs kept by slot.

    Each level hashes the keys left to twice as many places. A key alone at its place has it;
    the others go on. A key's slot is the rank of its place, so n keys have the slots below n.
    """

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.levels, marks, left, begin = [], [], np.arange(len(one)), 0
        while len(left):
            size = max(64, 2 * len(left))
            place = self._place(one[left], two[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            mark = np.zeros(size, bool)
            mark[place[alone]] = True
            marks.append(mark)
            self.levels.append((begin, size))
            left, begin = left[~alone], begin + size
        self.marks = np.concatenate(marks) if marks else np.zeros(0, bool)
        self.rank = np.cumsum(self.marks) - 1
        self.one, self.two = np.zeros(len(one), np.uint64), np.zeros(len(one), np.uint64)
        slot = self._find(one, two)
        self.one[slot], self.two[slot] = one, two

    @staticmethod
    def _place(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(one ^ mix(two + np.uint64((level + 1) * int(_MARK) & _WORD))) % np.uint64(size)).astype(np.int64)

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        slot, left = np.full(len(one), -1, np.int64), np.arange(len(one))
        for level, (begin, size) in enumerate(self.levels):
            if not len(left):
                break
            place = begin + self._place(one[left], two[left], level, size)
            here = self.marks[place]
            slot[left[here]] = self.rank[place[here]]
            left = left[~here]
        return slot

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for pairs that are not in the table."""
        slot = self._find(one, two)
        if not len(self.one):
            return slot
        same = (slot >= 0) & (self.one[slot] == one) & (self.two[slot] == two)
        return np.where(same, slot, -1)


def distinct(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Positions of the first of each distinct pair."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    return order[new]


def placed(turns: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of turns at positions `first`."""
    at = mix(first.astype(np.uint64) * _MARK + np.uint64(1))
    return mix(turns["one"] ^ at), mix(turns["two"] + at)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def frame(names: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def pack(piece: int):
    """Sorted rows (conv_id, n, digest, size) to pieces (conv_id, place, n, turns)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            times = batch.column(1).to_numpy(zero_copy_only=False)
            turns = np.zeros(batch.num_rows, TURN)
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, 4)
            turns["one"], turns["two"], turns["check"] = raw[:, 0], raw[:, 1], raw[:, 2] ^ raw[:, 3]
            turns["size"] = batch.column(3).to_numpy(zero_copy_only=False)
            ends = np.cumsum(times)
            total = int(ends[-1])
            edges = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            # borders of pieces: new conversations, and every `piece` turns
            starts = np.unique(np.concatenate([(ends - times)[edges], np.arange(0, total, piece)]))
            out: list[list] = [[], [], [], []]
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), total]):
                row = np.searchsorted(ends, np.arange(lo, hi), side="right")
                for column, value in zip(out, (ids[row[0]], part << 32 | number, hi - lo, turns[row].tobytes())):
                    column.append(value)
                number += 1
            yield frame("conv_id place n turns", [
                *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary())])
    return run


def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with (conv_id, turns, before, total, h, n_head, head) to pieces of rebuilt
    conversations: offset, turns, the two numbers of the piece, whether it ends there."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for conv_id, data, before, total, h, n_head, head in zip(*[c.to_pylist() for c in batch.columns]):
            taken = min(h, n_head)
            own = np.frombuffer(data, TURN)[max(0, h - before):]
            offset = taken + max(before - h, 0) if before else 0
            turns = np.concatenate([np.frombuffer(head, TURN)[:taken], own]) if not before else own
            # of a conversation with turns no empty piece goes on
            if not len(turns) and (before or taken + max(total - h, 0)):
                continue
            one, two = placed(turns, offset + np.arange(len(turns)))
            for column, value in zip(out, (
                    conv_id, offset, turns.tobytes(), int(np.bitwise_xor.reduce(one).view(np.int64)) if len(one) else 0,
                    int(np.bitwise_xor.reduce(two).view(np.int64)) if len(two) else 0,
                    offset + len(turns) == taken + max(total - h, 0))):
                column.append(value)
        if out[0]:
            yield frame("conv_id offset turns one two ends", [
                *[pa.array(c, pa.int64()) for c in out[:2]], pa.array(out[2], pa.binary()),
                *[pa.array(c, pa.int64()) for c in out[3:5]], pa.array(out[5], pa.bool_())])


NODES = ("kind int, shard bigint, slot bigint, parent bigint, one bigint, two bigint, parent_one bigint, parent_two bigint, "
         "depth bigint, checked bigint, size bigint, n bigint, least bigint, is_context boolean, has_child boolean")
#: Kinds of rows that a shard sends: its nodes, ends of conversations, pieces of long ones.
A_NODE, AN_END, A_PIECE = range(3)


def nodes_of(pieces: list[tuple], shard: int) -> list[pa.RecordBatch]:
    """Rows of a shard from pieces (conv_id, offset, turns, one, two, ends), one and two the
    digest of what is before the piece."""
    conv = np.array([p[0] for p in pieces], np.int64)
    offset = np.array([p[1] for p in pieces], np.int64)
    turns = np.frombuffer(b"".join(p[2] for p in pieces), TURN)
    start = np.array([(p[3], p[4]) for p in pieces], np.int64).view(np.uint64).reshape(-1, 2)
    length = np.array([len(p[2]) // TURN.itemsize for p in pieces], np.int64)
    begin = np.cumsum(length) - length
    of = np.repeat(np.arange(len(pieces)), length)
    position = np.arange(len(turns)) - begin[of]
    digests = []
    for k, numbers in enumerate(placed(turns, offset[of] + position)):
        run = np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(numbers))) if len(numbers) else np.zeros(1, np.uint64)
        digests.append((run[1:] ^ run[begin][of] ^ start[of, k], run[:-1] ^ run[begin][of] ^ start[of, k]))
    (one, above_one), (two, above_two) = digests

    # pieces of one offset are a trie of their own, whose top is the root or what is before them
    apart = np.where(offset > 0, mix(offset.astype(np.uint64) * _MARK), np.uint64(0))
    later = offset > 0
    table_one = np.concatenate([one, start[:, 0]])
    table_two = np.concatenate([two ^ apart[of], start[:, 1] ^ apart])
    first = distinct(table_one, table_two)
    table = PerfectTable(table_one[first], table_two[first])
    slot = table.slots(table_one, table_two)
    n = len(first)
    rows, heads = slot[:len(turns)], slot[len(turns):]
    parent = np.full(n, -1, np.int64)
    parent[rows] = table.slots(above_one, above_two ^ apart[of])
    marked = np.zeros(n, np.uint64)
    marked[rows], marked[heads] = apart[of], apart
    depth, size, checked = (np.zeros(n, np.int64) for _ in range(3))
    above_by = np.zeros((n, 2), np.uint64)
    depth[rows], size[rows], checked[rows] = offset[of] + position + 1, turns["size"], turns["check"].view(np.int64)
    above_by[rows, 0], above_by[rows, 1] = above_one, above_two
    depth[heads] = offset
    agree = ((depth[rows] == offset[of] + position + 1) & (checked[rows] == turns["check"].view(np.int64))
             & (above_by[rows, 0] == above_one) & (above_by[rows, 1] == above_two))
    if not agree.all():
        raise ValueError("two sequences of turns have one digest")
    count = np.bincount(rows, minlength=n) + np.bincount(heads[~later], minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, rows, conv[of])
    np.minimum.at(least, heads, conv)
    context = np.zeros(n, bool)
    context[heads[later]] = True
    child = np.zeros(n, bool)
    child[parent[parent >= 0]] = True
    nothing = context | (depth == 0)
    node_two = table.two ^ marked

    def kind_rows(kind: int, size_: int, **given) -> pa.RecordBatch:
        names = [f.split()[0] for f in NODES.split(", ")]
        columns = {"kind": np.full(size_, kind, np.int32), "shard": np.full(size_, shard, np.int64), **given}
        empty = {"is_context": pa.bool_(), "has_child": pa.bool_()}
        return pa.RecordBatch.from_arrays([
            columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c]) if c in columns
            else pa.nulls(size_, empty.get(c, pa.int64())) for c in names], names)

    found = [kind_rows(
        A_NODE, n, slot=np.arange(n), parent=parent, one=signed(table.one), two=signed(node_two),
        parent_one=pa.array(above_by[:, 0].view(np.int64), mask=nothing), parent_two=pa.array(above_by[:, 1].view(np.int64), mask=nothing),
        depth=depth, checked=pa.array(checked, mask=nothing), size=pa.array(size, mask=context), n=count, least=least,
        is_context=context, has_child=child)]
    last = np.where(length > 0, rows[np.maximum(begin + length - 1, 0)] if len(rows) else 0, heads)
    ends = np.array([p[5] for p in pieces], bool)
    at = last[ends]
    found.append(kind_rows(AN_END, len(at), one=signed(table.one[at]), two=signed(node_two[at]), least=conv[ends]))
    long = np.flatnonzero((offset > 0) | ~ends)
    found.append(kind_rows(A_PIECE, len(long), slot=last[long], depth=offset[long], least=conv[long]))
    return found


def enumerate_nodes(limit: int):
    """Pieces of a task to shards of about `limit` turns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, turns = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for piece in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(piece)
                turns += 1 + len(piece[2]) // TURN.itemsize
                if turns >= limit:
                    yield from nodes_of(held, part << 32 | number)
                    held, turns, number = [], 0, number + 1
        if held:
            yield from nodes_of(held, part << 32 | number)
    return run


def upwards(parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> None:
    """Add every slot's values to its parent's, deepest slots first, in place."""
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for slots in np.split(order, edges):
        slots = slots[parent[slots] >= 0]
        for value in values:
            np.add.at(value, parent[slots], value[slots])


SUMS = ("one bigint, two bigint, n_children bigint, n_leaves bigint, saved bigint, conv_id bigint, depth bigint, "
        "parent_conv_id bigint, n_convs bigint, handed_to bigint, handed_at bigint")


def _by_slot(table: pa.Table) -> dict[str, np.ndarray]:
    order = np.argsort(table.column("slot").to_numpy())
    return {c: table.column(c).to_numpy()[order] for c in table.column_names}


def accumulate(table: pa.Table) -> pa.Table:
    """Sums of a shard's nodes, from its rows with their totals. Rows of what is before later
    pieces hand their sums to the conversation handed_to, to be added from depth handed_at."""
    node = _by_slot(table)
    parent, depth, n = node["parent"], node["depth"], len(node["slot"])
    own = (node["n"] > 0) & (node["least"] == node["all_least"])
    leaves = (own & ~node["all_child"].astype(bool)).astype(np.int64)
    size = np.nan_to_num(node["size"]).astype(np.int64)
    saved = np.where(own, (node["all_n"] - 1) * size, 0)
    children = np.bincount(parent[own & (parent >= 0)], minlength=n)
    upwards(parent, depth, leaves, saved)
    above = np.where(parent >= 0, node["all_least"][parent], 0)
    context = node["is_context"].astype(bool)
    kept = own | (children > 0) | (leaves > 0) | (saved != 0)
    return pa.table({
        "one": node["one"][kept], "two": node["two"][kept], "n_children": children[kept],
        "n_leaves": leaves[kept], "saved": saved[kept],
        "conv_id": pa.array(node["all_least"][kept], mask=~own[kept]), "depth": pa.array(depth[kept], mask=~own[kept]),
        "parent_conv_id": pa.array(above[kept], mask=(~own | (depth == 0))[kept]),
        "n_convs": pa.array(node["all_n"][kept], mask=~own[kept]),
        "handed_to": pa.array(node["least"][kept], mask=~context[kept]),
        "handed_at": pa.array(depth[kept], mask=~context[kept])})


def accumulate_handed(table: pa.Table) -> pa.Table:
    """Sums handed to slots of a shard, added up through it."""
    told = table.filter(table.column("is_told"))
    node = _by_slot(table.filter(pc.invert(table.column("is_told"))))
    leaves, saved = (np.zeros(len(node["slot"]), np.int64) for _ in range(2))
    at = told.column("slot").to_numpy()
    np.add.at(leaves, at, told.column("n_leaves").to_numpy())
    np.add.at(saved, at, told.column("saved").to_numpy())
    upwards(node["parent"], node["depth"], leaves, saved)
    kept = ((leaves > 0) | (saved != 0)) & ~node["is_context"].astype(bool)
    return pa.table({"one": node["one"][kept], "two": node["two"][kept], "n_leaves": leaves[kept], "saved": saved[kept]})


def stored(df: DataFrame, purpose: str) -> DataFrame:
    folder = shared_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def starts_of(conversations: DataFrame, piece: int) -> DataFrame:
    """conv_id, turns, before, total, h, n_head, head: pieces, and what they take from others."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("by"), F.octet_length(text).cast("long").alias("size"))
    counted = rows.groupBy("conv_id", "turn", "role", "by", "digest", "size").agg(F.count("*").alias("n"))
    order = ["conv_id", "turn", "role", "by"]
    pieces = stored(
        counted.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "n", "digest", "size")
        .mapInArrow(pack(piece), "conv_id bigint, place bigint, n bigint, turns binary"), "trie-pieces")
    own = Window.partitionBy("conv_id")
    slim = pieces.select(
        "conv_id", "place", F.coalesce(F.sum("n").over(
            own.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(own).alias("total"), F.substring("turns", 1, HEAD * TURN.itemsize).alias("begin"))
    # the first turns of every fifth conversation, from the few pieces that hold them
    kept = F.array_sort(F.collect_list(F.struct("before", "begin")))
    heads = slim.where(f"before < {HEAD} AND conv_id % 5 = 0").groupBy(F.col("conv_id").alias("g")).agg(
        F.substring(F.aggregate(kept, F.lit(b""), lambda a, x: F.concat(a, x["begin"])), 1, HEAD * TURN.itemsize).alias("head"))
    asked = slim.drop("begin").withColumn("g", F.expr("conv_id - conv_id % 5")).join(heads, "g", "left").select(
        "conv_id", "place", "before", "total", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"),
        F.coalesce(F.octet_length("head") / TURN.itemsize, F.lit(0)).cast("long").alias("n_head"),
        F.when(F.col("before") == 0, F.coalesce("head", F.lit(b""))).otherwise(F.lit(b"")).alias("head"))
    return pieces.join(asked, ["conv_id", "place"]).select("conv_id", "turns", "before", "total", "h", "n_head", "head")


def agreed(name: str) -> Column:
    digest = Window.partitionBy("one", "two")
    return F.min(name).over(digest).eqNullSafe(F.max(name).over(digest))


@dataclass
class Trie:
    """nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, one, two (the digest). ends: one, two, conv_id of conversations that end there."""

    nodes: DataFrame
    ends: DataFrame


def build(conversations: DataFrame, piece: int = PIECE, shard: int = SHARD) -> Trie:
    """The trie of rebuilt conversations.

    Turns stand in the order of turn (nulls first), role and SHA-256 of the text; null roles
    and texts are empty. Rows that are equal are equal turns. Rows without a conv_id belong to
    no conversation and are not read. A conversation takes its first h turns, h = crc32 of its
    id modulo 9, from conversation c - c % 5 (of its sign), none if that has no rows. Other
    columns are not read. An empty table has no node. Two sequences of turns with one digest
    raise an error.
    """
    pieces = stored(starts_of(conversations, piece).mapInArrow(
        rebuild, "conv_id bigint, offset bigint, turns binary, one bigint, two bigint, ends boolean"), "trie-rebuilt")
    # digests of what is before a piece; only conversations of several pieces have some
    earlier = Window.partitionBy("conv_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    later = pieces.where("offset > 0").select("conv_id").distinct()
    before = pieces.select("conv_id", "offset", "one", "two").join(later, "conv_id", "left_semi").select(
        "conv_id", "offset", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0).cast("long")).alias(f"{c}_before") for c in ("one", "two")])
    begun = pieces.drop("one", "two").join(before, ["conv_id", "offset"], "left").select(
        "conv_id", "offset", "turns", F.coalesce("one_before", F.lit(0)).alias("one"), F.coalesce("two_before", F.lit(0)).alias("two"), "ends")
    sent = stored(begun.mapInArrow(enumerate_nodes(shard), NODES), "trie-nodes")
    digest = Window.partitionBy("one", "two")
    same = agreed("depth") & agreed("parent_one") & agreed("parent_two") & agreed("checked") & agreed("size")
    local = sent.where(F.col("kind") == A_NODE).select(
        "shard", "slot", "parent", "one", "two", "depth", "size", "n", "least", "is_context",
        F.sum("n").over(digest).alias("all_n"),
        F.min(F.when(~F.col("is_context"), F.col("least"))).over(digest).alias("all_least"),
        F.max("has_child").over(digest).alias("all_child"), same.alias("same"))
    checked = F.when(F.col("same"), F.col("size")).otherwise(
        F.raise_error(F.lit("two sequences of turns have one digest")).cast("long"))
    local = stored(local.withColumn("size", checked).drop("same"), "trie-totals")
    sums = stored(local.groupBy("shard").applyInArrow(accumulate, SUMS), "trie-sums")

    # what arrives before a later piece goes to all earlier pieces of one of its conversations
    handed = sums.where("handed_to IS NOT NULL").groupBy(
        F.col("handed_to").alias("conv_id"), F.col("handed_at").alias("offset")).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    following = Window.partitionBy("conv_id").orderBy("offset").rowsBetween(1, Window.unboundedFollowing)
    parts = sent.where(F.col("kind") == A_PIECE).select("shard", "slot", F.col("least").alias("conv_id"), F.col("depth").alias("offset"))
    told = parts.join(handed, ["conv_id", "offset"], "left").select(
        "shard", "slot", *[F.coalesce(F.sum(c).over(following), F.lit(0)).alias(c) for c in ("n_leaves", "saved")]).where(
        "n_leaves <> 0 OR saved <> 0")
    wanted = local.join(told.select("shard").distinct(), "shard", "left_semi").select(
        "shard", "slot", "parent", "one", "two", "depth", "is_context", F.lit(0).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved"), F.lit(False).alias("is_told"))
    none = F.lit(0).cast("long")
    second = wanted.unionByName(told.select(
        "shard", "slot", none.alias("parent"), none.alias("one"), none.alias("two"), none.alias("depth"),
        F.lit(False).alias("is_context"), "n_leaves", "saved", F.lit(True).alias("is_told"))).groupBy("shard").applyInArrow(
        accumulate_handed, "one bigint, two bigint, n_leaves bigint, saved bigint")

    counts = sums.select(
        "one", "two", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        *[F.when(F.col("handed_to").isNull(), F.col(c)).otherwise(0).alias(c) for c in ("n_leaves", "saved")])
    nodes = counts.unionByName(second, allowMissingColumns=True).groupBy("one", "two").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")],
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = sent.where(F.col("kind") == AN_END).select("one", "two", F.col("least").alias("conv_id"))
    return Trie(nodes, ends)


def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (one, two, conv_id) to texts of up to ENDS comma-joined ids of a node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.ones(len(ids), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        starts = np.unique(np.concatenate([np.flatnonzero(new), np.arange(0, len(ids), ENDS)]))
        texts = [",".join(map(str, ids[lo:hi].tolist())) for lo, hi in zip(starts, [*starts[1:], len(ids)])]
        yield frame("one two first ids", [one[starts], two[starts], ids[starts], pa.array(texts, pa.string())])


def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts of ids to one SHA-256 per node, hashed as they pass."""
    node, digest = None, None
    for batch in batches:
        out = []
        for one, two, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)]):
            if (one, two) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (one, two), hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(("," + ids).encode())
        if out:
            yield frame("one two ends_sha256", [pa.array(c) for c in zip(*out)])
    if node is not None:
        yield frame("one two ends_sha256", [[node[0]], [node[1]], [digest.hexdigest()]])


def with_ends(trie: Trie) -> DataFrame:
    """The nodes with the SHA-256 of the ids of the conversations that end at each."""
    order = ["one", "two", "conv_id"]
    texts = (trie.ends.repartitionByRange(*order).sortWithinPartitions(*order)
             .mapInArrow(join_ids, "one bigint, two bigint, first bigint, ids string"))
    hashed = texts.repartition("one", "two").sortWithinPartitions("one", "two", "first").mapInArrow(
        hash_ids, "one bigint, two bigint, ends_sha256 string")
    return trie.nodes.join(hashed, ["one", "two"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
