"""Removal of byte strings that occur more than once (operator 8).

A byte goes if a string of LENGTH bytes over it also begins anywhere else in any text.

1. Every such string has an anchor, the place of its least gram hash, and equal strings have
   it at the same offset. A run of strings with one anchor is an entry: the gram's hash and
   a hash of the run's bytes. Blocks of texts send their distinct entries to buckets.
2. Entries of equal hashes (64 bits of the gram, 64 of the run) repeat as a whole, which no
   comparison of bytes verifies. Entries that share the gram only are compared
   by content: their bytes meet in the gram's bucket, and the suffixes that begin their
   strings are sorted. The sort is a mergesort whose comparisons find the common extension
   of two suffixes by binary search over prefix polynomial hashes. Neighbours with an
   extension of LENGTH are the repeats; their bytes are compared to rule out collisions.
3. Grams with more than HOT different runs are not sorted in one place. Their strings are
   compared one by one under two hashes of 64 and 16 bits, dealt by the first, each string
   once per block. This is the way for very common passages, at any number exact but
   for collisions of these hashes.
4. The answers return to the blocks, which mark and cut the bytes.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.anchors import PrefixHashes, anchors, mix
from gridlake.llm.arrow import by_bytes, raw_bytes, texts
from gridlake.llm.katz import HISTORY, rows_of, runs, split_rows, squeeze, unsqueeze
from gridlake.sources.scratch import shared_dir

LENGTH = 200
GRAM = 100
HOT = 2000
BLOCK_BYTES = 8 << 20
SEGMENT = 2 << 20
#: What becomes of an entry.
ALONE, REPEATED, COMPARED, HASHED, REPEATED_COMPARED, REPEATED_HASHED = range(6)


def pack_bytes(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(data, asbytes=True) + len(data).to_bytes(8, "little")


def unpack_bytes(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[-8:], "little")
    if not size:
        return np.zeros(0, np.uint8)
    return np.frombuffer(pa.decompress(data[:-8], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)


def make_blocks(batches, size: int = BLOCK_BYTES):
    part, number = TaskContext.get().partitionId(), 0
    for batch in by_bytes(batches, limit=size):
        data, offsets = raw_bytes(texts(batch.column(1)))
        ids = batch.column(0)
        yield rows_of([(part << 32 | number, -1, [
            ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(),
            ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
            offsets.tobytes(), pack_bytes(data.tobytes())])])
        number += 1


class Block:
    """The texts of a block and its entries, in the order of (bucket, gram, bytes)."""

    def __init__(self, parts: list[bytes], buckets: int, length: int, segment: int):
        self.doc_ids, self.nulls = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], bool)
        self.offsets, self.data = np.frombuffer(parts[2], np.int64), unpack_bytes(parts[3])
        self.length, self.segment, found = length, segment, []
        gram = GRAM * length // LENGTH
        for lo in range(0, len(self.data), segment):
            data = self.data[lo:lo + segment + length - 1]
            at = np.searchsorted(self.offsets, lo, side="right")
            stop = np.searchsorted(self.offsets, lo + len(data), side="left")
            bounds = np.clip(self.offsets[at - 1:stop + 1] - lo, 0, len(data))
            ends = np.repeat(bounds[1:], np.diff(bounds))
            hashes = PrefixHashes(data)
            place, grams, first, last = anchors(hashes, ends, gram, length)
            shape = (place - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
            found.append((grams, mix(hashes.of(first, last + length) + mix(shape)), place + lo, first + lo, last + lo))
        found = found or [(np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3]
        grams, runs_, place, first, last = (np.concatenate(x) for x in zip(*found))
        bucket = (mix(grams) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((first, runs_, grams, bucket))
        grams, runs_, bucket = grams[order], runs_[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (runs_[1:] != runs_[:-1])
        #: by occurrence: its entry, first and last begin; by entry: an occurrence, and more
        self.entry, self.first, self.last = np.cumsum(new) - 1, first[order], last[order]
        head = np.flatnonzero(new)
        self.place, self.begin, self.final = place[order][head], self.first[head], self.last[head]
        self.grams, self.runs, self.bucket = grams[head], runs_[head], bucket[head]
        self.many = np.diff([*head, len(order)]) > 1

    def by_bucket(self):
        begin, sizes = runs(self.bucket)
        return [(int(self.bucket[lo]), slice(lo, lo + n)) for lo, n in zip(begin, sizes)]

    def statuses(self, answers: list[tuple[int, list[bytes]]]) -> np.ndarray:
        got = [unsqueeze(p[0], np.uint8) for _, p in sorted(answers, key=lambda r: r[0])]
        return np.concatenate([np.zeros(0, np.uint8), *got])

    def hashed(self, status: np.ndarray, buckets: int):
        """Strings of hot entries: (string hash, second hash, bucket) of distinct ones, in
        order of bucket; and entry, begin, and number of the distinct string, by string."""
        hot = np.flatnonzero((status == HASHED) | (status == REPEATED_HASHED))
        sizes = self.final[hot] - self.begin[hot] + 1
        entry = np.repeat(hot, sizes)
        begin = np.repeat(self.begin[hot] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        one, two = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint16)
        for lo in range(0, len(self.data) if len(begin) else 0, self.segment):
            some = np.flatnonzero((begin >= lo) & (begin < lo + self.segment))
            if len(some):
                data, at = self.data[lo:lo + self.segment + self.length], begin[some] - lo
                one[some] = PrefixHashes(data).of(at, at + self.length)
                two[some] = PrefixHashes(data, 1).of(at, at + self.length) >> np.uint64(48)
        bucket = one % np.uint64(buckets)
        order = np.lexsort((two, one, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        head = order[new]
        return one[head], two[head], bucket[head].astype(np.int64), entry, begin, number


def send_entries(buckets: int, length: int, segment: int):
    def run(batches):
        for batch in batches:
            for number, _, parts in split_rows(pa.Table.from_batches([batch])):
                block = Block(parts, buckets, length, segment)
                yield rows_of([(number, b, [block.grams[s].tobytes(), block.runs[s].tobytes(),
                                            squeeze(block.many[s].astype(np.uint8))]) for b, s in block.by_bucket()])
    return run


def judge_entries(hot: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(split_rows(table), key=lambda r: r[0])
        grams = np.concatenate([np.frombuffer(p[0], np.uint64) for _, _, p in rows])
        own = np.concatenate([np.frombuffer(p[1], np.uint64) for _, _, p in rows])
        many = np.concatenate([unsqueeze(p[2], np.uint8) for _, _, p in rows]).astype(np.int64)
        order = np.lexsort((own, grams))
        new_gram = np.diff(grams[order], prepend=grams[order][:1] + np.uint64(1)) != 0
        new_run = new_gram | (np.diff(own[order], prepend=own[order][:1] + np.uint64(1)) != 0)
        run_of, gram_of = np.cumsum(new_run) - 1, np.cumsum(new_gram) - 1
        copies = np.bincount(run_of, weights=1 + many[order])[run_of]
        kinds = np.bincount(gram_of, weights=new_run)[gram_of]
        found = np.where(copies > 1, REPEATED, ALONE)
        found = np.where((kinds > 1) & (copies == 1), np.where(kinds > hot, HASHED, COMPARED), found)
        # one of the repeated runs is there for the others to compare with
        found = np.where((kinds > 1) & (copies > 1) & new_run, np.where(kinds > hot, REPEATED_HASHED, REPEATED_COMPARED), found)
        status = np.empty(len(order), np.uint8)
        status[order] = found
        out, at = [], 0
        for block, bucket, p in rows:
            n = len(p[0]) // 8
            out.append((block, bucket, [squeeze(status[at:at + n])]))
            at += n
        return pa.Table.from_batches([rows_of(out)])
    return run


def send_contents(buckets: int, length: int, segment: int):
    def run(table: pa.Table) -> pa.Table:
        rows = split_rows(table)
        block = Block(next(p for _, b, p in rows if b < 0), buckets, length, segment)
        status = block.statuses([(b, p) for _, b, p in rows if b >= 0])
        out, number = [], rows[0][0]
        shown = (status == COMPARED) | (status == REPEATED_COMPARED)
        for b, s in block.by_bucket():
            at = np.flatnonzero(shown[s]) + s.start
            if len(at):
                sizes = block.final[at] + length - block.begin[at]
                spans = [block.data[lo:lo + n] for lo, n in zip(block.begin[at].tolist(), sizes.tolist())]
                out.append((number, b, [block.grams[at].tobytes(), squeeze(block.place[at] - block.begin[at]),
                                        squeeze(sizes), pack_bytes(np.concatenate(spans).tobytes())]))
        one, two, bucket, _, _, string = block.hashed(status, buckets)
        times = np.bincount(string, minlength=len(one)) > 1
        begin, sizes = runs(bucket)
        for lo, n in zip(begin, sizes):
            s = slice(lo, lo + n)
            out.append((number, int(bucket[lo]), [one[s].tobytes(), two[s].tobytes(), squeeze(times[s].astype(np.uint8))]))
        return pa.Table.from_batches([rows_of(out)])
    return run


def extension(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, up to length, are equal from a and b on, by binary search."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
    while True:
        middle = (low + high + 1) // 2
        going = low < high
        if not going.any():
            return low
        same = hashes.of(a, a + middle) == hashes.of(b, b + middle)
        low, high = np.where(going & same, middle, low), np.where(going & ~same, middle - 1, high)


def sort_suffixes(data: np.ndarray, hashes: PrefixHashes, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of the starts by (group, the bytes from there, up to length).

    Merges runs of 1, 2, 4, ... suffixes of a group: the place of a suffix in the other run
    is found by binary search, so a merge compares each suffix a logarithmic number of times.
    """
    order = np.argsort(group, kind="stable")
    begin, sizes = runs(group[order])
    lead, size = np.repeat(begin, sizes), np.repeat(sizes, sizes)
    inside = np.arange(len(order)) - lead
    width = 1
    while len(sizes) and width < sizes.max():
        some = np.flatnonzero(size > width)
        pair = inside[some] // (2 * width) * (2 * width)
        right = inside[some] - pair >= width
        low = lead[some] + np.where(right, pair, np.minimum(pair + width, size[some]))
        high = lead[some] + np.minimum(np.where(right, pair + width, pair + 2 * width), size[some])
        other, mine = low.copy(), start[order[some]]
        while True:
            going = np.flatnonzero(low < high)
            if not len(going):
                break
            middle = (low[going] + high[going]) // 2
            theirs, own = start[order[middle]], mine[going]
            k = extension(hashes, theirs, own, length)
            same = k == length
            step = np.minimum(k, length - 1)
            # left runs go before equal suffixes of right runs
            less = np.where(same, right[going], data[theirs + step] < data[own + step])
            low[going] = np.where(less, middle + 1, low[going])
            high[going] = np.where(less, high[going], middle)
        to = lead[some] + pair + (inside[some] - pair - np.where(right, width, 0)) + (low - other)
        placed = order.copy()
        placed[to] = order[some]
        order = placed
        width *= 2
    return order


def compare_contents(length: int, segment: int):
    def contexts(rows):
        """(block, per entry sent: number of the first and last repeated string, or -1)."""
        grams = np.concatenate([np.frombuffer(p[0], np.uint64) for _, _, p in rows])
        before = np.concatenate([unsqueeze(p[1]) for _, _, p in rows])
        sizes = np.concatenate([unsqueeze(p[2]) for _, _, p in rows])
        data = np.concatenate([unpack_bytes(p[3]) for _, _, p in rows])
        at = np.cumsum(sizes) - sizes
        strings = sizes - length + 1
        first, last = np.full(len(grams), -1), np.full(len(grams), -1)
        order = np.argsort(grams, kind="stable")
        heads, n = runs(grams[order].view(np.int64))
        # groups are independent; a bounded number of bytes is sorted at a time
        total = np.add.reduceat(sizes[order], heads)
        cuts = np.flatnonzero(np.diff((np.cumsum(total) - 1) // segment)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(heads)]):
            own = order[heads[lo]:heads[hi - 1] + n[hi - 1]]
            k = strings[own]
            of = np.repeat(np.arange(len(own)), k)
            number = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            base = np.cumsum(sizes[own]) - sizes[own]
            some = np.concatenate([data[at[i]:at[i] + sizes[i]] for i in own.tolist()])
            start = base[of] + number
            _, name = np.unique(grams[own], return_inverse=True)
            # strings are equal only if their anchor has the same offset
            group = name[of] * (length + 1) + before[own][of] - number
            hashes = PrefixHashes(some)
            by = sort_suffixes(some, hashes, start, group, length)
            a, b = by[:-1], by[1:]
            equal = group[a] == group[b]
            equal[equal] = extension(hashes, start[a[equal]], start[b[equal]], length) == length
            found = np.flatnonzero(equal)
            for part in np.array_split(found, 1 + len(found) * length // segment):
                span = np.arange(length)
                equal[part] = (some[start[a[part]][:, None] + span] == some[start[b[part]][:, None] + span]).all(axis=1)
            again = np.zeros(len(start), bool)
            again[a[equal]], again[b[equal]] = True, True
            hit = np.flatnonzero(again)
            entry = own[of[hit]]
            first[entry[::-1]], last[entry] = number[hit][::-1], number[hit]
        out, at = [], 0
        for block, bucket, p in rows:
            m = len(p[0]) // 8
            out.append((block, -2 - bucket, [squeeze(first[at:at + m]), squeeze(last[at:at + m])]))
            at += m
        return out

    def strings(rows):
        one = np.concatenate([np.frombuffer(p[0], np.uint64) for _, _, p in rows])
        two = np.concatenate([np.frombuffer(p[1], np.uint16) for _, _, p in rows])
        times = np.concatenate([unsqueeze(p[2], np.uint8) for _, _, p in rows])
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        again = (np.bincount(number, weights=1 + times.astype(np.int64)) > 1)[number]
        out, at = [], 0
        for block, bucket, p in rows:
            m = len(p[0]) // 8
            out.append((block, -2 - bucket, [squeeze(again[at:at + m].astype(np.uint8))]))
            at += m
        return out

    def run(table: pa.Table) -> pa.Table:
        rows = split_rows(table)
        shown, hashed = ([r for r in rows if len(r[2]) == k] for k in (4, 3))
        return pa.Table.from_batches([rows_of((contexts(shown) if shown else []) + (strings(hashed) if hashed else []))])
    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def removed_bytes(block: Block, rows: list[tuple[int, list[bytes]]], buckets: int) -> np.ndarray:
    status = block.statuses([(b, p) for b, p in rows if b >= 0])
    first, last = np.full(len(status), -1), np.full(len(status), -1)
    whole = np.isin(status, (REPEATED, REPEATED_COMPARED, REPEATED_HASHED))
    first[whole], last[whole] = 0, (block.final - block.begin)[whole]
    shown = np.flatnonzero((status == COMPARED) | (status == REPEATED_COMPARED))
    told = sorted(((-2 - b, p) for b, p in rows if b < -1 and len(p) == 2), key=lambda r: r[0])
    if told:
        f, l = (np.concatenate([unsqueeze(p[i]) for _, p in told]) for i in (0, 1))
        own = status[shown] == COMPARED
        first[shown[own]], last[shown[own]] = f[own], l[own]
    told = sorted(((-2 - b, p) for b, p in rows if b < -1 and len(p) == 1), key=lambda r: r[0])
    if told:
        again = np.concatenate([unsqueeze(p[0], np.uint8) for _, p in told]).astype(bool)
        _, _, _, entry, begin, number = block.hashed(status, buckets)
        hit = np.flatnonzero(again[number] & (status[entry] == HASHED))
        shift = begin[hit] - block.begin[entry[hit]]
        first[entry[hit][::-1]], last[entry[hit]] = shift[::-1], shift
    use = np.flatnonzero(first[block.entry] >= 0)
    step = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(step, block.first[use] + first[block.entry[use]], 1)
    np.add.at(step, block.first[use] + last[block.entry[use]] + block.length, -1)
    return np.cumsum(step[:-1]) > 0


def cut_texts(buckets: int, length: int, segment: int):
    def run(table: pa.Table) -> pa.Table:
        rows = split_rows(table)
        block = Block(next(p for _, b, p in rows if b == -1), buckets, length, segment)
        gone = removed_bytes(block, [(b, p) for _, b, p in rows if b != -1], buckets)
        n_removed, n_spans, kept = [], [], []
        for lo, hi in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            mine = gone[lo:hi]
            n_removed.append(int(np.count_nonzero(mine)))
            n_spans.append(int(np.count_nonzero(mine[1:] & ~mine[:-1])) + int(mine[0]) if hi > lo else 0)
            kept.append(block.data[lo:hi][~mine].tobytes() if n_removed[-1] else block.data[lo:hi].tobytes())
        return pa.table({
            "doc_id": pa.array(block.doc_ids, pa.int64(), mask=block.nulls), "n_bytes": pa.array(np.diff(block.offsets)),
            "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
            "kept": pa.array(kept, pa.binary())})
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   hot: int = HOT, block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for every row.

    Strings are judged on the input. Null and empty texts have no bytes; texts shorter than
    length lose nothing. Repeated rows repeat each other, whatever their ids; null ids are
    kept. Other columns are not read.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(df: DataFrame, purpose: str) -> DataFrame:
        folder = shared_dir(spark, purpose)
        df.write.option("compression", "none").parquet(folder)
        return spark.read.schema(HISTORY).parquet(folder)

    blocks = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                    .mapInArrow(partial(make_blocks, size=block_bytes), HISTORY), "repeat-blocks")
    judged = stored(blocks.mapInArrow(send_entries(buckets, length, segment), HISTORY).groupBy("bucket").applyInArrow(
        judge_entries(hot), HISTORY), "repeat-entries")
    known = blocks.union(judged)
    compared = (known.groupBy("block").applyInArrow(send_contents(buckets, length, segment), HISTORY)
                .groupBy("bucket").applyInArrow(compare_contents(length, segment), HISTORY))
    return known.union(compared).groupBy("block").applyInArrow(cut_texts(buckets, length, segment), RESULT)
