"""Bigram language model with Katz backoff (operator 6).

Counts c of words and word pairs come from the training texts. A pair seen r times has
probability d(r) * r / c(history), d the Good-Turing discount (1 beyond CUT); other pairs
get backoff(history) * p(word), and words d(r) * r / N. What the discounts take from words
goes to one class of unknown words. backoff is what the pairs of a history leave, divided by
what their words leave of the word distribution, so every history adds up to 1.

Texts are read once, into blocks of word codes. Blocks send the distinct words, then the
distinct pairs they hold to buckets and get counts back; a hot history is cut into salts by
the next word. The driver sees counts of counts only. Tables of words, pairs and histories
are stored by bucket. Words are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.arrow import by_bytes, texts
from gridlake.llm.quality import in_fold, split_words
from gridlake.sources.scratch import shared_dir

CUT = 5
BLOCK_BYTES = 16 << 20
#: Ids of the start of a text, and the first id of a word.
BEGIN, FIRST_ID = 1, 2
END = xxhash.xxh3_64_intdigest(b"\0end of text")
HISTORY = "block long, bucket long, parts array<binary>"
_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("parts", pa.list_(pa.binary()))])


def squeeze(numbers: np.ndarray) -> bytes:
    """An array by byte planes, compressed; high planes are mostly zero."""
    numbers = np.ascontiguousarray(numbers)
    planes = numbers.view(np.uint8).reshape(-1, numbers.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) + len(planes.tobytes()).to_bytes(8, "little")


def unsqueeze(data: bytes, kind: type = np.int64) -> np.ndarray:
    size = int.from_bytes(data[-8:], "little")
    raw = pa.decompress(data[:-8], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def rows_of(rows: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.list_(pa.binary()))], schema=_SCHEMA)


def discounts(of: np.ndarray, cut: int = CUT) -> np.ndarray:
    """d(0..cut) from of[r], the number of types seen r times, r to cut + 1.

    Should the counts of counts be too thin for Good-Turing to give discounts between 0 and
    1, fewer of them are discounted; if none can be, all counts up to cut lose a half.
    """
    for k in range(cut, 0, -1):
        n = of.astype(float)
        if (n[1:k + 2] <= 0).any():
            continue
        common = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        d = ((r + 1) * n[2:k + 2] / (r * n[1:k + 1]) - common) / (1 - common) if common < 1 else np.full(k, -1.0)
        if ((d > 0) & (d < 1)).all():
            return np.concatenate(([0.0], d, np.ones(cut - k)))
    r = np.arange(1, cut + 1)
    return np.concatenate(([0.0], (r - 0.5) / r))


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


class Words:
    """The word distribution from counts of counts."""

    def __init__(self, total: int, types: int, of: np.ndarray):
        self.total, self.types, self.d = total, types, discounts(of)
        r = np.arange(len(self.d))
        self.unknown = float((of[:len(self.d)] * r * (1 - self.d)).sum() / total) if total else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / max(self.total, 1), self.unknown)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


class Dealer:
    """Which bucket holds a pair, and which the totals of a history."""

    def __init__(self, buckets: int, total: int):
        self.buckets, self.salt_size = buckets, max(1000, total // (4 * buckets))

    def history(self, h: np.ndarray) -> np.ndarray:
        return (mixed(h) % np.uint64(self.buckets)).astype(np.int64)

    def pair(self, h: np.ndarray, w: np.ndarray, seen: np.ndarray) -> np.ndarray:
        salts = (1 + seen // self.salt_size).astype(np.uint64)
        salt = mixed(w) % salts
        return ((mixed(h) + salt * np.uint64(0x9E3779B1)) % np.uint64(self.buckets)).astype(np.int64)


def make_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """doc_id, held_out, text -> one row per block of about size bytes: documents, word
    hashes, codes."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in by_bytes(batches, limit=size):
        owner, codes, words = split_words(pc.ascii_lower(texts(batch.column(2))))
        used, codes = np.unique(codes, return_inverse=True)
        names = words.cast(pa.large_binary()).take(pa.array(used)).to_pylist()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
        lengths = np.bincount(owner, minlength=batch.num_rows)
        ids = batch.column(0)
        yield rows_of([(part << 32 | number, -1, [
            ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(),
            ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
            batch.column(1).to_numpy(zero_copy_only=False).tobytes(),
            squeeze(lengths.astype(np.int64)), hashes.tobytes(), squeeze(codes.astype(np.uint32))])])
        number += 1


class Block:
    """Tokens of a block. Code len(hashes) is the end of a text, the next one its start."""

    def __init__(self, parts: list[bytes]):
        ids, nulls, held, lengths, hashes, codes = parts
        self.doc_ids, self.nulls = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool)
        self.held_out, lengths = np.frombuffer(held, bool), unsqueeze(lengths)
        self.hashes = np.concatenate((np.frombuffer(hashes, np.uint64), np.array([END], np.uint64)))
        end = len(self.hashes) - 1
        self.lengths = lengths + 1
        ends = np.cumsum(self.lengths) - 1
        self.codes = np.empty(int(self.lengths.sum()), np.int64)
        inside = np.ones(len(self.codes), bool)
        inside[ends] = False
        self.codes[inside] = unsqueeze(codes, np.uint32)
        self.codes[ends] = end
        self.before = np.concatenate(([end + 1], self.codes[:-1]))
        self.before[ends - lengths] = end + 1
        self.doc = np.repeat(np.arange(len(lengths)), self.lengths)
        self.trained = ~self.held_out[self.doc]

    def learn(self, answers: list[tuple[int, list[bytes]]], buckets: int) -> None:
        """Ids and counts of the block's words, from the buckets' answers."""
        self.ids, self.seen = np.empty(len(self.hashes) + 1, np.int64), np.empty(len(self.hashes) + 1, np.int64)
        dealt = (self.hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(dealt, kind="stable")
        got = [(unsqueeze(a), unsqueeze(c)) for _, (a, c) in sorted(answers, key=lambda r: r[0])]
        self.ids[order] = np.concatenate([g[0] for g in got])
        self.seen[order] = np.concatenate([g[1] for g in got])
        self.ids[-1], self.seen[-1] = BEGIN, self.seen[-2]

    def pairs(self, dealer: Dealer) -> tuple[np.ndarray, ...]:
        """(bucket, history code, word code, training count) of distinct pairs by (bucket,
        history id, word id), and the number of each token's pair."""
        width = len(self.hashes) + 1
        key, place = np.unique(self.before * width + self.codes, return_inverse=True)
        h, w = key // width, key % width
        count = np.bincount(place, weights=self.trained, minlength=len(key)).astype(np.int64)
        bucket = dealer.pair(self.ids[h], self.ids[w], self.seen[h])
        order = np.lexsort((self.ids[w], self.ids[h], bucket))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return bucket[order], h[order], w[order], count[order], back[place]


def split_rows(table: pa.Table) -> list[tuple[int, int, list[bytes]]]:
    return list(zip(*(table.column(c).to_pylist() for c in ("block", "bucket", "parts"))))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where runs of equal values begin, their lengths)."""
    begin = np.flatnonzero(np.diff(values, prepend=values[0] - 1)) if len(values) else np.zeros(0, np.int64)
    return begin, np.diff([*begin, len(values)])


def send_words(buckets: int):
    def run(batches):
        for batch in batches:
            for number, _, parts in split_rows(pa.Table.from_batches([batch])):
                block = Block(parts)
                count = np.bincount(block.codes[block.trained], minlength=len(block.hashes)).astype(np.int64)
                dealt = (block.hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(dealt, kind="stable")
                cuts = np.searchsorted(dealt[order], np.arange(buckets + 1))
                yield rows_of([(number, b, [block.hashes[order[lo:hi]].tobytes(), squeeze(count[order[lo:hi]])])
                               for b, lo, hi in zip(range(buckets), cuts, cuts[1:]) if hi > lo])
    return run


def count_words(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Answers to the blocks, and under block -1 total, types and counts of counts."""
        rows = split_rows(table)
        hashes = [np.frombuffer(p[0], np.uint64) for _, _, p in rows]
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([unsqueeze(p[1]) for _, _, p in rows])).astype(np.int64)
        of = np.bincount(np.minimum(count, CUT + 2), minlength=CUT + 3)[:CUT + 2]
        out = [(-1, rows[0][1], [np.array([count.sum(), (count > 0).sum(), *of], np.int64).tobytes()])]
        ends = np.cumsum([len(h) for h in hashes])
        for (block, bucket, _), hi, n in zip(rows, ends, map(len, hashes)):
            at = place[hi - n:hi]
            out.append((block, bucket, [squeeze(at * buckets + bucket + FIRST_ID), squeeze(count[at])]))
        return pa.Table.from_batches([rows_of(out)])
    return run


def send_pairs(dealer: Dealer):
    def run(table: pa.Table) -> pa.Table:
        rows = split_rows(table)
        block = Block(next(p for _, b, p in rows if b < 0))
        block.learn([(b, p) for _, b, p in rows if b >= 0], dealer.buckets)
        bucket, h, w, count, _ = block.pairs(dealer)
        out = []
        begins, sizes = runs(bucket)
        for lo, n in zip(begins, sizes):
            part = slice(lo, lo + n)
            heads, lengths = runs(block.ids[h[part]])
            out.append((rows[0][0], int(bucket[lo]), [
                squeeze(block.ids[h[part]][heads]), squeeze(lengths.astype(np.uint32)), squeeze(block.ids[w[part]]),
                squeeze(block.seen[w[part]]), squeeze(count[part])]))
        return pa.Table.from_batches([rows_of(out)])
    return run


def count_pairs(dealer: Dealer, words: Words):
    """Per bucket: pair counts for the blocks (block >= 0), histories wanted by blocks
    (-2 - block) and totals of histories (-1), the latter two under the history's bucket."""
    def run(table: pa.Table) -> pa.Table:
        rows = split_rows(table)
        heads = [unsqueeze(p[0]) for _, _, p in rows]
        lengths = [unsqueeze(p[1], np.uint32).astype(np.int64) for _, _, p in rows]
        h = np.concatenate([np.repeat(a, n) for a, n in zip(heads, lengths)])
        w = np.concatenate([unsqueeze(p[2]) for _, _, p in rows])
        seen = np.concatenate([unsqueeze(p[3]) for _, _, p in rows])
        count = np.concatenate([unsqueeze(p[4]) for _, _, p in rows])
        order = np.lexsort((w, h))
        first = np.ones(len(order), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        group = np.cumsum(first) - 1
        total = np.bincount(group, weights=count[order]).astype(np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = total[group]
        bucket, out, at = rows[0][1], [], 0
        for (block, _, p), own, n in zip(rows, heads, lengths):
            size = int(n.sum())
            out.append((block, bucket, [squeeze(back[at:at + size])]))
            at += size
            to = dealer.history(own)
            for b in np.unique(to):
                out.append((-2 - block, int(b), [squeeze(own[to == b])]))
        keep = total > 0
        ph, pw, pr = h[order][first][keep], words.p(seen[order][first][keep]), total[keep]
        begin, _ = runs(ph)
        of = np.bincount(np.minimum(pr, CUT + 2), minlength=CUT + 3)[:CUT + 2]
        out.append((-1, bucket, [of.astype(np.int64).tobytes(), b"", b"", b"", b""]))
        if len(begin):
            names = ph[begin]
            sums = np.add.reduceat(pr, begin)
            mass = np.add.reduceat(pw, begin)
            low = np.stack([np.add.reduceat((pr == r).astype(np.int64), begin) for r in range(1, CUT + 1)])
            to = dealer.history(names)
            for b in np.unique(to):
                s = to == b
                out.append((-1, int(b), [b"", squeeze(names[s]), squeeze(sums[s]), mass[s].tobytes(), squeeze(low[:, s].ravel())]))
        return pa.Table.from_batches([rows_of(out)])
    return run


def weigh_histories(d: np.ndarray):
    """Backoff weights and divisors of the histories that blocks want."""
    def run(table: pa.Table) -> pa.Table:
        rows = split_rows(table)
        stats = [p for b, _, p in rows if b == -1 and p[1]]
        names, out = np.zeros(0, np.int64), []
        if stats:
            names, place = np.unique(np.concatenate([unsqueeze(p[1]) for p in stats]), return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate([unsqueeze(p[2]) for p in stats]))
            mass = np.bincount(place, weights=np.concatenate([np.frombuffer(p[3]) for p in stats]))
            low = np.concatenate([unsqueeze(p[4]).reshape(CUT, -1) for p in stats], axis=1)
            left = sum(np.bincount(place, weights=low[r - 1]) * r * (1 - d[r]) for r in range(1, CUT + 1)) / sums
            # a history whose pairs are all frequent leaves nothing; one more count makes room
            full = left <= 1e-12
            divisor = np.where(full, sums + 1, sums)
            left = np.where(full, 1 / divisor, left)
            weight = left / np.maximum(1 - mass, 1e-300)
        for block, bucket, p in rows:
            if block < -1:
                wanted = unsqueeze(p[0])
                at = np.minimum(np.searchsorted(names, wanted), max(len(names) - 1, 0))
                known = names[at] == wanted if len(names) else np.zeros(len(wanted), bool)
                # an unknown history leaves everything to the word distribution
                back = np.where(known, weight[at], 1.0) if len(names) else np.ones(len(wanted))
                div = np.where(known, divisor[at], 0.0) if len(names) else np.zeros(len(wanted))
                out.append((-2 - block, -2 - bucket, [squeeze(wanted), back.tobytes(), squeeze(div.astype(np.int64))]))
        return pa.Table.from_batches([rows_of(out)])
    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_block(dealer: Dealer, words: Words, d: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        rows = split_rows(table)
        block = Block(next(p for _, b, p in rows if b == -1))
        block.learn([(b, p) for _, b, p in rows if b >= 0 and len(p) == 2], dealer.buckets)
        bucket, h, w, _, place = block.pairs(dealer)
        answers = sorted(((b, p) for _, b, p in rows if b >= 0 and len(p) == 1), key=lambda r: r[0])
        count = np.concatenate([unsqueeze(p[0]) for _, p in answers])
        told = [p for _, b, p in rows if b < -1]
        names, first = np.unique(np.concatenate([unsqueeze(p[0]) for p in told]), return_index=True)
        weight = np.concatenate([np.frombuffer(p[1]) for p in told])[first]
        divisor = np.concatenate([unsqueeze(p[2]) for p in told])[first]
        at = np.searchsorted(names, block.ids[h])
        seen = block.seen[w]
        p = np.where(count > 0, discounted(count, d) / np.maximum(divisor[at], 1), weight[at] * words.p(seen))
        n = len(block.doc_ids)
        base = np.log10((seen + 0.5) / (words.total + 0.5 * (words.types + 1)))
        known = np.bincount(block.doc, weights=(block.seen[block.codes] > 0), minlength=n).astype(np.int64)
        return pa.table({
            "doc_id": pa.array(block.doc_ids, pa.int64(), mask=block.nulls), "held_out": pa.array(block.held_out),
            "n_tokens": pa.array(block.lengths, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(n, words.total), pa.int64()),
            "base_score": np.bincount(block.doc, weights=base[place], minlength=n),
            "score": np.bincount(block.doc, weights=np.log10(p)[place], minlength=n)})
    return run


def score_texts(docs: DataFrame, fold: int = 1, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Texts whose id is not in the fold train the model; a null id is not in it. Null and
    empty texts hold the end only. Repeated rows count and are scored each. Without training
    texts every token is unknown and has probability 1. Other columns are not read.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(df: DataFrame, purpose: str) -> DataFrame:
        folder = shared_dir(spark, purpose)
        df.write.option("compression", "none").parquet(folder)
        return spark.read.schema(HISTORY).parquet(folder)

    def counts(df: DataFrame, n: int) -> np.ndarray:
        """Sums of the numbers that buckets report; a bounded row each, added up in Spark."""
        def numbers(batches):
            for batch in batches:
                found = [np.frombuffer(p[0], np.int64) for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([f.tolist() for f in found], pa.list_(pa.int64()))], ["v"])
        sums = df.select("parts").mapInArrow(numbers, "v array<long>").agg(*[F.sum(F.col("v")[i]) for i in range(n)]).first()
        return np.array([x or 0 for x in sums], np.int64)

    blocks = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), in_fold(F.col(id_col), fold).alias("held_out"),
        F.col(text_col).alias("text")).mapInArrow(partial(make_blocks, size=block_bytes), HISTORY), "lm-blocks")
    told = stored(blocks.mapInArrow(send_words(buckets), HISTORY).groupBy("bucket").applyInArrow(
        count_words(buckets), HISTORY), "lm-words")
    found = counts(told.where("block = -1"), CUT + 4)
    words = Words(int(found[0]), int(found[1]), found[2:])
    dealer = Dealer(buckets, words.total)
    known = blocks.union(told.where("block >= 0"))
    pairs = stored(known.groupBy("block").applyInArrow(send_pairs(dealer), HISTORY)
                   .groupBy("bucket").applyInArrow(count_pairs(dealer, words), HISTORY), "lm-pairs")
    of = counts(pairs.where((F.col("block") == -1) & (F.octet_length(F.col("parts")[0]) > 0)), CUT + 2)
    d = discounts(of)
    weights = pairs.where("block < 0").groupBy("bucket").applyInArrow(weigh_histories(d), HISTORY)
    return known.union(pairs.where("block >= 0")).union(weights).groupBy("block").applyInArrow(
        score_block(dealer, words, d), SCORES)
