"""Benchmark decontamination by Wu-Manber search (operator 1).

Texts become byte strings of lower-cased words, each with one space before and after, so a
window of words occurs exactly where its bytes do. The search looks at blocks of B bytes
that end a window of m bytes, m the shortest pattern of a length class: the shift table says
how far the next possible end is, zero leads to a bucket of patterns with that hash, and
their bytes are compared directly. Many stretches of a batch advance together, one numpy
step for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.arrow import by_bytes, raw_bytes, texts

WINDOW = 13
BLOCK_BYTES = 16 << 20
LANE = 2048
TABLE_BITS = 16
#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
_is_word = np.zeros(256, bool)
_is_word[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_plain = np.where(_is_word, np.arange(256), 0x20).astype(np.uint8)
_plain[0x41:0x5B] += 0x20
GAP = 0


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each text and the end). A text is b"\\0 w1 w2 ... wn "."""
    data, offsets = raw_bytes(column)
    n = len(offsets) - 1
    # each text gets b"\0 " before it and a space after it
    spaced = np.full(len(data) + 3 * n, 0x20, np.uint8)
    begin = offsets[:-1] + 3 * np.arange(n)
    body = np.ones(len(spaced), bool)
    body[begin], body[begin + 1], body[begin + 2 + np.diff(offsets)] = False, False, False
    spaced[body] = _plain[data]
    spaced[begin] = GAP
    keep = np.ones(len(spaced), bool)
    keep[1:] = (spaced[1:] != 0x20) | (spaced[:-1] != 0x20)
    upto = np.concatenate(([0], np.cumsum(keep)))
    return spaced[keep], np.concatenate((upto[begin], upto[-1:]))


def windows(column: pa.Array, size: int = WINDOW) -> list[list[bytes]]:
    """The distinct windows of each text; a text of fewer words, but not none, is one."""
    data, starts = normalised(column)
    found = []
    for lo, hi in zip(starts, starts[1:]):
        words = data[lo + 1:hi].tobytes().split()
        spans = [words[i:i + size] for i in range(max(1, len(words) - size + 1))] if words else []
        found.append(list(dict.fromkeys(b" " + b" ".join(s) + b" " for s in spans)))
    return found


class LengthClass:
    """Wu-Manber tables for patterns whose lengths differ by less than a factor of two."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.m = min(map(len, patterns))
        self.b = min(3, self.m)
        heads = np.frombuffer(b"".join(p[:self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        blocks = self.m - self.b + 1
        self.shift = np.full(1 << TABLE_BITS, blocks, np.int64)
        for j in range(blocks):
            at = self.key(heads, j)
            self.shift[at] = np.minimum(self.shift[at], blocks - 1 - j)
        keys = self.key(heads, blocks - 1)
        order = np.argsort(keys, kind="stable")
        self.bucket = np.searchsorted(keys[order], np.arange((1 << TABLE_BITS) + 1))
        self.patterns = [patterns[i] for i in order]
        self.numbers = np.array(numbers)[order]
        self.lengths = np.array([len(p) for p in self.patterns])
        self.head = heads[order]
        #: an eighth byte string per pattern, spread over its head, compared before the whole
        self.probe = np.unique(np.linspace(0, self.m - 1, 8).astype(np.int64))

    def key(self, rows: np.ndarray, j: int) -> np.ndarray:
        code = np.zeros(len(rows), np.uint32)
        for i in range(self.b):
            code = code * np.uint32(257) + rows[:, j + i]
        return self._mix(code)

    @staticmethod
    def _mix(code: np.ndarray) -> np.ndarray:
        return ((code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)

    def search(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, pattern number) of every occurrence."""
        last = len(data) - self.m
        if last < 0:
            return (np.zeros(0, np.int64),) * 3
        # a lane looks for occurrences that start in its own stretch
        at = np.arange(0, last + 1, LANE)
        stop = np.minimum(at + LANE, last + 1)
        tail = self.m - self.b
        hits = []
        while len(at):
            code = np.zeros(len(at), np.uint32)
            for i in range(self.b):
                code = code * np.uint32(257) + data[at + tail + i]
            key = self._mix(code)
            shift = self.shift[key]
            zero = np.flatnonzero(shift == 0)
            if len(zero):
                hits.append((at[zero], key[zero]))
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not hits:
            return (np.zeros(0, np.int64),) * 3
        return self._confirm(data, np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]))

    def _confirm(self, data: np.ndarray, at: np.ndarray, key: np.ndarray):
        out = []
        # pairs of a position and a pattern of its bucket, a bounded number at a time
        sizes = self.bucket[key + 1] - self.bucket[key]
        part = (np.cumsum(sizes) - 1) // (1 << 20)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(at)]):
            n = sizes[lo:hi]
            place = np.repeat(at[lo:hi], n)
            ends = np.cumsum(n)
            pattern = np.repeat(self.bucket[key[lo:hi]] - (ends - n), n) + np.arange(int(n.sum()))
            for j in self.probe:
                same = data[place + j] == self.head[pattern, j]
                place, pattern = place[same], pattern[same]
            for p, k in zip(place.tolist(), pattern.tolist()):
                whole = self.patterns[k]
                if data[p:p + len(whole)].tobytes() == whole:
                    out.append((p, p + len(whole), self.numbers[k]))
        found = np.array(out, np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1], found[:, 2]


class Searcher:
    def __init__(self, patterns: list[bytes]):
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            classes.setdefault(len(p).bit_length(), []).append(i)
        self.classes = [LengthClass([patterns[i] for i in c], c) for c in classes.values()]

    def search(self, data: np.ndarray):
        found = [c.search(data) for c in self.classes] or [(np.zeros(0, np.int64),) * 3]
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def pattern_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[bytes], list[list[str]]]]:
    """(windows, names of the items of each window) of at most BLOCK_BYTES each.

    Items stream to the driver; it holds one block at a time, whatever their number.
    """
    owners: dict[bytes, set[str]] = {}
    size = 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        name = "" if row[0] is None else row[0]
        for w in windows(texts(pa.array([row[1]], pa.string())))[0]:
            size += len(w) + 8 if w not in owners else 8
            owners.setdefault(w, set()).add(name)
        if size >= BLOCK_BYTES:
            yield list(owners), [sorted(v) for v in owners.values()]
            owners, size = {}, 0
    if owners:
        yield list(owners), [sorted(v) for v in owners.values()]


_searchers: dict = {}


def find_spans(
    docs: DataFrame, items: DataFrame, text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """docs with hit_words (n words), hit_spans (first and last hit word of each run of hit
    words, counted from 0) and hit_items (sorted distinct ids of items with occurring windows).

    A null text has no words. Null item texts have no windows; a null item id is named "".
    Repeated rows are searched each; repeated item ids count once. Columns hit_words,
    hit_spans and hit_items of the input are replaced, all others kept. Items beyond one
    block of patterns take one more pass over the rows in the same task.
    """
    own = [c for c in docs.columns if c not in ("hit_words", "hit_spans", "hit_items")]
    spans_type, items_type = "array<struct<lo:bigint,hi:bigint>>", "array<string>"
    df = docs.select(
        *[F.col(f"`{c}`") for c in own], F.lit(0).cast("bigint").alias("hit_words"),
        F.expr(f"cast(array() as {spans_type})").alias("hit_spans"),
        F.expr(f"cast(array() as {items_type})").alias("hit_items"))
    schema, place = df.schema, own.index(text_col)
    sc = docs.sparkSession.sparkContext

    def pass_over(shared, name):
        def run(batches):
            for batch in by_bytes(batches, text_col):
                if name not in _searchers:  # one block's tables per worker
                    _searchers.clear()
                    patterns, owners = shared.value
                    _searchers[name] = Searcher(patterns), owners
                searcher, owners = _searchers[name]
                yield hit_columns(batch, place, searcher, owners)
        return run

    shared = [sc.broadcast(block) for block in pattern_blocks(items, item_id_col, item_text_col)]
    for block in shared or [sc.broadcast(([], []))]:
        df = df.mapInArrow(pass_over(block, uuid4().hex), schema)
    return df


def hit_columns(batch: pa.RecordBatch, place: int, searcher: Searcher, owners: list[list[str]]) -> pa.RecordBatch:
    """The batch with its three hit columns brought up to date."""
    n = batch.num_rows
    data, starts = normalised(texts(batch.column(place)))
    opens = np.zeros(len(data) + 1, np.int64)
    opens[1:-1] = (data[1:] != 0x20) & (data[1:] != GAP) & (data[:-1] == 0x20)
    word_at = np.cumsum(opens)  # how many words have opened up to this byte
    first_word = np.concatenate((word_at[starts[:-1]], word_at[-1:]))
    n_words = np.diff(first_word)
    lo, hi, pattern = searcher.search(data)
    doc = np.searchsorted(starts, lo, side="right") - 1
    # words lo+1 .. hi-1 of the bytes; spans hold numbers within the text
    first = word_at[lo + 1] - 1 - first_word[doc] if len(lo) else lo
    last = word_at[hi - 1] - 1 - first_word[doc] if len(lo) else lo
    spans = batch.column(n_index(batch, "hit_spans")).to_pylist()
    names = batch.column(n_index(batch, "hit_items")).to_pylist()
    order = np.lexsort((last, first, doc))
    found: dict[int, list] = {}
    for i in order.tolist():
        found.setdefault(int(doc[i]), []).append(i)
    for d, rows in found.items():
        runs = sorted([(s["lo"], s["hi"]) for s in spans[d]] + [(int(first[i]), int(last[i])) for i in rows])
        merged = [list(runs[0])]
        for a, b in runs[1:]:
            if a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        spans[d] = [{"lo": a, "hi": b} for a, b in merged]
        names[d] = sorted({x for k in set(pattern[rows].tolist()) for x in owners[k]}.union(names[d]))
    columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    columns["hit_words"] = pa.array(n_words, pa.int64())
    columns["hit_spans"] = pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
    columns["hit_items"] = pa.array(names, pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def n_index(batch: pa.RecordBatch, name: str) -> int:
    return batch.schema.get_field_index(name)


def n_hit(spans: str = "hit_spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda n, s: n + s["hi"] - s["lo"] + 1)


def contaminated():
    """The contract's rule: some word is hit, and hit words are a twentieth of all or more."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("hit_words"))
