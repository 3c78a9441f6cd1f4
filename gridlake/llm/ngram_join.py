"""N-gram Jaccard self-join with a prefix tree (operator 9).

1. Every text becomes a set of word n-grams, held as sorted 64-bit hashes. Equal sets are
   one class from there on, whatever the number of copies.
2. N-grams get one global order, rare ones first; their numbers of sets come from counts by
   bucket. Two sets of Jaccard >= t share an n-gram among the first |x| - ceil(t |x|) + 1 of
   each. N-grams of one set only cannot be shared and are not sent, so common passages make
   no candidates unless they make up most of a text. No link is missed, none is capped.
3. Candidates that hang together form a cluster; its sets meet in one task. Large clusters
   are cut into blocks, and pairs of blocks meet.
4. In a task the sets, their n-grams in one order, are stored in a prefix tree. A new set
   walks down the tree. Sets with a common beginning share the overlap counted so far, and a
   subtree is left as soon as the elements still to come cannot reach the threshold, or all
   its sets already belong to the new set's component.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridlake.llm.arrow import texts
from gridlake.llm.components import components
from gridlake.llm.katz import HISTORY, rows_of, runs, split_rows, squeeze, unsqueeze
from gridlake.llm.quality import split_words
from gridlake.llm.repeats import make_blocks, unpack_bytes
from gridlake.sources.scratch import shared_dir

#: Sets and set elements of a block of a cluster; a task holds two blocks.
BLOCK_SETS = 2000
BLOCK_ELEMENTS = 1 << 20
MEETS = pa.list_(pa.struct([("cluster", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of all texts, where each text's begin and the end)."""
    column = pc.ascii_lower(texts(column))
    owner, codes, words = split_words(column)
    n = len(column)
    # different lengths of n-grams, as of short texts, never meet
    coded = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()),
                        np.uint64, len(words))[codes]
    cuts = np.searchsorted(owner, np.arange(n + 1))
    lengths = np.diff(cuts)
    grams = np.zeros(0, np.uint64)
    if len(coded) >= size:
        grams = np.zeros(len(coded) - size + 1, np.uint64)
        for i in range(size):
            grams += coded[i:len(coded) - size + 1 + i] * _ODD[i]
        grams = _mix(grams + np.uint64(size))
    held = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    ends = np.cumsum(held)
    out = np.zeros(int(held.sum()), np.uint64)
    for i in range(n):
        lo, hi = ends[i] - held[i], ends[i]
        if lengths[i] >= size:
            part = grams[cuts[i]:cuts[i] + held[i]]
            out[lo:hi] = np.sort(part)
        elif lengths[i]:
            few = coded[cuts[i]:cuts[i + 1]]
            out[lo] = _mix((few * _ODD[:len(few)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(few)))[0]
    of = np.repeat(np.arange(n), held)
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return out[first], np.concatenate(([0], np.cumsum(np.bincount(of[first], minlength=n))))


def set_keys(hashes: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(hashes[lo:hi].tobytes()) if hi > lo else None
            for lo, hi in zip(starts.tolist(), starts[1:].tolist())]


def node_of(key: bytes) -> int:
    """A number for a set in the candidate graph; should two sets share one, both are candidates."""
    return int.from_bytes(key[:8], "little", signed=True)


class SetBlock:
    """The sets of a block of texts; `fresh` are the texts whose set is new in the block."""

    def __init__(self, parts: list[bytes], words: int):
        ids, nulls, offsets, data = parts
        self.doc_ids, self.nulls = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool)
        text = pa.LargeStringArray.from_buffers(
            len(self.doc_ids), pa.py_buffer(offsets), pa.py_buffer(unpack_bytes(data)))
        self.hashes, self.starts = shingle_sets(text, words)
        self.keys = set_keys(self.hashes, self.starts)
        seen: set[bytes] = set()
        self.fresh = []
        for i, key in enumerate(self.keys):
            if key is not None and key not in seen and not self.nulls[i]:
                seen.add(key)
                self.fresh.append(i)
        rows = np.array(self.fresh, np.int64)
        self.nodes = np.array([node_of(self.keys[i]) for i in self.fresh], np.int64)
        self.sizes = np.diff(self.starts)[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(self.sizes) - self.sizes), self.sizes)
        self.grams, self.place, self.times = np.unique(
            self.hashes[at + np.arange(len(at))], return_inverse=True, return_counts=True)

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the distinct n-grams by bucket, buckets, the 32 bits that are counted)."""
        bucket, bits = self.grams % np.uint64(buckets), (self.grams // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)
        order = np.lexsort((bits, bucket))
        return order, bucket[order].astype(np.int64), bits[order].astype(np.int64)

    def prefixes(self, often: np.ndarray, percent: int) -> list[np.ndarray]:
        """Per fresh set the n-grams of its prefix that other sets hold as well."""
        row, often = np.repeat(np.arange(len(self.sizes)), self.sizes), often[self.place]
        grams = self.grams[self.place]
        order = np.lexsort((grams, often, row))
        position = np.arange(len(order)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        length = self.sizes + (-percent * self.sizes) // 100 + 1
        use = (position < length[row]) & (often[order] > 1)
        picked = grams[order[use]].view(np.int64)
        return np.split(picked, np.searchsorted(row[use], np.arange(1, len(self.sizes)))) if len(self.sizes) else []


def send_grams(buckets: int, words: int):
    """Distinct n-grams by bucket: 32 bits of each, as steps of the sorted numbers."""
    def run(batches):
        for batch in batches:
            for number, _, parts in split_rows(pa.Table.from_batches([batch])):
                block = SetBlock(parts, words)
                order, bucket, bits = block.dealt(buckets)
                begin, sizes = runs(bucket)
                yield rows_of([(number, int(bucket[lo]), [
                    squeeze(np.diff(bits[lo:lo + n], prepend=0).astype(np.uint32)),
                    squeeze(np.minimum(block.times[order[lo:lo + n]], 255).astype(np.uint8))])
                    for lo, n in zip(begin, sizes)])
    return run


def count_grams(table: pa.Table) -> pa.Table:
    """How many sets hold each n-gram, up to 255. Two n-grams that share the counted bits
    share a count, which moves them in the order for all sets alike."""
    rows = split_rows(table)
    bits = [np.cumsum(unsqueeze(p[0], np.uint32).astype(np.int64)) for _, _, p in rows]
    _, place = np.unique(np.concatenate(bits), return_inverse=True)
    times = np.concatenate([unsqueeze(p[1], np.uint8) for _, _, p in rows])
    often = np.minimum(np.bincount(place, weights=times), 255).astype(np.uint8)[place]
    ends = np.cumsum([len(b) for b in bits])
    return pa.Table.from_batches([rows_of([
        (block, bucket, [squeeze(often[hi - len(b):hi])]) for (block, bucket, _), b, hi in zip(rows, bits, ends)])])


def send_prefixes(buckets: int, words: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        rows = split_rows(table)
        block = SetBlock(next(p for _, b, p in rows if b < 0), words)
        order, _, _ = block.dealt(buckets)
        often = np.zeros(len(order), np.int64)
        told = [unsqueeze(p[0], np.uint8) for _, b, p in sorted((r for r in rows if r[1] >= 0), key=lambda r: r[1])]
        often[order] = np.concatenate([np.zeros(0, np.uint8), *told])
        grams, at, hung = combine(block.nodes, block.prefixes(often, percent))
        bucket = (grams.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        begin, sizes = runs(bucket[by])
        out = [(rows[0][0], int(bucket[by[lo]]), [grams[by[lo:lo + n]].tobytes(), block.nodes[at[by[lo:lo + n]]].tobytes(), b""])
               for lo, n in zip(begin, sizes)]
        if len(hung):
            out.append((rows[0][0], rows[0][0] % buckets, [b"", b"", hung.tobytes()]))
        return pa.Table.from_batches([rows_of(out)])
    return run


def hang(table: pa.Table) -> pa.Table:
    """Sets that share an n-gram of their prefixes hang on the smallest of them."""
    rows = split_rows(table)
    grams, nodes, hung = (np.frombuffer(b"".join(p[i] for _, _, p in rows), np.int64) for i in range(3))
    order = np.lexsort((nodes, grams))
    grams, nodes = grams[order], nodes[order]
    first = np.ones(len(order), bool)
    first[1:] = grams[1:] != grams[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    pairs = np.concatenate([np.stack([nodes[~first], nodes[lead[~first]]], 1), hung.reshape(-1, 2)])
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def combine(nodes: np.ndarray, signatures: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, positions of the sets that stand for them, links as rows of two nodes).

    Of the sets of a batch that share a signature the smallest stands for it and the others
    hang on it, so however many like sets there are, a signature leaves a batch once.
    """
    flat = np.concatenate([np.zeros(0, np.int64), *signatures])
    row = np.repeat(np.arange(len(nodes)), [len(s) for s in signatures])
    order = np.lexsort((nodes[row], flat))
    flat, row = flat[order], row[order]
    first = np.ones(len(order), bool)
    first[1:] = flat[1:] != flat[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    hung = np.stack([nodes[row[~first]], nodes[row[lead[~first]]]], 1)
    return flat[first], row[first], np.unique(hung, axis=0)


class Node:
    __slots__ = ("edge", "children", "least", "most", "sets", "sample", "alike")

    def __init__(self, edge, least, most, sample):
        self.edge, self.children, self.sets = edge, {}, []
        self.least, self.most, self.sample, self.alike = least, most, sample, True


class PrefixTree:
    """Sets as sorted arrays of ranks; common beginnings are stored once."""

    def __init__(self, percent: int, n_ranks: int, n_sets: int):
        self.percent = percent
        self.root = Node(np.zeros(0, np.int64), 1 << 62, 0, -1)
        self.inside = np.zeros(n_ranks + 1, bool)
        self.parent = list(range(n_sets))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _linked(self, overlap: int, x: int, y: int) -> bool:
        return (100 + self.percent) * overlap >= self.percent * (x + y)

    def links(self, number: int, ranks: np.ndarray) -> list[int]:
        """Sets in the tree linked with this one, at most those needed for its component."""
        found, n = [], len(ranks)
        self.inside[ranks] = True
        order = ranks.tolist()
        stack = [(child, 0, 0) for child in self.root.children.values()]
        while stack:
            node, overlap, depth = stack.pop()
            if node.alike and self.find(node.sample) == self.find(number):
                continue
            overlap += int(np.count_nonzero(self.inside[node.edge]))
            depth += len(node.edge)
            left = n - bisect_left(order, int(node.edge[-1]) + 1)
            best = min(max(depth + left, node.least), node.most)
            if not self._linked(overlap + min(best - depth, left), n, best):
                continue
            for other in node.sets:
                if self._linked(overlap, n, depth) and self.find(other) != self.find(number):
                    found.append(other)
                    self.parent[self.find(number)] = self.find(other)
            stack += [(child, overlap, depth) for child in node.children.values()]
        self.inside[ranks] = False
        return found

    def insert(self, number: int, ranks: np.ndarray) -> None:
        node, at, n = self.root, 0, len(ranks)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node is not self.root and node.alike:
                node.alike = self.find(node.sample) == self.find(number)
            if at == n:
                node.sets.append(number)
                return
            child = node.children.get(int(ranks[at]))
            if child is None:
                leaf = Node(ranks[at:], n, n, number)
                leaf.sets.append(number)
                node.children[int(ranks[at])] = leaf
                return
            k = min(len(child.edge), n - at)
            differ = np.flatnonzero(child.edge[:k] != ranks[at:at + k])
            k = int(differ[0]) if len(differ) else k
            if k < len(child.edge):
                upper = Node(child.edge[:k], child.least, child.most, child.sample)
                upper.alike = child.alike
                upper.children[int(child.edge[k])] = child
                child.edge = child.edge[k:]
                node.children[int(ranks[at])] = upper
                child = upper
            node, at = child, at + k


def tree_join(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets that connect what is connected, as pairs of positions.

    Ranks put the n-grams of most sets first, so that like sets share long beginnings.
    """
    grams, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, -often))] = np.arange(len(grams))
    ranks = rank[place]
    ends = np.cumsum([len(s) for s in sets])
    tree = PrefixTree(percent, len(grams), len(sets))
    found = []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own = np.sort(ranks[ends[i] - len(sets[i]):ends[i]])
        found += [(i, other) for other in tree.links(i, own)]
        tree.insert(i, own)
    return found


def near_duplicates(
    docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, key, class_id, component_id, component_key for every row.

    class_id is the smallest id with an equal set, component_id the smallest id reachable by
    links. Texts that are null or have no words have no n-grams and link with nothing; a
    text of fewer words than an n-gram is one n-gram. Rows with a null id are returned with
    their size and null ids, and link with nothing. The sets are the nodes of the graph, so
    rows that repeat an id link each by its own text; component_key is the key of the set that
    has the smallest id, and of such sets the smallest. Other columns are not read.
    """
    spark = docs.sparkSession

    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def describe(batches):
        for batch in batches:
            for number, _, parts in split_rows(pa.Table.from_batches([batch])):
                block = SetBlock(parts, words)
                n = len(block.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64(), mask=block.nulls), pa.array(np.diff(block.starts), pa.int64()),
                     pa.array(block.keys, pa.binary()),
                     pa.array([None if k is None else node_of(k) for k in block.keys], pa.int64()),
                     pa.array(np.full(n, number), pa.int64()), pa.array(np.arange(n), pa.int64())],
                    ["doc_id", "n_shingles", "key", "node", "block", "row"])

    def stored(df: DataFrame, purpose: str) -> DataFrame:
        folder = shared_dir(spark, purpose)
        df.write.option("compression", "none").parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    texts_of = docs.select(F.col(id_col).cast(LongType()).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stored(texts_of.mapInArrow(make_blocks, HISTORY), "ngram-blocks")
    sets = stored(blocks.mapInArrow(describe, "doc_id long, n_shingles long, key binary, node long, block long, row long"), "ngram-sets")
    by_class = sets.where("key is not null and doc_id is not null").groupBy("key").agg(
        F.min(F.struct("doc_id", "block", "row")).alias("at"), F.min("node").alias("node"), F.min("n_shingles").alias("n_shingles")).select(
        "key", "node", "n_shingles", F.col("at.doc_id").alias("class_id"), F.col("at.block").alias("block"), F.col("at.row").alias("row"))
    counted = blocks.mapInArrow(send_grams(buckets, words), HISTORY).groupBy("bucket").applyInArrow(count_grams, HISTORY)
    hung = (blocks.union(counted).groupBy("block").applyInArrow(send_prefixes(buckets, words, percent), HISTORY)
            .groupBy("bucket").applyInArrow(hang, "a long, b long"))
    clusters = components(hung)

    member = by_class.join(clusters, by_class["node"] == clusters["id"]).select(
        "class_id", "key", "n_shingles", "block", "row", F.col("component").alias("cluster"))
    extent = member.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_ELEMENTS)).alias("parts"))
    dealt = member.join(extent, "cluster").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "class_id", "key", "block", "row", "cluster",
        F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def sets_of(held: pa.Table, asked: pa.Table) -> pa.Table:
        grams = []
        if asked.num_rows:
            (_, _, (_, _, offsets, data)), = split_rows(held)
            text = pa.LargeStringArray.from_buffers(
                len(offsets) // 8 - 1, pa.py_buffer(offsets), pa.py_buffer(unpack_bytes(data)))
            hashes, starts = shingle_sets(text.take(asked.column("row").combine_chunks()), words)
            if set_keys(hashes, starts) != asked.column("key").to_pylist():
                raise ValueError("a set differs from the one that was read before")
            grams = [hashes[lo:hi].tobytes() for lo, hi in zip(starts.tolist(), starts[1:].tolist())]
        return pa.table({"class_id": asked.column("class_id"), "key": asked.column("key"),
                         "meets": pa.array(asked.column("meets").to_pylist(), MEETS), "grams": pa.array(grams, pa.binary())})

    wanted = pairs.groupBy("block", "row", "class_id", "key").agg(F.collect_set(F.struct("cluster", "low", "high")).alias("meets"))
    found = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(
        sets_of, "class_id long, key binary, meets array<struct<cluster:long,low:long,high:long>>, grams binary")
    placed = found.select("class_id", "key", "grams", F.explode("meets").alias("meet")).select(
        "class_id", "key", "grams", "meet.*")

    def join_task(table: pa.Table) -> pa.Table:
        ids, keys = table.column("class_id").to_pylist(), table.column("key").to_pylist()
        own = [np.frombuffer(g.as_py(), np.uint64) for g in table.column("grams")]
        linked = tree_join(own, percent)

        def nodes(side: int) -> pa.Array:
            rows = [pair[side] for pair in linked]
            return pa.StructArray.from_arrays(
                [pa.array([ids[n] for n in rows], pa.int64()), pa.array([keys[n] for n in rows], pa.binary())],
                ["class_id", "key"])

        return pa.table({"a": nodes(0), "b": nodes(1)})

    node = "struct<class_id:long,key:binary>"
    links = placed.groupBy("cluster", "low", "high").applyInArrow(join_task, f"a {node}, b {node}")
    joined = components(links)
    named = by_class.join(joined, F.struct(by_class["class_id"], by_class["key"]) == joined["id"], "left").select(
        F.col("key").alias("k"), "class_id", F.coalesce("component.class_id", "class_id").alias("component_id"),
        F.coalesce("component.key", "key").alias("component_key"))
    return sets.join(named, sets["key"] == named["k"], "left").select(
        "doc_id", "n_shingles", "key",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_key")).alias("component_key"))
