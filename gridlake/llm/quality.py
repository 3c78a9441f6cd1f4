"""Quality classifier on supervised subword embeddings (operator 3).

A text is the mean of learned vectors: one per word and one per character n-gram of a word,
all hashed to buckets, and one for "the same word again". A softmax layer turns the mean
into a probability. Vectors and layer are trained together by stochastic gradient descent.

The layer is linear in the mean, so scoring needs one number per bucket. Words repeat, so
the numbers of a word are added up once per distinct word of a batch.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.arrow import by_bytes, raw_bytes, texts

#: At most so many labelled rows are used to fit, chosen by a hash of the id.
TRAIN_ROWS = 6000
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
NGRAMS = (3, 4, 5)
DIMENSIONS = 8
EPOCHS = 8
RATE = 1.0
#: Bytes of text that are scored together.
SCORE_BYTES = 2 << 20
AGAIN = zlib.crc32(b"\0again") % BUCKETS
NO_ROWS = pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.int32())})


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number of each word, code of each word, distinct words); no empty words."""
    for mark in "\n\t\r\f\v":
        column = pc.replace_substring(column, mark, " ")
    parts = pc.split_pattern(column, " ")
    owner = np.repeat(np.arange(len(column)), np.diff(parts.offsets.to_numpy()))
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    filled = byte_count(coded.dictionary)[codes] > 0 if len(codes) else np.zeros(0, bool)
    return owner[filled], codes[filled], coded.dictionary


def byte_count(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every word and character n-gram of distinct words.

    N-grams are over the bytes of the word between two boundary marks.
    """
    words = words.cast(pa.large_string())
    data, offsets = raw_bytes(words)
    n = len(words)
    marked = np.zeros(len(data) + 2 * n, np.uint64)
    begin = offsets[:-1] + 2 * np.arange(n)
    sizes = np.diff(offsets)
    body = np.ones(len(marked), bool)
    body[begin], body[begin + sizes + 1] = False, False
    marked[body] = data
    marked[begin], marked[begin + sizes + 1] = 1, 2
    owner = np.repeat(np.arange(n), sizes + 2)
    buckets = [np.fromiter((zlib.crc32(w) % BUCKETS for w in words.cast(pa.large_binary()).to_pylist()), np.int64, n)]
    owners = [np.arange(n)]
    for k in NGRAMS:
        if len(marked) < k:
            continue
        code = np.full(len(marked) - k + 1, k, np.uint64)
        for i in range(k):
            code = code * np.uint64(0x100000001B3) + marked[i:len(marked) - k + 1 + i]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
        inside = owner[:len(code)] == owner[k - 1:]
        buckets.append(code[inside].astype(np.int64))
        owners.append(owner[:len(code)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def repeats(owner: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The text number of every word that is the same as the one before it."""
    return owner[1:][(codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])]


@dataclass
class Model:
    weight: np.ndarray  # by bucket: what one occurrence adds to the logit of label 1
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 for every text; a text without words has the bias only."""
        column = texts(column)
        n = len(column)
        owner, codes, words = split_words(column)
        if not len(codes):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        bucket, word = features(words)
        by_word = np.bincount(word, weights=self.weight[bucket], minlength=len(words))
        size = np.bincount(word, minlength=len(words))
        again = np.bincount(repeats(owner, codes), minlength=n)
        total = np.bincount(owner, weights=by_word[codes], minlength=n) + again * self.weight[AGAIN]
        count = np.bincount(owner, weights=size[codes], minlength=n) + again
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def train(labelled: pa.Table, seed: int = 7) -> Model:
    """Fit on (text, label) rows; without rows of both labels the bias alone is fitted."""
    labels = labelled.column("label").to_numpy().astype(np.int64)
    rows = []
    for lo in range(0, labelled.num_rows, 256):
        some = labelled.slice(lo, 256)
        owner, codes, words = split_words(texts(some.column("text").combine_chunks()))
        bucket, word = features(words)
        order = np.argsort(word, kind="stable")
        bucket, ends = bucket[order], np.searchsorted(word[order], np.arange(len(words) + 1))
        again = np.bincount(repeats(owner, codes), minlength=some.num_rows)
        cuts = np.searchsorted(owner, np.arange(some.num_rows + 1))
        for i in range(some.num_rows):
            own, times = np.unique(codes[cuts[i]:cuts[i + 1]], return_counts=True)
            size = ends[own + 1] - ends[own]
            at = np.repeat(ends[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            ids = np.concatenate((bucket[at], [AGAIN]))
            used, place = np.unique(ids, return_inverse=True)
            share = np.bincount(place, weights=np.concatenate((np.repeat(times, size), [again[i]])))
            rows.append((used.astype(np.int32), (share / max(1.0, share.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, 2), np.float32)
    base = np.zeros(2, np.float32)
    step, steps = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = np.float32(RATE * (1 - step / steps))
            ids, share = rows[i]
            mine = vectors[ids]
            mean = share @ mine
            logit = mean @ layer + base
            p = np.exp(logit - logit.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            base -= rate * np.float32(0.1) * error
            # the share of a bucket is small, so its step is scaled by the number of buckets
            vectors[ids] = mine - (rate * np.float32(20.0)) * share[:, None] * back
            step += 1
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(base[1] - base[0]))


def in_fold(id_col: Column, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, fold: int | None = 0, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label) of labelled documents outside the held-out fold, in a fixed order.

    At most max_rows rows, those with the smallest hash of the id, so every label has the
    same chance at any size. Null ids and labels are left out; an id with several labels
    counts as 0 if any of them is 0.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if fold is not None:
        usable = usable.where(~in_fold(F.col("doc_id"), fold))
    order = F.xxhash64(F.col("doc_id"))
    ids = (usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
           .orderBy(order, "doc_id").limit(max_rows))
    return (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
            .orderBy(order, "doc_id", "text").limit(max_rows).select("text", "label"))


def fit(docs: DataFrame, labels: DataFrame, fold: int | None = 0, max_rows: int = TRAIN_ROWS) -> Model:
    """Train on training_rows in one task; the driver gets one number per bucket."""
    found = training_rows(docs, labels, fold, max_rows).coalesce(1).mapInArrow(_train_rows, "weight binary, bias double").collect()
    if not found:
        return train(NO_ROWS)
    return Model(np.frombuffer(bytes(found[0]["weight"]), np.float64), found[0]["bias"])


def _train_rows(batches):
    held = list(batches)
    model = train(pa.Table.from_batches(held) if held else NO_ROWS)
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], ["weight", "bias"])


def score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """docs with the probability of label 1; null and empty texts have the bias's. Only the
    text is read for it; a column of that name is replaced, all others are kept."""
    own = [c for c in docs.columns if c != name]
    df = docs.select(*[F.col(f"`{c}`") for c in own], F.lit(0.0).alias(name))
    place, shared = own.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in by_bytes(batches, text_col, SCORE_BYTES):
            columns = batch.columns
            columns[-1] = pa.array(shared.value.score(batch.column(place)), pa.float64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
