"""Batches above every size constant give what uncut rows give."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from gridlake.llm import arrow, decontamination, encoding, ngram_join, quality


@pytest.fixture(scope="module")
def batch():
    """10 MB of texts in one batch, with nulls, in a 32-bit string column."""
    rng = random.Random(1)
    voc = [f"W{i}" for i in range(3000)] + ["Élan", "ß,", "日本", "x\ny"]
    rows = [" ".join(rng.choices(voc, k=rng.randint(0, 900))) for _ in range(4200)]
    rows[7] = rows[4000] = None
    assert sum(len(r or "") for r in rows) > 2 * arrow.BATCH_BYTES
    return pa.record_batch({"text": pa.array(rows, pa.string())})


def slices(batch):
    found = list(arrow.by_bytes(iter([batch])))
    assert len(found) > 2 and sum(b.num_rows for b in found) == batch.num_rows
    return [b.column(0) for b in found]


def test_texts(batch):
    lowered = [t for s in slices(batch) for t in pc.ascii_lower(arrow.texts(s)).to_pylist()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert lowered == [(t or "").translate(low) for t in batch.column(0).to_pylist()]


def test_sets_words_and_scores(batch):
    rows = batch.column(0).to_pylist()
    alone = [pa.array([t], pa.string()) for t in rows]
    cut = slices(batch)
    keys = [k for s in cut for k in ngram_join.set_keys(*ngram_join.shingle_sets(s, 3))]
    assert keys == [ngram_join.set_keys(*ngram_join.shingle_sets(a, 3))[0] for a in alone]
    words = np.concatenate([np.bincount(quality.split_words(arrow.texts(s))[0], minlength=len(s)) for s in cut])
    assert words.tolist() == [len((t or "").split()) for t in rows]
    model = quality.Model(np.random.default_rng(0).normal(size=quality.BUCKETS), 0.1)
    scores = np.concatenate([model.score(s) for s in cut])
    assert scores == pytest.approx(np.concatenate([model.score(a) for a in alone]))
    data = [decontamination.normalised(arrow.texts(s)) for s in cut]
    sizes = np.concatenate([np.diff(starts) for _, starts in data])
    assert sum(sizes) == sum(len(decontamination.normalised(arrow.texts(a))[0]) for a in alone)


@pytest.mark.parametrize("kind,name", [(encoding.Encoder, "byte_bpe_50k.json"), (encoding.Counter, "word_bpe_49k.json")])
def test_tokens(batch, kind, name):
    got = [kind(public_tokenizers.path(name))(s) for s in slices(batch)]
    plain = encoding.load(public_tokenizers.path(name))
    want = [e.ids for e in plain.encode_batch_fast([t or "" for t in batch.column(0).to_pylist()], add_special_tokens=False)]
    if kind is encoding.Counter:
        assert np.concatenate(got).tolist() == [len(w) for w in want]
    else:
        assert np.concatenate([g[0] for g in got]).tolist() == [i for w in want for i in w]
        assert np.concatenate([g[1] for g in got]).tolist() == [len(w) for w in want]
