import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridlake.llm import encoding, token_files
from gridlake.llm.token_counts import count_tokens
from gridlake.llm.token_files import Shard, pack, read_token_files, shard_bytes, unpack, write_token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "'s", "'", "!?", "é", "é", "Σ", "<|endoftext|>", "<|startoftext|>",
       "12", "\x01", "日本", " ", " x y", "\r\n", "İ", "ﬁ", " ", ",", "."]


def odd_texts(n):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return texts + ["".join(rng.choice([" a", " the", "\nB", "!", "'ll", "é", ","]) for _ in range(rng.randint(0, 30)))
                    for _ in range(n)]


@pytest.mark.parametrize("kept", [50, encoding.KEPT_PIECES])
def test_pieces_encode_as_the_library(kept, monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_PIECES", kept)
    texts = odd_texts(3000)
    want = [e.ids for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    encoder, counter = encoding.Encoder(BYTE), encoding.Counter(WORD)
    counts = [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    for lo in range(0, len(texts), 500):
        ids, sizes = encoder(pa.array(texts[lo:lo + 500]))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == want[lo:lo + 500]
        assert counter(pa.array(texts[lo:lo + 500])).tolist() == counts[lo:lo + 500]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 20000, dtype=np.uint64).astype(np.uint32)
    assert (unpack(np.frombuffer(pack(ids, bits), np.uint8), bits, len(ids)) == ids).all()
    shard = Shard(shard_bytes(3, [4, None, 9], ids, np.array([15000, 0, 5000]), bits) + b"\n")
    assert shard.doc_ids[[0, 2]].tolist() == [4, 9] and shard.nulls.tolist() == [False, True, False]
    for lo, hi in ((0, 20000), (0, 0), (4095, 4097), (8192, 8193), (19999, 20000), (5, 12345)):
        assert (shard.ids(lo, hi) == ids[lo:hi]).all()


def test_token_files(spark, edge_docs, edge_rows, no_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 2000)
    write_token_files(edge_docs, str(tmp_path / "t"), BYTE, 50257, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, str(tmp_path / "t")).collect())
    library, at, want = Tokenizer.from_file(BYTE), 0, []
    for i, t in sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [g[1:] for g in got if g[1] is not None] == [w[1:] for w in want if w[1] is not None]
    assert [g[0] for g in got][0] == 0 and sum(g[2] for g in got) == at
    assert sorted(g[0] for g in got)[1:] == np.cumsum([g[2] for g in got])[:-1].tolist()
    write_token_files(no_docs, str(tmp_path / "none"), BYTE, 50257, 2)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_token_counts(edge_docs, edge_rows, no_docs):
    library = Tokenizer.from_file(WORD)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in edge_rows), key=str)
    got = [tuple(r) for r in count_tokens(edge_docs, WORD, 100).collect()]
    assert sorted((g[:3] for g in got), key=str) == want
    assert all(g[3] == (g[2] > 100) for g in got)
    assert count_tokens(no_docs, WORD, 100).count() == 0
