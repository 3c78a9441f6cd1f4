"""Decontamination, quality, mixing."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridlake.llm import decontamination as dc
from gridlake.llm import mixing, quality
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_search_finds_all():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 20000).astype(np.uint8)
    text = data.tobytes()
    patterns = [text[i:i + n] for i, n in ((0, 3), (50, 4), (5000, 30), (19990, 10), (700, 13))] + [b"zz", b"ab"]
    patterns = list(dict.fromkeys(patterns))
    lo, hi, k = dc.Searcher(patterns).search(data)
    want = sorted((i, i + len(p), n) for n, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))
    assert sorted(zip(lo.tolist(), hi.tolist(), k.tolist())) == want


def test_spans(spark, edge_docs, edge_rows, no_docs, monkeypatch):
    long = next(t for i, t in edge_rows if i == 63).split()
    items = [(1, " ".join(long[:40])), (2, " ".join(long[30:33]).upper()), (3, None), (None, " ".join(long[100:120])),
             (5, ""), (6, "w1"), (1, " ".join(long[:40])), (7, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination(edge_rows, items), key=str)
    for size in (dc.BLOCK_BYTES, 200):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        found = dc.find_spans(edge_docs, bench)
        assert set(found.columns) == set(edge_docs.columns) | {"hit_words", "hit_spans", "hit_items"}
        got = found.select("doc_id", "hit_words", dc.n_hit(), "hit_items").collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert dc.find_spans(no_docs, bench).count() == 0
    assert {r.hit_items == [] for r in dc.find_spans(edge_docs, bench.limit(0)).collect()} == {True}


def test_quality_learns_from_6000_rows(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "'w' || id AS text")
    rows = quality.training_rows(docs, docs.selectExpr("doc_id", "doc_id % 2 AS quality"), fold=0).collect()
    assert len({r.text for r in rows}) == len(rows) == 6000
    assert not any(zlib.crc32(r.text[1:].encode()) % 5 == 0 for r in rows)


def test_quality(spark, edge_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, fold=0)
    scored = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id")
    held = scored.where(quality.in_fold(F.col("doc_id"), 0)).toPandas()
    assert ((held.score >= 0.3) == (held.quality == 1)).mean() >= 0.95
    # a score depends on the text alone
    again = quality.score(docs.select("doc_id", "text").repartition(3).withColumn("doc_id", F.lit(1)), model)
    assert sorted(r.score for r in again.collect()) == sorted(
        r.score for r in quality.score(docs.select("doc_id", "text"), model).collect())
    # a plain forward pass on the fitted numbers
    edge = quality.score(edge_docs, model).collect()
    for r in edge + quality.score(docs.where("doc_id < 40"), model).collect():
        assert abs(r.score - brute.quality_score(r.text, model.weight, model.bias)) < 1e-9
    assert len(edge) == edge_docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert len({r.score for r in edge if not (r.text or "").strip()}) == 1
    assert quality.score(no_docs, model).count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert nothing.score(pa.array(["a b", None])).tolist() == [0.5, 0.5]


def test_mixing(edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "SALT_ROWS", 5)
    planned = mixing.plan_copies(edge_docs)
    rows = planned.select("doc_id", "text", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()
    assert [c for c in planned.columns if not c.startswith("mix_")] == [c for c in edge_docs.columns if c != "mix_size"]
    sizes = {}
    for r in rows:
        assert r.mix_size == len(brute.WORD.findall(r.text or "")) and 0 <= r.mix_copies <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
    want = brute.mix_targets(sizes)
    taken = {}
    for r in rows:
        assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - want[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.mix_copies * r.mix_size
    largest = {s: max(r.mix_size for r in rows if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)
    again = mixing.plan_copies(edge_docs.repartition(7)).select("doc_id", "text", "mix_copies")
    assert sorted(map(str, again.collect())) == sorted(map(str, planned.select("doc_id", "text", "mix_copies").collect()))
    assert mixing.mix(edge_docs).count() == sum(r.mix_copies for r in rows)
    assert mixing.plan_copies(no_docs).count() == 0
