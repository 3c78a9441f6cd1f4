"""The stages against plain versions, each on its predecessor's rows."""

import numpy as np

import corpus_pipeline as cp
from gridlake.llm import quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        kept[name], before = docs, docs
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == COLUMNS
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        left = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name == "quality classifier":
            model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"), fold=0)
            scored = quality.score(before, model).select("doc_id", "score").collect()
            assert left == sorted(r.doc_id for r in scored if r.score >= 0.3) and len(left) < len(rows)
        elif name == "n-gram Jaccard join":
            found = brute.near_duplicates(rows, 5, 80)
            assert left == sorted({c for _, c in found.values()})
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert left == sorted(i for i, n, hit, _ in brute.contamination(rows, items) if not (hit > 0 and 20 * hit >= n))
        elif name == "mixing sources":
            assert set(left) <= {i for i, _ in rows} and max(np.unique(left, return_counts=True)[1]) <= 2
        else:
            assert left == sorted(i for i, _ in rows)


def test_edges(spark, edge_docs, no_docs, tmp_path):
    for given, name in ((edge_docs.select(COLUMNS), "edge"), (no_docs, "none")):
        docs = given
        for k, (_, stage) in enumerate(cp.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert (docs.count() == 0) == (name == "none")
