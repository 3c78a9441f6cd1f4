"""Statistics and robust outliers against plain versions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import outliers as o
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_chi_square():
    assert o.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert o.chi2_quantile(0.975, 5) == pytest.approx(12.832502, abs=1e-5)
    assert o.chi2_cdf(4.351460, 5) == pytest.approx(0.5, abs=1e-6)
    rng = np.random.default_rng(0)
    d = np.sort((rng.normal(size=(400_000, 5)) ** 2).sum(1))
    assert o.consistency(0.75, 5) == pytest.approx(5 / d[:300_000].mean(), rel=0.01)


def texts():
    rng, rows = random.Random(4), [None, "", " \t\n", "one", "one two", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\n\nx ", "é#é 日本 |\r\nq|",
                                   "a b c d b c d e b c d", "\x0b a \x0c b\x1f c\x0b"]
    voc = ["a", "b", "c", "dd", "é", "日本", "e#", "$f"]
    rows += ["".join(rng.choice(voc) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return rows + [" ".join(rng.choice(voc) for _ in range(20000)), "word " * 30000, " ".join(f"w{n}" for n in range(30000)) + " w0 w1 w2"]


def test_text_stats(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'e' AS lang", "'s' AS source", "1 AS n_words", "'x' AS stats")
    got = {r.doc_id: tuple(r[c] for c in o.STATS) for r in o.with_stats(df).collect()}
    assert got == {i: brute.text_stats(t) for i, t in rows}


def test_repeated_windows_of_one_hash(spark, monkeypatch):
    """Windows that share a hash and differ in words are not the same."""
    monkeypatch.setattr(o.F, "xxhash64", lambda *cols: F.length(cols[0].cast("string")).cast("long") * 0 + 5)
    rows = [(i, t) for i, t in enumerate(texts()) if len(t or "") < 5000]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", o.text_stats(F.coalesce("text", F.lit(""))).alias("s")).collect()
    assert {r.doc_id: tuple(r.s) for r in got} == {i: brute.text_stats(t) for i, t in rows}


def test_judge(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.expr("if(doc_id % 3 = 0, null, lang)").alias("lang"),
                                                                F.expr("if(source = 'src0', null, 'rest')").alias("source"))
    rows = docs.collect()
    got = {r.doc_id: r for r in o.judge(docs.repartition(5)).collect()}
    assert len(got) == len(rows)
    floors = np.array([f for _, _, f in o.FEATURES])
    groups = {}
    for r in rows:
        w, c, s, d, n = brute.text_stats(r.text)
        assert tuple(got[r.doc_id][x] for x in o.STATS) == (w, c, s, d, n)
        assert got[r.doc_id].base_failed == (w < 50 or 100 * n > 50 * w)
        if not got[r.doc_id].base_failed:
            x = (math.log1p(w), math.log(c / w), math.log1p(1000 * s / c), math.log1p(d), math.sqrt(n / w))
            groups.setdefault(json.dumps([r.lang, r.source]), []).append((r.doc_id, x))
    small = [m for k in [k for k, m in groups.items() if len(m) < o.LEAST_ROWS] for m in groups.pop(k)]
    if small:
        groups[""] = small
    assert len(groups) > 2
    for members in groups.values():
        x = np.array([m[1] for m in members])
        centre, cov = brute.robust_shape(x, floors, o.ALPHA, o.STEPS, o.NEAR, o.consistency, o.chi2_quantile)
        d2 = np.einsum("ij,ij->i", x - centre, np.linalg.solve(cov, (x - centre).T).T)
        mine = np.array([got[i].distance if got[i].distance is not None else -1 for i, _ in members])
        if len(members) < o.LEAST_ROWS:
            assert all(got[i].kept for i, _ in members)
            continue
        # bins and starts differ a little; verdicts do not
        assert np.corrcoef(np.log1p(mine), np.log1p(d2))[0, 1] > 0.98
        assert [got[i].kept for i, _ in members] == (d2 <= o.chi2_quantile(o.CUT, o.P)).tolist()


def test_verdicts_follow_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = o.judge(spark.read.parquet(f"{SF}/documents.parquet")).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.99 and kept[0] < 0.05


def test_edges(edge_docs, edge_rows, no_docs):
    got = o.judge(edge_docs).collect()
    assert sorted(tuple(r[c] for c in o.STATS) for r in got) == sorted(brute.text_stats(t) for _, t in edge_rows)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert o.judge(no_docs).count() == 0


def test_no_python_in_the_plan(spark):
    """DataFrame functions only."""
    plan = o.judge(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "MapPartitions"))
