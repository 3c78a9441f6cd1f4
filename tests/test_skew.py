"""Ordered, windowed and vector operators against brute force, with one hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators import vectors as vc
from gridlake.operators.embedder import embed_texts
from gridlake.operators.limiter import failure_counts
from gridlake.operators.ordered import exact_quantiles, running_sum
from gridlake.operators.relational import range_join


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.randint(-5, 9)) for i in range(900)] + [(f"k{i % 9}", i, 1) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    got = {(r["k"], r["i"]): r["s"] for r in running_sum(df, ["k"], "i", F.col("v"), "s", span=40).collect()}
    want, totals = {}, {}
    for k, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        totals[k] = totals.get(k, 0) + v
        want[(k, i)] = totals[k]
    assert got == want


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    data = {"hot": np.concatenate([np.round(rng.lognormal(3, 2, 4000), 2), np.full(2000, 7.0)]),
            "one": np.array([4.5]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("two", None)],
                               "k string, v double")
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.991, "e": 1.0}
    for r in exact_quantiles(df, ["k"], "v", shares).collect():
        for name, share in shares.items():
            assert r[name] == pytest.approx(np.quantile(data[r["k"]], share)), (r["k"], name)


def test_range_join(spark):
    rng = random.Random(4)
    points = [(i, rng.randint(0, 500)) for i in range(200)]
    spans = [(i, s, s + rng.randint(0, 120)) for i, s in ((i, rng.randint(0, 480)) for i in range(60))]
    got = range_join(
        spark.createDataFrame(points, "p bigint, at bigint"),
        spark.createDataFrame(spans, "s bigint, lo bigint, hi bigint"), "at", "lo", "hi", 25)
    want = sorted((p, s) for p, at in points for s, lo, hi in spans if lo <= at <= hi)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want


@pytest.mark.parametrize("reset", [False, True])
def test_limiter_brute_force(spark, reset):
    rng = random.Random(6)
    base = 1_700_000_000
    rows = []
    for i in range(700):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 3)}"
        rows.append((i, key, base + rng.randint(0, 9000), rng.choice(["fail", "fail", "ok", "view"])))
    rows += [(900, "edge", base, "fail"), (901, "edge", base + 300, "fail"), (902, "edge", base + 599, "fail")]
    seen = set()
    rows = [r for r in rows if not ((r[1], r[2]) in seen or seen.add((r[1], r[2])))]
    df = spark.createDataFrame(rows, "id bigint, k string, s bigint, e string").withColumn(
        "ts", F.col("s").cast("timestamp"))
    success = F.col("e") == "ok" if reset else None
    got = {r["id"]: (r["failures"], r["blocked"]) for r in failure_counts(
        df, "k", "ts", F.col("e") == "fail", success, slot_seconds=600).collect()}
    state, want = {}, {}
    for i, k, s, e in sorted(rows, key=lambda r: r[2]):
        recent = [t for t in state.get(k, []) if s - t < 300]
        if e == "fail":
            recent.append(s)
        if reset and e == "ok":
            recent = []
        state[k] = recent
        want[i] = (len(recent), len(recent) >= 5)
    assert got == want


def brute_knn(vectors, queries, k, label_of=None):
    out = {}
    for qid, q, qlab in queries:
        scored = sorted(
            (round(float(((np.array(v) - np.array(q)) ** 2).sum()), 6), i)
            for i, v, lab in vectors if label_of is None or lab == qlab)
        out[qid] = scored[:k]
    return out


@pytest.mark.parametrize("limit", [1000, 3])
@pytest.mark.parametrize("on", [None, ["label"]])
def test_knn_both_paths(spark, limit, on):
    rng = np.random.default_rng(7)
    vectors = [(i, [float(x) for x in np.round(rng.normal(size=5), 1)], int(i % 3)) for i in range(120)]
    vectors += [(200 + i, vectors[0][1], 0) for i in range(6)]
    queries = [(900 + i, [float(x) for x in np.round(rng.normal(size=5), 1)], int(i % 4)) for i in range(9)]
    queries.append((999, vectors[0][1], 0))
    v = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, label int")
    q = spark.createDataFrame(queries, "query_id bigint, query_vec array<double>, label int")
    found = vc.nearest_for_each(
        v, q, 4, on=on, max_broadcast_bytes=limit).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = {k: w for k, w in brute_knn(vectors, queries, 4, on).items() if w}
    assert got == want


@pytest.mark.parametrize("limit", [1000, 2])
def test_cosine_both_paths(spark, limit):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [(99, [0.0] * 4)]
    queries = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(7)]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in vc.cosine_for_each(
        spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>"),
        spark.createDataFrame(queries, "query_id bigint, query_vec array<double>"),
        least=-2.0, max_broadcast_bytes=limit).collect()}
    assert len(got) == len(vectors) * len(queries)
    for qi, q in queries:
        for vi, v in vectors:
            scale = np.linalg.norm(q) * np.linalg.norm(v)
            assert got[(qi, vi)] == pytest.approx(np.dot(q, v) / scale if scale else 0.0)


def test_single_query_pushes_top_k(spark):
    v = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    near = vc.nearest(v, [10.2], 3, F.col("vec_id") != 10)
    assert [r["vec_id"] for r in near.collect()] == [11, 9, 12]
    assert "TakeOrderedAndProject" in near._jdf.queryExecution().executedPlan().toString()


def test_embedder_contract(spark):
    df = spark.createDataFrame([(i, f"word{i % 5} other") for i in range(45)], "i int, t string").coalesce(1)
    sizes = []

    def short():
        return lambda texts: [[1.0]] * (len(texts) - 1)

    with pytest.raises(Exception, match="expected"):
        embed_texts(df, "t", short).collect()

    def sized():
        return lambda texts: [[float(len(texts)), float(t.split()[0][4:])] for t in texts]

    for r in embed_texts(df, "t", sized).collect():
        sizes.append(r["embedding"][0])
        assert r["embedding"][1] == r["i"] % 5
    assert max(sizes) <= 20
    again = [r["embedding"] for r in embed_texts(df, "t").collect()]
    assert again == [r["embedding"] for r in embed_texts(df, "t").collect()]
