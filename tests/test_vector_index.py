"""The cell index against plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators import vector_index as vi
from gridlake.operators import vectors as vc


def clustered(n, dim, groups, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))


def table(spark, rows):
    return spark.createDataFrame([(i, g, v if v is None else [x if x is None else float(x) for x in v]) for i, g, v in rows],
                                 "vec_id long, g string, embedding array<double>").repartition(4)


def asked(spark, rows):
    return spark.createDataFrame([(i, g, v if v is None else [float(x) for x in v]) for i, g, v in rows],
                                 "query_id long, g string, query_vec array<double>")


def proper(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / n), 12) if n else 0.0


def plain(rows, queries, k, metric="l2", least=None, on=False, exclude_self=False):
    out = {}
    for q, g, w in queries:
        found = []
        for i, h, v in rows:
            if not proper(v) or not proper(w) or len(v) != len(w) or (on and (g is None or g != h)) or (exclude_self and i == q):
                continue
            v, u = np.asarray(v, float), np.asarray(w, float)
            s = round(float(((v - u) ** 2).sum()), 6) if metric == "l2" else cosine(v, u)
            if least is None or s >= least:
                found.append((s if metric == "l2" else -s, i))
        found = sorted(found)[:k]
        if found:
            out[q] = [i for _, i in found]
    return out


def listed(df, metric="l2"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["score"] if metric == "l2" else -r["score"], r["vec_id"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def mixed_rows():
    data = [(i, "abc"[i % 3], v) for i, v in enumerate(clustered(600, 6, 25, 1))]
    data += [(600 + i, "a", v) for i, v in enumerate(clustered(50, 3, 5, 2))]
    data += [(700, "a", None), (701, "b", []), (702, "b", [float("nan")] * 6), (703, "a", [None] * 6), (704, None, [0.1] * 6),
             (705, "c", [0.0] * 6), (706, "c", [0.0] * 6), (707, "a", [float("inf")] * 6)]
    # a third of the rows are one vector
    return data + [(800 + i, "a", data[0][2]) for i in range(300)]


def mixed_queries():
    rng = np.random.default_rng(5)
    rows = [(i, "abcd"[i % 4], v + 0.01 * rng.normal(size=6)) for i, v in enumerate(clustered(60, 6, 25, 1))]
    return rows + [(100, "a", [0.0] * 6), (101, "a", None), (102, "a", [1.0, 2.0, 3.0]), (103, None, rows[0][2]), (104, "a", [1.0] * 9)]


@pytest.mark.parametrize("metric,k,least,on", [
    ("l2", 5, None, False), ("l2", 3, None, True), ("l2", 400, None, False), ("cosine", 7, None, False), ("cosine", 7, 0.9, False),
    ("cosine", None, 0.97, False), ("cosine", 4, None, True)])
def test_search_equals_plain_search(spark, metric, k, least, on):
    rows, queries = mixed_rows(), mixed_queries()
    index = vi.build_index(table(spark, rows), None, metric, ["g"] if on else None)
    found, visits = vi.search(index, asked(spark, queries), k, least)
    assert listed(found, metric) == plain(rows, queries, k, metric, least, on)
    assert all(0 <= r["cells_visited"] <= r["cells"] for r in visits.collect())


def test_cells_are_pruned(spark):
    data = [(i, "a", v) for i, v in enumerate(clustered(4000, 8, 60, 3, 0.02))]
    queries = [(i, "a", v) for i, _, v in data[::40]]
    index = vi.build_index(table(spark, data))
    found, visits = vi.search(index, asked(spark, queries), 5, exclude_self=True)
    assert listed(found) == {}.__class__(plain([(i, g, v) for i, g, v in data], queries, 5, exclude_self=True))
    shares = [(r["cells_visited"], r["cells"]) for r in visits.collect()]
    assert len(shares) == len(queries) and all(a < b for a, b in shares)
    assert sum(a for a, _ in shares) < 0.35 * sum(b for _, b in shares)


def test_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vi, "PART_ROWS", 50)
    monkeypatch.setattr(vi, "BLOCK_QUERIES", 7)
    rows, queries = mixed_rows(), mixed_queries()
    found, _ = vi.search(vi.build_index(table(spark, rows), pivots=5), asked(spark, queries), 6)
    assert listed(found) == plain(rows, queries, 6)


def test_many_queries_take_the_index(spark):
    rows, queries = mixed_rows(), mixed_queries()
    few = vc.nearest_for_each(table(spark, rows), asked(spark, queries), 4, on=["g"])
    many = vc.nearest_for_each(table(spark, rows), asked(spark, queries), 4, on=["g"], max_broadcast_bytes=0)
    assert sorted(few.collect()) == sorted(many.select(*few.columns).collect())
    few = vc.cosine_for_each(table(spark, rows), asked(spark, queries), 4, 0.5)
    many = vc.cosine_for_each(table(spark, rows), asked(spark, queries), 4, 0.5, max_broadcast_bytes=0)
    assert sorted(few.collect()) == sorted(many.select(*few.columns).collect())


def test_nothing_to_search(spark):
    none = table(spark, [(1, "a", None)])
    found, visits = vi.search(vi.build_index(none), asked(spark, [(1, "a", [1.0])]))
    assert found.collect() == [] and visits.count() == 0
    found, _ = vi.search(vi.build_index(table(spark, mixed_rows())), asked(spark, []))
    assert found.collect() == []


def test_only_visited_cells_are_scanned(spark):
    index = vi.build_index(table(spark, mixed_rows()))
    some = index.rows.where(F.expr("dim = 6 AND cell IN (1, 2)"))
    assert "PartitionFilters: [" in some._jdf.queryExecution().executedPlan().toString()


def test_queries_move_by_parts_not_by_cells(spark, monkeypatch):
    """Independent directions, where no bound prunes and every query visits every cell."""
    rng = np.random.default_rng(9)
    data = [(i, "ab"[i % 2], v) for i, v in enumerate(rng.normal(size=(900, 24)))]
    moved, stored = [], vi._stored
    monkeypatch.setattr(vi, "_stored", lambda df, purpose: moved.append((purpose, stored(df, purpose))) or moved[-1][1])
    found, visits = vi.search(vi.build_index(table(spark, data), on=["g"]), asked(spark, data), 3, exclude_self=True)
    assert listed(found) == plain(data, data, 3, on=True, exclude_self=True)
    assert sum(r["cells_visited"] for r in visits.collect()) > 20 * len(data)
    assert sum(df.count() for purpose, df in moved if purpose == "index-visits") <= 2 * len(data)


def test_tasks_pass_on_their_own_best_only(spark):
    """Few rows go on however many batches a task has."""
    data = [(i, "a", v) for i, v in enumerate(clustered(400, 6, 9, 4))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        partial = vc._meet(table(spark, data).coalesce(1), asked(spark, data), 3, "l2", np.inf, [], "vec_id", "embedding",
                           "query_id", "query_vec", True)
        assert partial.count() == 3 * len(data)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert listed(partial) == plain(data, data, 3, exclude_self=True)
