"""N-gram join, vectors, components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import ngram_join as nj
from gridlake.llm import vector_pairs as vp
from gridlake.llm.components import components
from tests.llm import brute


def edited_texts():
    rng, rows = random.Random(3), []
    voc = [f"w{k}" for k in range(60)]
    for _ in range(40):
        base = [rng.choice(voc) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 12, 15, 20, 40, 80, 150]))]
        for _ in range(rng.randint(1, 20)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if text:
                    k = rng.randrange(len(text))
                    text[k:k + rng.randint(0, 1)] = [rng.choice(voc)]
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.1 else " ".join(text)))
    return rows


@pytest.mark.parametrize("size,percent,block", [(3, 90, 2000), (3, 90, 4), (5, 80, 2000)])
def test_near_duplicates(spark, size, percent, block, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SETS", block)
    rows = edited_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_duplicates(df, size, percent).collect()}
    assert got == brute.near_duplicates(rows, size, percent)


def test_near_duplicates_edges(edge_docs, edge_rows, no_docs):
    # rows that repeat an id have the same text here but for null ids
    want = brute.near_duplicates([r for r in edge_rows if r[0] is not None and r[0] != 5])
    got = [r for r in nj.near_duplicates(edge_docs.where("doc_id IS NULL OR doc_id <> 5")).collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert sorted(r.n_shingles for r in got if r.doc_id is None) == [0, 58]
    assert nj.near_duplicates(edge_docs).count() == edge_docs.count()
    assert nj.near_duplicates(no_docs).count() == 0


def repeated_ids(edge_rows):
    """Rows with ids that repeat over different texts, some of them near copies of others."""
    rng = random.Random(8)
    a, b, c = ([f"{n}{rng.randrange(50)}" for _ in range(60)] for n in "abc")
    near = [*a[:-1], "other"]
    rows = [r for r in edge_rows if r[0] is not None] + [
        (300, " ".join(a)), (300, " ".join(b)), (301, " ".join(c)), (301, " ".join(a)), (299, " ".join(near)),
        (302, " ".join(b)), (303, " ".join(c)), (304, " ".join(c)), (304, " ".join([*c[:-1], "x"])), (304, None), (304, "")]
    return rows + [(305, " ".join(a[:30] + b[:30])), (305, " ".join(b[30:] + c[30:]))]


def test_near_duplicates_repeated_ids(spark, edge_rows):
    rows = repeated_ids(edge_rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # by row numbers in the order of ids, which are then read as the ids
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    found = brute.near_duplicates([(n, rows[k][1]) for n, k in enumerate(order)])
    want = sorted((rows[k][0], found[n][0], rows[order[found[n][1]]][0]) for n, k in enumerate(order))
    got = nj.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_stage_keeps_texts_of_repeated_ids(spark):
    import corpus_pipeline as cp

    rng = random.Random(9)
    a, b, c = (" ".join(f"{n}{rng.randrange(90)}" for _ in range(80)) for n in "abc")
    rows = [(1, a), (2, a + " x"), (2, b), (3, c), (3, b + " y"), (3, c + " z"), (4, None), (4, ""), (4, ""), (5, a), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()), key=str)
    of_c = [(3, t) for i, t in left if t in (c, c + " z")]
    assert len(of_c) == 1 and left == sorted([(1, a), (2, b), *of_c, (4, None), (4, "")], key=str)


@pytest.mark.parametrize("block", [4096, 40])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vp, "BLOCK", block)
    rng, rows = np.random.default_rng(0), []
    for _ in range(25):
        centre = rng.normal(size=8)
        rows += [centre + rng.normal(size=8) * rng.choice([0, 0.05, 0.2, 0.4]) for _ in range(rng.integers(1, 20))]
    rows = [[float(x) for x in r] for r in rows]
    rows += [[0.0] * 8, None, [], [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7,
             [1e300] * 8, [1e-300] * 8, [1.0] * 8, [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(rows)) + [(3, rows[3]), (None, rows[4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).repartition(3)
    got = vp.near_vectors(df).collect()
    named = sorted((-1, 0, -1) if r.vec_id is None else (r.vec_id, r.n_links, r.component_id) for r in got)
    assert named == brute.near_vectors(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert vp.near_vectors(df.limit(0)).count() == 0


def test_cover_tree_levels():
    rng = np.random.default_rng(1)
    points = vp.unit(np.repeat(rng.normal(size=(20, 6)), 30, axis=0) + 0.03 * rng.normal(size=(600, 6)))
    tree = vp.CoverTree(points)
    assert sorted(map(tuple, tree.points)) == sorted(map(tuple, points)) and tree.levels
    for k, radius in enumerate(vp.RADII[:len(tree.levels)]):
        _, _, radii = tree.level(k)
        assert radii.max() <= radius + 1e-9
        if k:
            assert set(tree.levels[k - 1]) <= set(tree.levels[k])
    found = vp.matches(tree, tree, 0.9)
    assert (found == (tree.points @ tree.points.T >= 0.9)).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, rng.randint(1, 60)) for _ in range(40)]
    links += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7)]
    groups = brute.Groups({x for pair in links for x in pair})
    for a, b in links:
        groups.union(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: groups.find(i) for i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
