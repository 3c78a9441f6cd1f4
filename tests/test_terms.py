"""Dictionary terms in texts, and literals in stored values, against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import access as ac
from gridlake.operators import resolve as rs
from gridlake.operators import terms as tm


def texts(rng, n):
    return ["".join(rng.choices("abcé 订单", k=rng.randint(0, 30))) for _ in range(n)] + [None, ""]


@pytest.mark.parametrize("limits", [{}, {"max_terms": 7, "slice_texts": 11}, {"max_bytes": 40}])
def test_terms_in_texts(spark, limits):
    rng = random.Random(1)
    said = texts(rng, 120)
    words = ["".join(rng.choices("abcé 订单", k=rng.randint(1, 4))) for _ in range(60)] + ["", None, "a", "ab", "订单"]
    df = spark.createDataFrame(list(enumerate(said)), "n int, t string").selectExpr("*", "'x' AS term").repartition(3)
    listed = spark.createDataFrame([(w,) for w in words], "term string")
    got = {r["n"]: r["terms"] for r in tm.with_terms(df, "t", listed, **limits).collect()}
    want = {n: sorted({w for w in words if w and t and w in t}, key=lambda w: (-len(w), w)) for n, t in enumerate(said)}
    assert got == want


def test_no_terms(spark):
    df = spark.createDataFrame([(1, "a")], "n int, t string")
    assert [r["terms"] for r in tm.with_terms(df, "t", spark.createDataFrame([], "term string")).collect()] == [[]]


def test_very_many_aliases(spark):
    """100,000 terms, a plan of the same size as for two."""
    many = spark.range(100_000).selectExpr("concat('t', id, 'x') AS term", "concat('c', id) AS target", "'column' AS kind")
    asked = spark.createDataFrame([(1, "what of t77x and t99999x, t5 x"), (2, None), (3, "none")], "n int, q string")
    got = {r["n"]: [(a["term"], a["target"]) for a in r["aliases"]] for r in rs.alias_expansion(asked, "q", many).collect()}
    assert got == {1: [("t99999x", "c99999"), ("t77x", "c77")], 2: [], 3: []}

    plan = rs.alias_expansion(asked, "q", many)._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 10_000


def test_mentioned_columns_of_the_own_table(spark):
    names = spark.createDataFrame(
        [("d1", 0, 1, "Order", "Order", None), ("d1", 0, 2, "Fee", "Total fee", "Fee paid"), ("d2", 0, 1, "Fee", "Fee", ""),
         ("d2", 0, 2, "", "Name", "Order")],
        "document_id string, sheet_idx int, col_index int, technical_name string, display_name string, description string")
    asked = spark.createDataFrame(
        [(1, "d1", 0, "Total fee of Fee paid"), (2, "d2", 0, "Order and Fee"), (3, "d3", 0, "Fee"), (4, "d1", 0, None), (1, "d1", 0, "Order")],
        "request_id int, document_id string, sheet_idx int, q string")
    got = sorted((r["request_id"], r["q"], r["col_index"]) for r in ac.mentioned_columns(asked, names, "q").collect())
    assert got == [(1, "Order", 1), (1, "Total fee of Fee paid", 2), (2, "Order and Fee", 1), (2, "Order and Fee", 2)]


def test_ladder_against_plain_search(spark):
    rng = random.Random(4)
    values = ["".join(rng.choices("abÉc ", k=rng.randint(0, 12))) for _ in range(150)] + [None, "Exact", " exact "]
    literals = ["".join(rng.choices("aBéc ", k=rng.randint(0, 5))) for _ in range(60)] + ["", "a", "exact", "zzz", "Exact"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, v string").repartition(3)

    def rank(v, x):
        return 1 if v == x else 2 if v.strip(" ").lower() == x.strip(" ").lower() else 3 if x.lower() in v.lower() else 9

    want, modes = set(), {}
    for x in set(literals):
        ranks = {i: rank(v, x) for i, v in enumerate(values) if v is not None}
        best = min(ranks.values())
        modes[x] = {1: "exact", 2: "normalized", 3: "fuzzy", 9: "exact-not-found"}[best]
        want |= {(x, modes[x], i) for i, r in ranks.items() if r == best and best < 9}
    got = {(r["literal"], r["match_mode"], r["n"]) for r in rs.match_ladder(df, "v", literals).collect()}
    assert got == want
    asked = spark.createDataFrame([(x,) for x in literals], "literal string")
    assert {r["literal"]: r["match_mode"] for r in rs.match_modes(df, "v", asked).collect()} == modes


def test_ladder_joins_by_equal_keys(spark):
    df = spark.createDataFrame([(1, "abc")], "n int, v string")
    asked = spark.range(1000).select(F.col("id").cast("string").alias("literal"))
    plan = rs.match_ladder(df, "v", asked)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
