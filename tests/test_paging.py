"""Pages by spans against the fold over whole contexts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators import chunks as ch
from gridlake.operators import paging as pg


def fold(needs, limit):
    """The page of every line, line by line."""
    pages, page, used = [], -1, 0
    for need in needs:
        if page < 0 or used + need > limit:
            page, used = page + 1, 0
        pages.append(page)
        used += need
    return pages


@pytest.mark.parametrize("limit", [1, 7, 30, 200])
def test_spans_compose(limit):
    rng = random.Random(limit)
    for _ in range(300):
        needs = [rng.choice([1, 2, 5, 9, 40]) for _ in range(rng.randint(1, 60))]
        want, at, fill, page, got = fold(needs, limit), 0, 0, -1, []
        while at < len(needs):
            span = np.array(needs[at:at + rng.randint(1, 20)], np.int64)
            got += pg.cut(span, fill, page, limit).tolist()
            fill, page = pg.walk(pg.span_table(span, limit), int(span.sum()), fill, page, limit)
            at += len(span)
            assert page == got[-1]
        assert got == want


@pytest.mark.parametrize("span", [pg.SPAN_CHARS, 50])
def test_pages_are_those_of_the_whole_context(spark, span):
    rng = random.Random(3)
    rows = []
    for q in range(30):
        for rank in range(rng.randint(1, 12)):
            text = "\n".join("é" * rng.choice([0, 1, 8, 30, 150]) for _ in range(rng.randint(1, 25)))
            rows.append((None if q == 7 else q, rank, text, rng.choice([None, "f"]), rng.choice([None, "s"])))
    rows.append((40, 0, "", None, None))
    hits = spark.createDataFrame(rows, "query_id int, rank int, content string, filename string, source string").repartition(5)
    whole = ch.build_context(hits, "query_id", "rank")
    want = {r["query_id"]: r["p"] for r in whole.select("query_id", ch.context_pages(F.col("context"), 100).alias("p")).collect()}
    got = {}
    for r in sorted(pg.context_page_rows(hits, "query_id", ["rank"], 100, span).collect(), key=lambda r: r["page"]):
        got.setdefault(r["query_id"], []).append(r["content"])
    assert got == want


def test_no_hits(spark):
    none = spark.createDataFrame([], "query_id int, rank int, content string, filename string, source string")
    assert pg.context_page_rows(none, "query_id", ["rank"]).collect() == []
