"""Context pages over line rows, for contexts of any size.

A page takes lines while its characters, one more for each line, stay within the limit. Where a
page ends so depends on all lines before, yet only through how full the page is on which a span
of lines begins. A span therefore tells, for every place at which its first new page can
begin, how many pages follow and how full the last one is; these are at most as many places as
lines fit one page. Walking a context's spans with these tables gives each span the page
and the fill it begins with, and spans are then cut into pages apart from each other. No
context and no group of lines beyond a span is one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.sources.scratch import shared_dir

#: Most characters of the lines that are cut together, but for a single longer line.
SPAN_CHARS = 1 << 20
RULE = "---"


def block_lines(hits: DataFrame, query: str, order: list[str]) -> DataFrame:
    """query, order, n, line: every hit's label, the lines of its content, an empty line and a
    rule. The rule behind a context's last hit is not part of it."""
    label = F.concat(F.lit("[来源："), F.coalesce("filename", "source", F.lit("未知来源")), F.lit("]:"))
    lines = F.concat(F.array(label), F.split("content", "\n"), F.array(F.lit(""), F.lit(RULE)))
    return hits.select(query, *order, F.posexplode(lines).alias("n", "line"))


def span_table(needs: np.ndarray, limit: int) -> dict[str, np.ndarray]:
    """For a first new page at line j: pages that begin from there on, and the fill at the end."""
    upto = np.cumsum(needs)
    n = len(needs)
    before = upto - needs
    # where the page that begins at line j ends: at least one line further
    follow = np.append(np.maximum(np.searchsorted(upto, before + limit, side="right"), np.arange(1, n + 1)), n)
    # pages of the chain from j, and the line at which its last page begins, by doubled steps
    pages, last, jump = np.append(np.ones(n, np.int64), 0), np.arange(n + 1), follow
    while (jump[:n] < n).any():
        inside = jump < n
        pages = pages + np.where(inside, pages[jump], 0)
        last = np.where(inside, last[jump], last)
        jump = jump[jump]
    held = int(np.searchsorted(upto, limit, side="right"))
    first = min(held, n - 1)
    return {"upto": upto[:held], "pages": pages[:first + 1], "fill": upto[-1] - before[last[:first + 1]]}


def walk(table: dict[str, np.ndarray], total: int, fill: int, page: int, limit: int) -> tuple[int, int]:
    """(fill, page) behind a span that begins on page `page` (-1: none) with this fill."""
    if page < 0:
        j = 0
    else:
        j = int(np.searchsorted(table["upto"], limit - fill, side="right")) if fill <= limit else 0
        if j >= len(table["pages"]):
            return fill + total, page
    return int(table["fill"][j]), page + int(table["pages"][j])


def cut(needs: np.ndarray, fill: int, page: int, limit: int) -> np.ndarray:
    """The page of every line of a span."""
    upto = np.cumsum(needs)
    pages, n = np.empty(len(needs), np.int64), len(needs)
    begin, base = 0, -fill
    if page < 0:
        page, base = 0, 0
    elif fill + needs[0] > limit:
        page, base = page + 1, 0
    while begin < n:
        end = max(int(np.searchsorted(upto, base + limit, side="right")), begin + 1)
        pages[begin:end] = page
        begin, page = end, page + 1
        base = int(upto[end - 1])
    return pages


def _pack(limit: int, span_chars: int):
    """Sorted rows (query, line) to spans: query, part, number, lines, total, table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, chars, now = TaskContext.get().partitionId(), 0, [], 0, None

        def span() -> pa.RecordBatch:
            needs = np.fromiter(map(len, held), np.int64, len(held)) + 1
            table = span_table(needs, limit)
            return pa.RecordBatch.from_arrays(
                [now, pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([held], pa.list_(pa.string())),
                 pa.array([int(needs.sum())], pa.int64()), *[pa.array([table[c]], pa.list_(pa.int64())) for c in ("upto", "pages", "fill")]],
                ["query", "part", "number", "lines", "total", "upto", "pages", "fill"])

        for batch in batches:
            queries = batch.column(0)
            names, lines = queries.to_pylist(), batch.column(1).to_pylist()
            for i, (name, line) in enumerate(zip(names, lines)):
                if held and (name != now[0].as_py() or chars + len(line) + 1 > span_chars):
                    yield span()
                    held, chars, number = [], 0, number + 1
                if not held:
                    now = queries.slice(i, 1)
                held.append(line)
                chars += len(line) + 1
        if held:
            yield span()
    return run


def _walk_spans(limit: int):
    """Sorted spans without lines to the state in which each begins: (query, part, number, fill,
    page, is_last, whole); whole contexts within the limit have one page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states(spans: list) -> pa.RecordBatch:
            # the last line, a rule, is not part of the text
            whole = sum(s[3] for s in spans) - len(RULE) - 2 <= limit
            fill, page, out = 0, -1, []
            for query, part, number, total, upto, pages, after in spans:
                out.append((part, number, fill, page))
                table = {"upto": np.array(upto, np.int64), "pages": np.array(pages, np.int64), "fill": np.array(after, np.int64)}
                fill, page = walk(table, total, fill, page, limit)
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([s[0] for s in spans]), *[pa.array(c, pa.int64()) for c in columns],
                 pa.array([i == len(spans) - 1 for i in range(len(spans))]), pa.array([whole] * len(spans))],
                ["query", "part", "number", "fill", "page", "is_last", "whole"])

        held: list = []
        for batch in batches:
            queries = batch.column(0)
            for i, row in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]])):
                name = queries.slice(i, 1)
                if held and held[0][0][0].as_py() != name[0].as_py():
                    yield states(held)
                    held = []
                held.append((name, *row))
        if held:
            yield states(held)
    return run


def _cut_spans(limit: int):
    """Spans with the state they begin in to pieces of pages: (query, page, part, number, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = batch.column(0)
            for i, (part, number, lines, fill, page, is_last, whole) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]])):
                needs = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
                pages = np.zeros(len(lines), np.int64) if whole else cut(needs, fill, page, limit)
                if is_last:
                    lines, pages = lines[:-1], pages[:-1]
                edges = [0, *(np.flatnonzero(np.diff(pages)) + 1).tolist(), len(lines)]
                texts = [(int(pages[lo]), "\n".join(lines[lo:hi])) for lo, hi in zip(edges, edges[1:]) if lo < hi]
                if texts:
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays(
                        [queries.take(pa.array([i] * n)), pa.array([t[0] for t in texts], pa.int64()), pa.array([part] * n, pa.int64()),
                         pa.array([number] * n, pa.int64()), pa.array([t[1] for t in texts], pa.string())],
                        ["query", "page", "part", "number", "text"])
    return run


def context_page_rows(hits: DataFrame, query: str, order: list[str], limit: int = fv.CONTEXT_PAGE_CHARS,
                      span_chars: int = SPAN_CHARS) -> DataFrame:
    """query, page (from 0), content: the pages of every query's context, of all hits it is given.

    `order` are columns that order a query's hits, without ties. The pages joined by line
    breaks are the context that build_context makes of the same hits. A null content makes
    its hit's block null there and is an empty text here.
    """
    hits = hits.withColumn("content", F.coalesce("content", F.lit("")))
    kind = hits.schema[query].dataType.simpleString()
    lines = block_lines(hits, query, order).withColumnRenamed(query, "query")
    keys = ["query", *order, "n"]
    spans = _stored(
        lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("query", "line").mapInArrow(
            _pack(limit, span_chars), f"query {kind}, part bigint, number bigint, lines array<string>, total bigint, upto array<bigint>, "
                          "pages array<bigint>, fill array<bigint>"), "page-spans")
    slim = spans.select("query", "part", "number", "total", "upto", "pages", "fill")
    states = slim.repartition("query").sortWithinPartitions("query", "part", "number").mapInArrow(
        _walk_spans(limit), f"query {kind}, part bigint, number bigint, fill bigint, page bigint, is_last boolean, whole boolean")
    pieces = spans.select("query", "part", "number", "lines").join(states.drop("query"), ["part", "number"]).select(
        "query", "part", "number", "lines", "fill", "page", "is_last", "whole").mapInArrow(
        _cut_spans(limit), f"query {kind}, page bigint, part bigint, number bigint, text string")
    parts = F.array_sort(F.collect_list(F.struct("part", "number", "text")))
    return pieces.groupBy("query", "page").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("content")).select(
        F.col("query").alias(query), "page", "content")


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    folder = shared_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
