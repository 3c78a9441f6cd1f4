"""Exact nearest vectors through pivot cells.

Vectors lie in cells, each around its nearest of a bounded number of pivots, and a small table
tells every cell's size and the range of distances from its pivot. By the triangle inequality
that bounds from below how near a vector of the cell can be to a query. A query visits a few
cells of least bound, then all others whose bound is not above its k-th distance. Only visited
cells are read; what is returned is exact.

For cosines the vectors are scaled to length 1, where distance and cosine rank alike; vectors of
zeros get an axis of their own, so that their cosine with everything is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlake.sources.scratch import shared_dir

#: Most pivots of one dimension; their number is about the root of the number of vectors.
PIVOTS = 1024
#: Vectors and queries that meet in one task.
PART_ROWS, BLOCK_QUERIES = 20_000, 20_000
#: Most (cell, metadata) rows whose table is broadcast; beyond it there is no index.
MOST_CELLS = 200_000
FIRST_CELLS = 4
#: Scores are rounded; a cell whose bound is within this of the k-th score is visited.
MARGIN = 2e-6
DIGITS = {"l2": 6, "cosine": 12}


class TooManyCells(ValueError):
    """The metadata columns have so many values that cells would be no help."""


@dataclass
class VectorIndex:
    """rows: id, metadata, vec (prepared), dim, cell; cells: one row per (metadata, dim, cell)
    with n, low, high; pivots by dimension."""

    rows: DataFrame
    cells: pd.DataFrame
    pivots: dict[int, np.ndarray]
    on: list[str]
    id_col: str
    metric: str


def prepared(vectors: np.ndarray, metric: str, is_query: bool) -> np.ndarray:
    """Vectors as they are compared: for cosines of length 1 with two more axes, one for vectors
    of zeros and one for queries of zeros."""
    if metric == "l2":
        return vectors
    length = np.linalg.norm(vectors, axis=1)
    zero = length == 0
    unit = vectors / np.where(zero, 1.0, length)[:, None]
    extra = np.zeros((len(vectors), 2))
    extra[zero, int(is_query)] = 1.0
    return np.concatenate([unit, extra], axis=1)


def _matrix(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(rows of vectors that are there and finite, as a matrix of one length; their positions)."""
    good = [i for i, v in enumerate(column) if v is not None and len(v) and not any(x is None for x in v)]
    if not good:
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    m = np.stack([np.asarray(column.iloc[i], np.float64) for i in good])
    fine = np.isfinite(m).all(axis=1)
    return m[fine], np.array(good)[fine]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0))


def build_index(
    vectors: DataFrame, folder: str | None = None, metric: str = "l2", on: list[str] | None = None,
    id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None,
) -> VectorIndex:
    """Store vectors by cell below `folder`, with the table of cells beside them.

    Vectors that are missing, empty or hold missing or infinite numbers are left out, as they
    never rank. The pivots are the vectors of the least hashes of the id, so many for each
    length; they decide how much is read and nothing else.
    """
    spark, on = vectors.sparkSession, on or []
    folder = folder or shared_dir(spark, "vector-index")
    kept = vectors.select(id_col, *on, F.col(vec_col).cast("array<double>").alias("vec")).where("size(vec) > 0")
    sizes = kept.groupBy(F.size("vec").alias("dim")).count().orderBy("dim").limit(1000).collect()
    centres = {}
    for r in sizes:
        n = pivots or min(PIVOTS, int(r["count"] ** 0.5) + 1)
        rows = kept.where(F.size("vec") == r["dim"]).orderBy(F.xxhash64(id_col), id_col).limit(n).select("vec").toPandas()
        matrix, _ = _matrix(rows["vec"])
        if len(matrix):
            centres[r["dim"]] = np.unique(prepared(matrix, metric, False), axis=0)
    shared = spark.sparkContext.broadcast(centres)
    schema = StructType([*kept.select(id_col, *on).schema.fields,
                         *spark.createDataFrame([], "vec array<double>, dim int, cell int, far double").schema.fields])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["vec"].map(len).to_numpy()
            for dim in np.unique(lengths):
                some = pdf[lengths == dim]
                matrix, at = _matrix(some["vec"])
                if dim not in shared.value or not len(at):
                    continue
                matrix = prepared(matrix, metric, False)
                step = max(1, 8_000_000 // len(shared.value[dim]))
                for lo in range(0, len(at), step):
                    part = matrix[lo:lo + step]
                    far = _distances(part, shared.value[dim])
                    cell = far.argmin(axis=1)
                    out = some.iloc[at[lo:lo + step]].copy()
                    # the distance itself, not what is left of a difference of squares
                    exact = np.linalg.norm(part - shared.value[dim][cell], axis=1)
                    out["vec"], out["dim"], out["cell"], out["far"] = list(part), int(dim), cell.astype(np.int32), exact
                    yield out

    placed = kept.mapInPandas(place, schema)
    # rebalanced by the sizes that the shuffle finds, so a cell of most rows is cut as well
    placed.hint("rebalance", "dim", "cell").write.partitionBy("dim", "cell").parquet(f"{folder}/rows")
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    rows.groupBy(*on, "dim", "cell").agg(
        F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).write.parquet(f"{folder}/cells")
    listed = [(dim, i, c.tolist()) for dim, m in centres.items() for i, c in enumerate(m)]
    spark.createDataFrame(listed, "dim int, cell int, vec array<double>").coalesce(1).write.parquet(f"{folder}/pivots")
    return open_index(spark, folder, schema, metric, on, id_col)


def open_index(spark: SparkSession, folder: str, schema: StructType, metric: str, on: list[str], id_col: str) -> VectorIndex:
    """A stored index; only its table of cells and its pivots are loaded."""
    # nulls agree with nothing
    cells = spark.read.parquet(f"{folder}/cells").dropna(subset=["cell", *on]).limit(MOST_CELLS + 1).toPandas()
    if len(cells) > MOST_CELLS:
        raise TooManyCells(f"{folder} has more than {MOST_CELLS} cells")
    pivots: dict[int, np.ndarray] = {}
    for dim, some in spark.read.parquet(f"{folder}/pivots").toPandas().sort_values(["dim", "cell"]).groupby("dim"):
        pivots[int(dim)] = np.stack(some["vec"].to_numpy())
    return VectorIndex(spark.read.schema(schema).parquet(f"{folder}/rows"), cells, pivots, on, id_col, metric)


def _bounds(query: np.ndarray, cells: pd.DataFrame, pivots: np.ndarray) -> np.ndarray:
    """Least distance that a vector of each cell can have from each query."""
    at = _distances(query, pivots)[:, cells["cell"].to_numpy()]
    low, high = cells["low"].to_numpy(), cells["high"].to_numpy()
    # products of matrices are inexact where points nearly coincide
    return np.maximum(np.maximum(at - high, low - at) - 1e-6, 0.0)


class Nearest:
    """The k rows of least rank for each of n queries, met batch by batch. Ranks are rounded, and
    ties go to the least id. Without k, all rows up to `most`."""

    #: Found rows beyond which only the best are kept.
    PENDING = 1_000_000
    #: Rows that give queries their first bound; queries and rows of one product.
    SEED, QUERIES, ROWS = 512, 1024, 2048

    def __init__(self, names: np.ndarray, k: int | None, digits: int, exclude_self: bool = False, most: np.ndarray | float = np.inf):
        self.names, self.k, self.digits, self.exclude_self = names, k, digits, exclude_self
        self.most = np.broadcast_to(np.asarray(most, np.float64), len(names)).copy()
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending, self.kept = 0, 0

    def take(self, at: np.ndarray, rank: np.ndarray, ids: np.ndarray) -> None:
        """Ranks of rows `ids` for the queries at places `at`."""
        first = np.flatnonzero(np.isinf(self.most[at]))
        if self.k is not None and len(first) and self.k <= len(ids):
            some = rank[first]
            if self.exclude_self:
                some = np.where(self.names[at[first]][:, None] == ids[None, :], np.inf, some)
            edge = np.round(np.partition(some, self.k - 1, axis=1)[:, self.k - 1], self.digits)
            self.most[at[first]] = np.where(np.isnan(edge), np.inf, edge)
        most = self.most[at]
        q, v = np.nonzero(rank <= (most + 10.0 ** -self.digits)[:, None])
        self._hold(at[q], ids[v], np.round(rank[q, v], self.digits))
        if self.k is not None and self.pending > self.PENDING + 2 * self.kept:
            self.best()

    def scan(self, at: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, metric: str) -> None:
        """Prepared rows for the prepared queries at places `at`.

        All pairs meet in products of single precision, whose error has a bound; only pairs that
        may be good within it are ranked in double precision.
        """
        right = np.concatenate([rows, (rows * rows).sum(1)[:, None]], axis=1) if metric == "l2" else rows
        fine = np.isfinite(right).all(axis=1)
        if not fine.all():
            rows, right, ids = rows[fine], right[fine], ids[fine]
        fresh = self.k is not None and bool(np.isinf(self.most[at]).any())
        if fresh:
            self._bound(at, queries, rows[:max(self.SEED, 2 * self.k)], ids, metric)
        single = right.astype(np.float32)
        longest = np.sqrt((right * right).sum(1)).max(initial=0.0)
        lo, width = 0, self.SEED
        while lo < len(ids):
            hi = min(len(ids), lo + (min(width, self.ROWS) if fresh else self.ROWS))
            for a in range(0, len(at), self.QUERIES):
                self._near(at[a:a + self.QUERIES], queries[a:a + self.QUERIES], rows[lo:hi], single[lo:hi], longest, ids[lo:hi], metric)
            if self.k is not None and self.pending - self.kept >= max(self.k * len(at), self.kept // 2):
                self.best()
            lo, width = hi, 2 * width

    def _bound(self, at: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, metric: str) -> None:
        """A bound for queries that have none, from the first rows."""
        some = np.flatnonzero(np.isinf(self.most[at])) if len(rows) >= self.k else []
        step = max(1, 1_000_000 // max(len(rows), 1))
        for lo in range(0, len(some), step):
            own = some[lo:lo + step]
            q = queries[own]
            rank = ranks(q, rows, metric)
            if self.exclude_self:
                rank = np.where(self.names[at[own]][:, None] == ids[None, :len(rows)], np.inf, rank)
            edge = np.partition(rank, self.k - 1, axis=1)[:, self.k - 1]
            # products are inexact by what the squares have
            edge += 4 * (q.shape[1] + 8) * np.finfo(np.float64).eps * ((q * q).sum(1) + (rows * rows).sum(1).max())
            edge = np.round(edge, self.digits) + 10.0 ** -self.digits
            self.most[at[own]] = np.where(np.isnan(edge), np.inf, edge)

    def _near(self, at: np.ndarray, q: np.ndarray, v: np.ndarray, single: np.ndarray, longest: float, ids: np.ndarray, metric: str) -> None:
        # rank is left @ right and, for distances, the square of the query
        left = np.concatenate([-2.0 * q, np.ones((len(q), 1))], axis=1) if metric == "l2" else -q
        own = (q * q).sum(1) if metric == "l2" else np.zeros(len(q))
        lengths = np.sqrt((left * left).sum(1))
        slack = (left.shape[1] + 8) * float(np.finfo(np.float32).eps) * lengths * longest + 1e-15 * own + 10.0 ** -self.digits
        if not (longest < 1e18 and lengths.max(initial=0.0) < 1e18):
            self.take(at, ranks(q, v, metric), ids)
            return
        with np.errstate(over="ignore"):
            limit = np.nextafter((self.most[at] + slack - own).astype(np.float32), np.float32(np.inf))
        flat = _places(left.astype(np.float32) @ single.T <= limit[:, None])
        step = max(1, 4_000_000 // left.shape[1])
        for lo in range(0, len(flat), step):
            i, j = np.divmod(flat[lo:lo + step], len(ids))
            if metric == "l2":
                apart = q[i] - v[j]
                score = np.einsum("ij,ij->i", apart, apart)
            else:
                score = -np.einsum("ij,ij->i", q[i], v[j])
            self._hold(at[i], ids[j], np.round(score, self.digits))
        if self.k is not None and self.pending > self.PENDING + 2 * self.kept:
            self.best()

    def _hold(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        good = np.isfinite(score) & (score <= self.most[at])
        if self.exclude_self:
            good &= self.names[at] != ids
        self.held.append((at[good], ids[good], score[good]))
        self.pending += len(self.held[-1][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and ranks that are left."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, ids, score = (np.concatenate(x) for x in zip(*self.held))
        if self.k is not None and len(at):
            order = np.lexsort((ids, score, at))
            at, ids, score = at[order], ids[order], score[order]
            begins = np.concatenate(([True], at[1:] != at[:-1]))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            last = place == self.k - 1
            self.most[at[last]] = np.minimum(self.most[at[last]], score[last])
            kept = place < self.k
            at, ids, score = at[kept], ids[kept], score[kept]
        self.held, self.pending, self.kept = [(at, ids, score)], len(at), len(at)
        return at, ids, score


def _places(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true values, looked for eight at a time."""
    flat = mask.ravel()
    whole = len(flat) & ~7
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    i, j = np.nonzero(flat[:whole].reshape(-1, 8)[some])
    return np.concatenate([8 * some[i] + j, whole + np.flatnonzero(flat[whole:])])


def _parts(cells: pd.DataFrame, on: list[str]) -> pd.DataFrame:
    """The table of cells with the parts in which they meet queries: cells are packed up to a
    number of rows, larger ones are cut into parts of their own."""
    cells = cells.sort_values([*on, "dim", "cell"], ignore_index=True)
    base, splits, following = np.zeros(len(cells), np.int64), np.ones(len(cells), np.int64), 0
    for key, at in cells.groupby([*on, "dim"]).indices.items():
        rows = part_rows(key[-1] if isinstance(key, tuple) else key)
        now, filled = -1, 0
        for i in at:
            n = int(cells["n"].iloc[i])
            splits[i] = max(1, -(-n // rows))
            if splits[i] > 1:
                base[i], following = following, following + int(splits[i])
                continue
            if now < 0 or filled + n > rows:
                now, filled, following = following, 0, following + 1
            base[i], filled = now, filled + n
    return cells.assign(base=base, splits=splits)


def part_rows(dim: int, most: int | None = None) -> int:
    """Rows of a part or block: fewer if vectors are long."""
    return min(PART_ROWS if most is None else most, max(1000, (32 << 20) // (8 * int(dim))))


def _by_part(cells: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(part, places of its cells, whether the part is the cell's first) of one (metadata, dim)."""
    base, splits = cells["base"].to_numpy(), cells["splits"].to_numpy()
    held: dict[int, list[int]] = {}
    for i, (b, s) in enumerate(zip(base.tolist(), splits.tolist())):
        for p in range(b, b + s):
            held.setdefault(p, []).append(i)
    return [(p, np.array(at), base[at] == p) for p, at in held.items()]


def _visits(groups: dict, pivots: dict, on: list[str], metric: str, first: bool):
    """One row per query and part that holds cells to visit: `need` has a bit per cell of the part.

    The first round visits the nearest cells in one part, that of the nearest cell; the other round
    all cells not `seen` that may hold something as near as the k-th row found.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["query_vec"].map(lambda v: 0 if v is None else len(v))
            for key, asked in pdf.groupby([*[pdf[c] for c in on], lengths], sort=False):
                key = key if isinstance(key, tuple) else (key,)
                cells, listed = groups.get(key, (None, None))
                if cells is None or not key[-1]:
                    continue
                matrix, at = _matrix(asked["query_vec"])
                if not len(at):
                    continue
                asked, matrix = asked.iloc[at], prepared(matrix, metric, True)
                step = max(1, 2_000_000 // len(cells))
                for lo in range(0, len(asked), step):
                    yield from visit(asked.iloc[lo:lo + step], matrix[lo:lo + step], cells, listed, pivots[key[-1]], int(key[-1]))

    def visit(asked, matrix, cells, listed, centres, dim) -> Iterator[pd.DataFrame]:
        bounds = _bounds(matrix, cells, centres)
        reach = asked["kth"].to_numpy(np.float64)
        base, numbers = cells["base"].to_numpy(), cells["cell"].to_numpy()
        home = base[bounds.argmin(axis=1)]
        need = bounds <= np.where(np.isnan(reach), np.inf, reach)[:, None]
        if first:
            # the cells of a query's own part, in the order of their bounds
            near = base[None, :] == home[:, None]
            order = np.argsort(np.where(near, bounds, np.inf), axis=1, kind="stable")[:, :FIRST_CELLS]
            among = np.zeros(need.shape, bool)
            np.put_along_axis(among, order, True, axis=1)
            need &= near & among
        else:
            for row, seen in zip(need, asked["seen"]):
                if seen is not None and len(seen):
                    row[np.searchsorted(numbers, np.asarray(seen))] = False
        for part, places, begins in listed:
            own = need[:, places]
            some = np.flatnonzero(own.any(axis=1))
            if len(some):
                own = own[some]
                found = asked.iloc[some].drop(columns=["seen"]).copy()
                found["query_vec"], found["dim"], found["home"], found["part"] = list(matrix[some]), dim, home[some], part
                found["need"] = [r.tobytes() for r in np.packbits(own, axis=1)]
                found["cells"] = (own & begins).sum(axis=1)
                found["visits"] = [numbers[places[r]].tolist() if first else None for r in own]
                yield found

    return run


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(
    index: VectorIndex, queries: DataFrame, k: int | None = 5, least: float | None = None,
    query_col: str = "query_id", query_vec_col: str = "query_vec", exclude_self: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(query, id, score for the k best rows of each query; query, cells visited, cells in all).

    The score is the rounded squared distance, least first, or the rounded cosine, greatest
    first; ties go to the least id. `least` (cosines only) leaves out rows below it. Metadata of
    the index must agree; nulls agree with nothing.

    Cells lie in parts and queries, by their nearest cell, in blocks of bounded size. A task holds one
    block and one part. So rows that move are the vectors times the blocks that visit them, and
    the queries times the parts they visit, not times the cells.
    """
    spark, on, id_col, metric = index.rows.sparkSession, index.on, index.id_col, index.metric
    digits = DIGITS[metric]
    reach = None if least is None else float(np.sqrt(max(2.0 - 2.0 * least, 0.0) + MARGIN))
    asked = _stored(queries.select(query_col, F.col(query_vec_col).cast("array<double>").alias("query_vec"), *on).withColumns({
        "row": F.monotonically_increasing_id(), "kth": F.lit(reach).cast("double"), "seen": F.lit(None).cast("array<int>")}), "index-queries")
    kind_v, kind_q = index.rows.schema[id_col].dataType.simpleString(), queries.schema[query_col].dataType.simpleString()
    pair = f"{query_col} {kind_q}, {id_col} {kind_v}, score double"
    visit_schema = StructType([*asked.drop("seen").schema.fields, *spark.createDataFrame(
        [], "dim int, home bigint, part bigint, need binary, cells bigint, visits array<int>").schema.fields])
    order = Window.partitionBy(query_col).orderBy(F.col("score") if metric == "l2" else F.desc("score"), id_col)
    table = _parts(index.cells, on)
    groups = {}
    for key, some in table.groupby([*on, "dim"]):
        groups[key if isinstance(key, tuple) else (key,)] = (some, _by_part(some))
    shared = spark.sparkContext.broadcast((groups, index.pivots))
    members = spark.sparkContext.broadcast({p: some["cell"].to_numpy()[at] for some, listed in groups.values() for p, at, _ in listed})
    place = spark.createDataFrame(
        [tuple(getattr(x, "item", lambda x=x: x)() for x in r) for r in table[[*on, "dim", "cell", "base", "splits"]].itertuples(index=False)],
        StructType([*index.rows.select(*on, "dim", "cell").schema.fields, *spark.createDataFrame([], "base bigint, splits bigint").schema.fields]))

    def meet(key: tuple, rows: pa.Table, some: pa.Table) -> pa.Table:
        names, ids = some[query_col].combine_chunks(), rows[id_col].combine_chunks()
        found = Nearest(names.to_numpy(zero_copy_only=False), k, digits, exclude_self, np.inf if least is None else -least)
        if rows.num_rows and some.num_rows:
            cells, v, q = members.value[key[0].as_py()], _vectors(rows["vec"]), _vectors(some["query_vec"])
            if k is not None:
                found.most = np.minimum(found.most, some["rank"].combine_chunks().fill_null(np.inf).to_numpy())
            bits = np.frombuffer(b"".join(some["need"].to_pylist()), np.uint8).reshape(some.num_rows, -1)
            need = np.unpackbits(bits, axis=1, count=len(cells)).astype(bool)
            of, keys = rows["cell"].to_numpy(), ids.to_numpy(zero_copy_only=False)
            for j, cell in enumerate(cells):
                at, own = np.flatnonzero(need[:, j]), np.flatnonzero(of == cell)
                if len(at) and len(own):
                    found.scan(at, q[at], v[own], keys[own], metric)
        at, near, score = found.best()
        kinds = [names.type, ids.type, pa.float64()]
        return pa.Table.from_arrays([names.take(pa.array(at, pa.int64())), pa.array(near, kinds[1]), pa.array(
            score if metric == "l2" else -score, kinds[2])], names=[query_col, id_col, "score"])

    best, visited = None, None
    for first in ((True, False) if k is not None else (False,)):
        def run(batches: Iterator[pd.DataFrame], first: bool = first) -> Iterator[pd.DataFrame]:
            return _visits(*shared.value, on, metric, first)(batches)

        visits = _stored(asked.mapInPandas(run, visit_schema), "index-visits")
        # queries of one nearest part are a block, cut if they are many
        load = visits.groupBy("home").agg(F.max("dim").alias("dim"), F.count_distinct("row").alias("n")).collect()
        if load:
            blocks = spark.createDataFrame([(r["home"], -(-r["n"] // part_rows(r["dim"], BLOCK_QUERIES))) for r in load], "home bigint, blocks bigint")
            # the k-th rank of rows found before bounds what can still be of use
            rank = F.lit(None).cast("double") if best is None else F.col("rank")
            some = visits if best is None else visits.join(kth.select(query_col, "rank"), query_col, "left")
            right = some.join(F.broadcast(blocks), "home").withColumn("block", F.struct("home", F.pmod(F.xxhash64("row"), F.col("blocks")))).select(
                "part", "block", query_col, "query_vec", "need", rank.alias("rank"))
            asking = visits.join(F.broadcast(blocks), "home").select(
                "part", F.struct("home", F.pmod(F.xxhash64("row"), F.col("blocks"))).alias("block")).distinct()
            cells = [(r["dim"], r["cell"]) for r in visits.select("part").distinct().join(place.select("dim", "cell", F.explode(F.sequence(
                "base", F.col("base") + F.col("splits") - 1)).alias("part")), "part").select("dim", "cell").distinct().collect()]
            by_dim = {d: sorted({c for e, c in cells if e == d}) for d, _ in cells}
            pool = index.rows.where(" OR ".join(f"dim = {d} AND cell IN ({', '.join(map(str, cs))})" for d, cs in by_dim.items()))
            left = pool.join(F.broadcast(place), [*on, "dim", "cell"]).withColumn(
                "part", F.col("base") + F.pmod(F.xxhash64(id_col), F.col("splits"))).join(F.broadcast(asking), "part").select(
                "part", "block", id_col, "cell", "vec")
            found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, pair)
            best = found if best is None else best.unionByName(found)
            if k is not None:
                best = best.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")
            best = _stored(best, "index-best")
            count = visits.select(query_col, F.col("cells").alias("cells_visited"))
            visited = count if visited is None else visited.unionByName(count)
        if first and best is not None:
            # queries with k rows need look no further than the k-th; others look everywhere
            far = F.max(F.col("score") if metric == "l2" else -F.col("score"))
            kth = _stored(best.groupBy(query_col).agg(F.count("*").alias("n"), far.alias("rank")).where(F.col("n") >= k).select(
                query_col, "rank", F.sqrt((F.col("rank") if metric == "l2" else 2 + 2 * F.col("rank")) + MARGIN).alias("far")), "index-kth")
            seen = visits.where("part = home").select("row", F.col("visits").alias("found"))
            asked = _stored(asked.join(kth, query_col, "left").join(seen, "row", "left").select(
                query_col, "query_vec", *on, "row", F.least("far", "kth").alias("kth"), F.col("found").alias("seen")), "index-queries")
    if best is None:
        return spark.createDataFrame([], pair), spark.createDataFrame([], f"{query_col} {kind_q}, cells_visited bigint, cells bigint")
    totals = place.groupBy(*on, "dim").agg(F.count("*").alias("cells"))
    asked_of = asked.withColumn("dim", F.size("query_vec"))
    report = visited.groupBy(query_col).agg(F.sum("cells_visited").alias("cells_visited"))
    return best, asked_of.join(totals, [*on, "dim"]).join(report, query_col, "left").select(
        query_col, F.coalesce("cells_visited", F.lit(0)).cast("bigint").alias("cells_visited"), "cells")


def ranks(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Squared distances, or cosines of prepared vectors with the other sign."""
    if metric != "l2":
        return -(queries @ rows.T)
    d = queries @ rows.T
    d *= -2.0
    d += (queries * queries).sum(1)[:, None]
    d += (rows * rows).sum(1)[None, :]
    return np.maximum(d, 0.0, out=d)


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written, so that rounds do not repeat each other's work."""
    folder = shared_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
