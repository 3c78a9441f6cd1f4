"""Near-duplicate vectors by dual traversal of cover trees (operator 5).

Equal vectors are one class. Classes go to the nearest of a bounded number of pivots; large
cells are cut into blocks. Two cells meet only if their covering radii leave room for a
pair. Every block gets a cover tree: nested levels with halving radii, a node covering a run
of the block's vectors. Two blocks meet in one task, which walks both trees level by level,
drops node pairs whose centres are farther apart than both radii and the threshold allow,
and compares what is left of the vectors. Links are counted and joined to components in the
task; pairs are never emitted, so a group of thousands costs rows in proportion to it.

Where vectors have no near groups (independent directions in many dimensions), covering
bounds prune nothing and an exact join compares all pairs of centres; the work then grows
with the square of the classes, in matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.components import components
from gridlake.sources.scratch import shared_dir

BLOCK = 4096
MAX_PIVOTS = 1024
#: Radii of the tree's levels below the root, on the unit sphere.
RADII = (1.0, 0.5, 0.25)
STRIPE = 512


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(points: np.ndarray, radius: float) -> np.ndarray:
    """Number of the centre that covers each point; centres are farther apart than radius."""
    n = len(points)
    owner = np.full(n, -1)
    centres: list[int] = []
    for lo in range(0, n, STRIPE):
        part = points[lo:lo + STRIPE]
        if centres:
            d = distances(part, points[centres])
            near = d.argmin(axis=1)
            hit = d[np.arange(len(part)), near] <= radius
            owner[lo:lo + len(part)][hit] = near[hit]
        free = np.flatnonzero(owner[lo:lo + len(part)] < 0)
        if len(free):
            d = distances(part[free], part[free])
            open_ = np.ones(len(free), bool)
            for i in range(len(free)):
                if open_[i]:
                    reached = open_ & (d[i] <= radius)
                    owner[lo + free[reached]] = len(centres)
                    centres.append(lo + int(free[i]))
                    open_ &= ~reached
    return owner


class CoverTree:
    """points in tree order; by level: where nodes begin, their centres and covering radii."""

    def __init__(self, points: np.ndarray):
        order, cuts = np.arange(len(points)), np.array([0])
        self.levels: list[np.ndarray] = []
        for radius in RADII:
            parts, begins = [], []
            for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                own = order[lo:hi]
                owner = net(points[own], radius) if len(own) > 1 else np.zeros(1, int)
                by = np.argsort(owner, kind="stable")
                parts.append(own[by])
                begins.append(lo + np.flatnonzero(np.diff(owner[by], prepend=-1)))
            order, cuts = np.concatenate(parts), np.concatenate(begins)
            if 2 * len(cuts) <= len(order):  # a level of single points bounds nothing
                self.levels.append(cuts)
            elif len(cuts) == len(order):
                break
        self.order, self.points = order, points[order]

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, centre, radius) of the nodes of a level; below the last, points."""
        if k >= len(self.levels):
            n = len(self.points)
            return np.arange(n), self.points, np.zeros(n)
        begin = self.levels[k]
        sizes = np.diff([*begin, len(self.points)])
        centre = self.points[begin]
        far = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", self.points, np.repeat(centre, sizes, axis=0)), 0))
        return begin, centre, np.maximum.reduceat(far, begin)


def matches(a: CoverTree, b: CoverTree, threshold: float) -> np.ndarray:
    """Which points of a and b have at least this cosine, as a matrix in tree order."""
    reach = np.sqrt(2 - 2 * threshold)
    alive = np.ones((1, 1), bool)
    rows, cols = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(max(len(a.levels), len(b.levels))):
        begin_a, centre_a, radius_a = a.level(k)
        begin_b, centre_b, radius_b = b.level(k)
        above_a = np.searchsorted(rows, begin_a, side="right") - 1
        above_b = np.searchsorted(cols, begin_b, side="right") - 1
        keep = np.zeros((len(begin_a), len(begin_b)), bool)
        for lo in range(0, len(begin_a), STRIPE):
            hi = lo + STRIPE
            limit = radius_a[lo:hi, None] + radius_b[None] + reach + 1e-9
            keep[lo:hi] = (distances(centre_a[lo:hi], centre_b) <= limit) & alive[above_a[lo:hi]][:, above_b]
        alive, rows, cols = keep, begin_a, begin_b
    # what is left meets point by point: single precision decides all but close calls
    n, m = len(a.points), len(b.points)
    found = np.zeros((n, m), bool)
    margin = 1e-6 + 2e-7 * a.points.shape[1]
    fine_a, fine_b = a.points.astype(np.float32), b.points.astype(np.float32)
    node_a = np.searchsorted(rows, np.arange(n), side="right") - 1
    node_b = np.searchsorted(cols, np.arange(m), side="right") - 1
    for lo in range(0, n, STRIPE):
        hi = min(lo + STRIPE, n)
        live = alive[node_a[lo]:node_a[hi - 1] + 1]
        if not live.any():
            continue
        use = np.flatnonzero(live.any(axis=0)[node_b])
        allowed = alive[node_a[lo:hi]][:, node_b[use]]
        dots = fine_a[lo:hi] @ fine_b[use].T
        sure = (dots >= threshold + margin) & allowed
        i, j = np.nonzero((dots >= threshold - margin) & ~sure & allowed)
        if len(i):
            exact = np.einsum("ij,ij->i", a.points[lo + i], b.points[use[j]])
            sure[i, j] = exact >= threshold
        found[lo:hi][:, use] = sure
    return found


def flood(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest label reachable through the matrix, for rows and columns."""
    rows, cols = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
    part = found[np.ix_(rows, cols)]
    big = np.iinfo(np.int64).max
    while len(rows):
        before = left[rows].copy(), right[cols].copy()
        for lo in range(0, len(rows), STRIPE):
            at = rows[lo:lo + STRIPE]
            left[at] = np.minimum(left[at], np.where(part[lo:lo + STRIPE], right[cols], big).min(axis=1))
        for lo in range(0, len(rows), STRIPE):
            at = rows[lo:lo + STRIPE]
            right[cols] = np.minimum(right[cols], np.where(part[lo:lo + STRIPE], left[at][:, None], big).min(axis=0))
        if (before[0] == left[rows]).all() and (before[1] == right[cols]).all():
            break
    return left, right


def meet(a: tuple, b: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, smallest id reached in this task) of the vectors of one or two blocks that
    have links. A block is (ids, rows of equal vectors, tree)."""
    ids, weight, tree = a
    if b is None:
        found = matches(tree, tree, threshold)
        np.fill_diagonal(found, False)
        found |= found.T
        links = found @ weight
        least, _ = flood(found, ids.copy(), ids.copy())
        some = links > 0
        return ids[some], links[some], least[some]
    ids_b, weight_b, tree_b = b
    found = matches(tree, tree_b, threshold)
    links, links_b = found @ weight_b, weight @ found
    least, least_b = flood(found, ids.copy(), ids_b.copy())
    some, some_b = links > 0, links_b > 0
    return (np.concatenate([ids[some], ids_b[some_b]]), np.concatenate([links[some], links_b[some_b]]),
            np.concatenate([least[some], least_b[some_b]]))


def stacked(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return np.stack([np.asarray(v.values) for v in column]) if len(column) else np.zeros((0, 0))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, and vectors of different lengths do not link. A row with a null id links with
    nothing and has no component. Repeated rows link with each other. Other columns are not
    read. At most MAX_PIVOTS vectors, those with the smallest hash, serve as pivots; they
    place vectors in cells and do not change the result.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    proper = (F.col("vec").isNotNull() & (F.size("vec") > 0) & F.col("vec_id").isNotNull()
              & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("vec", lambda x: x != 0))
    rows = base.select("vec_id", F.when(F.coalesce(proper, F.lit(False)), F.col("vec")).alias("vec"))
    rows = rows.withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit(17), "vec"))
    usable = rows.where("vec is not null")
    folder = shared_dir(spark, "vector-classes")
    (usable.groupBy("k1", "k2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"), F.first("vec").alias("vec"))
     .write.parquet(folder))
    classes = spark.read.parquet(folder)

    total = classes.count()
    n_pivots = max(1, min(MAX_PIVOTS, total // BLOCK))
    pivots: dict[int, np.ndarray] = {}
    for r in classes.orderBy(F.xxhash64("class_id"), "class_id").limit(n_pivots).select("vec").toLocalIterator():
        pivots.setdefault(len(r.vec), []).append(r.vec)
    first = 0
    for dim in sorted(pivots):
        pivots[dim] = (first, unit(np.array(pivots[dim])))
        first += len(pivots[dim][1])

    def assign(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(2)])
            cell, far = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                if dim not in pivots:
                    cell[at], far[at] = -dim, 2.0
                    continue
                d = distances(unit(stacked(batch.column(2).take(pa.array(at)))), pivots[dim][1])
                cell[at] = pivots[dim][0] + d.argmin(axis=1)
                far[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)],
                                             ["class_id", "n", "vec", "cell", "far"])

    vec_type = classes.schema["vec"].dataType.simpleString()
    placed = classes.select("class_id", "n", "vec").mapInArrow(
        assign, f"class_id long, n long, vec {vec_type}, cell long, far double")
    cells = {r.cell: (r.n, r.far) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    blocks = {c: -(-n // BLOCK) for c, (n, _) in cells.items()}
    offset, at = {}, 0
    for c in sorted(cells):
        offset[c] = at
        at += blocks[c]
    reach = float(np.sqrt(2 - 2 * threshold))
    near: dict[int, list[int]] = {c: [c] for c in cells}
    for first, centres in pivots.values():
        d = distances(centres, centres)
        own = [first + i for i in range(len(centres)) if first + i in cells]
        for x in own:
            near[x] = [y for y in own if d[x - first, y - first] <= cells[x][1] + cells[y][1] + reach + 1e-9]
    if not cells:
        near, offset, blocks = {0: [0]}, {0: 0}, {0: 1}
    sizes = F.create_map(*[F.lit(x) for c in blocks for x in (c, blocks[c])])
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("class_id"), sizes[F.col("cell")]))

    def pack(table: pa.Table) -> pa.Table:
        cell, part = table.column("cell")[0].as_py(), table.column("part")[0].as_py()
        rows = stacked(table.column("vec").combine_chunks())
        tree = CoverTree(unit(rows))
        ids, n = table.column("class_id").to_numpy(), table.column("n").to_numpy()
        number = offset[cell] + part
        meets = [m for c in near[cell] for m in range(offset[c], offset[c] + blocks[c])]
        levels = np.concatenate([np.array([len(tree.levels), *map(len, tree.levels)]), *tree.levels]).astype(np.int64)
        return pa.table({
            "number": pa.array([number], pa.int64()), "meets": pa.array([meets], pa.list_(pa.int64())),
            "ids": pa.array([ids[tree.order].tobytes()], pa.binary()), "n": pa.array([n[tree.order].tobytes()], pa.binary()),
            "kind": pa.array([rows.dtype.str]), "data": pa.array([rows[tree.order].tobytes()], pa.binary()),
            "levels": pa.array([levels.tobytes()], pa.binary())})

    packed = dealt.groupBy("cell", "part").applyInArrow(
        pack, "number long, meets array<long>, ids binary, n binary, kind string, data binary, levels binary")
    tasks = packed.withColumn("other", F.explode("meets")).drop("meets").select(
        F.least("number", "other").alias("low"), F.greatest("number", "other").alias("high"),
        "number", "ids", "n", "kind", "data", "levels")

    def block(row: dict) -> tuple:
        ids, n = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["n"], np.int64)
        levels = np.frombuffer(row["levels"], np.int64)
        tree = CoverTree.__new__(CoverTree)
        tree.points = unit(np.frombuffer(row["data"], np.dtype(row["kind"])).reshape(len(ids), -1))
        ends = 1 + levels[0] + np.cumsum(levels[1:1 + levels[0]])
        tree.levels = [levels[e - k:e] for e, k in zip(ends, levels[1:1 + levels[0]])]
        return ids, n, tree

    def join_task(table: pa.Table) -> pa.Table:
        own = [block(r) for r in table.sort_by("number").to_pylist()]
        ids, links, least = meet(own[0], own[1] if len(own) > 1 else None, threshold)
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()),
                         "least": pa.array(least, pa.int64())})

    met_folder = shared_dir(spark, "vector-links")
    tasks.groupBy("low", "high").applyInArrow(join_task, "id long, links long, least long").write.parquet(met_folder)
    met = spark.read.parquet(met_folder)
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(met.select(F.col("id").alias("a"), F.col("least").alias("b")))
    named = (classes.select("k1", "k2", "class_id", "n")
             .join(links.withColumnRenamed("id", "class_id"), "class_id", "left")
             .join(joined.withColumnRenamed("id", "class_id"), "class_id", "left")
             .select(F.col("k1").alias("c1"), F.col("k2").alias("c2"),
                     (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "class_id").alias("component_id")))
    own = rows["vec"].isNotNull() & (rows["k1"] == named["c1"]) & (rows["k2"] == named["c2"])
    return rows.join(named, own, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
