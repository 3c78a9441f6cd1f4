"""CSV and TSV files as grid rows."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.sources.scratch import shared_dir

ROWS_SCHEMA = "path string, sheet_idx int, sheet_name string, row_index bigint, cells array<string>"
#: Blocks whose beginnings are broadcast: one row per input split, of which the driver holds a
#: task each. Beyond it the optimizer chooses the join.
BROADCAST_BLOCKS = 1_000_000
#: Blocks that are smaller than this share a task.
TASK_BYTES = 4 << 20
#: Longest field, beyond the csv module's own limit.
csv.field_size_limit((1 << 31) - 1)


def _rows(path: str, content: bytes, sep: str) -> pd.DataFrame:
    records = list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), delimiter=sep))
    width = max((len(r) for r in records), default=0)
    cells = [[v or None for v in r] + [None] * (width - len(r)) for r in records]
    return pd.DataFrame({
        "path": path, "sheet_idx": 0, "sheet_name": "Sheet1",
        "row_index": range(1, len(cells) + 1), "cells": cells})


def parse_delimited(contents: DataFrame, sep: str) -> DataFrame:
    """Rows of files given as (path, content); each file is one bounded upload. The same rows
    as from read_delimited."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield _rows(path, content, sep)

    return contents.select("path", "content").mapInPandas(run, ROWS_SCHEMA)


_BLOCK_CONFS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@contextmanager
def _blocks_of(spark: SparkSession, block_bytes: int | None) -> Iterator[None]:
    """Spark's file blocks of another size while files are read."""
    before = {n: spark.conf.get(n) for n in _BLOCK_CONFS}
    try:
        if block_bytes is not None:
            spark.conf.set(_BLOCK_CONFS[0], str(block_bytes))
            spark.conf.set(_BLOCK_CONFS[1], "100")
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", glob: str = "*.csv", block_bytes: int | None = None) -> DataFrame:
    """All matching files, of any size, split over tasks; a record may span lines.

    A line break ends a record unless it stands in quotes, which depends on all that comes
    before it. The task that reads a block cuts it into records at once, for both cases of its
    beginning until they agree, mostly after one quoted field; from there on records count for
    both. A block is then a map from how it begins to how it ends. These maps, one small row
    per block, are composed by running windows over a file's blocks, which gives each block its
    true beginning and first record number. Only pieces of records that cross a border move.
    `block_bytes` sets the size of blocks for the files alone; small blocks share a task.
    """
    lines = (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .text(path, lineSep="\n").select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"))
    with _blocks_of(spark, block_bytes):
        if block_bytes is not None and block_bytes < TASK_BYTES:
            cores = spark.sparkContext.defaultParallelism
            lines = lines.coalesce(max(cores, -(-lines.rdd.getNumPartitions() * block_bytes // TASK_BYTES)))
        cut = _written(lines.mapInArrow(lambda batches: _cut_blocks(batches, sep), CUT), "csv-cut")
    starts = _written(block_starts(cut.where("kind = 2").select("path", "block", "told.*")), "csv-starts")
    few = starts.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS

    def placed(rows: DataFrame, beginnings: DataFrame) -> DataFrame:
        """Rows of the true beginnings, with their record numbers in the file."""
        side = F.broadcast(beginnings) if few else beginnings
        return rows.join(side, ["path", "block"]).where("side = 2 OR side = cast(open AS int)").withColumn(
            "record", F.col("record") + F.col("ends") + F.when(F.col("side") == 2, F.col("base")).otherwise(0))

    pieces = placed(cut.where("kind = 1").select("path", "block", "side", "record", "piece"), starts).groupBy("path", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("text"))
    joined = _written(pieces.mapInPandas(lambda batches: _joined(batches, sep), "path string, record bigint, cells array<string>"), "csv-joined")
    widths = starts.groupBy("path").agg(F.max("width").alias("w")).join(
        joined.groupBy("path").agg(F.max(F.size("cells")).alias("v")), "path", "left").select("path", F.greatest("w", "v").alias("w"))
    whole = placed(cut.where("kind = 0").select("path", "block", "side", "record", "cells"), starts.join(widths, "path"))
    rows = whole.select("path", "record", "cells", "w").unionByName(joined.join(widths, "path"))
    return rows.select(
        "path", F.lit(0).alias("sheet_idx"), F.lit("Sheet1").alias("sheet_name"), F.col("record").alias("row_index"),
        F.concat("cells", F.array_repeat(
            F.lit(None).cast("string"), F.col("w") - F.size("cells"))).alias("cells"))


def _written(df: DataFrame, purpose: str) -> DataFrame:
    """Written once for its several readers, so no file is parsed again."""
    folder = shared_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_SIDE = "struct<open:boolean,ends:bigint,base:bigint,width:int>"
#: kind 0 is a record, 1 a piece of one that crosses a border, 2 tells of the block; side is the
#: beginning for which the row holds (0 outside quotes, 1 inside, 2 both); record counts from
#: the block's beginning, or from where the sides agree.
CUT = ("path string, block bigint, kind int, side int, record bigint, cells array<string>, piece string, "
       f"told struct<outside:{_SIDE},inside:{_SIDE}>")


def block_starts(told: DataFrame) -> DataFrame:
    """path, block, open, ends, base, width: how blocks truly begin.

    A block that ends alike for both beginnings settles what follows; others keep or swap the
    state. So the state before a block is that behind the last settling one, changed by the
    number of swaps since: a last value and a running sum, linear in the file's blocks.
    """
    ordered = Window.partitionBy("path").orderBy("block")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("inside").isNull() | (F.col("outside.open") == F.col("inside.open"))
    swaps = F.coalesce((~settles & F.col("outside.open")).cast("int"), F.lit(0))
    state = told.withColumn("swaps", swaps).withColumn(
        "settled", F.when(settles, F.pmod(F.col("outside.open").cast("int") + F.sum("swaps").over(upto), F.lit(2))))
    is_open = F.pmod(F.coalesce(F.last("settled", True).over(before), F.lit(0))
                     + F.coalesce(F.sum("swaps").over(before), F.lit(0)), F.lit(2)) == 1
    state = state.withColumn("open", is_open)
    state = state.withColumn("own", F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside")))
    return state.select(
        "path", "block", "open", F.coalesce(F.sum("own.ends").over(before), F.lit(0)).alias("ends"),
        F.col("own.base").alias("base"), F.col("own.width").alias("width"))


def _pieces(text: str) -> list[str]:
    """A line of the file with its break, cut at breaks of the other kind."""
    if "\r" not in text:
        return [text + "\n"]
    return list(io.StringIO(text + "\n", newline=""))


def _parse(text: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])


#: A line that shows whether a record was still open before it.
_END = "\x1eend\x1e"


class _Side:
    """Follows lines from one beginning."""

    def __init__(self, is_open: bool, sep: str):
        self.open, self.head, self.sep = is_open, is_open, sep
        self.ends, self.width, self.held = 0, 0, []

    def take(self, lines: list[str]) -> tuple[list, list[int]]:
        """Records that end in these lines, and after how many lines each does. The rest of a
        record that began before the block is a text instead of a list."""
        found, after, start = [], [], 0
        if self.open and lines:
            reader = csv.reader(chain(['"' + lines[0]], lines[1:], [_END]), delimiter=self.sep)
            next(reader)
            start = reader.line_num
            if start > len(lines):
                self.held += lines
                return found, after
            text = "".join([*self.held, *lines[:start]])
            found.append(text if self.head else _parse(text, self.sep))
            after.append(start)
            self.open, self.head, self.held = False, False, []
        rest = lines[start:] if start else lines
        reader, n, last = csv.reader(chain(rest, [_END]), delimiter=self.sep), len(rest), 0
        for record in reader:
            if reader.line_num > n:
                if record != [_END]:
                    self.open, self.held = True, rest[last:]
                break
            last = reader.line_num
            found.append(record)
            after.append(start + last)
        self.ends += len(found)
        self.width = max(self.width, max((len(r) for r in found if not isinstance(r, str)), default=0))
        return found, after


class _Block:
    """Cuts one block's lines; `rows` are (kind, side, record, cells, piece)."""

    def __init__(self, path: str, block: int, sep: str):
        self.path, self.block, self.sep = path, block, sep
        self.sides = [_Side(False, sep), _Side(True, sep)]
        self.base, self.common = (0, 0), None
        if block == 0:
            self.common = self.sides[0]
        self.first = block == 0

    def lines(self, values: pa.Array) -> list[str]:
        texts = values.to_pylist()
        if self.first:
            texts[0] = texts[0].removeprefix("\ufeff")
            self.first = False
        if pc.any(pc.match_substring(values, "\r")).as_py():
            return [p for t in texts for p in _pieces(t)]
        return [t + "\n" for t in texts]

    def take(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.first and not values[0].as_py().startswith("\ufeff"):
            self.first = False
        plain = (self.common is not None and not self.common.open and not self.first
                 and not pc.any(pc.match_substring_regex(values, '["\r]')).as_py())
        if plain:
            yield self.plain(values)
            return
        lines = self.lines(values)
        if self.common is not None:
            begun = self.common.ends
            found, _ = self.common.take(lines)
            yield from self.told(2, begun - self.base[0], found)
            return
        begun = [side.ends for side in self.sides]
        (outside, out_after), (inside, in_after) = (side.take(lines) for side in self.sides)
        meets = min(set(out_after) & set(in_after), default=None)
        cuts = [len(outside), len(inside)]
        if meets is not None:
            cuts = [out_after.index(meets) + 1, in_after.index(meets) + 1]
            self.base, self.common = (begun[0] + cuts[0], begun[1] + cuts[1]), self.sides[0]
        yield from self.told(0, begun[0], outside[:cuts[0]])
        yield from self.told(1, begun[1], inside[:cuts[1]])
        if meets is not None:
            yield from self.told(2, 0, outside[cuts[0]:])

    def plain(self, values: pa.Array) -> pa.RecordBatch:
        """Lines without quotes are records."""
        cells = pc.split_pattern(values, self.sep)
        begun = self.common.ends - self.base[0]
        n = len(values)
        self.common.ends += n
        filled = pc.not_equal(values, "")
        sizes = pc.if_else(filled, pc.list_value_length(cells), 0)
        self.common.width = max(self.common.width, pc.max(sizes).as_py())
        flat = cells.flatten()
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        if not pc.all(filled).as_py():
            flat = flat.filter(filled.take(pa.array(cells.value_parent_indices())))
        return self.frame(n, 0, 2, pa.array(range(begun + 1, begun + n + 1), pa.int64()),
                          pa.ListArray.from_arrays(offsets, pc.if_else(pc.equal(flat, ""), None, flat)), pa.nulls(n, pa.string()))

    def told(self, side: int, begun: int, found: list) -> Iterator[pa.RecordBatch]:
        if found and isinstance(found[0], str):
            yield self.frame(1, 1, side, pa.array([begun + 1], pa.int64()), None, pa.array([found[0]], pa.string()))
            found, begun = found[1:], begun + 1
        if found:
            n = len(found)
            flat = pa.array(list(chain.from_iterable(found)), pa.string())
            sizes = pa.array([0, *map(len, found)], pa.int32())
            cells = pa.ListArray.from_arrays(pc.cumulative_sum(sizes), pc.if_else(pc.equal(flat, ""), None, flat))
            yield self.frame(n, 0, side, pa.array(range(begun + 1, begun + n + 1), pa.int64()), cells, pa.nulls(n, pa.string()))

    def frame(self, n: int, kind: int, side: int | None, record, cells, piece, told=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([self.path] * n, pa.string()), pa.array([self.block] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
            pa.array([side] * n, pa.int32()), record, pa.nulls(n, pa.list_(pa.string())) if cells is None else cells, piece,
            pa.nulls(n, _TOLD) if told is None else told], _CUT_NAMES)

    def end(self) -> Iterator[pa.RecordBatch]:
        """Pieces that are left, and how the block ends for each beginning."""
        rest = [(2, self.common, self.base[0])] if self.common is not None else [(k, s, 0) for k, s in enumerate(self.sides)]
        for side, state, base in rest:
            if state.held:
                yield self.frame(1, 1, side, pa.array([state.ends - base + 1], pa.int64()), None, pa.array(["".join(state.held)], pa.string()))
        ends = []
        for k, (state, base) in enumerate(zip(self.sides, self.base)):
            own = {"open": state.open, "ends": state.ends, "base": base, "width": state.width}
            if self.common is not None:
                own = {"open": self.common.open, "ends": self.common.ends - self.base[0] + base, "base": base,
                       "width": max(state.width, self.common.width)}
            ends.append(own if k == 0 or self.block else None)
        yield self.frame(1, 2, None, pa.nulls(1, pa.int64()), None, pa.nulls(1, pa.string()),
                         pa.array([{"outside": ends[0], "inside": ends[1]}], _TOLD))


_END_TYPE = pa.struct([("open", pa.bool_()), ("ends", pa.int64()), ("base", pa.int64()), ("width", pa.int32())])
_TOLD = pa.struct([("outside", _END_TYPE), ("inside", _END_TYPE)])
_CUT_NAMES = ["path", "block", "kind", "side", "record", "cells", "piece", "told"]


def _cut_blocks(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """Lines (path, block, value), block after block, to rows of CUT."""
    now = None
    for batch in batches:
        paths, blocks, values = batch.columns
        n = batch.num_rows
        changes = [] if n < 2 else pc.indices_nonzero(pc.or_(
            pc.not_equal(paths.slice(1), paths.slice(0, n - 1)), pc.not_equal(blocks.slice(1), blocks.slice(0, n - 1)))).to_pylist()
        edges = [0, *[c + 1 for c in changes], n]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            path, block = paths[lo].as_py(), blocks[lo].as_py()
            if now is None or (now.path, now.block) != (path, block):
                if now is not None:
                    yield from now.end()
                now = _Block(path, block, sep)
            # the kernels read strings that begin at 0
            yield from now.take(pa.concat_arrays([values.slice(lo, hi - lo)]))
    if now is not None:
        yield from now.end()


def _joined(batches: Iterator[pd.DataFrame], sep: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({
            "path": batch["path"], "record": batch["record"],
            "cells": [[v or None for v in _parse(t, sep)] for t in batch["text"]]})


def as_grid(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Grid of parsed rows; manifest has path, document_id, user_id, filename, file_type."""
    return rows.join(manifest, "path").select(
        "user_id", "document_id", "filename", "file_type", "sheet_idx", "sheet_name",
        "row_index", "cells")
