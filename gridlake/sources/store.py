"""Parquet stores for chunks, vectors and sheet models.

The chunk store is versioned (see versions): rows lie in one immutable folder per write, and a
table of documents says in which folder a document's rows count. Replacing or deleting a
document changes its entry only; no other row is read or written again. Folders of which some
rows no longer count are marked, and only those are joined with the entries on reading.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlake.operators.typed import SheetModel
from gridlake.sources.versions import VersionConflict, Versions  # noqa: F401

#: The entries of all documents are cut into so many parts; a write rewrites those it touches.
BUCKETS = 64
DOCUMENT_KEYS = ["collection", "user_id", "document_id"]
ENTRY = ("collection string, user_id string, document_id string, folder string, chunks bigint, filename string, "
         "size bigint, created_at string, bucket int")


def write_partitions(df: DataFrame, root: str, partition_by: list[str]) -> None:
    """Replace the partitions that df has rows of."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(root))


def read_store(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equal keys; a null is a value of its own."""
    found = F.lit(True)
    for name in names:
        found = found & left[name].eqNullSafe(right[name])
    return found


def _entries(versions: Versions, state: dict[str, Any], buckets: list[str] | None = None) -> DataFrame:
    """Entries of all documents, or of some buckets."""
    held = state["tables"].get("chunks", {}).get("buckets", {})
    folders = [f"{folder}/bucket={b}" for b, folder in held.items() if buckets is None or b in buckets]
    schema = StructType.fromDDL(ENTRY)
    if not folders:
        return versions.spark.createDataFrame([], schema)
    return versions.get("documents", folders, schema).where("chunks IS NOT NULL")


def _describe(rows: DataFrame, folder: str) -> DataFrame:
    """Entries of the documents in a folder's rows; columns that rows lack are null."""
    def column(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None)

    name = F.coalesce(column("filename"), column("source"), F.lit("未知文件"))
    return rows.groupBy(*DOCUMENT_KEYS).agg(
        F.lit(folder).alias("folder"), F.count("*").alias("chunks"), F.min(name).alias("filename"),
        F.max(F.coalesce(column("file_size"), F.lit(0))).cast("bigint").alias("size"),
        F.min(column("processed_at")).cast("string").alias("created_at")).withColumn("bucket", _bucket())


def _change(versions: Versions, state: dict[str, Any], fresh: DataFrame | None, gone: DataFrame | None, folder: str,
            dimensions: dict[str, int], write: tuple[str, int] | None) -> int:
    """Publish the version in which written rows and deletions count. The steps before the
    last one write folders that no reader looks at."""
    spark = versions.spark
    entry = state["tables"].get("chunks", {"folders": [], "stale": [], "buckets": {}, "dimensions": {},
                                           "schema": {"type": "struct", "fields": []}})
    new = _describe(fresh, folder) if fresh is not None else spark.createDataFrame([], StructType.fromDDL(ENTRY))
    touched = new.select(*DOCUMENT_KEYS, "bucket")
    if gone is not None:
        touched = touched.unionByName(gone.select(*[F.col(c).cast("string").alias(c) for c in DOCUMENT_KEYS]).withColumn("bucket", _bucket()))
    touched = touched.distinct()
    buckets = [str(r["bucket"]) for r in touched.select("bucket").distinct().collect()]
    old = _entries(versions, state, buckets)
    met = _same(old, touched, *DOCUMENT_KEYS)
    stale = [r["folder"] for r in old.join(touched, met, "left_semi").select("folder").distinct().collect()]
    _put_entries(versions, old.join(touched, met, "left_anti").unionByName(new), folder, buckets)
    now = {**entry, "buckets": {**entry["buckets"], **{b: folder for b in buckets}},
           "stale": sorted({*entry["stale"], *stale}), "dimensions": {**entry["dimensions"], **dimensions}}
    if fresh is not None:
        now = versions.append({"tables": {"chunks": now}}, "chunks", folder, fresh.schema)
    return versions.publish(state, {"chunks": now}, write)


def _put_entries(versions: Versions, entries: DataFrame, folder: str, buckets: list[str]) -> None:
    # a bucket without entries keeps a row without a document
    marks = versions.spark.createDataFrame([(int(b),) for b in buckets], "bucket int")
    rows = entries.unionByName(marks, allowMissingColumns=True)
    versions.put(rows.repartition("bucket"), "documents", folder, "bucket")


def _put_rows(versions: Versions, chunks: DataFrame, folder: str) -> DataFrame:
    """Rows written into a folder, read back, so that chunks are computed once."""
    named = chunks.withColumns({c: F.col(c).cast("string") for c in DOCUMENT_KEYS})
    schema = versions.put(named, "chunks", folder, "collection", "user_id")
    return versions.get("chunks", [folder], schema)


def add_chunks(chunks: DataFrame, root: str, vec_col: str = "embedding", write: tuple[str, int] | None = None) -> None:
    """Add chunks with vectors, all or nothing; documents that are there are replaced whole.

    One aggregate over the written rows checks that each has a vector and that the vectors fit
    their collection's dimension, which the version keeps; stored vectors are not read. Rows that
    do not fit are never published. `write` (a writer's name and its number of the write)
    makes a repeated write change nothing.
    """
    versions = Versions(chunks.sparkSession, root)
    state = versions.state()
    if versions.done(state, write):
        return
    folder = versions.new_folder()
    rows = _put_rows(versions, chunks, folder)
    kept = state["tables"].get("chunks", {}).get("dimensions", {})
    found = rows.groupBy("collection").agg(
        F.count_if(F.col(vec_col).isNull() | (F.size(vec_col) <= 0)).alias("missing"),
        F.min(F.size(vec_col)).alias("low"), F.max(F.size(vec_col)).alias("high")).collect()
    unfit = [r.asDict() for r in found if r["missing"] or r["low"] != r["high"] or kept.get(r["collection"], r["low"]) != r["low"]]
    if unfit:
        raise ValueError(f"chunks without a vector, or of another dimension: {unfit[:5]}")
    _change(versions, state, rows, None, folder, {r["collection"]: r["low"] for r in found}, write)


def replace_documents(fresh: DataFrame, root: str, gone: DataFrame | None = None, write: tuple[str, int] | None = None) -> None:
    """Store in which the documents of `fresh` exist in this version only, and those of
    `gone` (collection, user_id, document_id) not at all. Only their entries change; a write that
    fails anywhere leaves the version before it whole. A null key is a value of its own."""
    versions = Versions(fresh.sparkSession, root)
    state = versions.state()
    if not versions.done(state, write):
        folder = versions.new_folder()
        _change(versions, state, _put_rows(versions, fresh, folder), gone, folder, {}, write)


def delete_documents(doomed: DataFrame, root: str, write: tuple[str, int] | None = None) -> None:
    """Take documents (collection, user_id, document_id) out of the store."""
    versions = Versions(doomed.sparkSession, root)
    state = versions.state()
    if not versions.done(state, write):
        _change(versions, state, None, doomed, versions.new_folder(), {}, write)


def read_chunks(spark: SparkSession, root: str, collection: str | None = None, user_id: str | None = None,
                number: int | None = None) -> DataFrame:
    """All chunks of the last version, or of an earlier one, or those of a collection or a
    user, of which only the partitions are read. A store without versions has no chunks."""
    versions = Versions(spark, root)
    return _live(versions, versions.state(number), collection, user_id)


def _live(versions: Versions, state: dict[str, Any], collection: str | None = None, user_id: str | None = None) -> DataFrame:
    entry = state["tables"]["chunks"]
    schema = StructType.fromJson(entry["schema"])

    def of(folders: list[str]) -> DataFrame:
        rows = versions.get("chunks", folders, schema, named=True)
        for name, value in (("collection", collection), ("user_id", user_id)):
            rows = rows if value is None else rows.where(F.col(name) == value)
        return rows

    whole = of([f for f in entry["folders"] if f not in entry["stale"]])
    changed = [f for f in entry["folders"] if f in entry["stale"]]
    if not changed:
        return whole.drop("part")
    rows, live = of(changed), _entries(versions, state).withColumnRenamed("folder", "part")
    return whole.unionByName(rows.join(live, _same(rows, live, "part", *DOCUMENT_KEYS), "left_semi")).drop("part")


def stored_documents(spark: SparkSession, root: str) -> DataFrame:
    """collection, user_id, document_id, filename, size, chunks, created_at, type of all stored
    documents, from their entries; no chunk is read."""
    versions = Versions(spark, root)
    suffix = F.when(F.col("filename").contains("."), F.lower(F.substring_index("filename", ".", -1))).otherwise("")
    return _entries(versions, versions.state()).select(
        *DOCUMENT_KEYS, "filename", "size", "chunks", "created_at", suffix.alias("type"))


def stored_collections(spark: SparkSession, root: str) -> DataFrame:
    """collection, n_vectors from the entries."""
    return stored_documents(spark, root).groupBy("collection").agg(F.sum("chunks").alias("n_vectors"))


def compact(spark: SparkSession, root: str) -> None:
    """Rows that count of all changed folders into one folder; what is read stays the same."""
    versions = Versions(spark, root)
    state = versions.state()
    entry = state["tables"].get("chunks", {})
    if not entry.get("stale"):
        return
    folder = versions.new_folder()
    only = {**state, "tables": {"chunks": {**entry, "folders": [f for f in entry["folders"] if f in entry["stale"]]}}}
    live = _live(versions, only)
    versions.put(live, "chunks", folder, "collection", "user_id")
    moved = _entries(versions, state).withColumn(
        "folder", F.when(F.col("folder").isin(entry["stale"]), folder).otherwise(F.col("folder")))
    _put_entries(versions, moved, folder, list(entry["buckets"]))
    kept = [f for f in entry["folders"] if f not in entry["stale"]]
    versions.publish(state, {"chunks": {**entry, "folders": [*kept, folder], "stale": [],
                                        "buckets": {b: folder for b in entry["buckets"]}}})


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Remove folders that none of the last `keep` versions names. Run it only while nobody
    writes or reads an older version."""
    versions = Versions(spark, root)
    states = [versions.state(n) for n in versions.numbers()[-keep:]]
    held = [s["tables"]["chunks"] for s in states if "chunks" in s["tables"]]
    versions.remove_unnamed("chunks", {f for e in held for f in e["folders"]})
    versions.remove_unnamed("documents", {f for e in held for f in e["buckets"].values()})


def save_model(model: SheetModel, root: str) -> None:
    """Sheet model as three tables partitioned by user; loading prunes to one user."""
    owners = model.tables.select("document_id", "sheet_idx", "user_id")
    columns = model.columns.join(owners, ["document_id", "sheet_idx"])
    for name, df in (("grid", model.grid), ("tables", model.tables), ("columns", columns)):
        write_partitions(df, f"{root}/{name}", ["user_id"])


def load_model(spark: SparkSession, root: str, user_id: str | None = None) -> SheetModel:
    def load(name: str) -> DataFrame:
        df = read_store(spark, f"{root}/{name}").withColumn("user_id", F.col("user_id").cast("string"))
        return df if user_id is None else df.where(F.col("user_id") == str(user_id))

    return SheetModel(load("grid"), load("tables"), load("columns").drop("user_id"))


def export_tables_json(model: SheetModel) -> DataFrame:
    """Nested table descriptions, one JSON text per sheet; its rows follow as JSON lines."""
    listed = model.columns.groupBy("document_id", "sheet_idx").agg(
        F.array_sort(F.collect_list(F.struct(
            "col_index", "technical_name", "display_name", "description", "data_type",
            "physical_type"))).alias("columns"))
    joined = model.tables.join(listed, ["document_id", "sheet_idx"])
    return joined.select("user_id", "document_id", F.to_json(F.struct(
        "document_id", "filename", "file_type", "sheet_name", "table_id", "table_range",
        "n_header_rows", "data_row_start", "data_row_end", "row_count", "col_count", "columns",
    )).alias("json"))
