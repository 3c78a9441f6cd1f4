"""Chunk store as a catalog: listing, chunk access, deletes, reindexing and citations.

A store is a DataFrame of chunks with real columns for the metadata; `collection` names
the embedding model's share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.a1 import cell_range, col_letter

TABLE_CHUNKS = ["workbook_summary", "sheet_schema", "row_group"]


def collection_info(store: DataFrame) -> DataFrame:
    return store.groupBy("collection").agg(F.count("*").alias("n_vectors"))


def list_documents(store: DataFrame) -> DataFrame:
    """Documents per user: file name, type, size, number of chunks, first processing time."""
    name = F.coalesce("filename", "source", F.lit("未知文件"))
    listed = store.where(F.col("document_id").isNotNull()).groupBy("user_id", "document_id").agg(
        F.min(name).alias("filename"), F.max(F.coalesce("file_size", F.lit(0))).alias("size"),
        F.count("*").alias("chunks"), F.min("processed_at").alias("created_at"))
    return listed.withColumn("type", F.when(
        F.col("filename").contains("."), F.lower(F.substring_index("filename", ".", -1))
    ).otherwise(""))


def catalog_totals(documents: DataFrame, name_part: str = "") -> DataFrame:
    """Totals of the documents whose name contains a text, letter case ignored."""
    shown = documents.where(F.contains(F.lower("filename"), F.lower(F.lit(name_part))))
    return shown.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.max("created_at").alias("last_update"))


def document_chunks(store: DataFrame, document_id: str, user_id: str | None = None) -> DataFrame:
    own = store.where(F.col("document_id") == document_id)
    if user_id is not None:
        own = own.where(F.col("user_id") == user_id)
    return own.orderBy("chunk_index")


def table_chunks_of(store: DataFrame, chunk_types: list[str]) -> DataFrame:
    return store.where(F.col("chunk_type").isin(chunk_types))


def without_documents(store: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store without the listed (document_id, user_id) pairs, and the number of chunks gone."""
    keys = ["document_id", "user_id"]
    gone = store.join(doomed, keys, "left_semi").agg(F.count("*").alias("deleted"))
    return store.join(doomed, keys, "left_anti"), gone


class ReindexError(ValueError):
    """A reindex request that must not run."""


def reindex(
    store: DataFrame, document_id: str, user_id: str, source: str, target: str,
    embed: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Store after embedding a document again into another collection.

    Ids, order and content stay. A version already in the target is replaced whole; the
    result is a new DataFrame, so a failed write leaves the old store as it was.
    """
    if source == target:
        raise ReindexError("source and target collection are the same")
    held = store.where((F.col("collection") == source) & (F.col("document_id") == document_id))
    own = held.where(F.col("user_id") == user_id)
    if own.isEmpty():
        reason = "is not in " + source if held.isEmpty() else "belongs to another user"
        raise ReindexError(f"document {document_id} {reason}")
    fresh = embed(own).withColumn("collection", F.lit(target))
    return replace_versions(store, fresh)


def replace_versions(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Store in which the documents of `fresh` exist in the new version only."""
    keys = ["collection", "document_id", "user_id"]
    replaced = fresh.select(*keys).distinct()
    return store.join(replaced, keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def backfill_document_ids(store: DataFrame) -> DataFrame:
    """Chunks without a document id get one derived from their user and source.

    The id is a hash of (user, source), so it needs no shuffle and a rerun gives the same.
    """
    stem = F.regexp_replace("id", "_[^_]*\\z", "")
    origin = F.coalesce(F.nullif("source", F.lit("")), stem)
    derived = F.left(F.sha2(F.concat_ws("|", F.coalesce("user_id", F.lit("")), origin), 256), F.lit(32))
    missing = F.coalesce(F.length("document_id") == 0, F.lit(True))
    return (
        store.withColumn("filename", F.when(missing, F.coalesce(
            F.nullif("filename", F.lit("")), F.trim(origin))).otherwise(F.col("filename")))
        .withColumn("document_id", F.when(missing, derived).otherwise(F.col("document_id"))))


def orphans(representations: DataFrame, store: DataFrame) -> DataFrame:
    """Documents that have a representation and no vectors."""
    return representations.join(
        store.select("document_id").distinct(), "document_id", "left_anti")


def expand_best_table(hits: DataFrame, store: DataFrame, query: str = "query_id") -> DataFrame:
    """All chunks of the table that holds a query's nearest table chunk, in row order.

    hits: query, document_id, sheet_name, table_id, chunk_type, score (small is near).
    """
    place = F.struct("score", "document_id", "sheet_name", "table_id")
    best = hits.where(F.col("chunk_type").isin(TABLE_CHUNKS)).groupBy(query).agg(
        F.min(place).alias("b")).select(query, "b.document_id", "b.sheet_name", "b.table_id")
    place = ["document_id", "sheet_name", "table_id"]
    members = store.where(F.col("chunk_type").isin(TABLE_CHUNKS)).join(
        best.select(*place).distinct(), place, "left_semi").dropDuplicates(["id"])
    return best.join(members, place)


def row_coverage(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows covered by row groups per key."""
    return chunks.where(F.col("chunk_type") == "row_group").groupBy(*keys).agg(
        F.sum(F.col("row_end") - F.col("row_start") + 1).alias("covered_rows"),
        F.count("*").alias("n_groups"))


def citations(
    hits: DataFrame, query: str = "query_id", rank: str = "rank", limit: int = fv.MAX_CITATIONS
) -> DataFrame:
    """First citations per query: table chunks, one per place, unified coordinates.

    The first mention of a place is a minimum, so only one row per place reaches the
    final ranking.
    """
    kinds = [*TABLE_CHUNKS, "table_structured_access"]
    cited = hits.where(F.col("chunk_type").isin(kinds))
    known = (F.col("column_start") > 0) & (F.col("column_end") > 0)
    column = F.when(known, F.concat(
        col_letter(F.col("column_start")), F.lit(":"), col_letter(F.col("column_end"))))
    place = ["document_id", "sheet_name", "table_id", "range", "chunk_type"]
    first = cited.groupBy(query, *place).agg(F.min(F.struct(
        F.col(rank).alias("rank"), F.coalesce("filename", "source").alias("filename"),
        F.col("row_start").alias("row_index"), "row_start", "row_end", column.alias("column"),
        F.when(F.col("chunk_type") == "table_structured_access", "structured")
        .otherwise("semantic").alias("match_mode"))).alias("f"))
    order = Window.partitionBy(query).orderBy("f.rank", *place)
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select(
        query, F.col("n").cast("bigint").alias("n"), *place, "f.filename", "f.row_index",
        "f.row_start", "f.row_end", "f.column", "f.match_mode")


def structured_citation(accesses: DataFrame, tables: DataFrame) -> DataFrame:
    """Coordinates of structured accesses, derived from the table they read."""
    keys = ["document_id", "sheet_name", "table_id"]
    joined = accesses.join(tables.select(*keys, "col_count", "row_count"), keys)
    last = F.coalesce("row_end", "row_count")
    return joined.withColumn("range", cell_range(
        F.lit(1), F.coalesce("row_start", F.lit(1)), F.col("col_count"), last)
    ).withColumn("column_start", F.lit(1)).withColumn("column_end", F.col("col_count"))


def source_label(filename: Column, source: Column) -> Column:
    return F.coalesce(filename, source, F.lit("未知来源"))
