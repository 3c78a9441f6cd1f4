"""Vector search, guards and maintenance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.digest import cache_key
from gridlake.functions.vector import cosine, squared_distance
from gridlake.operators.vector_index import DIGITS, Nearest, _stored, build_index, prepared, search

DISTANCE_DIGITS = 6
#: Blocks in which queries go to all tasks; each block reads all vectors once.
MOST_BLOCKS = 16


def nearest(
    vectors: DataFrame, query: list[float], k: int = 5, where: Column | None = None,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """k nearest vectors to one query among those that pass the metadata filter.

    Missing vectors and those of another length never rank; search_guard tells beforehand
    whether a collection has any. The filter runs first; order and limit become a per-task
    top-k with a small merge.
    """
    pool = vectors if where is None else vectors.where(where)
    target = F.array(*[F.lit(float(x)) for x in query])
    distance = F.round(squared_distance(F.col(vec_col), target), DISTANCE_DIGITS)
    return pool.where(F.size(vec_col) == len(query)).withColumn("score", distance).orderBy(
        F.asc_nulls_last("score"), id_col).limit(k)


def search_guard(stored: DataFrame, queries: DataFrame, vec_col: str = "embedding",
                 query_vec_col: str = "query_vec") -> DataFrame:
    """Per collection that queries ask: its dimension, theirs, and whether search may run.

    An empty collection may be searched and gives nothing; missing vectors do not count.
    """
    asked = queries.select("collection", F.col(query_vec_col).alias(vec_col))
    held = stored.where(F.size(vec_col) > 0)
    return dimension_check(held, asked, vec_col).withColumnsRenamed(
        {"new_dim": "query_dim", "compatible": "searchable"})


def checked(stored: DataFrame, queries: DataFrame, vec_col: str = "embedding",
            query_vec_col: str = "query_vec") -> DataFrame:
    """The queries; running them fails if a collection they ask has another dimension."""
    guard = search_guard(stored, queries, vec_col, query_vec_col)
    text = F.concat(
        F.lit("collection "), "collection", F.lit(" holds vectors of "), F.col("existing_dim").cast("string"),
        F.lit(" numbers, the query has "), F.col("query_dim").cast("string"))
    ok = guard.select("collection", F.when(F.col("searchable"), F.lit(True)).otherwise(
        F.raise_error(text).cast("boolean")).alias("__ok"))
    return queries.join(ok, "collection").where("__ok").drop("__ok")


def _bytes(queries: DataFrame, query_vec_col: str, width: int) -> int:
    """Bytes of the queries, counted before they may go to every task."""
    n, numbers = queries.agg(F.count("*"), F.sum(F.greatest(F.size(query_vec_col), F.lit(0)))).first()
    return 8 * ((numbers or 0) + n * width)


def _asked_by_length(queries: pd.DataFrame, on: list[str], query_col: str, query_vec_col: str) -> dict:
    """(names, matrix) of the queries by metadata and length; missing vectors are left out."""
    lengths = queries[query_vec_col].map(lambda v: 0 if v is None else len(v))
    return {
        key if isinstance(key, tuple) else (key,): (some[query_col].to_numpy(), np.stack(some[query_vec_col].to_numpy()).astype(np.float64))
        for key, some in queries[lengths > 0].groupby([*[queries[c] for c in on], lengths], sort=False)}


def _meet(
    vectors: DataFrame, queries: DataFrame, k: int | None, metric: str, most: float, on: list[str], id_col: str, vec_col: str,
    query_col: str, query_vec_col: str, exclude_self: bool = False,
) -> DataFrame:
    """The best rows of each task for every query. The queries go to every task as matrices, and a
    task keeps no more than their best rows, whatever its number of batches."""
    shared = queries.sparkSession.sparkContext.broadcast(
        _asked_by_length(queries.toPandas(), on, query_col, query_vec_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, found = shared.value, {}
        for pdf in batches:
            lengths = pdf[vec_col].map(lambda v: 0 if v is None else len(v))
            for key, rows in pdf.groupby([*[pdf[c] for c in on], lengths], sort=False):
                key = key if isinstance(key, tuple) else (key,)
                if key not in asked or not key[-1]:
                    continue
                names, matrix = asked[key]
                best = found.setdefault(key, Nearest(names, k, DIGITS[metric], exclude_self, most))
                v, ids = prepared(np.stack(rows[vec_col].to_numpy()).astype(np.float64), metric, False), rows[id_col].to_numpy()
                best.scan(np.arange(len(names)), prepared(matrix, metric, True), v, ids, metric)
                if k is None:
                    yield listed(found.pop(key))
        for best in found.values():
            yield listed(best)

    def listed(best: Nearest) -> pd.DataFrame:
        at, ids, score = best.best()
        return pd.DataFrame({query_col: best.names[at], id_col: ids, "score": score if metric == "l2" else -score})

    return vectors.select(id_col, vec_col, *on).mapInPandas(run, _pair_schema(vectors, queries, id_col, query_col))


def _pair_schema(vectors: DataFrame, queries: DataFrame, id_col: str, query_col: str) -> str:
    kind_v = vectors.schema[id_col].dataType.simpleString()
    kind_q = queries.schema[query_col].dataType.simpleString()
    return f"{query_col} {kind_q}, {id_col} {kind_v}, score double"


def nearest_for_each(
    vectors: DataFrame, queries: DataFrame, k: int = 5, on: list[str] | None = None,
    id_col: str = "vec_id", vec_col: str = "embedding", query_col: str = "query_id",
    query_vec_col: str = "query_vec", exclude_self: bool = False,
    max_broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """k nearest vectors for every query; `on` lists metadata columns that must agree.

    Missing vectors and those of another length than the query never rank. Distances are
    matrix products over Arrow batches, and a task passes on only its own k best per query,
    so no pair table exists. Queries of more bytes go in blocks, one after the other, and beyond
    MOST_BLOCKS blocks they meet the cells of an index instead.
    """
    on = on or []
    order = Window.partitionBy(query_col).orderBy("score", id_col)
    size = _bytes(queries, query_vec_col, 2 + len(on))
    if size > max_broadcast_bytes * MOST_BLOCKS:
        index = build_index(vectors, None, "l2", on, id_col, vec_col)
        partial, _ = search(index, queries, k, None, query_col, query_vec_col, exclude_self)
        return partial.withColumn("rank", F.row_number().over(order))

    vectors, queries = vectors.select(id_col, vec_col, *on), queries.select(query_col, query_vec_col, *on)
    blocks = -(-size // max_broadcast_bytes) if size else 1
    if blocks > 1:
        # read once per block
        vectors, queries = _stored(vectors, "nearest-vectors"), _stored(queries, "nearest-queries")

    def best(some: DataFrame) -> DataFrame:
        partial = _meet(vectors, some, k, "l2", np.inf, on, id_col, vec_col, query_col, query_vec_col, exclude_self)
        return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if blocks == 1:
        return best(queries)
    block = F.pmod(F.xxhash64(query_col), F.lit(blocks))
    return reduce(DataFrame.unionByName, [
        _stored(best(queries.where(block == i)), "nearest-best") for i in range(blocks)])


def cosine_for_each(
    vectors: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None,
    id_col: str = "vec_id", vec_col: str = "embedding", query_col: str = "query_id",
    query_vec_col: str = "query_vec", max_broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """Cosine similarity of every query with its k most similar vectors, with those of at
    least `least`, or both; 0.0 where a vector is all zeros. Missing vectors and those of
    another length are left out. One bound must be given: all pairs are never listed."""
    if k is None and least is None:
        raise ValueError("give k or least")
    if _bytes(queries, query_vec_col, 2) > max_broadcast_bytes:
        index = build_index(vectors, None, "cosine", None, id_col, vec_col)
        return search(index, queries, k, least, query_col, query_vec_col)[0]

    scored = _meet(vectors, queries.select(query_col, query_vec_col), k, "cosine", np.inf if least is None else -least, [], id_col,
                   vec_col, query_col, query_vec_col)
    if k is None:
        return scored
    order = Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)
    return scored.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")


def similar_texts(
    docs: DataFrame, query: list[float], k: int = 5, text: str = "content",
    id_col: str = "id", vec_col: str = "embedding",
) -> DataFrame:
    """k texts most similar by cosine, with a preview of at most 200 characters. A missing
    vector, or one of another length, has similarity 0.0."""
    target = F.array(*[F.lit(float(x)) for x in query])
    same = F.coalesce(F.size(vec_col) == len(query), F.lit(False))
    score = F.when(same, F.round(cosine(F.col(vec_col), target), DISTANCE_DIGITS)).otherwise(F.lit(0.0))
    return docs.withColumn("similarity", score).orderBy(F.desc("similarity"), id_col).limit(
        k).select(id_col, preview(F.col(text)).alias("document"), "similarity")


def preview(text: Column, width: int = 200) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))
                  ).otherwise(text)


def mean_vectors(vectors: DataFrame, keys: list[str], vec_col: str = "embedding") -> DataFrame:
    """Mean vector per key. Positions are averaged with partial sums, then put in order."""
    parts = vectors.select(*keys, F.posexplode(vec_col).alias("pos", "x"))
    means = parts.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "m")))
    collected = means.groupBy(*keys) if keys else means.groupBy()
    return collected.agg(F.transform(in_order, lambda p: p["m"]).alias("mean_vec"))


def vector_validity(batch: DataFrame, expected: int, vec_col: str = "embedding") -> DataFrame:
    """Count and emptiness check of one batch of vectors."""
    empty = F.col(vec_col).isNull() | (F.size(vec_col) <= 0)
    checked = batch.agg(
        F.count("*").alias("n_vectors"), F.count_if(empty).alias("n_empty"))
    return checked.withColumn(
        "valid", (F.col("n_vectors") == expected) & (F.col("n_empty") == 0) & (F.lit(expected) > 0))


def dimension_check(stored: DataFrame, batch: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Per collection of the batch: stored and new dimension, and whether writing is allowed.

    A collection without vectors accepts any single dimension.
    """
    existing = stored.groupBy("collection").agg(
        F.min(F.size(vec_col)).alias("existing_dim"), F.max(F.size(vec_col)).alias("existing_max"))
    new = batch.groupBy("collection").agg(
        F.min(F.size(vec_col)).alias("new_dim"), F.max(F.size(vec_col)).alias("new_max"))
    uniform = F.col("new_dim") == F.col("new_max")
    fits = F.col("existing_dim").isNull() | (
        (F.col("existing_dim") == F.col("new_dim")) & (F.col("existing_max") == F.col("new_max")))
    return new.join(existing, "collection", "left").select(
        "collection", "existing_dim", "new_dim", (uniform & fits).alias("compatible"))


def collection_name(model: Column, default_model: str) -> Column:
    """Collection of an embedding model: the default model keeps the first collection."""
    safe = F.btrim(F.regexp_replace(model, "[^A-Za-z0-9]", "_"), F.lit("_"))
    own = F.left(F.concat(F.lit(fv.COLLECTION_PREFIX), safe), F.lit(fv.COLLECTION_NAME_MAX))
    return F.when(
        F.coalesce(F.length(model) == 0, F.lit(True)) | (model == default_model),
        fv.LEGACY_COLLECTION).otherwise(own)


def look_up_cache(
    texts: DataFrame, cache: DataFrame, model: str, now: Column, ttl: int = fv.CACHE_TTL_SECONDS
) -> DataFrame:
    """Texts with key, embedding where the cache holds one, and hit.

    cache: key, embedding, stored_at (seconds). Only entries younger than ttl count.
    """
    fresh = cache.where(now - F.col("stored_at") < ttl).select("key", "embedding", F.lit(True).alias("hit"))
    keyed = texts.withColumn("key", cache_key(F.lit(model), F.col("text")))
    return keyed.join(fresh, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def trim_cache(
    cache: DataFrame, now: Column, ttl: int = fv.CACHE_TTL_SECONDS,
    keep: int = fv.CACHE_MAX_ENTRIES,
) -> DataFrame:
    """Unexpired entries, the most recently used ones only. A global top-k, no full sort."""
    return cache.where(now - F.col("stored_at") < ttl).orderBy(
        F.desc("last_used"), "key").limit(keep)


def cache_stats(lookups: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of a lookup log with a boolean column hit."""
    return lookups.agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    ).withColumn("hit_rate", F.coalesce(
        F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")), F.lit(0.0)))
