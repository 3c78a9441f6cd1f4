"""Incremental ingest: new files to sheet models and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlake.operators.chunks import guard_size, table_chunks
from gridlake.operators.typed import infer
from gridlake.sources.delimited import as_grid
from gridlake.sources.readers import read_contents
from gridlake.sources.versions import Versions
from gridlake.streaming.jobs import few_listing_tasks, new_files, run_each_batch


def ingest_tables(
    spark: SparkSession, inbox: str, root: str, identify: Callable[[Column], dict[str, Column]],
    extension: str = "csv", per_batch: int | None = None,
) -> DataFrame:
    """Parse, infer and chunk files that are new since the last run; returns the chunk store.

    identify maps the path column to document_id, user_id, filename and file_type. The
    parsed grid is written first, so later steps read a table and not the files again. Grid,
    chunks and rejected chunks of a micro-batch become visible together, by one version; a
    repeated batch finds its number published and changes nothing. per_batch bounds its files,
    by default their bytes are bounded.
    """
    versions = Versions(spark, root)

    def handle(files: DataFrame, number: int) -> None:
        state = versions.state()
        if versions.done(state, ("ingest", number)):
            return
        folder, changed = versions.new_folder(), {}

        def put(df: DataFrame, name: str, *keys: str) -> None:
            schema = versions.put(df, name, folder, *keys)
            changed[name] = versions.append(state, name, folder, schema)

        manifest = files.select("path", *[c.alias(n) for n, c in identify(F.col("path")).items()])
        grid = as_grid(read_contents(files, extensions=[extension]), manifest)
        put(grid.withColumn("user_id", F.col("user_id").cast("string")), "grid", "user_id")
        stored = versions.get("grid", [folder], StructType.fromJson(changed["grid"]["schema"]))
        model = infer(stored)
        chunks, rejected = guard_size(table_chunks(stored, model.tables, model.columns))
        put(rejected, "rejected")
        put(chunks, "chunks", "user_id")
        versions.publish(state, changed, ("ingest", number))

    with few_listing_tasks(spark):
        files = new_files(spark, inbox, f"*.{extension}", per_batch)
        run_each_batch(files, f"{root}/progress", handle)
    return versions.read("chunks")
