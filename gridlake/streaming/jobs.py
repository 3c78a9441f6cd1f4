"""Running streaming queries over files to a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def run_to_table(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Process all available input into a Parquet table and read it back."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def run_each_batch(stream: DataFrame, root: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process all available input batch by batch; a repeated batch has the same number."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    query.awaitTermination()


#: Bytes of files that make a micro-batch.
BATCH_BYTES = 512 << 20
#: Tasks for each core that list folders: one for each folder would cost more than the listing.
LISTING_WAVES = 4
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks for each core; streams started inside keep that."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), LISTING_WAVES * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def new_files(
    spark: SparkSession, path: str, glob: str, per_batch: int | None = None, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Stream of (path, modificationTime, length, content) of files not seen before.

    A micro-batch takes a number of bytes, or per_batch files if that is given: a batch costs much
    besides its files, so many small ones share it.
    """
    most = ("maxBytesPerTrigger", batch_bytes) if per_batch is None else ("maxFilesPerTrigger", per_batch)
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .option(*most).load(path))
