"""Upload manifests: acceptance rules and file metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.digest import mask_secret, salted_hash
from gridlake.sources.readers import extension_of


def check_uploads(manifest: DataFrame) -> DataFrame:
    """Adds status to (filename, content_type, size): 200, or 400, 415, 413 when refused."""
    ext = F.concat(F.lit("."), extension_of(F.col("filename")))
    allowed = F.create_map(*[
        part for e, mimes in fv.ALLOWED_MIME.items()
        for part in (F.lit(e), F.array(*[F.lit(m) for m in mimes]))])
    given = F.coalesce(F.length("content_type") > 0, F.lit(False))
    fits = (
        ~given | (F.col("content_type") == fv.ANY_MIME)
        | F.coalesce(F.array_contains(F.try_element_at(allowed, ext), F.col("content_type")),
                     F.lit(False)))
    return manifest.withColumn(
        "status",
        F.when(~ext.isin(list(fv.ALLOWED_MIME)), 400).when(~fits, 415)
        .when(F.col("size") > fv.MAX_UPLOAD_BYTES, 413).otherwise(200))


def file_metadata(contents: DataFrame) -> DataFrame:
    """Name, extension, size and content hash of (path, content)."""
    name = F.regexp_extract("path", r"([^/\\]*)\z", 1)
    ext = F.when(name.rlike(r"[^.].*\.[^.]+\z"), F.concat(
        F.lit("."), extension_of(name))).otherwise("")
    return contents.select(
        "path", name.alias("filename"), ext.alias("file_extension"),
        F.octet_length("content").cast("bigint").alias("file_size"),
        F.md5("content").alias("file_hash"))


def protect(df: DataFrame, column: str, salt: str) -> DataFrame:
    """Replaces a secret column by its mask and a salted hash."""
    secret = F.col(column)
    return df.withColumn(f"{column}_hash", salted_hash(secret, salt)).withColumn(
        column, mask_secret(secret))
