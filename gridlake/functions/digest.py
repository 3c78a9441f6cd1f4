"""Digests for identities, secrets and whole-table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_secret(c: Column) -> Column:
    """First and last four characters; '***' for short or missing secrets."""
    masked = F.concat(F.left(c, F.lit(4)), F.lit("..."), F.right(c, F.lit(4)))
    return F.when(F.length(c) > 8, masked).otherwise(F.lit("***"))


def salted_hash(c: Column, salt: str) -> Column:
    return F.sha2(F.concat(c, F.lit(salt)), 256)


def cache_key(model: Column, text: Column) -> Column:
    return F.md5(F.concat(model, F.lit(": "), text))


def row_digest(*parts: Column) -> Column:
    """Hash of one row. Every part is length-prefixed, so cell borders cannot shift."""
    sealed = [
        F.coalesce(
            F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")),
            F.lit("-"))
        for p in parts
    ]
    return F.sha2(F.concat(*sealed), 256)


def combine_digests(digest: Column) -> Column:
    """Aggregate row hashes to one hash, whatever their order.

    Four 60-bit slices are summed, so partial sums combine on the map side and no group
    is ever collected. Rows carry their position, hence order changes still show.
    """
    sums = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
        for i in range(4)
    ]
    sealed = F.concat_ws("|", F.count(digest).cast("string"), *[s.cast("string") for s in sums])
    return F.left(F.sha2(sealed, 256), F.lit(16))
