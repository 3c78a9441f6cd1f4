"""Mixing sources to target weights by systematic sampling (operator 10).

The expected copies of a document are its source's rate, target / source size. Inside a
source documents stand in order of size, equal sizes in order of a hash. The prefix sum of
the rate plus one random offset of the source crosses integers; a document is emitted once
for each integer it crosses. Neighbours have like sizes, so the words taken stay near the
target however sizes are spread.

No window holds a whole source: positions are added up over (source, size) cells, a cell of
many rows is cut into salts by the hash, and rows are numbered inside one salt only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SALT_ROWS = 4096
HASH_RANGE = float(16 ** 15)
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*parts: Column) -> Column:
    """The first 60 bits of an md5 of the parts as a number."""
    joined = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target, rate from one row (source, source_size) per source.

    Targets are level * weight, or cap * source_size where that is less; the level is the
    one at which they add up to share of all sizes. With sources in order of the level at
    which they reach their cap, it follows from the caps before and the weights from there.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("full_at", F.col("cap") / F.col("w"))
    level = (F.sum("source_size").over(everything) * F.lit(share)
             - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levels = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    # once a source is below its cap, all that come later are
    top = levels.withColumn("level", F.max(F.when(F.col("free"), F.struct(-F.col("full_at"), F.col("level")))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return top.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def plan_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 0,
) -> DataFrame:
    """Every row with mix_size, mix_source_size, mix_target and mix_copies (0, 1, ... cap).

    A null source is a source of its own, last in order. Null and empty texts have size 0
    and are still dealt copies at their source's rate, which add no words; a source of size
    0 gets none. Rows that are the same in id and text are dealt separately. All other
    columns are kept; names starting with mix_ are replaced.
    """
    own = [c for c in docs.columns if not c.startswith("mix_")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("mix_row"), F.col(source_col).alias("mix_source"),
        F.col(id_col).alias("mix_id"), words(F.col(text_col)).alias("mix_size"), hash60(F.col(id_col), F.col(text_col)).alias("mix_hash"))
    narrow = rows.select("mix_source", "mix_size", "mix_hash")
    cells = narrow.groupBy("mix_source", "mix_size").agg(F.count("*").alias("n"))
    sizes = cells.groupBy(F.col("mix_source").alias("source")).agg(
        F.sum(F.col("n") * F.col("mix_size")).alias("source_size"))
    rates = targets(sizes, weights, share, cap)
    in_source = Window.partitionBy("mix_source").orderBy("mix_size").rowsBetween(Window.unboundedPreceding, -1)
    offset = hash60(F.lit(seed), F.col("source")) / F.lit(HASH_RANGE)
    placed = cells.withColumn("before", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    placed = placed.join(rates, F.col("mix_source").eqNullSafe(F.col("source"))).select(
        F.col("mix_source").alias("c_source"), F.col("mix_size").alias("c_size"), "before",
        F.ceil(F.col("n") / SALT_ROWS).alias("salts"), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), "rate", offset.alias("offset"))

    def salted(df: DataFrame, cells: DataFrame) -> DataFrame:
        here = df["mix_source"].eqNullSafe(cells["c_source"]) & (df["mix_size"] == cells["c_size"])
        return df.join(cells, here).drop("c_source", "c_size").withColumn(
            "salt", F.floor(F.col("mix_hash") / F.lit(HASH_RANGE) * F.col("salts")))

    counts = salted(narrow, placed.where("salts > 1")).groupBy("mix_source", "mix_size", "salt").agg(F.count("*").alias("n"))
    in_cell = Window.partitionBy("mix_source", "mix_size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        F.col("mix_source").alias("s_source"), F.col("mix_size").alias("s_size"), F.col("salt").alias("s_salt"),
        F.coalesce(F.sum("n").over(in_cell), F.lit(0)).alias("shift"))
    dealt = salted(rows, placed)
    dealt = dealt.join(shifts, dealt["mix_source"].eqNullSafe(shifts["s_source"]) & (dealt["mix_size"] == shifts["s_size"])
                       & (dealt["salt"] == shifts["s_salt"]), "left")
    inside = Window.partitionBy("mix_source", "mix_size", "salt").orderBy("mix_hash", "mix_id")
    upto = F.col("before") + F.coalesce(F.col("shift"), F.lit(0)) + F.row_number().over(inside)
    copies = (F.floor(upto * F.col("rate") + F.col("offset"))
              - F.floor((upto - 1) * F.col("rate") + F.col("offset")))
    return dealt.withColumn("mix_copies", F.least(copies, F.floor(F.lit(cap))).cast("long")).select(
        *[F.col("mix_row").getField(c).alias(c) for c in own], "mix_size", "mix_source_size", "mix_target", "mix_copies")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed rows themselves, each repeated by its copies; columns as given."""
    own = [c for c in docs.columns if not c.startswith("mix_")]
    planned = plan_copies(docs, **parameters).where("mix_copies > 0")
    return planned.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(
        *[F.col(f"`{c}`") for c in own])


PLAN_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (
               ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
t AS (SELECT source, source_size,
             least(cap, coalesce((SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1) * w, cap)) AS target,
             ('0x' || substr(md5('0/' || coalesce(source, '')), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u
      FROM l),
p AS (SELECT d.*, t.source_size, t.target, t.u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(floor(i * rate + u) - floor((i - 1) * rate + u), 2)::BIGINT AS copies FROM p)
"""
