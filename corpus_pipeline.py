"""Raw documents to packed token ids, in stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of documents. Rows with null texts or ids pass every stage by
its operator's rules; empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import decontamination, mixing, ngram_join, quality, token_files
from gridlake.sources.scratch import shared_dir

#: Documents below this probability of label 1 go.
QUALITY_LEAST = 0.3
#: Near duplicates share at least so many percent of their 5-word shingles.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; labels of fold 0 are not learned from."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold=0)
    return quality.score(docs, model, "__quality").where(F.col("__quality") >= QUALITY_LEAST).drop("__quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of the smallest id. Rows without id stay.

    Rows get numbers that go with them through the join, so a row is kept or dropped by its
    own links. Texts without shingles link with nothing; of equal rows of them one stays.
    """
    folder = shared_dir(spark, "pipeline-numbered")
    docs.withColumn("__row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)
    own = F.when(F.col("doc_id").isNotNull(), F.col("__row"))
    found = ngram_join.near_duplicates(rows.select(own.alias("__row"), "text"), SHINGLE_WORDS, SHINGLE_PERCENT, id_col="__row").select(
        F.col("doc_id").alias("__row"), "component_id", "n_shingles")
    # a row that the join does not return is an error
    size = F.when(F.col("doc_id").isNull() | F.col("n_shingles").isNotNull(), F.col("n_shingles")).otherwise(
        F.raise_error(F.lit("the join lost a row")).cast("long"))
    # texts without words are told apart by themselves; no other text goes through the joins
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    slim = rows.select("doc_id", "__row", F.when(wordless, F.coalesce(F.sha2("text", 256), F.lit("null"))).alias("bare"))
    placed = slim.join(found, "__row", "left").withColumn("n_shingles", size).where("doc_id IS NOT NULL").select(
        "doc_id", "__row", F.when(F.col("n_shingles") > 0, F.struct(F.col("component_id"), F.lit(None).cast("string").alias("bare"))).otherwise(
            F.struct(F.col("doc_id").alias("component_id"), "bare")).alias("group"))
    heads = placed.groupBy("group").agg(F.min(F.struct("doc_id", "__row")).alias("head")).select("head.__row")
    dropped = placed.select("__row").join(heads, "__row", "left_anti")
    return rows.join(dropped, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark passages."""
    found = decontamination.find_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontamination.contaminated()).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources come near their target weights."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files, read back: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_dir(spark, "pipeline-tokens")
    token_files.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50257, end_id=2)
    return token_files.read_token_files(spark, folder)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mix_sources),
    ("token-ID output", token_output),
]

#: The classifier, the prefix-tree join and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        folder = shared_dir(spark, f"pipeline-stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
