"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import oracles
from gridlake.sources.scratch import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.token_files import read_token_files, write_token_files

    folder = shared_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder,
                      public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50257, end_id=2)
    return read_token_files(spark, folder)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def _op10_sql() -> str:
    from gridlake.llm.mixing import PLAN_SQL

    return PLAN_SQL + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM c"


@query("op10_mix_sources", _op10_sql())
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.mixing import plan_copies

    planned = plan_copies(table(spark, sf_dir, "documents"))
    return planned.selectExpr(
        "doc_id", "mix_size AS size", "mix_source_size AS source_size", "mix_target AS target",
        "mix_copies * mix_size AS taken")


@query("op1_decontaminate", r"""
WITH it AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, w[i:i + 12] AS p, len(w[i:i + 12]) AS n
  FROM it, range(1, greatest(2, len(w) - 11)) r(i) WHERE len(w) > 0),
d AS (
  SELECT rowid AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, i, n, w[i:i + n - 1] AS p FROM d, sizes, range(1, len(w) - n + 2) t(i) WHERE len(w) >= n),
hit AS (SELECT dw.r, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.p = win.p),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hit, range(0, n) t(k) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)
""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.decontamination import contaminated, find_spans, n_hit

    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("hit_words").alias("n_words"), n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.quality import fit, in_fold, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), fold=0)
    return score(docs, model).select(
        "doc_id", in_fold(F.col("doc_id"), 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.main_text import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op9_ngram_join")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_vector_pairs", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
       WHERE e IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)
         AND list_sum(list_transform(e, lambda x: x * x)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
      ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS seen FROM v UNION
      SELECT r.id, p.b FROM r JOIN p ON p.a = r.seen),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN c ON c.id = v.vec_id
""")
def op5_vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.vector_pairs import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_katz_scores")
def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.katz import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


@query("op8_remove_repeats")
def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_robust_outliers", oracles.robust_outliers())
def op13_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.outliers import STATS, judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", *STATS, "base_failed", "kept")


@query("op12_conversation_repair", oracles.CONVERSATION_REPAIR)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.conversation_repair import damage, digests, repair

    told = table(spark, sf_dir, "conversations")
    return digests(repair(damage(told), told.select("conv_id")))


@query("op11_prefix_trie", oracles.PREFIX_TRIE)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.prefix_trie import build, with_ends

    return with_ends(build(table(spark, sf_dir, "conversations")))
