"""Queries on vector search, the chunk catalog and retrieval."""

from pyspark.sql import functions as F

from gridlake.functions import vector as vf
from gridlake.operators import catalog as ct
from gridlake.operators import vector_index as vi
from gridlake.operators import vectors as vc
from gridlake.operators.chunks import build_context, table_chunks
from gridlake.operators.embedder import embed_texts, hashed_words
from gridlake.operators.typed import infer
from gridlake.plans import fixtures as fx
from gridlake.plans.chunking import LINE_CHUNKS_CTE, line_chunks
from gridlake.plans.registry import query, spread, table

# One query vector per label: the mean of the label's vectors.
MEANS_CTE = """positions AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, list(m ORDER BY pos) AS mean_vec FROM (SELECT label, pos, avg(x) AS m FROM positions GROUP BY ALL) GROUP BY label)"""


def _means(spark, sf):
    return vc.mean_vectors(table(spark, sf, "embeddings"), ["label"])


@query("e01_filtered_knn", f"""WITH {MEANS_CTE},
scored AS (SELECT m.label AS query_id, vec_id, round(list_distance(embedding::DOUBLE[], mean_vec) ^ 2, 6) AS score
  FROM means m JOIN embeddings e ON e.label = m.label)
SELECT query_id::BIGINT AS query_id, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored) WHERE rank <= 5""")
def e01(spark, sf):
    """Nearest vectors to each label's mean among the vectors of that label."""
    queries = _means(spark, sf).select(
        F.col("label").alias("query_id"), F.col("mean_vec").alias("query_vec"), "label")
    found = vc.nearest_for_each(table(spark, sf, "embeddings"), queries, 5, on=["label"])
    return found.select(
        F.col("query_id").cast("bigint"), "vec_id", "score", F.col("rank").cast("bigint"))


@query("e01_single_query_knn", f"""WITH {MEANS_CTE}
SELECT vec_id, round(list_distance(embedding::DOUBLE[], mean_vec) ^ 2, 6) AS score FROM embeddings, means
WHERE means.label = 3 AND embeddings.label <> 3 ORDER BY score, vec_id LIMIT 10""")
def e01_single(spark, sf):
    target = _means(spark, sf).where("label = 3").first()["mean_vec"]
    return vc.nearest(table(spark, sf, "embeddings"), target, 10, F.col("label") != 3).select("vec_id", "score")


@query("e01_knn_self_join", """WITH pairs AS (SELECT a.vec_id AS query_id, b.vec_id,
  round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ^ 2, 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT query_id, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 3""")
def e01_all(spark, sf):
    """Every vector against all others; no pair table is formed."""
    vectors = spread(table(spark, sf, "embeddings"))
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return vc.nearest_for_each(vectors, queries, 3, exclude_self=True).select("query_id", "vec_id", "score")


@query("e01_pruned_knn", """WITH pairs AS (SELECT a.vec_id AS query_id, b.vec_id,
  round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ^ 2, 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label)
SELECT query_id, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 4""")
def e01_pruned(spark, sf):
    """Every vector against those of its label, cell by cell of a stored index."""
    vectors = table(spark, sf, "embeddings")
    index = vi.build_index(vectors, on=["label"])
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")
    return vi.search(index, queries, 4, exclude_self=True)[0].select("query_id", "vec_id", "score")


def _mixed(spark, sf):
    """Vectors of which some are missing and some are cut to half their length."""
    vec, n = F.col("embedding"), F.col("vec_id")
    return table(spark, sf, "embeddings").withColumn("embedding", F.when(n % 5 == 2, F.lit(None)).when(
        n % 7 == 1, F.slice(vec, 1, F.floor(F.size(vec) / 2).cast("int"))).otherwise(vec))


@query("e01_mixed_dimensions", f"""WITH {MEANS_CTE},
scored AS (SELECT m.label AS query_id, vec_id, round(list_distance(embedding::DOUBLE[], mean_vec) ^ 2, 6) AS score
  FROM means m JOIN embeddings e ON e.label = m.label WHERE vec_id % 5 <> 2 AND vec_id % 7 <> 1)
SELECT query_id::BIGINT AS query_id, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored) WHERE rank <= 5""")
def e01_mixed(spark, sf):
    """Missing vectors and those of another length never rank."""
    queries = _means(spark, sf).select(
        F.col("label").alias("query_id"), F.col("mean_vec").alias("query_vec"), "label")
    return vc.nearest_for_each(_mixed(spark, sf), queries, 5, on=["label"]).select(
        F.col("query_id").cast("bigint"), "vec_id", "score")


@query("e08_search_guard", """WITH stored AS (SELECT 'c' || label % 4 AS collection, min(len(embedding) // 2) AS lo, max(len(embedding)) AS hi,
    bool_or(vec_id % 7 = 1) AND bool_or(vec_id % 7 <> 1) AS two FROM embeddings WHERE vec_id % 5 <> 2 AND label % 4 IN (1, 2)
    AND (label % 4 = 2 OR vec_id % 7 <> 1) GROUP BY ALL),
asked AS (SELECT 'c' || label % 4 AS collection, max(len(embedding)) AS dim FROM embeddings GROUP BY ALL)
SELECT collection, CASE WHEN two THEN lo ELSE hi END::BIGINT AS existing_dim, dim::BIGINT AS query_dim,
  hi IS NULL OR NOT two AS searchable FROM asked LEFT JOIN stored USING (collection)""")
def e08_search(spark, sf):
    """Collections that hold one dimension, two of them, or nothing, before a search."""
    name = F.concat(F.lit("c"), (F.col("label") % 4).cast("string"))
    stored = _mixed(spark, sf).withColumn("collection", name).where(
        (F.col("label") % 4 == 2) | ((F.col("label") % 4 == 1) & (F.col("vec_id") % 7 != 1)))
    queries = table(spark, sf, "embeddings").select(name.alias("collection"), F.col("embedding").alias("query_vec"))
    return vc.search_guard(stored, queries).select(
        "collection", F.col("existing_dim").cast("bigint"), F.col("query_dim").cast("bigint"), "searchable")


@query("e02_cosine", f"""WITH {MEANS_CTE}
SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN 0.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], mean_vec), 6) END AS similarity
FROM embeddings JOIN means USING (label)""")
def e02(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumn(
        "embedding", F.when(F.col("vec_id") % 50 == 7, F.transform("embedding", lambda x: F.lit(0.0)))
        .otherwise(F.col("embedding").cast("array<double>")))
    means = vc.mean_vectors(table(spark, sf, "embeddings"), ["label"])
    return vectors.join(means, "label").select(
        "vec_id", F.round(vf.cosine(F.col("embedding"), F.col("mean_vec")), 6).alias("similarity"))


@query("e03_batch_cosine", f"""WITH {MEANS_CTE},
scored AS (SELECT m.label::BIGINT AS query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], mean_vec), 6) AS similarity,
  row_number() OVER (PARTITION BY m.label ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], mean_vec), 12) DESC, vec_id) AS rank
  FROM embeddings, means m)
SELECT query_id, vec_id, similarity FROM scored WHERE rank <= 25""")
def e03(spark, sf):
    """The 25 vectors most similar to each label mean."""
    queries = _means(spark, sf).select(
        F.col("label").cast("bigint").alias("query_id"), F.col("mean_vec").alias("query_vec"))
    return vc.cosine_for_each(spread(table(spark, sf, "embeddings")), queries, k=25).select(
        "query_id", "vec_id", F.round("score", 6).alias("similarity"))


@query("e03_cosine_threshold", f"""WITH {MEANS_CTE}
SELECT m.label::BIGINT AS query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], mean_vec), 6) AS similarity
FROM embeddings, means m WHERE round(list_cosine_similarity(embedding::DOUBLE[], mean_vec), 12) >= 0.25""")
def e03_least(spark, sf):
    queries = _means(spark, sf).select(
        F.col("label").cast("bigint").alias("query_id"), F.col("mean_vec").alias("query_vec"))
    return vc.cosine_for_each(spread(table(spark, sf, "embeddings")), queries, least=0.25).select(
        "query_id", "vec_id", F.round("score", 6).alias("similarity"))


@query("e03_pruned_cosine", f"""WITH {MEANS_CTE},
scored AS (SELECT m.label::BIGINT AS query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], mean_vec), 6) AS similarity,
  row_number() OVER (PARTITION BY m.label ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], mean_vec), 12) DESC, vec_id) AS rank
  FROM embeddings, means m WHERE round(list_cosine_similarity(embedding::DOUBLE[], mean_vec), 12) >= 0.25)
SELECT query_id, vec_id, similarity FROM scored WHERE rank <= 10""")
def e03_pruned(spark, sf):
    """The 10 vectors most similar to each label mean, of at least 0.25, from a stored index."""
    queries = _means(spark, sf).select(F.col("label").cast("bigint").alias("query_id"), F.col("mean_vec").alias("query_vec"))
    index = vi.build_index(table(spark, sf, "embeddings"), metric="cosine")
    return vi.search(index, queries, 10, 0.25)[0].select("query_id", "vec_id", F.round("score", 6).alias("similarity"))


WORD_VECTORS_CTE = """words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents),
places AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos, 1.0 - 2.0 * (('0x' || substr(md5(w), 9, 2))::BIGINT % 2) AS s FROM words),
sums AS (SELECT doc_id, pos, sum(s)::DOUBLE AS x FROM places GROUP BY ALL),
lengths AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM sums GROUP BY doc_id),
vectors AS (SELECT doc_id, list(CASE WHEN coalesce(n, 0) > 0 THEN coalesce(x, 0) / n ELSE 0.0 END ORDER BY r.pos) AS v
  FROM documents CROSS JOIN range(64) AS r(pos) LEFT JOIN sums USING (doc_id, pos) LEFT JOIN lengths USING (doc_id) GROUP BY doc_id)"""


@query("e04_similar_texts", f"""WITH {WORD_VECTORS_CTE},
target AS (SELECT list(m ORDER BY pos) AS t FROM (SELECT pos, avg(x) AS m FROM (
  SELECT generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM vectors) GROUP BY pos)),
scored AS (SELECT doc_id AS id, round(list_cosine_similarity(v, t), 6) AS similarity FROM vectors, target)
SELECT id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS document, similarity
FROM scored JOIN documents ON doc_id = id ORDER BY similarity DESC, id LIMIT 5""")
def e04(spark, sf):
    """Documents most similar to the mean of all document vectors, with previews."""
    docs = embed_texts(spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"), F.col("text").alias("content")), "content").checkpoint()
    target = vc.mean_vectors(docs, []).first()["mean_vec"]
    return vc.similar_texts(docs, target, 5)


@query("c10_question_context", f"""WITH asked AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back
  FROM conversations WHERE role = 'user'),
texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - conv_id, text FROM asked WHERE back = 1),
{WORD_VECTORS_CTE.replace("FROM documents", "FROM texts")},
scored AS (SELECT -1 - q.doc_id AS query_id, d.doc_id, round(list_distance(d.v, q.v) ^ 2, 6) AS score
  FROM vectors q JOIN vectors d ON q.doc_id < 0 AND d.doc_id >= 0),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM scored)
SELECT query_id, string_agg('[来源：' || coalesce(CASE WHEN doc_id % 4 <> 0 THEN 'file_' || doc_id END, lang, '未知来源') || ']:'
  || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS context
FROM hits JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id""")
def c10_question(spark, sf):
    """Contexts of the five nearest documents to the last question of every conversation."""
    docs = table(spark, sf, "documents")
    asked = table(spark, sf, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.max(F.struct("turn", "text"))["text"].alias("question"))
    questions = embed_texts(asked, "question", vec_col="query_vec", keep=["query_id"])
    vectors = embed_texts(spread(docs).select("doc_id", "text"), "text", keep=["doc_id"])
    hits = vc.nearest_for_each(vectors, questions, 5, id_col="doc_id").select("query_id", "doc_id", "rank")
    found = docs.select("doc_id", F.col("lang").alias("source"), F.col("text").alias("content"), F.when(
        F.col("doc_id") % 4 != 0, F.concat(F.lit("file_"), F.col("doc_id").cast("string"))).alias("filename"))
    return build_context(hits.join(found, "doc_id"), "query_id", "rank")


@query("e04_previews", """SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS document
FROM documents""")
def e04_previews(spark, sf):
    return table(spark, sf, "documents").select("doc_id", vc.preview(F.col("text")).alias("document"))


@query("e05_mean_vector", f"""WITH {MEANS_CTE}
SELECT label::BIGINT AS label, generate_subscripts(mean_vec, 1)::BIGINT AS pos, round(unnest(mean_vec), 6) AS m FROM means""")
def e05(spark, sf):
    return _means(spark, sf).select(
        F.col("label").cast("bigint"), F.posexplode("mean_vec").alias("pos", "m")).select(
        "label", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("m", 6).alias("m"))


@query("e06_unit_vectors", """WITH lengths AS (SELECT vec_id, embedding, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS n FROM embeddings)
SELECT vec_id, round(list_sum([x::DOUBLE / n FOR x IN embedding]), 6) AS total, round(embedding[1]::DOUBLE / n, 6) AS first, 1.0::DOUBLE AS length FROM lengths""")
def e06(spark, sf):
    units = table(spark, sf, "embeddings").select("vec_id", vf.unit(F.col("embedding")).alias("u"))
    return units.select(
        "vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.col("u")[0], 6).alias("first"), F.round(vf.norm(F.col("u")), 6).alias("length"))


@query("e07_vector_validity", """SELECT n AS n_vectors, e AS n_empty, n = x AND e = 0 AND x > 0 AS valid FROM (
  SELECT count(*) AS n, count(*) FILTER (vec_id % 97 = 13) AS e, (SELECT count(*) FROM embeddings) AS x FROM embeddings)""")
def e07(spark, sf):
    vectors = table(spark, sf, "embeddings")
    broken = vectors.withColumn(
        "embedding", F.when(F.col("vec_id") % 97 != 13, F.col("embedding")))
    return vc.vector_validity(broken, vectors.count())


def _collections(spark, sf):
    label = F.col("label")
    return table(spark, sf, "embeddings").withColumn(
        "collection", F.concat(F.lit("c"), (label % 4).cast("string"))).withColumn(
        "stored", label < 8)


@query("e08_dimension_guard", """WITH v AS (SELECT 'c' || label % 4 AS collection, label < 8 AND label % 4 <> 3 AS stored,
  CASE WHEN label % 4 = 2 AND label >= 8 OR label = 9 THEN len(embedding) // 2 ELSE len(embedding) END::BIGINT AS dim FROM embeddings),
s AS (SELECT collection, min(dim) AS a, max(dim) AS b FROM v WHERE stored GROUP BY 1),
n AS (SELECT collection, min(dim) AS c, max(dim) AS d FROM v WHERE NOT stored GROUP BY 1)
SELECT collection, a AS existing_dim, c AS new_dim, c = d AND (a IS NULL OR (a = c AND b = d)) AS compatible FROM n LEFT JOIN s USING (collection)""")
def e08(spark, sf):
    label = F.col("label")
    short = ((label % 4 == 2) & (label >= 8)) | (label == 9)
    vectors = _collections(spark, sf).withColumn("embedding", F.when(
        short, F.slice("embedding", F.lit(1), F.floor(F.size("embedding") / 2).cast("int"))
    ).otherwise(F.col("embedding"))).withColumn("stored", F.col("stored") & (label % 4 != 3))
    checked = vc.dimension_check(vectors.where("stored"), vectors.where("NOT stored"))
    return checked.select(
        "collection", F.col("existing_dim").cast("bigint"), F.col("new_dim").cast("bigint"), "compatible")


@query("e09_collection_names", """SELECT DISTINCT model, CASE WHEN model = 'embed-src1' OR model = '' THEN 'ai_assistant_docs'
  ELSE left('ai_assistant_docs__' || trim(regexp_replace(model, '[^A-Za-z0-9]', '_', 'g'), '_'), 63) END AS collection
FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'embed-' || source WHEN 1 THEN '.' || lang || '/v' || doc_id % 9 || '.0!' WHEN 2 THEN ''
  ELSE repeat(source || ' ', 20) END AS model FROM documents)""")
def e09(spark, sf):
    doc = F.col("doc_id")
    model = (
        F.when(doc % 4 == 0, F.concat(F.lit("embed-"), "source"))
        .when(doc % 4 == 1, F.concat(F.lit("."), "lang", F.lit("/v"), (doc % 9).cast("string"), F.lit(".0!")))
        .when(doc % 4 == 2, "").otherwise(F.repeat(F.concat("source", F.lit(" ")), 20)))
    models = table(spark, sf, "documents").select(model.alias("model")).distinct()
    return models.withColumn("collection", vc.collection_name(F.col("model"), "embed-src1"))


@query("e10_collection_info", f"WITH {LINE_CHUNKS_CTE} SELECT collection, count(*) AS n_vectors FROM line_chunks GROUP BY 1")
def e10(spark, sf):
    return ct.collection_info(line_chunks(spark, sf))


LISTED_CTE = f"""{LINE_CHUNKS_CTE}, catalog AS (SELECT user_id, document_id, min(coalesce(filename, source, '未知文件')) AS filename,
  max(coalesce(file_size, 0)) AS size, count(*) AS chunks, min(processed_at) AS created_at FROM line_chunks GROUP BY 1, 2)"""


@query("e11_document_catalog", f"""WITH {LISTED_CTE}
SELECT *, lower(string_split(filename, '.')[-1]) AS type FROM catalog""")
def e11(spark, sf):
    return ct.list_documents(line_chunks(spark, sf))


@query("e12_catalog_totals", f"""WITH {LISTED_CTE}
SELECT count(*) AS documents, sum(chunks)::BIGINT AS chunks, sum(size)::BIGINT AS size, max(created_at) AS last_update
FROM catalog WHERE contains(lower(filename), lower('SRC1'))""")
def e12(spark, sf):
    return ct.catalog_totals(ct.list_documents(line_chunks(spark, sf)), "SRC1")


@query("e13_document_chunks", f"""WITH {LINE_CHUNKS_CTE}
SELECT document_id, chunk_index, content FROM line_chunks WHERE document_id = 'd42' AND user_id = '0' ORDER BY chunk_index""")
def e13(spark, sf):
    return ct.document_chunks(line_chunks(spark, sf), "d42", "0").select(
        "document_id", "chunk_index", "content")


def _table_store(spark, sf):
    model = infer(fx.stored_grid(spark, sf))
    return table_chunks(model.grid, model.tables, model.columns), model


GROUP_ROWS_CTE = f"""{fx.UP_TO_FACTS},
groups AS (SELECT g.doc, (g.row_index - f.n_header_rows - 1) // 8 AS grp, min(row_index) AS row_start, max(row_index) AS row_end
  FROM grid g JOIN facts f USING (doc) WHERE row_index > n_header_rows GROUP BY g.doc, grp),
store AS (SELECT doc, 'doc_' || doc || '_0' AS id, 'workbook_summary' AS chunk_type, 0 AS row_start, 0 AS row_end,
    'A1:H' || last_row AS range FROM facts
  UNION ALL SELECT doc, 'doc_' || doc || '_1', 'sheet_schema', 1, n_header_rows, 'A1:H' || n_header_rows FROM facts
  UNION ALL SELECT doc, 'doc_' || doc || '_' || grp + 2, 'row_group', row_start, row_end, 'A' || row_start || ':H' || row_end FROM groups)"""


@query("e14_table_chunks_by_type", f"""{GROUP_ROWS_CTE}
SELECT 'doc_' || doc AS document_id, id, chunk_type FROM store WHERE chunk_type IN ('workbook_summary', 'sheet_schema')""")
def e14(spark, sf):
    store, _ = _table_store(spark, sf)
    return ct.table_chunks_of(store, ["workbook_summary", "sheet_schema"]).select(
        "document_id", "id", "chunk_type")


@query("e15_delete_documents", f"""WITH {LINE_CHUNKS_CTE}, doomed AS (
  SELECT 'd' || doc_id AS document_id, (doc_id % 14)::VARCHAR AS user_id FROM labels WHERE toxic = 1)
SELECT collection, count(*) AS n_left, (SELECT count(*) FROM line_chunks SEMI JOIN doomed USING (document_id, user_id)) AS deleted
FROM line_chunks ANTI JOIN doomed USING (document_id, user_id) GROUP BY collection""")
def e15(spark, sf):
    """Requests name a wrong owner for half of the documents; those stay."""
    doomed = table(spark, sf, "labels").where("toxic = 1").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"),
        (F.col("doc_id") % 14).cast("string").alias("user_id"))
    left, gone = ct.without_documents(line_chunks(spark, sf), doomed)
    return left.groupBy("collection").agg(F.count("*").alias("n_left")).withColumn(
        "deleted", F.lit(gone.first()["deleted"]).cast("bigint"))


def _with_ids(chunks):
    return chunks.withColumn("id", F.concat_ws("_", "document_id", F.col("chunk_index").cast("string")))


@query("e16_reindex", f"""WITH {LINE_CHUNKS_CTE}
SELECT document_id || '_' || chunk_index AS id, collection, length(content) AS n, NULL::BIGINT AS dim FROM line_chunks
UNION ALL SELECT document_id || '_' || chunk_index, 'ai_assistant_docs__new', length(content), 32 FROM line_chunks WHERE document_id = 'd42'""")
def e16(spark, sf):
    store = _with_ids(line_chunks(spark, sf)).withColumn("embedding", F.lit(None).cast("array<double>"))
    after = ct.reindex(
        store, "d42", "0", "ai_assistant_docs", "ai_assistant_docs__new",
        lambda chunks: embed_texts(chunks, "content", hashed_words(32)))
    return after.select(
        "id", "collection", F.length("content").cast("bigint").alias("n"),
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("dim"))


@query("e17_replace_versions", f"""WITH {LINE_CHUNKS_CTE},
fresh AS (SELECT document_id, chunk_index, 'v2' AS version FROM line_chunks WHERE user_id = '3' AND chunk_index < 2)
SELECT document_id, chunk_index, 'v1' AS version FROM line_chunks WHERE document_id NOT IN (SELECT document_id FROM fresh)
UNION ALL SELECT * FROM fresh""")
def e17(spark, sf):
    """Documents of one owner get a shorter second version."""
    store = line_chunks(spark, sf).withColumn("version", F.lit("v1"))
    fresh = store.where("user_id = '3' AND chunk_index < 2").withColumn("version", F.lit("v2"))
    return ct.replace_versions(store, fresh).select("document_id", "chunk_index", "version")


@query("e18_backfill_ids", f"""WITH {LINE_CHUNKS_CTE}, gaps AS (SELECT document_id || '_' || chunk_index AS id,
  CASE WHEN user_id <> '2' THEN document_id END AS document_id, user_id, CASE WHEN user_id = '2' THEN NULL ELSE filename END AS filename,
  CASE WHEN document_id LIKE '%1' THEN NULL ELSE ' ' || source END AS source FROM line_chunks)
SELECT id, coalesce(document_id, left(sha256(user_id || '|' || coalesce(source, regexp_replace(id, '_[^_]*$', ''))), 32)) AS document_id,
  CASE WHEN document_id IS NULL THEN trim(coalesce(source, regexp_replace(id, '_[^_]*$', ''))) ELSE filename END AS filename FROM gaps""")
def e18(spark, sf):
    foreign = F.col("user_id") == "2"
    chunks = _with_ids(line_chunks(spark, sf)).withColumn(
        "source", F.when(~F.col("document_id").endswith("1"), F.concat(F.lit(" "), "source"))
    ).withColumn("document_id", F.when(~foreign, F.col("document_id"))
    ).withColumn("filename", F.when(~foreign, F.col("filename")))
    return ct.backfill_document_ids(chunks).select("id", "document_id", "filename")


@query("e19_orphans", """SELECT 'd' || doc_id AS document_id FROM documents ANTI JOIN labels USING (doc_id)""")
def e19(spark, sf):
    def name(df):
        return df.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"))

    return ct.orphans(name(table(spark, sf, "documents")), name(table(spark, sf, "labels")))


# Retrieval log: each customer's question hits the row groups of its orders, nearest first.
HITS_CTE = """hits AS (SELECT o_custkey AS query_id, o_orderkey // 500 AS doc,
    'doc_' || o_orderkey // 500 || '_' || (o_orderkey % 500 // 8 + 2) AS id, round(min(o_totalprice), 2) AS score
  FROM orders GROUP BY ALL)"""


def _hits(spark, sf):
    doc, place = F.floor(F.col("o_orderkey") / 500), F.floor((F.col("o_orderkey") % 500) / 8) + 2
    return table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("query_id"),
        F.concat(F.lit("doc_"), doc.cast("string")).alias("document_id"),
        F.concat(F.lit("doc_"), doc.cast("string"), F.lit("_"), place.cast("string")).alias("id"),
    ).agg(F.round(F.min("o_totalprice"), 2).alias("score"))


@query("e20_expand_best_table", f"""{GROUP_ROWS_CTE}, {HITS_CTE},
best AS (SELECT query_id, doc FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, 'doc_' || doc) = 1)
SELECT query_id, s.id, s.chunk_type, s.row_start::BIGINT AS row_start FROM best JOIN store s USING (doc)""")
def e20(spark, sf):
    store, _ = _table_store(spark, sf)
    keys = store.select("id", "sheet_name", "table_id", "chunk_type")
    hits = _hits(spark, sf).join(keys, "id")
    return ct.expand_best_table(hits, store).select("query_id", "id", "chunk_type", "row_start")


@query("e21_citations", f"""{GROUP_ROWS_CTE}, {HITS_CTE},
ranked AS (SELECT query_id, doc, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM hits),
placed AS (SELECT query_id, r.doc, s.range, s.row_start, s.row_end, min(rank) AS rank FROM ranked r JOIN store s USING (id) GROUP BY ALL)
SELECT query_id, n, document_id, range, 'orders_' || doc || '.csv' AS filename, row_start::BIGINT AS row_index, row_end::BIGINT AS row_end,
  'A:H' AS column, 'semantic' AS match_mode FROM (
  SELECT *, 'doc_' || doc AS document_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM placed) WHERE n <= 5""")
def e21(spark, sf):
    store, _ = _table_store(spark, sf)
    ranked = _hits(spark, sf).withColumn("rank", F.struct("score", "id")).drop("document_id")
    hits = ranked.join(store.withColumnRenamed("source_uri", "source"), "id")
    return ct.citations(hits).select(
        "query_id", "n", "document_id", "range", "filename", "row_index", "row_end", "column", "match_mode")


@query("e21_structured_citations", f"""{fx.UP_TO_FACTS}, reads AS (SELECT o_custkey AS query_id, o_orderkey // 500 AS doc,
  min(o_orderkey % 500 + 3) AS row_start, max(o_orderkey % 500 + 3) AS row_end FROM orders GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 'doc_' || doc) AS n FROM reads)
SELECT query_id, n, 'doc_' || doc AS document_id, 'A' || row_start || ':H' || row_end AS range, row_start, row_end, 'A:H' AS column,
  'structured' AS match_mode FROM placed WHERE n <= 5""")
def e21_structured(spark, sf):
    """Sheet rows that each customer's lookups read, cited through their tables."""
    from gridlake.operators.grid import table_summary

    tables = table_summary(fx.orders_grid(spark, sf))
    place = F.col("o_orderkey") % 500 + 3
    reads = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("query_id"),
        F.concat(F.lit("doc_"), F.floor(F.col("o_orderkey") / 500).cast("string")).alias("document_id"),
    ).agg(F.min(place).alias("row_start"), F.max(place).alias("row_end"))
    accesses = reads.select(
        "*", F.lit("Orders").alias("sheet_name"), F.lit("Orders#0").alias("table_id"),
        F.lit("table_structured_access").alias("chunk_type"), F.col("document_id").alias("rank"),
        F.lit("f.csv").alias("filename"), F.lit(None).cast("string").alias("source"))
    return ct.citations(ct.structured_citation(accesses, tables)).select(
        "query_id", "n", "document_id", "range", "row_start", "row_end", "column", "match_mode")


@query("e22_row_coverage", f"""{GROUP_ROWS_CTE}
SELECT 'doc_' || doc AS document_id, sum(row_end - row_start + 1)::BIGINT AS covered_rows, count(*) AS n_groups
FROM groups GROUP BY doc""")
def e22(spark, sf):
    store, _ = _table_store(spark, sf)
    return ct.row_coverage(store, ["document_id"])


# Cache: texts of labelled documents were embedded at a time that depends on the document.
_NOW = 10000
CACHE_CTE = """cache AS (SELECT DISTINCT md5('m1: ' || text) AS key, (doc_id * 37 % 10000) AS stored_at, doc_id % 5000 AS last_used
  FROM documents JOIN labels USING (doc_id) QUALIFY row_number() OVER (PARTITION BY md5('m1: ' || text) ORDER BY doc_id) = 1)"""


def _cache(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    first = labelled.groupBy(F.md5(F.concat(F.lit("m1: "), "text")).alias("key")).agg(
        F.min("doc_id").alias("doc_id"))
    return first.select(
        "key", (F.col("doc_id") * 37 % 10000).alias("stored_at"),
        (F.col("doc_id") % 5000).alias("last_used"),
        F.array(F.col("doc_id").cast("double")).alias("embedding"))


@query("e23_cache_split", f"""WITH {CACHE_CTE}
SELECT doc_id, c.key IS NOT NULL AS hit FROM documents LEFT JOIN (SELECT key FROM cache WHERE {_NOW} - stored_at < 3600) c
ON c.key = md5('m1: ' || text)""")
def e23(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", "text")
    return vc.look_up_cache(texts, _cache(spark, sf), "m1", F.lit(_NOW)).select("doc_id", "hit")


@query("e24_cache_trim", f"""WITH {CACHE_CTE}
SELECT key, last_used FROM cache WHERE {_NOW} - stored_at < 3600 ORDER BY last_used DESC, key LIMIT 1024""")
def e24(spark, sf):
    return vc.trim_cache(_cache(spark, sf), F.lit(_NOW)).select("key", "last_used")


@query("e24_cache_stats", f"""WITH {CACHE_CTE}, looked AS (SELECT c.key IS NOT NULL AS hit FROM documents
  LEFT JOIN (SELECT key FROM cache WHERE {_NOW} - stored_at < 3600) c ON c.key = md5('m1: ' || text))
SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(avg(hit::INT), 6) AS hit_rate FROM looked""")
def e24_stats(spark, sf):
    stats = vc.cache_stats(e23(spark, sf))
    return stats.withColumn("hit_rate", F.round("hit_rate", 6))


@query("u01_embed_texts", f"""WITH {WORD_VECTORS_CTE}
SELECT doc_id, generate_subscripts(v, 1)::BIGINT - 1 AS pos, round(unnest(v), 6) AS x FROM vectors""")
def u01(spark, sf):
    chunks = spread(table(spark, sf, "documents")).select("doc_id", "text")
    return embed_texts(chunks, "text").select("doc_id", F.posexplode("embedding").alias("pos", "x")).select(
        "doc_id", F.col("pos").cast("bigint"), F.round("x", 6).alias("x"))


@query("u01_vector_checks", """SELECT count(*) AS n_vectors, 64::BIGINT AS dim, count(*) FILTER (trim(text) <> '') AS n_unit FROM documents""")
def u01_checks(spark, sf):
    """Every document gets one vector of the model's size; texts with words give unit length."""
    vectors = embed_texts(spread(table(spark, sf, "documents")).select("doc_id", "text"), "text")
    length = F.round(vf.norm(F.col("embedding")), 6)
    return vectors.agg(
        F.count("*").alias("n_vectors"), F.max(F.size("embedding")).cast("bigint").alias("dim"),
        F.count_if(length == 1.0).alias("n_unit"))
