"""Queries on text cleaning, chunks and the texts built from them."""

from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.text import clean_text
from gridlake.operators import chunks as ch
from gridlake.operators import paging
from gridlake.operators import typed as ty
from gridlake.plans import fixtures as fx
from gridlake.plans.registry import query, spread, table

# Documents with the line-end and blank-line variety that files have.
_RAW = ("(CASE WHEN doc_id % 3 = 0 THEN chr(65279) ELSE '' END || replace(replace(text, '. ', CASE doc_id % 4 "
        "WHEN 0 THEN '.' || chr(13) || chr(10) WHEN 1 THEN '.' || chr(13) || chr(13) || chr(13) || chr(13) || ' ' || chr(13) "
        "WHEN 2 THEN '.' || chr(10) || ' ' || chr(9) || chr(10) || chr(10) || chr(10) ELSE '. ' END), 'zz', ''))")


def raw_documents(spark, sf):
    key = F.col("doc_id") % 4
    end = (
        F.when(key == 0, ".\r\n").when(key == 1, ".\r\r\r\r \r")
        .when(key == 2, ".\n \t\n\n\n").otherwise(". "))
    raw = F.concat(
        F.when(F.col("doc_id") % 3 == 0, "﻿").otherwise(""),
        F.replace(F.replace("text", F.lit(". "), end), F.lit("zz"), F.lit("")))
    return spread(table(spark, sf, "documents")).select("doc_id", "lang", "source", raw.alias("raw"))


# Blank lines, then runs of them: keep a blank line only if fewer than two blanks precede it.
_CLEAN_SQL = f"""WITH raw AS (SELECT doc_id, {_RAW} AS raw FROM documents),
unix AS (SELECT doc_id, regexp_replace(regexp_replace(raw, '^\\x{{FEFF}}', ''), '\\r\\n|\\r', chr(10), 'g') AS t FROM raw),
lines AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS line FROM unix),
flagged AS (SELECT *, {fx.sql_trim('line')} = '' AS blank FROM lines),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, blank ORDER BY i) AS run FROM flagged),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, blank, run ORDER BY i) AS place FROM runs)
SELECT doc_id, string_agg(CASE WHEN blank THEN '' ELSE line END, chr(10) ORDER BY i) AS text
FROM kept WHERE NOT blank OR place <= 2 GROUP BY doc_id"""


@query("c01_clean_text", _CLEAN_SQL)
def c01(spark, sf):
    return raw_documents(spark, sf).select("doc_id", clean_text(F.col("raw")).alias("text"))


@query("c02_page_text", f"""WITH pages_of AS (SELECT doc_id, generate_subscripts(string_split(text, '. '), 1) AS p,
  unnest(string_split(text, '. ')) AS page FROM documents),
lines AS (SELECT doc_id, p, generate_subscripts(string_split(page, chr(10)), 1) AS i, unnest(string_split(page, chr(10))) AS line FROM pages_of),
clean AS (SELECT doc_id, p, string_agg({fx.sql_trim('line')}, chr(10) ORDER BY i) AS body FROM lines
  WHERE {fx.sql_trim('line')} <> '' GROUP BY doc_id, p)
SELECT doc_id, coalesce(string_agg('第' || p || '页：' || chr(10) || body, chr(10) || chr(10) ORDER BY p), '') AS content
FROM documents LEFT JOIN clean USING (doc_id) GROUP BY doc_id""")
def c02(spark, sf):
    return spread(table(spark, sf, "documents")).select(
        "doc_id", ch.page_text(F.split("text", r"\. ")).alias("content"))


@query("c03_recursive_split")
def c03(spark, sf):
    return ch.split_texts(spread(table(spark, sf, "documents")), "doc_id", "text")


@query("c03_split_invariants", """SELECT doc_id, true AS within_size, true AS inside_text,
  len(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS n_words FROM documents
WHERE regexp_matches(text, '\\S')""")
def c03_invariants(spark, sf):
    """Chunks keep the size, are cut from the text, and together hold all its words."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text")
    chunks = ch.split_texts(docs, "doc_id", "text").join(docs, "doc_id")
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    return chunks.groupBy("doc_id").agg(
        F.bool_and(F.length("content") <= fv.CHUNK_SIZE).alias("within_size"),
        F.bool_and(F.contains("text", "content")).alias("inside_text"),
        F.size(F.array_distinct(F.flatten(F.collect_list(words)))).cast("bigint").alias("n_words"))


def _sql_stop(start: str) -> str:
    """End of the sentence chunk that begins behind a character number of text."""
    reach = f"text[{start} + 1:{start} + 1000]"
    ends = ", ".join(
        f"CASE WHEN contains({reach}, '{m}') THEN length({reach}) - strpos(reverse({reach}), '{m}') + 1 ELSE 0 END"
        for m in fv.SENTENCE_ENDS)
    space = f"length(regexp_extract({reach}, '(?s)^(.*{fx.WS_SQL})', 1))"
    return (f"CASE WHEN {start} + 1000 >= length(text) THEN length(text) WHEN greatest({ends}) > 0 "
            f"THEN {start} + greatest({ends}) WHEN {space} > 0 THEN {start} + {space} ELSE {start} + 1000 END")


@query("c04_sentence_split", f"""WITH RECURSIVE spans AS (
  SELECT doc_id, text, 0::BIGINT AS start, ({_sql_stop('0')})::BIGINT AS stop FROM documents WHERE length(text) > 1000
  UNION ALL
  SELECT doc_id, text, start, ({_sql_stop('start')})::BIGINT FROM (
    SELECT doc_id, text, CASE WHEN stop - 200 > start THEN stop - 200 ELSE stop END AS start FROM spans WHERE stop < length(text))),
chunks AS (SELECT doc_id, start, stop, {fx.sql_trim('text[start + 1:stop]')} AS content FROM spans)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, start AS start_pos, stop AS end_pos,
  count(*) OVER (PARTITION BY doc_id) AS total_chunks, content FROM chunks WHERE content <> ''
UNION ALL SELECT doc_id, 0, 0, length(text), 1, text FROM documents WHERE length(text) BETWEEN 1 AND 1000""")
def c04(spark, sf):
    return ch.split_sentences(spread(table(spark, sf, "documents")), "doc_id", "text")


# Chunk store derived from documents: one chunk per line; a tenth lack some metadata.
LINE_CHUNKS_CTE = """line_chunks AS (
  SELECT 'd' || doc_id AS document_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS chunk_index,
         unnest(string_split(text, chr(10))) AS content, (doc_id % 7)::VARCHAR AS user_id,
         CASE WHEN doc_id % 10 <> 3 THEN source || '_' || doc_id || '.' || lang END AS filename,
         source || '.txt' AS source, n_chars AS file_size,
         CASE WHEN doc_id % 2 = 0 THEN 'ai_assistant_docs' ELSE 'ai_assistant_docs__' || lang END AS collection,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60), '%Y-%m-%dT%H:%M:%S') AS processed_at
  FROM documents)"""


def line_chunks(spark, sf):
    doc = F.col("doc_id")
    stamp = F.date_format(
        (F.lit(1704067200).cast("bigint") + doc * 60).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d"), doc.cast("string")).alias("document_id"),
        F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"),
        (doc % 7).cast("string").alias("user_id"),
        F.when(doc % 10 != 3, F.concat("source", F.lit("_"), doc.cast("string"), F.lit("."), "lang"))
        .alias("filename"),
        F.concat("source", F.lit(".txt")).alias("source"), F.col("n_chars").alias("file_size"),
        F.when(doc % 2 == 0, fv.LEGACY_COLLECTION).otherwise(
            F.concat(F.lit(fv.COLLECTION_PREFIX), "lang")).alias("collection"),
        stamp.alias("processed_at"),
    ).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("c05_chunk_stamp", f"""WITH {LINE_CHUNKS_CTE}
SELECT document_id || '_' || chunk_index AS id, document_id, chunk_index, length(content) AS content_length,
  coalesce('upload_' || doc_id, filename) AS filename, coalesce('upload_' || doc_id, l.source) AS source,
  coalesce(CASE WHEN doc_id % 5 <> 0 THEN n_chars * 2 END, file_size) AS file_size, 'u' || doc_id % 3 AS user_id
FROM line_chunks l JOIN (SELECT *, 'd' || doc_id AS document_id FROM documents) USING (document_id)""")
def c05(spark, sf):
    doc = F.col("doc_id")
    documents = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), doc.cast("string")).alias("document_id"),
        F.concat(F.lit("upload_"), doc.cast("string")).alias("filename"),
        F.when(doc % 5 != 0, F.col("n_chars") * 2).alias("file_size"),
        F.concat(F.lit("u"), (doc % 3).cast("string")).alias("user_id"))
    stamped = ch.stamp(line_chunks(spark, sf), documents)
    return stamped.withColumn("content_length", F.length("content").cast("bigint")).drop("content")


@query("c06_size_guard", f"""WITH {LINE_CHUNKS_CTE}, n AS (SELECT document_id, count(*) AS n_chunks FROM line_chunks GROUP BY 1)
SELECT document_id, n_chunks, CASE WHEN n_chunks > 10 THEN 'DOCUMENT_TOO_LARGE' END AS error_type FROM n""")
def c06(spark, sf):
    accepted, rejected = ch.guard_size(line_chunks(spark, sf), limit=10)
    kept = accepted.groupBy("document_id").agg(F.count("*").alias("n_chunks")).withColumn(
        "error_type", F.lit(None).cast("string"))
    return kept.unionByName(rejected)


_LETTERS = "chr((64 + col_index)::INT)"
_LISTED_CTE = f"""listed AS (SELECT doc, string_agg({_LETTERS} || '=' || technical_name, ', ' ORDER BY col_index) AS mapping,
  string_agg(technical_name || '（' || description || '）', '; ' ORDER BY col_index) FILTER (length(description) > 0) AS noted,
  string_agg({_LETTERS} || ' ' || technical_name || coalesce(' — ' || nullif(description, ''), '') || ' （类型：' || data_type || '）',
    chr(10) ORDER BY col_index) AS schema_lines FROM names JOIN types USING (doc, col_index) GROUP BY doc)"""


def _model(spark, sf):
    return ty.infer(fx.stored_grid(spark, sf))


@query("c07_summary_chunks", f"""{fx.UP_TO_TYPES}, {_LISTED_CTE}
SELECT 'doc_' || doc AS document_id, '文件《orders_' || doc || '.csv》（类型 csv）是一个二维表格文档，包含 1 个工作表。' || chr(10)
  || '工作表「Orders」范围 A1:H' || last_row || '，共 ' || col_count || ' 列、' || (last_row - n_header_rows) || ' 条数据行（含 '
  || n_header_rows || ' 层表头）。' || chr(10) || '该表全部字段（列字母=字段名）：' || chr(10) || mapping
  || coalesce(chr(10) || '部分字段描述：' || noted, '') AS content FROM facts JOIN listed USING (doc)""")
def c07(spark, sf):
    model = _model(spark, sf)
    return ch.summary_chunks(model.tables, model.columns).select("document_id", "content")


@query("c08_schema_chunks", f"""{fx.UP_TO_TYPES}, {_LISTED_CTE}
SELECT 'doc_' || doc AS document_id, 'orders_' || doc || '.csv#Orders!A1:H' || n_header_rows AS source_uri,
  '工作表「Orders」字段结构（表 Orders#0，共 ' || col_count || ' 列）：' || chr(10) || schema_lines AS content
FROM facts JOIN listed USING (doc)""")
def c08(spark, sf):
    model = _model(spark, sf)
    return ch.schema_chunks(model.tables, model.columns).select("document_id", "source_uri", "content")


_GROUPS_CTE = f"""groups AS (SELECT g.doc, (g.row_index - f.n_header_rows - 1) // 8 AS grp, min(row_index) AS row_start,
  max(row_index) AS row_end, count(*) AS n, string_agg(row_index || ' | ' || array_to_string([coalesce(x, '') FOR x IN cells], ' | '),
    chr(10) ORDER BY row_index) AS body
  FROM grid g JOIN facts f USING (doc) WHERE row_index > n_header_rows GROUP BY g.doc, grp)"""


@query("c09_row_group_chunks", f"""{fx.UP_TO_TYPES}, {_LISTED_CTE}, {_GROUPS_CTE}
SELECT 'doc_' || doc AS document_id, row_start, row_end, 'A' || row_start || ':H' || row_end AS range,
  '工作表「Orders」| 数据范围：A' || row_start || ':H' || row_end || '（第 ' || row_start || '-' || row_end || ' 行，共 ' || n || ' 行）' || chr(10)
  || '字段映射（列字母=字段名）：' || mapping || chr(10) || '行号 | A | B | C | D | E | F | G | H' || chr(10) || body AS content
FROM groups JOIN listed USING (doc)""")
def c09(spark, sf):
    model = _model(spark, sf)
    return ch.row_group_chunks(model.grid, model.tables, model.columns).select(
        "document_id", "row_start", "row_end", "range", "content")


@query("c09_table_chunk_ids", f"""{fx.UP_TO_FACTS}, {_GROUPS_CTE},
parts AS (SELECT doc, 'workbook_summary' AS chunk_type, 0 AS chunk_index, 0 AS row_start, 0 AS row_end FROM facts
  UNION ALL SELECT doc, 'sheet_schema', 1, 1, n_header_rows FROM facts
  UNION ALL SELECT doc, 'row_group', 2 + grp, row_start, row_end FROM groups)
SELECT 'doc_' || doc || '_' || chunk_index AS id, 'doc_' || doc AS document_id, (doc % 4)::VARCHAR AS user_id, chunk_type,
  row_start::BIGINT AS row_start, row_end::BIGINT AS row_end, chunk_index::BIGINT AS chunk_index, 8::BIGINT AS column_end FROM parts""")
def c09_ids(spark, sf):
    model = _model(spark, sf)
    return ch.table_chunks(model.grid, model.tables, model.columns).select(
        "id", "document_id", "user_id", "chunk_type", "row_start", "row_end", "chunk_index", "column_end")


@query("c10_context", """WITH ranked AS (SELECT source, doc_id, text, lang,
  row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT source AS query_id, string_agg('[来源：' || coalesce(CASE WHEN doc_id % 4 <> 0 THEN 'file_' || doc_id END, lang, '未知来源') || ']:'
  || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM ranked GROUP BY source""")
def c10(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    hits = table(spark, sf, "documents").select(
        F.col("source").alias("query_id"), F.col("lang").alias("source"), "doc_id", "n_chars",
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("file_"), F.col("doc_id").cast("string"))).alias("filename"),
    ).withColumn("rank", F.row_number().over(order))
    return ch.build_context(hits, "query_id", "rank")


@query("c11_source_pages", """WITH RECURSIVE blocks AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank,
    '[来源：' || coalesce(CASE WHEN doc_id % 4 <> 0 THEN 'file_' || doc_id END, lang, '未知来源') || ']:' || chr(10) || text || chr(10) AS block FROM documents),
whole AS (SELECT source, string_agg(block, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY source),
lines AS (SELECT source, generate_subscripts(string_split(context, chr(10)), 1) AS n, unnest(string_split(context, chr(10))) AS line FROM whole),
walk AS (
  SELECT source, n, 0 AS page, length(line) + 1 AS used FROM lines WHERE n = 1
  UNION ALL
  SELECT w.source, l.n, CASE WHEN w.used + length(l.line) + 1 > 24000 THEN w.page + 1 ELSE w.page END,
    CASE WHEN w.used + length(l.line) + 1 > 24000 THEN 0 ELSE w.used END + length(l.line) + 1
  FROM walk w JOIN lines l ON l.source = w.source AND l.n = w.n + 1)
SELECT source AS query_id, page::BIGINT AS page, string_agg(line, chr(10) ORDER BY n) AS content
FROM walk JOIN lines USING (source, n) JOIN whole USING (source) WHERE length(context) > 24000 GROUP BY source, page
UNION ALL SELECT source, 0, context FROM whole WHERE length(context) <= 24000""")
def c11_source(spark, sf):
    """Pages of the context of all documents of a source, which is never one value."""
    hits = table(spark, sf, "documents").select(
        F.col("source").alias("query_id"), F.col("lang").alias("source"), "doc_id", "n_chars", F.col("text").alias("content"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("file_"), F.col("doc_id").cast("string"))).alias("filename"))
    return paging.context_page_rows(hits, "query_id", ["n_chars", "doc_id"])


@query("c11_context_pages", """WITH RECURSIVE lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
walk AS (
  SELECT doc_id, n, 0 AS page, length(line) + 1 AS used FROM lines WHERE n = 1
  UNION ALL
  SELECT w.doc_id, l.n, CASE WHEN w.used + length(l.line) + 1 > 2000 THEN w.page + 1 ELSE w.page END,
    CASE WHEN w.used + length(l.line) + 1 > 2000 THEN 0 ELSE w.used END + length(l.line) + 1
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.n = w.n + 1)
SELECT doc_id, page::BIGINT AS page, string_agg(line, chr(10) ORDER BY n) AS content
FROM walk JOIN lines USING (doc_id, n) JOIN documents USING (doc_id) WHERE length(text) > 2000 GROUP BY doc_id, page
UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 2000""")
def c11(spark, sf):
    pages = ch.context_pages(F.col("text"), 2000)
    return spread(table(spark, sf, "documents")).select(
        "doc_id", F.posexplode(pages).alias("page", "content")).withColumn("page", F.col("page").cast("bigint"))


@query("c11_page_totals", """SELECT doc_id, text, length(text) <= 2000 AS single FROM documents""")
def c11_totals(spark, sf):
    """Pages joined again give the text."""
    pages = ch.context_pages(F.col("text"), 2000)
    return spread(table(spark, sf, "documents")).select("doc_id", pages.alias("p"), "text").select(
        "doc_id", F.array_join("p", "\n").alias("text"),
        (F.size("p") == 1).alias("one_page"), F.length("text").alias("n")).select(
        "doc_id", "text", (F.col("one_page") & (F.col("n") <= 2000)).alias("single"))


@query("c12_chat_messages", """WITH turns AS (SELECT conv_id, turn, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
recent AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '用户' ELSE '助手' END || ': ' || text || chr(10), '' ORDER BY turn) AS history
  FROM turns WHERE back <= 10 GROUP BY conv_id),
asked AS (SELECT conv_id, text AS question FROM turns WHERE back = 1)
SELECT conv_id, 'Answer from the conversation.' || chr(10) || history AS system_text, question FROM recent JOIN asked USING (conv_id)""")
def c12(spark, sf):
    from gridlake.operators.conversations import last_messages

    recent = last_messages(table(spark, sf, "conversations"))
    grouped = recent.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("history"))
    messages = ch.chat_messages(
        F.lit("Answer from the conversation.\n"), F.col("history"),
        F.element_at("history", -1)["content"])
    return grouped.select("conv_id", messages.alias("m")).select(
        "conv_id", F.col("m")[0]["content"].alias("system_text"), F.col("m")[1]["content"].alias("question"))


@query("c13_answer_lines", """SELECT event_id, event_type || ' | ' || coalesce(CASE WHEN user_id % 3 <> 0 THEN user_id::VARCHAR END, '')
  || ' | ' || trim(regexp_replace(replace(props, ':', chr(13) || chr(10)), '[\\r\\n\\t]+', ' ', 'g')) AS line FROM events""")
def c13(spark, sf):
    rows = table(spark, sf, "events").withColumn(
        "buyer", F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    ).withColumn("note", F.replace("props", F.lit(":"), F.lit("\r\n")))
    return rows.select("event_id", ch.answer_line(["event_type", "buyer", "note"]).alias("line"))
