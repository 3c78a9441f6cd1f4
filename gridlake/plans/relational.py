"""Relational queries over typed tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlake.operators import relational as rel
from gridlake.operators import typed as ty
from gridlake.plans import fixtures as fx
from gridlake.plans.registry import query, table


@query("r01_projection", """SELECT o_orderkey AS order_id, o_totalprice * 2 AS doubled, o_orderstatus AS status
FROM orders""")
def r01(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice") * 2).alias("doubled"),
        F.col("o_orderstatus").alias("status"))


@query("r02_filter", """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
WHERE l_quantity > 45 AND (l_returnflag = 'R' OR l_discount < 0.02)""")
def r02(spark, sf):
    return table(spark, sf, "lineitem").where(
        (F.col("l_quantity") > 45) & ((F.col("l_returnflag") == "R") | (F.col("l_discount") < 0.02))
    ).select("l_orderkey", "l_partkey", "l_quantity")


@query("r03_normalized_equality", """SELECT c_custkey, c_mktsegment FROM customer
WHERE lower(trim(c_mktsegment)) = lower(trim('  building '))""")
def r03(spark, sf):
    return table(spark, sf, "customer").where(
        F.lower(F.trim("c_mktsegment")) == F.lower(F.trim(F.lit("  building ")))
    ).select("c_custkey", "c_mktsegment")


@query("r04_like_escaped", r"""SELECT event_id, props FROM events
WHERE lower(props) LIKE '%' || replace(lower('"K": 2'), '%', '\%') || '%' ESCAPE '\'""")
def r04(spark, sf):
    return table(spark, sf, "events").where(rel.contains_text(F.col("props"), '"K": 2')).select(
        "event_id", "props")


@query("r05_timestamp_filter", """SELECT event_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'""")
def r05(spark, sf):
    start = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    end = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").where(
        (F.col("ts") >= start) & (F.col("ts") < end)
    ).orderBy("ts").select("event_id", "event_type")


@query("r06_in_subquery", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""")
def r06(spark, sf):
    big = table(spark, sf, "lineitem").where("l_quantity >= 49").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(big, "o_orderkey", "left_semi").select(
        "o_orderkey", "o_totalprice")


@query("r07_not_exists", """SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def r07(spark, sf):
    buyers = table(spark, sf, "orders").where("o_totalprice > 400000").select(
        F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(buyers, "c_custkey", "left_anti").select(
        "c_custkey", "c_name")


@query("r07_not_in_with_nulls", """SELECT count(*) AS n FROM customer
WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 1000 = 999 THEN NULL ELSE o_custkey END FROM orders)""")
def r07_nulls(spark, sf):
    buyers = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 1000 != 999, F.col("o_custkey")).alias("c_custkey"))
    return rel.not_in(table(spark, sf, "customer"), buyers, "c_custkey").agg(F.count("*").alias("n"))


@query("r07_not_in", """SELECT c_custkey FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS c_custkey FROM customer)
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def r07_not_in(spark, sf):
    buyers = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("c_custkey"))
    return rel.not_in(customers, buyers, "c_custkey")


@query("r08_inner_join", """SELECT o_orderkey, o_orderpriority, l_partkey, l_quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def r08(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity")
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(items, "o_orderkey")


@query("r09_left_join", """SELECT c_custkey, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def r09_left(spark, sf):
    # Orders are reduced to one row per customer before they meet the customers.
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, sf, "customer").select("c_custkey").join(spent, "c_custkey", "left").select(
        "c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "total")


@query("r09_full_outer_join", """SELECT n_nationkey::BIGINT AS nation, customers, suppliers FROM
(SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1) c
FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s
ON c_nationkey = s_nationkey RIGHT JOIN nation ON n_nationkey = coalesce(c_nationkey, s_nationkey)""")
def r09_full(spark, sf):
    customers = table(spark, sf, "customer").where("c_acctbal > 5000").groupBy(
        F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    suppliers = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(
        F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    return customers.join(suppliers, "k", "full").join(nations, "k", "right").select(
        F.col("k").cast("bigint").alias("nation"), "customers", "suppliers")


@query("r10_series_product", """SELECT n_name, s.i::BIGINT AS step, s.i * n_nationkey AS scaled
FROM nation CROSS JOIN generate_series(1, 4) AS s(i)""")
def r10(spark, sf):
    # Repeating each row over a generated array needs no join at all.
    return table(spark, sf, "nation").select(
        "n_name", F.explode(F.sequence(F.lit(1), F.lit(4)).cast("array<bigint>")).alias("step"),
        "n_nationkey").select("n_name", "step", (F.col("step") * F.col("n_nationkey")).alias("scaled"))


@query("r11_range_join", """SELECT e.event_id AS error_id, p.event_id AS purchase_id
FROM events e JOIN events p ON p.ts BETWEEN e.ts AND e.ts + INTERVAL 10 MINUTE
WHERE e.event_type = 'error' AND p.event_type = 'purchase'""")
def r11(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = events.where("event_type = 'error'").select(
        F.col("event_id").alias("error_id"), F.col("at").alias("from_at"),
        (F.col("at") + 600_000_000).alias("to_at"))
    purchases = events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"), "at")
    return rel.range_join(purchases, errors, "at", "from_at", "to_at", 600_000_000).select(
        "error_id", "purchase_id")


@query("r12_cte_join", """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1),
big AS (SELECT o_custkey, total FROM spend WHERE total > 1000000)
SELECT c_custkey, c_mktsegment, round(total, 2) AS total FROM big JOIN customer ON c_custkey = o_custkey""")
def r12(spark, sf):
    spend = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("total"))
    big = spend.where("total > 1000000")
    return big.join(table(spark, sf, "customer"), "c_custkey").select(
        "c_custkey", "c_mktsegment", F.round("total", 2).alias("total"))


@query("r13_derived_table", """SELECT o_orderpriority, count(*) AS n FROM
(SELECT o_orderpriority, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') WHERE o_totalprice > 200000)
GROUP BY o_orderpriority""")
def r13(spark, sf):
    inner = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return inner.where("o_totalprice > 200000").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("r14_union_distinct", """SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def r14(spark, sf):
    orders = table(spark, sf, "orders")
    a = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return a.union(b).distinct()


@query("r15_union_all", """SELECT c_nationkey::BIGINT AS k, c_acctbal AS bal FROM customer
UNION ALL SELECT s_nationkey::BIGINT, s_acctbal FROM supplier""")
def r15(spark, sf):
    a = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("k"), F.col("c_acctbal").alias("bal"))
    b = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("k"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(b)


@query("r16_intersect", """SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def r16_intersect(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return orders.where("o_orderstatus = 'F'").select("k").intersect(
        orders.where("o_orderstatus = 'P'").select("k"))


@query("r16_except", """SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000""")
def r16_except(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(
        table(spark, sf, "orders").where("o_totalprice > 400000").select(
            F.col("o_custkey").alias("k")))


@query("r17_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber::BIGINT AS line FROM lineitem")
def r17(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("bigint").alias("line")).distinct()


@query("r18_global_aggregates", """SELECT count(*) AS n, count(nullif(l_returnflag, 'N')) AS returned,
round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS mean_price,
min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem""")
def r18(spark, sf):
    return table(spark, sf, "lineitem").agg(
        F.count("*").alias("n"), F.count(F.nullif("l_returnflag", F.lit("N"))).alias("returned"),
        F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean_price"),
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("r19_count_distinct", """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts,
count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag""")
def r19(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("r19_approx_distinct", """SELECT l_returnflag, TRUE AS parts_close, TRUE AS orders_close FROM lineitem GROUP BY l_returnflag""")
def r19_approx(spark, sf):
    """Sketched counts of distinct values lie within a tenth of the exact ones.

    Exact and sketched counts are aggregates of their own: in one, each distinct value would
    carry the buffers of the sketches.
    """
    items, flag = table(spark, sf, "lineitem"), "l_returnflag"
    counts = items.groupBy(flag).agg(*[
        F.approx_count_distinct(name, 0.02).alias(name) for name in ("l_partkey", "l_orderkey")])
    for name in ("l_partkey", "l_orderkey"):
        exact = items.select(F.col(flag).alias("of"), F.col(name).alias("value")).distinct().groupBy("of").agg(
            F.count("value").alias(f"{name}_exact"))
        counts = counts.join(exact, F.col(flag).eqNullSafe(F.col("of"))).drop("of")

    def close(name):
        return F.abs(F.col(name) - F.col(f"{name}_exact")) <= F.col(f"{name}_exact") * 0.1

    return counts.select(flag, close("l_partkey").alias("parts_close"), close("l_orderkey").alias("orders_close"))


@query("r20_group_by", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc,
count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def r20(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("r20_sheet_orders_by_priority", f"""{fx.UP_TO_PHYS}
SELECT {fx.sql_trim('upper(cells[7])')} AS priority, count(*) AS n_orders,
  round(sum(try_cast(replace(cells[4], ',', '') AS DOUBLE)), 2) AS amount
FROM kept WHERE cells[7] IS NOT NULL GROUP BY 1 ORDER BY n_orders DESC, priority LIMIT 5""")
def r20_sheets(spark, sf):
    """From cells to an answer: infer, type, group, sort, limit."""
    frames = ty.typed_frames(ty.infer(fx.stored_grid(spark, sf)))
    orders = rel.union_compatible(frames, next(iter(frames)), ["Priority", "Order Amount"])
    return (
        orders.where(F.col("Priority").isNotNull())
        .groupBy(F.upper(F.trim("Priority")).alias("priority"))
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("Order Amount"), 2).alias("amount"))
        .orderBy(F.desc("n_orders"), "priority").limit(5))


@query("r21_having", """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
GROUP BY o_custkey HAVING count(*) >= 12""")
def r21(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n >= 12")


@query("r22_rollup", """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def r22_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("r22_cube", """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
GROUP BY CUBE (l_returnflag, l_linestatus)""")
def r22_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("r22_grouping_sets", """SELECT c_mktsegment, c_nationkey::BIGINT AS nation, count(*) AS n FROM customer
GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""")
def r22_sets(spark, sf):
    customers = table(spark, sf, "customer")
    seg, nat = F.col("c_mktsegment"), F.col("c_nationkey")
    return customers.groupingSets([[seg], [nat], []], seg, nat).agg(F.count("*").alias("n")).select(
        "c_mktsegment", F.col("c_nationkey").cast("bigint").alias("nation"), "n")


@query("r23_window_frames", """SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_quantity,
row_number() OVER w AS rn, round(sum(l_quantity) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent_qty
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice)""")
def r23(spark, sf):
    # Partitions are single orders: a key that cannot collect a large share of the rows.
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        F.row_number().over(w).cast("bigint").alias("rn"),
        F.round(F.sum("l_quantity").over(w.rowsBetween(-2, 0)), 2).alias("recent_qty"))


@query("r24_order_by_nulls_last", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 3 THEN o_totalprice END AS amount
FROM orders ORDER BY amount DESC NULLS LAST, o_orderkey""")
def r24(spark, sf):
    amount = F.when(F.col("o_orderkey") % 7 != 3, F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", amount.alias("amount")).orderBy(
        F.desc_nulls_last("amount"), "o_orderkey")


@query("r25_top_n", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def r25(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("r26_group_topn", """SELECT p_partkey, p_name, qty FROM (SELECT l_partkey, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY l_partkey ORDER BY qty DESC, l_partkey LIMIT 10) JOIN part ON p_partkey = l_partkey""")
def r26(spark, sf):
    best = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.round(F.sum("l_quantity"), 2).alias("qty")).orderBy(F.desc("qty"), "p_partkey").limit(10)
    return F.broadcast(best).join(table(spark, sf, "part"), "p_partkey").select(
        "p_partkey", "p_name", "qty")


@query("r27_result_cap", """SELECT count(*) AS returned, (SELECT count(*) > 2000 FROM lineitem) AS truncated
FROM (SELECT * FROM lineitem LIMIT 2000)""")
def r27(spark, sf):
    rows, truncated = rel.capped(table(spark, sf, "lineitem").select("l_orderkey"))
    return rows.agg(F.count("*").alias("returned")).withColumn("truncated", F.lit(truncated))


@query("r28_split_unnest", """SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def r28_split(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query("r28_regexp_split", """SELECT word, count(*) AS n FROM
(SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents)
WHERE word <> '' GROUP BY word""")
def r28_regexp(spark, sf):
    words = table(spark, sf, "documents").select(
        F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("r28_series_unnest", """SELECT l_linenumber::BIGINT AS line, i::BIGINT AS i, count(*) AS n
FROM (SELECT l_linenumber, unnest(generate_series(1, l_linenumber)) AS i FROM lineitem) GROUP BY ALL""")
def r28_series(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.explode(F.sequence(F.lit(1), F.col("l_linenumber")).cast("array<bigint>")).alias("i")
    ).groupBy("line", "i").agg(F.count("*").alias("n"))


@query("r28_flatten_repeat", """SELECT n_name, array_to_string(flatten([[n_name], string_split(r_name, 'I')]), '+') AS parts,
repeat(r_name, 2) AS twice FROM nation JOIN region ON n_regionkey = r_regionkey""")
def r28_flatten(spark, sf):
    joined = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        "n_name",
        F.array_join(F.flatten(F.array(F.array("n_name"), F.split("r_name", "I"))), "+").alias("parts"),
        F.repeat("r_name", 2).alias("twice"))


@query("r29_compatible_union", """SELECT o_orderstatus AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1""")
def r29(spark, sf):
    """Three tables; the third stores the amount as text, so it does not take part."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("part"))
    tables = {
        "t_f": orders.where("part = 'F'"),
        "t_p": orders.where("part = 'P'").withColumn("extra", F.lit(1)),
        "t_o": orders.where("part = 'O'").withColumn("o_totalprice", F.col("o_totalprice").cast("string")),
    }
    united = rel.union_compatible(tables, "t_f", ["part", "o_totalprice"])
    return united.groupBy("part").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("r29_compatible_sheets", f"""{fx.UP_TO_PHYS},
alike AS (SELECT doc, max(physical_type) FILTER (technical_name = 'Created Time') AS t FROM phys GROUP BY doc)
SELECT document_id, count(*) AS n_rows, round(sum(try_cast(replace(cells[4], ',', '') AS DOUBLE)), 2) AS amount
FROM kept JOIN alike USING (doc) WHERE t = (SELECT t FROM alike WHERE doc = 1) GROUP BY document_id""")
def r29_sheets(spark, sf):
    """Rows of all sheets that have the amounts and times of one sheet in its types."""
    from gridlake.operators import typed as ty

    model = ty.infer(fx.stored_grid(spark, sf))
    chosen = ty.compatible_sheets(model, "doc_1", 0, ["Created Time", "Order Amount"])
    rows = ty.variant_rows(model).join(chosen.withColumnRenamed("document_id", "__document_id"), "__document_id", "left_semi")
    return rows.groupBy(F.col("__document_id").alias("document_id")).agg(
        F.count("*").alias("n_rows"), F.round(F.sum(ty.value_of("Order Amount", "double")), 2).alias("amount"))


@query("r30_tenant_scope", f"""WITH {fx.GRID_CTE}
SELECT document_id, count(*) AS n_rows FROM grid WHERE user_id = '1' GROUP BY document_id""")
def r30(spark, sf):
    return rel.tenant_scope(fx.orders_grid(spark, sf), "1").groupBy("document_id").agg(
        F.count("*").alias("n_rows"))


@query("r31_sources", f"""{fx.UP_TO_KEPT}
SELECT DISTINCT document_id, filename, 'Orders' AS sheet_name, row_index, 'A' || row_index || ':H' || row_index AS range
FROM kept WHERE cells[3] = 'F' ORDER BY filename, sheet_name, row_index, range LIMIT 50""")
def r31(spark, sf):
    frames = ty.typed_frames(ty.infer(fx.stored_grid(spark, sf)))
    wanted = ["Status", "__document_id", "__filename", "__sheet_name", "__row_index", "__range"]
    rows = rel.union_compatible(frames, next(iter(frames)), wanted)
    return rel.sources_of(rows.where(F.col("Status") == "F"))


@query("r32_queryable_documents", """SELECT (doc % 4)::VARCHAR AS user_id, 'doc_' || doc AS document_id,
'Orders_' || doc || '.' || type AS filename, lower(type) AS type
FROM (SELECT DISTINCT o_orderkey // 500 AS doc,
      ['csv', 'XLSX', 'pdf', 'tsv', 'txt'][o_orderkey // 500 % 5 + 1] AS type FROM orders)
WHERE lower(type) IN ('xlsx', 'xls', 'csv', 'tsv')""")
def r32(spark, sf):
    doc = F.floor(F.col("o_orderkey") / 500)
    kinds = F.array(*[F.lit(k) for k in ("csv", "XLSX", "pdf", "tsv", "txt")])
    documents = table(spark, sf, "orders").select(doc.alias("doc")).distinct().select(
        (F.col("doc") % 4).cast("string").alias("user_id"),
        F.concat(F.lit("doc_"), F.col("doc").cast("string")).alias("document_id"),
        F.get(kinds, (F.col("doc") % 5).cast("int")).alias("file_type"), "doc"
    ).withColumn("filename", F.concat(
        F.lit("Orders_"), F.col("doc").cast("string"), F.lit("."), "file_type"))
    return rel.queryable_documents(documents)
