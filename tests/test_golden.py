"""Small tables with known results."""

import pytest
from pyspark.sql import functions as F

from gridlake.operators import chunks as ch
from gridlake.operators import questions as qs
from gridlake.operators import relational as rel
from gridlake.operators import resolve as rs
from gridlake.operators import typed as ty
from gridlake.operators.grid import header_rows

GRID = ("user_id string, document_id string, filename string, file_type string, sheet_idx int, "
        "sheet_name string, row_index bigint, cells array<string>")


def grid_of(spark, rows, document="d1", user="7", sheet="Sheet1", idx=0):
    return spark.createDataFrame(
        [(user, document, f"{document}.csv", "csv", idx, sheet, i, r) for i, r in enumerate(rows, 1)], GRID)


def test_two_header_rows(spark):
    rows = [
        ["Order ID", "Qty", "Fee", "Note"], ["Platform unique id", "Number sold", "Shipping fee", "Free text"],
        ["577063219842100001", "1", "1.5", "a"], ["577063219842100002", "2", "2.5", "b"],
        ["577063219842100003", "3", "3.5", "c"]]
    model = ty.infer(grid_of(spark, rows))
    table = model.tables.first()
    assert (table["n_header_rows"], table["row_count"], table["table_range"]) == (2, 3, "A1:D5")
    kinds = {r["technical_name"]: (r["data_type"], r["physical_type"]) for r in model.columns.collect()}
    assert kinds == {
        "Order ID": ("numeric", "VARCHAR"), "Qty": ("numeric", "DOUBLE"), "Fee": ("numeric", "DOUBLE"),
        "Note": ("text", "VARCHAR")}


@pytest.mark.parametrize("rows, expected", [
    ([["50", "x"], ["1", "2"]], 1),                      # a number in the title row is no data
    ([["a"], ["b"], ["c"], ["d"], ["e"], ["f"]], 4),     # capped
    ([["a", "b"], [None, None], ["x", "y"]], 1),         # a blank row ends the head
    ([[None, ""], ["a", "b"]], 1),                       # at least one
    ([["a", "b"], ["c", "12345678901"]], 1),             # a long id is data
    ([["a", "b"], ["note", "12"], ["1", "2"]], 2),       # one number is still a head
    ([["only"]], 1),
])
def test_header_depth(spark, rows, expected):
    assert header_rows(grid_of(spark, rows)).first()["n_header_rows"] == expected


def test_sum_of_fees(spark):
    rows = [["SKU ID", "Original Shipping Fee"]] + [
        [f"100{i}", v] for i, v in enumerate(["10", "20", "30", "40", "51.41"])]
    frame, = ty.typed_frames(ty.infer(grid_of(spark, rows))).values()
    assert frame.agg(F.sum("Original Shipping Fee")).first()[0] == pytest.approx(151.41)


def test_percent_and_late_bad_values(spark):
    rows = [["k", "share", "n", "id code"]] + [[f"r{i}", f"{i}%", str(i), f"0{i}"] for i in range(1, 61)]
    model = ty.infer(grid_of(spark, rows))
    cells = ty.typed_cells(model).where("technical_name = 'share'")
    assert cells.where("number IS NOT NULL").count() == 0
    scaled = ty.typed_cells(model, percent="scale").where("technical_name = 'share' AND row_index = 13")
    assert scaled.first()["number"] == pytest.approx(0.12)
    assert ty.conversion_failures(model).count() == 60


def test_dates_filter(spark):
    rows = [["name", "n", "m", "dt"]] + [["x", "1", "2", d] for d in ("2026-01-01", "2026-03-15", "2026-06-20")]
    frame, = ty.typed_frames(ty.infer(grid_of(spark, rows))).values()
    assert frame.schema["dt"].dataType.simpleString() == "timestamp_ntz"
    assert frame.where(F.col("dt") >= F.lit("2026-02-01").cast("timestamp_ntz")).count() == 2


def test_views_join_and_union(spark):
    skus = grid_of(spark, [["sku", "qty", "n"], ["A", "10", "1"], ["B", "20", "2"]], "book-1", sheet="List", idx=0)
    prices = grid_of(spark, [["sku", "price", "n"], ["A", "5", "1"], ["B", "8", "2"]], "book-1", sheet="Shipping", idx=1)
    foreign = grid_of(spark, [["sku", "qty"], ["Z", "1"]], "book-2", user="8")
    model = ty.infer(skus.unionByName(prices).unionByName(foreign))
    views = ty.publish_views(spark, model, "7")
    assert sorted(views) == ["t_book_1_0", "t_book_1_1"]
    joined = spark.sql("SELECT a.sku, qty, price FROM t_book_1_0 a JOIN t_book_1_1 b ON a.sku = b.sku ORDER BY 1")
    assert [tuple(r) for r in joined.collect()] == [("A", 10.0, 5.0), ("B", 20.0, 8.0)]


def test_duplicate_headers_get_suffix(spark):
    rows = [["x", "X", "y"], ["1", "2", "3"], ["4", "5", "6"]]
    frame, = ty.typed_frames(ty.infer(grid_of(spark, rows))).values()
    assert frame.columns[:3] == ["x", "X_2", "y"]


def test_chunks_of_nineteen_rows(spark):
    rows = [["id no", "v"]] + [[f"{i}", f"{i}.5"] for i in range(1, 20)]
    model = ty.infer(grid_of(spark, rows))
    chunks = ch.table_chunks(model.grid, model.tables, model.columns).orderBy("chunk_index").collect()
    assert [c["chunk_type"] for c in chunks] == ["workbook_summary", "sheet_schema"] + ["row_group"] * 3
    assert [(c["row_start"], c["row_end"]) for c in chunks[2:]] == [(2, 9), (10, 17), (18, 20)]
    assert [c["id"] for c in chunks] == [f"d1_{i}" for i in range(5)]


@pytest.mark.parametrize("n, rows, truncated", [(1999, 1999, False), (2000, 2000, False), (2001, 2000, True)])
def test_result_cap(spark, n, rows, truncated):
    kept, more = rel.capped(spark.range(n))
    assert (kept.count(), more) == (rows, truncated)


def test_no_widening_without_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2, "y")], "n int, s string")
    assert rel.union_compatible({"a": a, "b": b}, "a", []).count() == 1
    assert rel.union_compatible({"a": a, "b": b}, "a", ["n"]).count() == 2


def dictionary_of(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "provider string")
    return rs.enum_dictionary(df, "t", ["provider"])


@pytest.mark.parametrize("values, literal, verdict, resolved", [
    (["SF International"], "SF", "RESOLVED", "SF International"),
    (["SF International"], " sf  international", "RESOLVED", "SF International"),
    (["SF International", "SF Express", "SF Local"], "SF", "AMBIGUOUS", None),
    (["SF International"], "UPS", "UNCHANGED", "UPS"),
    (["SF International"], "International", "RESOLVED", "SF International"),
    (["SF International"], "SF Inter", "UNCHANGED", "SF Inter"),
    ([f"v {i}" for i in range(31)], "v", "UNCHANGED", "v"),
])
def test_resolution(spark, values, literal, verdict, resolved):
    asked = spark.createDataFrame([(literal,)], "literal string")
    row = rs.resolve_literals(asked, dictionary_of(spark, values), "literal").first()
    assert (row["verdict"], row["resolved"]) == (verdict, resolved)


ROUTES = [
    ("这个表有多少列？", "SCHEMA", "HIGH"), ("这个表有多少条记录？", "PRECISE_QUERY", "MEDIUM"),
    ("这个表有多少个订单？", "PRECISE_QUERY", "MEDIUM"), ("这个表有多少个 SKU？", "PRECISE_QUERY", "MEDIUM"),
    ("这个表里的所有 SKU 是什么？", "STRUCTURED_ACCESS", "HIGH"),
    ("前50条 SKU 是什么？", "STRUCTURED_ACCESS", "HIGH"),
    ("Seller SKU 是什么意思？", "SEMANTIC_RETRIEVAL", "HIGH"),
    ("金眼这个产品相关的数据在哪里？", "SEMANTIC_RETRIEVAL", "MEDIUM"),
    ("金眼一共卖了多少单？", "PRECISE_QUERY", "HIGH"), ("哪个 SKU 卖得最多？", "PRECISE_QUERY", "HIGH"),
    ("销量最高10个 SKU 的商品名称是什么？", "PRECISE_QUERY", "HIGH"),
    ("订单有多少？", "PRECISE_QUERY", "MEDIUM"), ("数量是多少？", "AMBIGUOUS", "LOW"),
    ("按 Quantity 从高到低排列前 10 条订单。", "PRECISE_QUERY", "HIGH"),
    ("按运费降序排列。", "PRECISE_QUERY", "HIGH"), ("把这个表里的全部 SKU 提取出来。", "STRUCTURED_ACCESS", "HIGH"),
    ("列出这个表所有 SKU。", "STRUCTURED_ACCESS", "HIGH"),
    ("把所有 Shipping Provider Name 列出来。", "STRUCTURED_ACCESS", "HIGH"),
    ("Original Shipping Fee 总和是多少？", "PRECISE_QUERY", "HIGH"),
    ("物流商为 SF 的有几单？", "PRECISE_QUERY", "HIGH"),
    ("列出所有 SKU 并按原顺序展示。", "STRUCTURED_ACCESS", "HIGH"), ("", "AMBIGUOUS", "LOW"),
    ("所有文件的销量加起来", "UNSUPPORTED", "MEDIUM"), ("这是几个意思", "AMBIGUOUS", "LOW"),
]


def test_routes(spark):
    asked = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(ROUTES)], "i int, q string")
    found = {r["i"]: (r["route"], r["confidence"]) for r in qs.route(asked, "q").collect()}
    assert found == {i: (r, c) for i, (_, r, c) in enumerate(ROUTES)}


def test_intents(spark):
    asked = [
        ("第 3 到 9 条", ("range", None, 3, 9, None)), ("前 12 个", ("first_n", None, None, None, 12)),
        ("最后5行", ("last_n", None, None, None, 5)), ("查 'AB-12'", ("lookup", "AB-12", None, None, None)),
        ("订单号 9876 在哪里", ("lookup", "9876", None, None, None)),
        ("完整的一二三四五表", (None, None, None, None, None)), ("随便问问", (None, None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], "i int, q string")
    got = {r["i"]: tuple(r)[2:] for r in qs.access_intent(df, "q").collect()}
    assert got == {i: want for i, (_, want) in enumerate(asked)}


def test_fingerprint_follows_content_only(spark):
    rows = [["a", "b"], ["1", "2"], ["3", None]]
    base = grid_of(spark, rows)

    def mark(g):
        return ty.fingerprints(g).first()["fingerprint"]

    assert mark(base) == mark(base.withColumn("filename", F.lit("other.csv")).repartition(3))
    for changed in ([["a", "b"], ["1", "2"], ["3", ""]], [["a", "b"], ["3", None], ["1", "2"]],
                    [["a", "b"], ["12", None], ["3", None]]):
        assert mark(base) != mark(grid_of(spark, changed))
