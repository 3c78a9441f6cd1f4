"""What a step moves or starts must not grow faster than its input."""

import glob
import os

from gridlake.sources import delimited


def test_small_blocks_share_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for d in range(3):
        (tmp_path / "in" / f"{d}.csv").write_text("".join(f'{i},"a ""{i}"",\n{d}"\n' for i in range(300)))
    folders, before = {}, spark.conf.get("spark.sql.files.maxPartitionBytes")

    def folder(spark, purpose):
        folders[purpose] = str(tmp_path / purpose)
        return folders[purpose]

    monkeypatch.setattr(delimited, "shared_dir", folder)
    rows = delimited.read_delimited(spark, str(tmp_path / "in"), block_bytes=61)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert len(glob.glob(folders["csv-cut"] + "/*.parquet")) <= spark.sparkContext.defaultParallelism
    got = {(r["path"][-5:], r["row_index"]): r["cells"] for r in rows.collect()}
    assert got == {(f"{d}.csv", i + 1): [str(i), f'a "{i}",\n{d}'] for d in range(3) for i in range(300)}


def test_keys_of_a_slot_are_judged_together(spark, tmp_path):
    """Many keys in few states, the failures those of the batch form."""
    import datetime as dt

    from pyspark.sql import functions as F

    from gridlake.operators.limiter import failure_counts
    from gridlake.streaming import limiter
    from gridlake.streaming.jobs import run_to_table

    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"k{i * 31 % 400}" if i % 50 else None, start + dt.timedelta(seconds=i * 7919 % 90000), "fsn"[i * 13 % 7 % 3]) for i in range(3000)]
    rows.append((9999, "end", start + dt.timedelta(days=9), "n"))
    events = spark.createDataFrame(rows, "event_id long, key string, at timestamp, kind string")
    failure, success = F.col("kind") == "f", F.col("kind") == "s"
    kinds = dict(window_seconds=20000, slot_seconds=30000)
    root = str(tmp_path)
    for part in range(3):
        events.where((F.col("event_id") % 3 == part) & (F.col("event_id") != 9999)).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        run_to_table(limiter.limit_failures(stream, "key", "at", "event_id", failure, success, delay="3 days", **kinds), root)
    events.where("event_id = 9999").write.mode("append").parquet(f"{root}/in")
    got = run_to_table(limiter.limit_failures(stream, "key", "at", "event_id", failure, success, delay="3 days", **kinds), root)
    want = failure_counts(events.where("event_id <> 9999"), "key", "at", failure, success, tie="event_id", **kinds)
    columns = ["event_id", "key", "failures", "blocked"]
    assert sorted(got.select(*columns).collect(), key=lambda r: r[0]) == sorted(want.select(*columns).collect(), key=lambda r: r[0])
    state = spark.read.format("statestore").load(f"{root}/state")
    assert state.count() <= 2 * limiter.KEY_GROUPS


def test_timers_follow_buckets_not_keys():
    import numpy as np
    import pandas as pd

    from gridlake.streaming.limiter import sliding_failures
    from gridlake.streaming.timed_limiter import Limiter
    from tests.test_timed_limiter import SECOND, Clock, Handle

    rng = np.random.default_rng(3)
    n, window = 4000, 300
    rows = pd.DataFrame({"k": rng.choice([f"u{i}" for i in range(60)], n), "micros": np.sort(rng.choice(6000, n, replace=False)) * SECOND,
                         "event_id": range(n), "is_failure": rng.random(n) < 0.5, "is_success": rng.random(n) < 0.05, "is_own": True})
    limiter, handle = Limiter("k", window, 5, 6000, 100), Handle()
    limiter.init(handle)
    for part in (rows[::2], rows[1::2]):
        list(limiter.handleInputRows((0, 0), iter([part]), Clock(0)))
    assert len(handle.timers) <= 61
    got = pd.concat([f for at in sorted(handle.timers) for f in limiter.handleExpiredTimer((0, 0), Clock(at), None)])
    assert len(got) == n
    for key, some in rows.groupby("k"):
        want, _ = sliding_failures(np.zeros(0, np.int64), some["micros"].to_numpy(), some["is_failure"].to_numpy(),
                                   some["is_success"].to_numpy(), window * SECOND)
        mine = got[got["k"] == key].set_index("event_id")["failures"]
        assert mine.loc[some["event_id"]].tolist() == want.tolist()


def test_small_documents_share_files(spark, tmp_path):
    """As many files as tasks, not as documents; rows with breaks and quotes as before."""
    from pyspark.sql import functions as F

    from gridlake.plans import file_fixtures as ff

    grid = spark.range(900).select(
        F.concat(F.lit("d"), (F.col("id") % 300).cast("string")).alias("document_id"), F.col("id").alias("row_index"),
        F.array(F.col("id").cast("string"), F.when(F.col("id") % 7 > 0, F.lit('"a",\n\tb'))).alias("cells"))
    root = str(tmp_path / "in")
    ff.write_csv_bundles(grid, 2, root, "\t")
    assert len(glob.glob(root + "/*.csv")) <= 8
    rows = ff.unbundled(delimited.read_delimited(spark, root, "\t", block_bytes=997)).collect()
    assert {(r["document_id"], r["row_index"]): r["cells"] for r in rows} == {
        (f"d{i % 300}", i // 300 + 1): [str(i), '"a",\n\tb' if i % 7 else None] for i in range(900)}
    assert len(rows) == 900


def test_views_read_their_own_folder(spark, monkeypatch):
    """A view of one sheet must not scan the rows of all sheets; mixed layouts and types stay."""
    from gridlake.operators import typed as ty
    from tests.test_golden import grid_of

    monkeypatch.setattr(ty, "SHEETS_PER_PART", 2)
    grid = None
    for i in range(12):
        head = [["sku", "qty", "day", "n"], ["qty", "sku", "x y", "n"]][i % 2]
        rows = [[f"A{r}", f"{i},{r:03}", f"2026-01-0{r + 1}", "1"] if i % 2 == 0 else [f"{i}.{r}", f"B{r}", "t", "1"] for r in range(3)]
        one = grid_of(spark, [head, *rows], f"v{i}")
        grid = one if grid is None else grid.unionByName(one)
    views = ty.publish_views(spark, ty.infer(grid), "7")
    assert sorted(views) == sorted(f"t_v{i}_0" for i in range(12))
    for i in (4, 7):
        got = spark.sql(f"SELECT * FROM t_v{i}_0")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(part" in plan and "Join" not in plan
        assert got.selectExpr("sku", "qty").orderBy("qty").collect() == [
            (f"A{r}", float(i * 1000 + r)) if i % 2 == 0 else (f"B{r}", float(f"{i}.{r}")) for r in range(3)]
        assert got.schema[2].dataType.simpleString() == ("timestamp_ntz" if i % 2 == 0 else "string")


def test_requests_share_the_hits_of_their_value(spark, monkeypatch):
    """The same choice from hits by value as from hits by request; pairs are made last."""
    from pyspark.sql import functions as F

    from gridlake.operators import access as ac
    from gridlake.operators.access import SHEET_KEYS

    rows = spark.range(240).select(
        F.concat(F.lit("d"), (F.col("id") % 6).cast("string")).alias("document_id"), F.lit(0).alias("sheet_idx"),
        F.col("id").alias("row_index"),
        F.array(F.when(F.col("id") % 3 > 0, F.lit("F")), F.lit(" f "), (F.col("id") % 11).cast("string")).alias("cells"))
    asked = spark.range(40).select(F.col("id").alias("request_id"), F.when(F.col("id") % 2 == 0, " f").otherwise(
        F.col("id").cast("string")).alias("value"))
    documents = rows.select("document_id").distinct().withColumn("filename", F.concat(F.lit("z"), F.lit("d5") < F.col("document_id"), "document_id"))
    candidates = spark.createDataFrame([(r, f"d{d}", float(r * 7 % 5 + d)) for r in range(0, 30) for d in (r % 6, 3, 8)] + [(2, "d1", None)],
                                       "request_id long, document_id string, score double")
    few = ac.lookup_anywhere(rows, asked).select("request_id", *SHEET_KEYS, "row_index")
    want = sorted(tuple(r) for r in ac.first_document_with_hit(few, candidates, documents).select(
        "request_id", "document_id", "tier", "n_matches").collect())
    pairs = sorted(tuple(r) for r in few.collect())
    monkeypatch.setattr(ac, "FEW_REQUESTS", 3)
    many = ac.lookup_anywhere(rows, asked)
    assert sorted(tuple(r) for r in many.select("request_id", *SHEET_KEYS, "row_index").collect()) == pairs
    assert not any(c.startswith("__") for c in many.columns)
    plan = many._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "Aggregate [request_id" not in "\n".join(plan[:8])
    values = asked.select("request_id", ac.compact(F.col("value")).alias("value"))
    hits = ac.lookup_anywhere(rows, values.select(F.col("value").alias("request_id"), "value").distinct())
    assert hits.count() < len(pairs) / 5
    got = ac.first_document_with_hit(hits, candidates, documents, values)
    assert sorted(tuple(r) for r in got.select("request_id", "document_id", "tier", "n_matches").collect()) == want


def test_distinct_values_carry_no_sketches(spark, tmp_path):
    """Also for a flag or keys that are null."""
    from gridlake.plans import relational

    spark.createDataFrame([(f, None if f == "N" else i % 50, i) for i in range(300) for f in ("A", "N", None)],
                          "l_returnflag string, l_partkey long, l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = relational.r19_approx(spark, str(tmp_path))
    assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, df.collect()), key=str) == [("A", True, True), ("N", True, True), (None, True, True)]


def test_texts_are_decoded_in_slices():
    import pyarrow as pa

    from gridlake.sources import plaintext

    contents = ["编号".encode("gbk") * 9, b"\xff\xfe", "é".encode("latin1")] * 100
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(300)]), pa.array(contents, pa.binary())], ["path", "content"])
    got = list(plaintext._decode_rest(iter([batch])))
    assert [b.num_rows for b in got] == [plaintext.SLICE_ROWS] * 3
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["content"] for r in rows] == contents and rows[0]["text"] == "编号" * 9
    assert [r["encoding"] for r in rows[:3]] == ["gbk", "latin1", "latin1"]


def test_texts_are_cut_in_slices():
    """As many chunks as before, passed on for a slice of a batch."""
    import pyarrow as pa

    from gridlake.functions.splitters import recursive_chunks
    from gridlake.operators import chunks as ch

    texts = ["one two " * 300, "", None, "short"] * 60
    batch = pa.RecordBatch.from_arrays([pa.array(range(240)), pa.array(texts)], ["k", "t"])
    fields = pa.schema([("k", pa.int64()), ("chunk_index", pa.int64()), ("content", pa.string())])

    def cut(names, some):
        assert len(names) <= ch.SLICE_ROWS
        return [(k, i, c) for k, t in zip(names, some) if t for i, c in enumerate(recursive_chunks(t, 1000, 200, [" ", ""]))]

    got = list(ch._cut_slices(iter([batch]), cut, fields))
    assert len(got) == 3
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [
        (k, i, c) for k, t in enumerate(texts) if t for i, c in enumerate(recursive_chunks(t, 1000, 200, [" ", ""]))]


def test_sentences_are_cut_in_slices(spark, monkeypatch):
    """The same spans whatever the slice."""
    from gridlake.functions.splitters import sentence_chunks
    from gridlake.operators import chunks as ch

    texts = ["An end. " * 200 + "x" * 1500, "", None, "short"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    want = [(k, i, a, b, c) for k, t in enumerate(texts) for i, (a, b, c) in enumerate(sentence_chunks(t or "", 1000, 200))]
    for rows in (1, 7, 100):
        monkeypatch.setattr(ch, "SLICE_ROWS", rows)
        got = ch.split_sentences(docs, "k", "t").select("k", "chunk_index", "start_pos", "end_pos", "content").collect()
        assert sorted(map(tuple, got)) == want


def test_frames_are_dealt_out_once(spark):
    """Lists of frames are not built before they move; order and ties as before, null frames count."""
    from gridlake.streaming.frames import fold_frames

    rows = [(r, s, f"<{s * 37 % 11}>" if s % 5 else None) for r in range(3) for s in range(-25, 60)] + [(1, 7, "b"), (1, 7, "a")]
    frames = spark.createDataFrame(rows[::-1], "r long, s long, c string")
    df = fold_frames(frames, "r", "s", "c", block=10)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    want = {}
    for r, s, c in sorted(rows, key=lambda x: (x[0], x[1], x[2] or "")):
        n, text = want.get(r, (0, ""))
        want[r] = n + 1, text + (c or "")
    assert {x["r"]: (x["n_frames"], x["answer"]) for x in df.collect()} == want


def test_small_files_share_batches(spark, tmp_path):
    """A micro-batch is bounded by bytes, not by its number of files; listing keeps to few tasks."""
    from gridlake.streaming import jobs

    (tmp_path / "in").mkdir()
    for i in range(12):
        (tmp_path / "in" / f"{i}.csv").write_text("x" * 100)
    name, seen = jobs._LISTING, {}
    before = spark.conf.get(name)
    with jobs.few_listing_tasks(spark):
        assert int(spark.conf.get(name)) <= 4 * spark.sparkContext.defaultParallelism
        for bound in (500, 1 << 20):
            found = seen.setdefault(bound, [])
            jobs.run_each_batch(jobs.new_files(spark, str(tmp_path / "in"), "*.csv", batch_bytes=bound),
                                str(tmp_path / f"p{bound}"), lambda df, n: found.append(df.count()))
    assert spark.conf.get(name) == before
    assert sum(seen[500]) == 12 and max(seen[500]) == 5 and seen[1 << 20] == [12]


def test_refusals_pass_the_contents_once(spark):
    """Files above the limit are told in the same pass; no rows of whole sheets are made."""
    from gridlake.plans import file_fixtures as ff
    from gridlake.sources import workbook as wb

    good = ff.xlsx_bytes({"A": [["x", "1"]] * 40})
    files = spark.createDataFrame([("good", good), ("short", ff._short_sheet(good)), ("none", None), ("text", b"x"), ("empty", b""),
                                   ("large", good + b"0" * 9000)], "path string, content binary")
    df = wb.refused_workbooks(files, max_bytes=len(good))
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, df.select("path", "sheet_name", "reason").collect())) == [
        ("empty", None, "not a workbook: BadZipFile"), ("large", None, wb.TOO_LARGE),
        ("short", "A", "broken sheet: ExpatError"), ("text", None, "not a workbook: BadZipFile")]


def test_sorted_cells_lie_in_even_tasks(spark):
    """A large grid is dealt out by a bounded number of rows, a small one stays."""
    from gridlake.operators import typed as ty
    from tests.test_golden import grid_of

    grid = grid_of(spark, [["sku", "qty"], *[[f"A{r}", str(r)] for r in range(300)]], "even").coalesce(1)
    model = ty.infer(grid)
    assert ty.in_even_tasks(model) is model
    even = ty.in_even_tasks(model, rows_per_task=20)
    assert even.grid.rdd.getNumPartitions() == 16
    assert max(even.grid.rdd.glom().map(len).collect()) < 60
    key = ["document_id", "row_index", "col_index", "number", "text"]
    assert sorted(map(str, ty.typed_cells(even).select(*key).collect())) == sorted(map(str, ty.typed_cells(model).select(*key).collect()))


def test_query_blocks_meet_vectors_in_turn(spark, monkeypatch):
    """More queries than one broadcast holds need no index and no shuffle of the vectors."""
    import numpy as np

    from gridlake.operators import vectors as vc

    rng = np.random.default_rng(8)
    rows = [[float(x) for x in v] for v in rng.normal(size=(700, 5))]
    rows += rows[:40] + [[float("nan")] * 5, [1e200] * 5, [3e19, 0.0, 0.0, 0.0, 0.0], None]
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, rows[i]) for i in range(0, 700, 9)], "query_id long, query_vec array<double>")
    size = 8 * queries.count() * 7
    monkeypatch.setattr(vc, "build_index", None)
    want = sorted(map(tuple, vc.nearest_for_each(table, queries, 4).collect()))
    got = sorted(map(tuple, vc.nearest_for_each(table, queries, 4, max_broadcast_bytes=size // 5).collect()))
    assert got == want
    good = np.array(rows[:740])
    for q in range(0, 700, 9):
        apart = np.round(((good - good[q]) ** 2).sum(1), 6)
        best = np.lexsort((np.arange(740), apart))[:4]
        assert [(v, s) for i, v, s, _ in sorted(want, key=lambda r: r[3]) if i == q] == [(v, apart[v]) for v in best]


def test_products_pass_on_few_pairs(monkeypatch):
    """All pairs meet in single precision; few are ranked, and those as all pairs in double."""
    import numpy as np

    from gridlake.operators import vector_index as vi

    rng = np.random.default_rng(9)
    rows, ids = 1e3 + rng.normal(size=(6000, 8)), np.arange(6000)
    queries = rows[::50] + 0.01 * rng.normal(size=(120, 8))
    ranked = []
    monkeypatch.setattr(vi.Nearest, "_hold", lambda self, at, ids, score, old=vi.Nearest._hold: (ranked.append(len(at)), old(self, at, ids, score))[1])
    for metric in ("l2", "cosine"):
        q, v = vi.prepared(queries, metric, True), vi.prepared(rows, metric, False)
        found = vi.Nearest(np.arange(120), 5, vi.DIGITS[metric])
        for lo in range(0, 6000, 2000):
            found.scan(np.arange(120), q, v[lo:lo + 2000], ids[lo:lo + 2000], metric)
        at, near, score = found.best()
        for i in range(120):
            exact = ((v - q[i]) ** 2).sum(1) if metric == "l2" else -(v @ q[i])
            np.testing.assert_allclose(score[at == i], np.sort(exact)[:5], atol=2e-6)
    assert found.k == 5 and all(ranked)
    centred = vi.Nearest(np.arange(120), 5, 6)
    ranked.clear()
    for lo in range(0, 6000, 2000):
        centred.scan(np.arange(120), queries - 1e3, rows[lo:lo + 2000] - 1e3, ids[lo:lo + 2000], "l2")
    assert sum(ranked) < 120 * 6000 / 20


def test_lines_are_made_before_questions_meet_them(spark):
    """A line that many questions ask for is made once for them; the same lines whatever the groups."""
    from gridlake.operators import access as ac

    rows = spark.createDataFrame(
        [("d", 0, p + 2, p, [f"a{p}", None, f" x\n{p}"][:1 + p % 3]) for p in range(1, 60) if p % 11],
        "document_id string, sheet_idx int, row_index long, position long, cells array<string>")
    forms = [None, [(3, "C")], [(1, "A"), (3, "C")]]
    asked = [(i, "d", 0, i % 7 + 1, (i * 13) % 58 + 1, forms[i % 3]) for i in range(40)]
    slices = spark.createDataFrame(
        asked, "request_id long, document_id string, sheet_idx int, low long, high long, cols array<struct<col_index:int,technical_name:string>>")
    want = []
    for r, _, _, low, high, cols in asked:
        for p in range(low, high + 1):
            if p % 11 and p < 60:
                cells = [f"a{p}", "", f"x {p}"][:1 + p % 3]
                values = dict(enumerate(cells, 1))
                said = [(n, values.get(c, "")) for c, n in cols or []]
                text = " | ".join([str(p + 2), *cells]) if not cols else f"第{p + 2}行: " + (
                    said[0][1] if len(said) == 1 else " | ".join(f"{n}={v}" for n, v in said))
                want.append((r, p + 2, text))
    plan = ac.question_rows(slices, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[:plan.index("Join")] and "regexp_replace" in plan
    for slot, more in ((200, {}), (7, {"together": 2})):
        assert sorted(map(tuple, ac.question_rows(slices, rows, slot, **more).collect())) == sorted(want)


def test_pairs_of_one_value_are_dealt_out(spark, tmp_path, monkeypatch):
    """Rows and requests of a hot value meet in many tasks, each pair once, and take little room when written."""
    from pyspark.sql import functions as F

    from gridlake.operators import access as ac

    rows = spark.range(100).select(
        F.concat(F.lit("d"), F.floor(F.col("id") / 30).cast("string")).alias("document_id"), F.lit(0).alias("sheet_idx"),
        (F.col("id") % 30 + 2).alias("row_index"),
        F.array(F.when(F.col("id") % 9 > 0, F.lit(" F")), F.lit("f"), F.col("id").cast("string")).alias("cells"))
    asked = spark.range(20_000).select(F.col("id").alias("request_id"), F.when(F.col("id") % 50 > 0, F.lit(" f ")).when(
        F.col("id") % 100 > 0, (F.col("id") % 70).cast("string")).alias("value"))
    columns = ["request_id", "document_id", "sheet_idx", "row_index"]

    def facts(df):
        return tuple(df.agg(F.count("*"), F.count_distinct(*columns), F.bit_xor(F.xxhash64(*columns, "cells"))).first())

    want = facts(ac.lookup_anywhere(rows, asked))
    names = rows.select("document_id", "sheet_idx").distinct().select("*", F.explode(F.array(*[F.struct(
        F.lit(i).alias("col_index"), F.lit(n).alias("technical_name")) for i, n in enumerate("ABC", 1)])).alias("c")).select(
        "document_id", "sheet_idx", "c.*")
    own = asked.where("request_id < 900").select("*", F.lit("d1").alias("document_id"), F.lit(0).alias("sheet_idx"), F.get(F.array(
        F.lit("A"), F.lit("B"), F.lit(None).cast("string")), F.col("request_id") % 3).alias("lookup_column"))
    some = sorted(tuple(r) for r in ac.lookup(rows, names, own).select(*columns, "cells").collect())
    for name, n in {"FEW_REQUESTS": 3, "ROWS_TOGETHER": 10, "REQUESTS_TOGETHER": 6000, "PAIRS_PER_TASK": 100_000}.items():
        monkeypatch.setattr(ac, name, n, raising=False)
    got = ac.lookup_anywhere(rows, asked)
    assert not any(c.startswith("__") for c in got.columns)
    assert facts(got) == want and want[0] == want[1] > 1_900_000
    shares = [r["count"] for r in got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert max(shares) < want[0] / 3
    got.select("request_id", "document_id", "row_index").write.parquet(str(tmp_path / "pairs"))
    assert sum(map(os.path.getsize, glob.glob(str(tmp_path / "pairs" / "*.parquet")))) < want[0] / 2
    monkeypatch.setattr(ac, "REQUESTS_TOGETHER", 50)
    assert sorted(tuple(r) for r in ac.lookup(rows, names, own).select(*columns, "cells").collect()) == some


def test_views_share_generated_code(spark, monkeypatch):
    """Views of equal columns run one piece of code, and one of them reads its pages only, not its folder."""
    from pyspark.sql import functions as F

    from gridlake.operators import typed as ty
    from tests.test_golden import grid_of

    monkeypatch.setattr(ty, "SHEETS_PER_PART", 100)
    monkeypatch.setattr(ty, "ROWS_PER_PAGE", 5, raising=False)
    grid = None
    for i in range(6):
        one = grid_of(spark, [["sku", "qty", "n"], *[[f"A{i}", f"{r}.5", "1"] for r in range(40)]], "same").withColumn("sheet_idx", F.lit(i))
        grid = one if grid is None else grid.unionByName(one)
    views = ty.publish_views(spark, ty.infer(grid), "7")
    assert sorted(views) == [f"t_same_{i}" for i in range(6)]
    codes, scanned = set(), []
    for view in views:
        got = spark.sql(f"SELECT sku, qty FROM {view}")
        assert sorted(map(tuple, got.collect())) == sorted((f"A{view[-1]}", r + 0.5) for r in range(40))
        run = got._jdf.queryExecution()
        codes.add(run.debug().codegenToSeq().apply(0)._2())
        scanned.append(run.executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value())
    assert len(codes) == 1
    assert all(40 <= n <= 160 for n in scanned), scanned
