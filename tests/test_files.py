"""Readers, stores, splitters and streams on real files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from gridlake.functions.splitters import recursive_chunks, sentence_chunks
from gridlake.operators import catalog as ct
from gridlake.operators import chunks as ch
from gridlake.operators.embedder import embed_texts
from gridlake.plans.file_fixtures import xlsx_bytes
from gridlake.sources import plaintext, readers, store
from gridlake.sources import workbook as wb
from gridlake.sources.delimited import parse_delimited, read_delimited
from gridlake.sources.workbook import read_workbooks
from gridlake.streaming.jobs import new_files, run_each_batch


def grid_rows(df):
    return {(r["path"].rsplit("/", 1)[-1], r["row_index"]): list(r["cells"]) for r in df.collect()}


def test_csv_quotes_bom_ragged_blank(spark, tmp_path):
    text = '﻿a,b\r\n"x, ""y""","line\nbreak"\r\n\r\n1,,3\r\n'
    (tmp_path / "f.csv").write_bytes(text.encode("utf-8"))
    assert grid_rows(read_delimited(spark, str(tmp_path))) == {
        ("f.csv", 1): ["a", "b", None], ("f.csv", 2): ['x, "y"', "line\nbreak", None],
        ("f.csv", 3): [None, None, None], ("f.csv", 4): ["1", None, "3"]}


def test_split_files_equal_whole_files(spark, tmp_path):
    rng = random.Random(1)
    for name, n in (("a.csv", 900), ("b.csv", 3), ("c.csv", 200)):
        out = io.StringIO()
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows(
            [[f"{name}{i}", 'q"' * (i % 3) + "\n,é" * (i % 4), "x" * rng.randint(1, 60)][:1 + i % 3] for i in range(n)])
        (tmp_path / name).write_text("\ufeff" + out.getvalue(), encoding="utf-8", newline="")
    (tmp_path / "d.csv").write_bytes(b'a,b\n"x\ny",2\n3,4')
    (tmp_path / "e.csv").write_bytes(b'5" pipe,"6"" pipe"\rlone,cr\n' + b'"long\n' + b"l\n" * 3000 + b'end",1\nz,9\n')
    contents = spark.read.format("binaryFile").load(str(tmp_path))
    whole = grid_rows(parse_delimited(contents, ","))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for size in ("1000", "7000", "134217728"):
        try:
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], "100")
            assert grid_rows(read_delimited(spark, str(tmp_path))) == whole
        finally:
            for n, v in zip(names, before):
                spark.conf.set(n, v)


def test_workbook_sheets_gaps_and_dates(spark, tmp_path):
    data = xlsx_bytes({"One": [["a", "b"], [None, None], ["1.5", "007"]], "Empty": [], "Two": [["z"]]})
    (tmp_path / "w.xlsx").write_bytes(data)
    rows = read_workbooks(spark, str(tmp_path)).collect()
    found = {(r["sheet_idx"], r["sheet_name"], r["row_index"]): list(r["cells"]) for r in rows}
    assert found == {
        (0, "One", 1): ["a", "b"], (0, "One", 2): [None, None], (0, "One", 3): ["1.5", "007"],
        (2, "Two", 1): ["z"]}


def test_workbook_styles():
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    plain = xlsx_bytes({"S": [["x"]]})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as src, zipfile.ZipFile(out, "w") as dst:
        for name in src.namelist():
            body = src.read(name).decode()
            if name.endswith("sheet1.xml"):
                body = (f'<worksheet {ns}><sheetData><row r="1"><c r="A1" s="1"><v>45000</v></c>'
                        '<c r="B1" s="1"><v>45000.5</v></c><c r="C1" t="b"><v>1</v></c>'
                        '<c r="D1" t="inlineStr"><is><t>in</t></is></c><c r="AA1"><v>3</v></c></row></sheetData></worksheet>')
            dst.writestr(name, body)
        dst.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    (_, _, _, part, method, _, _, dates, reason), = wb.sheet_parts("p", out.getvalue())
    (number, cells), = wb.sheet_rows((part, method), None, set(dates))
    assert (number, reason) == (1, None)
    assert cells[:4] == ["2023-03-15", "2023-03-15 12:00:00", "TRUE", "in"] and cells[26] == "3"


def rewritten(book, part, body, kind=None):
    """The workbook with another body for one part."""
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if kind is None else kind) as dst:
        for name in src.namelist():
            dst.writestr(name, body if name == part else src.read(name))
    return out.getvalue()


def test_unreadable_workbooks_are_rows_with_reasons(spark, tmp_path, monkeypatch):
    good = xlsx_bytes({"One": [["a"], ["b"]], "Two": [["c"]]})
    files = {"good": good, "text": b"no zip", "cut": good[:len(good) // 2],
             "broken": rewritten(good, "xl/worksheets/sheet2.xml", "<worksheet><sheetData><row>"),
             "lost": rewritten(good, "xl/sharedStrings.xml", "<sst/>"), "large": xlsx_bytes({"L": [[str(i) + "x"] for i in range(4000)]}),
             "stored": rewritten(good, "", "", 0)}
    for name, data in files.items():
        (tmp_path / f"{name}.xlsx").write_bytes(data)
    limit = len(files["large"]) - 1
    refused = sorted((r.path.rsplit("/", 1)[-1], r.sheet_name, r.reason) for r in wb.refused_files(spark, str(tmp_path), max_bytes=limit).collect())
    assert refused == [("broken.xlsx", "Two", "broken sheet: ExpatError"), ("cut.xlsx", None, "not a workbook: BadZipFile"),
                       ("large.xlsx", None, wb.TOO_LARGE),
                       ("lost.xlsx", "One", "broken sheet: ValueError"), ("lost.xlsx", "Two", "broken sheet: ValueError"),
                       ("text.xlsx", None, "not a workbook: BadZipFile")]
    rows = read_workbooks(spark, str(tmp_path), max_bytes=limit).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.sheet_name, r.row_index, *r.cells) for r in rows) == sorted(
        [(f"{n}.xlsx", "One", i, c) for n in ("good", "stored", "broken") for i, c in ((1, "a"), (2, "b"))]
        + [(f"{n}.xlsx", "Two", 1, "c") for n in ("good", "stored")])


def test_long_sheet_streams_and_rows_out_of_order():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{r}"><c r="B{r}"><v>{r}</v></c></row>' for r in range(1, 30001))
    book = rewritten(xlsx_bytes({"S": [["x"]]}), "xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    (_, _, _, part, method, *_), = wb.sheet_parts("p", book)
    import tracemalloc

    tracemalloc.start()
    n = sum(1 for number, cells in wb.sheet_rows((part, method), None, set()) if cells == [None, str(number)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 30000 and peak < 4_000_000
    body = '<row r="3"><c r="A3"><v>3</v></c></row><row r="1"><c r="C1"><v>1</v></c></row>'
    book = rewritten(xlsx_bytes({"S": [["x"]]}), "xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    (_, _, _, part, method, *_), = wb.sheet_parts("p", book)
    assert list(wb.sheet_rows((part, method), None, set())) == [(1, [None, None, "1"]), (2, [None] * 3), (3, ["3", None, None])]


def test_mixed_directory_and_new_reader(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("x,y\n1,2\n")
    (tmp_path / "b.tsv").write_text("x\ty\n")
    (tmp_path / "c.xlsx").write_bytes(xlsx_bytes({"S": [["k"]]}))
    (tmp_path / "d.psv").write_text("p|q\n")
    (tmp_path / "e.txt").write_text("not a table")
    assert len(grid_rows(readers.read_directory(spark, str(tmp_path)))) == 4
    from gridlake.sources.delimited import parse_delimited

    readers.register_reader("PSV", lambda contents: parse_delimited(contents, "|"))
    try:
        assert grid_rows(readers.read_directory(spark, str(tmp_path)))[("d.psv", 1)] == ["p", "q"]
    finally:
        del readers.TABLE_READERS["psv"]


def test_encodings(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("订单\r\n二\n".encode("utf-8"))
    (tmp_path / "g.txt").write_bytes("订单编号".encode("gbk"))
    (tmp_path / "l.log").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "e.md").write_bytes(b"\n")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in plaintext.read_texts(spark, str(tmp_path)).collect()}
    assert (rows["u.txt"]["text"], rows["u.txt"]["line_count"], rows["u.txt"]["encoding"]) == ("订单\n二\n", 2, "utf-8")
    assert (rows["g.txt"]["text"], rows["g.txt"]["encoding"]) == ("订单编号", "gbk")
    assert rows["l.log"]["encoding"] == "latin1" and rows["e.md"]["line_count"] == 1


def random_text(rng, n):
    return "".join(rng.choices(["word ", "long" * 9 + " ", "。", "！", "\n", "\n\n", "，", "x"], k=n))


def test_recursive_split_invariants():
    rng = random.Random(9)
    seps = ["\n\n", "\n", "。", "！", "？", "；", "，", " ", ""]
    for _ in range(60):
        text = random_text(rng, rng.randint(0, 300))
        parts = list(recursive_chunks(text, 100, 20, seps))
        at = 0
        for part in parts:
            assert 0 < len(part) <= 100
            place = text.find(part, max(0, at - 140))
            assert place >= 0
            at = max(at, place + len(part))
        squeezed = "".join(text.split())
        assert not squeezed or parts
        assert set(squeezed) <= set("".join(parts))


def test_recursive_split_known():
    assert list(recursive_chunks("aa bb cc dd", 5, 2, [" ", ""])) == ["aa bb", "cc", "dd"]
    assert list(recursive_chunks("one\n\ntwo\n\nthree", 9, 0, ["\n\n", "\n", " ", ""])) == ["one\n\ntwo", "three"]
    assert list(recursive_chunks("abcdefghij", 4, 1, [""])) == ["abcd", "defg", "ghij"]
    assert list(recursive_chunks("", 4, 1, [""])) == []


def test_sentence_split_covers_text():
    rng = random.Random(10)
    for _ in range(60):
        text = random_text(rng, rng.randint(0, 200))
        cut = list(sentence_chunks(text, 90, 15))
        covered = set()
        for start, stop, chunk in cut:
            assert stop - start <= 90 and chunk == (text[start:stop].strip() if len(text) > 90 else text)
            covered.update(range(start, stop))
        assert all(i in covered or text[i].isspace() for i in range(len(text)))


def test_context_pages(spark):
    rng = random.Random(11)
    texts = ["\n".join("y" * rng.randint(0, 30) for _ in range(rng.randint(1, 40))) for _ in range(40)] + ["z" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", ch.context_pages(F.col("t"), 100).alias("p")).collect():
        assert "\n".join(r["p"]) == r["t"]
        assert all(len(p) < 100 or "\n" not in p for p in r["p"]) or len(r["t"]) <= 100


_CHUNK = "id string, collection string, user_id string, document_id string, content string"


def test_store_replaces_documents_and_keeps_the_old_version(spark, tmp_path):
    root = str(tmp_path / "store")
    first = spark.createDataFrame([(f"d{d}_{i}", "c", "u", f"d{d}", "old") for d in (1, 2, 3) for i in (0, 1)], _CHUNK)
    store.replace_documents(first, root)
    store.replace_documents(first, root)
    fresh = spark.createDataFrame([("d1_0", "c", "u", "d1", "new")], _CHUNK)

    def held():
        return sorted((r["id"], r["content"]) for r in store.read_chunks(spark, root).collect())

    before = held()
    assert len(before) == 6
    with pytest.raises(Exception):  # noqa: B017
        store.replace_documents(fresh.withColumn("content", F.raise_error(F.lit("lost")).cast("string")), root)
    assert held() == before
    store.replace_documents(fresh, root)
    assert held() == [("d1_0", "new")] + [r for r in before if not r[0].startswith("d1")]
    store.delete_documents(first.select("collection", "user_id", "document_id").distinct(), root)
    assert held() == []
    store.replace_documents(fresh, root)
    assert held() == [("d1_0", "new")]


@pytest.mark.parametrize("step", ["put chunks", "put documents", "publish"])
def test_a_failure_at_any_step_leaves_the_old_version_whole(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "store")
    schema = _CHUNK + ", embedding array<double>, filename string"

    def rows(text, *documents, dim=2):
        return spark.createDataFrame([(f"{d}_{i}", "c", "u", d, text, [1.0] * dim, "f") for d in documents for i in (0, 1)], schema)

    def held():
        return sorted((r["id"], r["content"]) for r in store.read_chunks(spark, root).collect())

    store.add_chunks(rows("old", "a", "b"), root)
    before, listed = held(), sorted(store.stored_documents(spark, root).collect())
    with monkeypatch.context() as m:
        def fail(self, *args, **kwargs):
            if step == "publish" or args[1] == step.split()[1]:
                raise OSError("lost")
            return put(self, *args, **kwargs)

        put = store.Versions.put
        m.setattr(store.Versions, step.split()[0], fail)
        with pytest.raises(OSError):
            store.add_chunks(rows("new", "b", "c"), root)
    assert held() == before and sorted(store.stored_documents(spark, root).collect()) == listed
    store.add_chunks(rows("new", "b", "c"), root)
    assert held() == [(f"{d}_{i}", t) for d, t in (("a", "old"), ("b", "new"), ("c", "new")) for i in (0, 1)]
    store.vacuum(spark, root)
    assert len(held()) == 6


def test_repeated_writes_conflicts_and_versions(spark, tmp_path):
    root = str(tmp_path / "store")

    def rows(text, *documents):
        return spark.createDataFrame([(f"{d}_0", "c", "007", d, text) for d in documents], _CHUNK)

    def held(number=None):
        return sorted((r["id"], r["user_id"], r["content"]) for r in store.read_chunks(spark, root, number=number).collect())

    store.replace_documents(rows("one", "a", "b", "c"), root, write=("stream", 0))
    store.replace_documents(rows("two", "b"), root, write=("stream", 1))
    want = [("a_0", "007", "one"), ("b_0", "007", "two"), ("c_0", "007", "one")]
    assert held() == want
    for number in (0, 1):
        store.replace_documents(rows("again", "a", "b", "c"), root, write=("stream", number))
    assert held() == want and store.Versions(spark, root).numbers() == [1, 2]
    # a writer that began before the last version was published
    versions = store.Versions(spark, root)
    with pytest.raises(store.VersionConflict):
        versions.publish(versions.state(1), {})
    assert held() == want and held(1) == [(f"{d}_0", "007", "one") for d in "abc"]
    store.delete_documents(rows("x", "a", "zz"), root)
    store.compact(spark, root)
    assert held() == want[1:] and versions.state()["tables"]["chunks"]["stale"] == []
    assert [(r["document_id"], r["chunks"]) for r in store.stored_documents(spark, root).orderBy("document_id").collect()] == [("b", 1), ("c", 1)]
    assert store.read_chunks(spark, root, user_id="8").count() == 0 and store.read_chunks(spark, root, "c", "007").count() == 2
    store.vacuum(spark, root)
    assert held() == want[1:]
    nulls = spark.createDataFrame([("n_0", "c", None, None, "x")], _CHUNK)
    store.replace_documents(nulls, root)
    store.replace_documents(nulls, root)
    assert len(held()) == 3 and store.stored_collections(spark, root).first()["n_vectors"] == 3


def test_pruned_reads(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(f"{u}{d}", c, u, f"{d}", "x") for c in ("c1", "c2") for u in ("u1", "u2") for d in range(3)], _CHUNK)
    store.replace_documents(df, root)
    plan = store.read_chunks(spark, root, "c1", "u2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "= c1" in plan and "= u2" in plan and "Join" not in plan


def test_add_chunks_guards_vectors(spark, tmp_path):
    root = str(tmp_path / "vectors")
    schema = "id string, document_id string, user_id string, collection string, embedding array<double>"

    def add(*rows):
        store.add_chunks(spark.createDataFrame([(i, i, "u", c, v) for i, c, v in rows], schema), root)

    add(("a", "c1", [1.0, 2.0]))
    add(("b", "c2", [1.0]))
    for bad in ([("x", "c1", [1.0])], [("x", "c1", None)], [("x", "c3", [1.0]), ("y", "c3", [1.0, 2.0])]):
        with pytest.raises(ValueError):
            add(*bad)
    assert sorted(r["id"] for r in store.read_chunks(spark, root).collect()) == ["a", "b"]


def test_json_safe_values(spark):
    from gridlake.functions.values import as_json_value

    df = spark.sql(
        "SELECT CAST(1.50 AS DECIMAL(9,2)) d, DATE '2026-01-02' a, TIMESTAMP_NTZ '2026-01-02 03:04:05' t, "
        "TIMESTAMP_NTZ '2026-01-02 03:04:05.25' u, X'61FF6263' b, 7 i")
    row = df.select(*[as_json_value(F.col(n), t).alias(n) for n, t in df.dtypes]).first()
    assert tuple(row) == (1.5, "2026-01-02", "2026-01-02T03:04:05", "2026-01-02T03:04:05.250000", "abc", 7)


def test_reindex_refusals(spark):
    chunks = spark.createDataFrame(
        [("c1", "d1", "u1", f"d1_{i}", f"text {i}") for i in range(5)],
        "collection string, document_id string, user_id string, id string, content string")
    embed = lambda df: embed_texts(df, "content")
    for args in (("d1", "u1", "c1", "c1"), ("d9", "u1", "c1", "c2"), ("d1", "u2", "c1", "c2")):
        with pytest.raises(ct.ReindexError):
            ct.reindex(chunks, *args, embed)
    once = ct.reindex(chunks, "d1", "u1", "c1", "c2", embed)
    twice = ct.reindex(once.select(*chunks.columns, "embedding"), "d1", "u1", "c1", "c2", embed)
    for result in (once, twice):
        kept = result.where("collection = 'c2'").orderBy("id").collect()
        assert [(r["id"], r["content"]) for r in kept] == [(f"d1_{i}", f"text {i}") for i in range(5)]
        assert result.count() == 10


def test_stream_sees_files_once(spark, tmp_path):
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    seen = []

    def collect(batch, number):
        seen.extend(r["path"].rsplit("/", 1)[-1] for r in batch.select("path").collect())

    for names in (["a.csv", "b.csv"], ["c.csv"], []):
        for name in names:
            (inbox / name).write_text("x,y\n1,2\n")
        run_each_batch(new_files(spark, str(inbox), "*.csv"), state, collect)
    assert sorted(seen) == ["a.csv", "b.csv", "c.csv"]
