"""Physical plans: what is pushed down, what is shuffled, what must not appear."""

import pytest

from gridlake.operators import grid as g
from gridlake.operators.limiter import failure_counts
from gridlake.operators.typed import infer, typed_frames
from gridlake.plans import fixtures as fx
from gridlake.plans import load_all
from gridlake.plans.registry import QUERIES, table

SF_DIR = "/root/testdata/sf0.001"
load_all()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "r08_inner_join", "r10_series_product", "r11_range_join", "v03_literal_candidates", "v05_match_ladder",
    "a05_lookup_in_column", "a07_first_document_with_hit", "a08_mentioned_columns", "e03_batch_cosine",
    "e15_delete_documents", "e20_expand_best_table", "k05_character_summary", "k07_history_page"])
def test_no_pairwise_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["r02_filter"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)" in plan
    read = plan.split("ReadSchema:")[1]
    assert "l_shipdate" not in read and "l_extendedprice" not in read


def test_row_evidence_needs_no_shuffle(spark):
    assert "Exchange" not in plan_of(g.row_evidence(fx.stored_grid(spark, SF_DIR)))


def test_typed_frames_project(spark):
    model = infer(fx.stored_grid(spark, SF_DIR))
    for frame in typed_frames(model).values():
        plan = plan_of(frame)
        assert "SortMergeJoin" not in plan and "Generate" not in plan


def test_top_rows_filter_reaches_the_grid_scan(spark):
    assert "LessThanOrEqual(row_index,4)" in plan_of(g.sheet_heads(fx.stored_grid(spark, SF_DIR)))


def test_limiter_partitions_by_key_and_slot(spark):
    from pyspark.sql import functions as F

    events = table(spark, SF_DIR, "events")
    plan = plan_of(failure_counts(events, "user_id", "ts", F.col("event_type") == "error"))
    assert plan.count("Exchange hashpartitioning") == 1 and "__slot" in plan.split("hashpartitioning(")[1]


def test_last_messages_limit_before_the_shuffle(spark):
    assert plan_of(QUERIES["k08_last_messages"](spark, SF_DIR)).count("WindowGroupLimit") == 2


def test_contexts_grow_with_the_questions(spark):
    """A context holds the few hits of one question, however many documents there are."""
    got = QUERIES["c10_question_context"](spark, SF_DIR).collect()
    asked = table(spark, SF_DIR, "conversations").where("role = 'user'").select("conv_id").distinct()
    assert len(got) == asked.count() and all(r.context.count("[来源：") == 5 for r in got)


def test_csv_blocks_move_no_lines(spark, tmp_path):
    from gridlake.sources import delimited as dl

    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    lines = spark.read.text(str(tmp_path), lineSep="\n").selectExpr("_metadata.file_path AS path", "_metadata.file_block_start AS block", "value")
    assert "Exchange" not in plan_of(lines.mapInArrow(lambda b: dl._cut_blocks(b, ","), dl.CUT))


def test_block_starts_of_very_many_blocks(spark):
    """The composition over 100,000 blocks equals a walk from block to block."""
    import random

    from gridlake.sources import delimited as dl

    rng, rows = random.Random(1), []
    for block in range(100_000):
        out, inn = rng.choice([(False, True)] * 6 + [(True, False)] * 3 + [(True, True), (False, False)])
        rows.append(("f", block, (out, rng.randint(0, 3), block % 5, 2), None if block == 0 else (inn, rng.randint(0, 3), block % 7, 3)))
    schema = f"path string, block bigint, outside {dl._SIDE}, inside {dl._SIDE}"
    got = {r["block"]: (r["open"], r["ends"], r["base"]) for r in dl.block_starts(spark.createDataFrame(rows, schema)).collect()}
    is_open, ends = False, 0
    for _, block, outside, inside in rows:
        own = inside if is_open else outside
        assert got[block] == (is_open, ends, own[2])
        is_open, ends = own[0], ends + own[1]


def test_one_view_for_any_number_of_sheets(spark):
    from gridlake.operators import typed as ty

    rows = [("u1", f"d{d}", f"d{d}.csv", "csv", 0, "S", r, ["k", f"c{d % 7}"] if r == 1 else [str(r), f"{r}.25" if d % 2 else f"{r}.5"])
            for d in range(200) for r in (1, 2, 3)]
    grid = spark.createDataFrame(rows, "user_id string, document_id string, filename string, file_type string, sheet_idx int, "
                                       "sheet_name string, row_index bigint, cells array<string>")
    ty.publish_sheets(spark, ty.infer(grid), "u1", view="many_sheets", function="many_sheet")
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("many")] == ["many_sheets"]
    got = spark.sql("SELECT data:k::double AS k, data:c4::double AS c FROM many_sheet('t_d4_0') ORDER BY k").collect()
    assert [tuple(r) for r in got] == [(2.0, 2.5), (3.0, 3.5)]
    assert spark.sql("SELECT count(DISTINCT __document_id) AS n FROM many_sheets").first()["n"] == 200
