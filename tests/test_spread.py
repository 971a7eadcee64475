"""Narrow tables of one row group are dealt over all cores, and cells by key before they are sorted."""

from quillspark.catalog.report import runs_wide
from quillspark.catalog.search import questions
from quillspark.operators import runs
from quillspark.views import view


def test_narrow_tables_are_dealt_over_all_cores(spark, sf):
    for df in (view(spark, sf, "studies"), questions(spark, sf)):
        sizes = df.rdd.glom().map(len).collect()
        assert sum(x > 0 for x in sizes) >= spark.sparkContext.defaultParallelism


def test_cells_are_dealt_by_key_before_they_are_aggregated(spark, sf):
    rows = spark.createDataFrame([(1, "x", None), (2, None, "y"), (3, None, None)], "id long, a string, b string")
    # A key without any of the named columns stays, with nulls.
    alone = spark.createDataFrame([(4, "b", 2, "z", "filled")], "id long, column_key string, position int, value string, status string")
    for df in (runs.wide(runs.cells(rows, ["id"], ["a", "b"]).unionByName(alone), ["id"], ["a"]), runs_wide(spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.rindex("Exchange hashpartitioning(") > plan.rindex("Aggregate(")
    got = runs.wide(runs.cells(rows, ["id"], ["a", "b"]).unionByName(alone), ["id"], ["a"]).collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (2, None), (3, None), (4, None)]


def test_titles_and_features_are_not_broadcast(spark, sf):
    """Files of titles are small for what they hold, so no join may rest on their size."""
    from quillspark.catalog.enrichment import enrich_titles, pairs

    for df in (enrich_titles(spark, sf), pairs(spark, sf).select("p_id", "confidence")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin [r_set" not in plan and "BroadcastHashJoin [p_set" not in plan and "BroadcastHashJoin [r_id" not in plan


def test_references_are_dealt_by_rows_and_gather_no_lists(spark, sf):
    from quillspark.catalog.report import report_references
    from quillspark.operators import report
    from quillspark.views import parts_of

    assert parts_of(spark.range(1000), rows=10) == 100
    plan = report_references(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("REPARTITION_BY_NUM") == 3
    rows = [(1, 10, 1, 7), (1, 10, 1, 5), (1, 9, 4, 7), (1, 12, 1, 5), (2, 3, 1, None)]
    each = spark.createDataFrame(rows, "report_id long, position long, at int, paper_id long")
    assert sorted(map(tuple, report.first_references(each).collect())) == [(1, 5, 2), (1, 7, 1), (2, None, 1)]
    claims = spark.createDataFrame([(1, 9, [4, 3]), (1, 8, [3, 6])], "report_id long, position long, paper_ids array<long>")
    assert sorted(map(tuple, report.reference_numbers(claims).collect())) == [(1, 3, 1), (1, 4, 3), (1, 6, 2)]
