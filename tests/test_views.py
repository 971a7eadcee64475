import re

from quillspark.views import view


def test_publications_join_labels_without_the_whole_text(spark, sf):
    """Where labels are too many to be sent to all, the join moves every document's row."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = view(spark, sf, "publications")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    above = plan[: plan.index("Exchange hashpartitioning")]
    assert "SortMergeJoin" in above and not re.search(r"\btext#", above)
