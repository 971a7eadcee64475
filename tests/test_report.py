import pytest
from pyspark.sql import functions as F

from quillspark.operators import report


def studies(spark, first, n):
    rows = spark.range(first, first + n).select(F.col("id").alias("study_id"), F.lit("sleep").alias("outcome_measured"), F.lit("").alias("key_result"), F.lit("None").alias("review_type"), (F.col("id") % 7).cast("int").alias("citation_count"))
    return rows


@pytest.mark.parametrize(("strict", "partial", "want"), [(20, 20, (10, 5)), (3, 20, (3, 12)), (20, 2, (13, 2)), (4, 4, (4, 4)), (0, 20, (0, 15)), (11, 6, (10, 5)), (12, 3, (12, 3))])
def test_context_fills_up_from_the_tier_with_more_left(spark, strict, partial, want):
    got = report.select_context(studies(spark, 0, strict), studies(spark, 100, partial), ["sleep", "placebo"]).collect()
    assert (sum(r["tier"] == "strict" for r in got), sum(r["tier"] == "partial" for r in got)) == want


def test_page_numbers():
    assert report.page_numbers(1, 9) == [1, 2, 3, 4, 5]
    assert report.page_numbers(5, 9) == [3, 4, 5, 6, 7]
    assert report.page_numbers(9, 9) == [5, 6, 7, 8, 9]
    assert report.page_numbers(1, 2) == [1, 2]
