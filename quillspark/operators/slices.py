"""Order within a key of any size: a key is cut into slices, and what a slice must know of the
others comes from one row of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, release


def _sliced(rows: DataFrame, order: str, slices: int) -> DataFrame:
    """``rows`` with ``slice_``, the number of their equal part of the range of ``order``."""
    bounds = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    low, width = bounds["low"] or 0, max(1, ((bounds["high"] or 0) - (bounds["low"] or 0)) // slices + 1)
    return rows.withColumn("slice_", F.floor((F.col(order) - low) / width))


def latest_before(events: DataFrame, key: str, order: str, value: str, slices: int = 1000) -> DataFrame:
    """``events`` with ``latest``: the last non-null ``value`` of the same ``key`` in an earlier ``order``.

    ``order`` is a number of its own for every row.  A key is looked through in slices of the
    order, and the slices' last values carry over, so no task holds all rows of a key.  Rows
    with a null key have no latest.
    """
    sliced = _sliced(events, order, slices)
    inside = Window.partitionBy(key, "slice_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = sliced.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key, "slice_").agg(F.max_by(value, order).alias("end_"))
    # Each slice with values tells the next ones; a slice asks the last one before it.
    slots = sliced.where(F.col(key).isNotNull()).select(key, "slice_").distinct().join(ends, [key, "slice_"], "left")
    across = slots.withColumn("before_", F.last("end_", ignorenulls=True).over(Window.partitionBy(key).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1))).select(key, "slice_", "before_")
    held = sliced.withColumn("own_", F.last(value, ignorenulls=True).over(inside)).join(across, [key, "slice_"], "left")
    found = F.when(F.col(key).isNotNull(), F.coalesce("own_", "before_"))
    return held.select(*events.columns, found.alias("latest"))


def numbered(rows: DataFrame, by: str, order: str, name: str = "place", slices: int = 1000) -> DataFrame:
    """``rows`` with their number from 1 in the order of ``order``, a whole number of its own for
    every row, among those of one ``by``: that in its slice, after all rows of the slices before."""
    sliced = _sliced(rows, order, slices)
    counts = sliced.groupBy(by, "slice_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(by).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(by).alias("by_"), F.col("slice_").alias("of_"), before.alias("before_"))
    inside = F.row_number().over(Window.partitionBy(by, "slice_").orderBy(order))
    joined = sliced.withColumn("in_", inside).join(offsets, F.col(by).eqNullSafe(F.col("by_")) & F.col("slice_").eqNullSafe(F.col("of_")))
    return joined.select(*rows.columns, (F.col("before_") + F.col("in_")).alias(name))


def order_statistic(samples: DataFrame, column: str, by: str, share: float, bins: int = 1000) -> DataFrame:
    """Rows (by, value): the non-null sample at place floor(share n) of each group, from 0, in order.

    Samples are counted by distinct value first.  Then each group's range is cut into bins, the
    bin that holds the place becomes its range, and so on until that is a single value; so no
    group is sorted or held by one task.  Groups with no sample don't appear; NaN counts as the
    largest value, as in Spark's order.
    """
    held = samples.where(F.col(column).isNotNull()).groupBy(F.col(by).alias("by_"), F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    held = materialise(held.withColumn("nan", F.isnan("v").cast("int")), "values")
    whole = held.groupBy("by_").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("nan")).alias("nans"), F.min(F.when(F.col("nan") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("nan") == 0, F.col("v"))).alias("high"))
    place = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    nan = place >= F.col("n") - F.col("nans")
    ranges = materialise(whole.select("by_", place.alias("place"), F.when(nan, float("nan")).otherwise(F.col("low")).alias("low"), F.when(nan, float("nan")).otherwise(F.col("high")).alias("high")), "ranges")
    while not ranges.where("low < high").isEmpty():
        open_ = ranges.where("low < high")
        inside = held.join(open_.withColumnRenamed("by_", "of_"), F.col("by_").eqNullSafe(F.col("of_"))).select("by_", "v", "n", "place", "low", "high").where("v between low and high")
        # The ends are scaled first: the width of a range may exceed the largest number.
        part = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        at = F.floor(F.least(F.when(F.isnan(part), 0.0).otherwise(part), F.lit(1.0)) * (bins - 1))
        # Both ends have a bin of their own, so that every round gets nearer, infinite ones too.
        at = F.when(F.col("v") == F.col("high"), bins).when(F.col("v") == F.col("low"), -1).otherwise(at)
        counts = inside.groupBy("by_", at.alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("place").alias("place"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("by_").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counts.withColumn("before", before).where("before <= place and place < before + n")
        nearer = hit.select("by_", (F.col("place") - F.col("before")).alias("place"), "low", "high")
        fewer = materialise(ranges.where("not low < high").unionByName(nearer), "ranges")
        release(ranges)
        ranges = fewer
    return ranges.select(F.col("by_").alias(by), F.col("low").alias("value"))
