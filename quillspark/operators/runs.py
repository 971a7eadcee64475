"""Versioned extraction runs: unpivoted cells, nested detail, and the chain of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per cell: (key, column_key, position, value, status), status ``filled`` or
    ``missing``; values as text."""
    made = F.array(*[F.struct(F.lit(c).alias("column_key"), F.lit(i + 1).alias("position"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    each = rows.select(*key, F.explode(made).alias("c")).select(*key, "c.*")
    return each.withColumn("status", F.when(F.coalesce("value", F.lit("")) == "", "missing").otherwise("filled"))


def cells_by_run(rows: DataFrame, columns: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``cells`` of the columns of each row's own run: ``rows`` has run_id, the key and ``fields``,
    ``columns`` (run_id, column_key, position) says which of them a run shows, and where.

    A column that isn't among the fields is missing in all rows; a run without columns has none.
    """
    entries = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in fields]))
    held = rows.select("run_id", *key, entries.alias("fields"))
    each = held.join(columns.select("run_id", "column_key", "position"), "run_id")
    made = each.select("run_id", *key, "column_key", "position", F.try_element_at("fields", F.col("column_key")).alias("value"))
    return made.withColumn("status", F.when(F.coalesce("value", F.lit("")) == "", "missing").otherwise("filled"))


def run_id(at: Column, kind: str = "inc") -> Column:
    """A run's name by its time in UTC, to the millisecond: ``inc_20240131235959123``."""
    return F.concat(F.lit(f"{kind}_"), F.date_format(at, "yyyyMMddHHmmssSSS"))


def wide(found: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Cells back in columns; the columns are named, so no pass is made to find them.

    Cells of other columns are left out (a key with none of the named ones has all of them
    null), and rows are dealt by key before they are sorted for it, not within the tasks that made them."""
    kept = found.select(*key, "column_key", F.when(F.col("column_key").isin(columns), F.col("value")).alias("value"))
    return kept.repartition(*key).groupBy(*key).pivot("column_key", columns).agg(F.first("value"))


def chain(runs: DataFrame) -> DataFrame:
    """Runs (report_id, run_id, created_at) with run_index, parent and whether they are active."""
    order = Window.partitionBy("report_id").orderBy("created_at", "run_id")
    last = F.max("run_index").over(Window.partitionBy("report_id"))
    numbered = runs.withColumns({"run_index": F.row_number().over(order), "parent_run_id": F.lag("run_id").over(order)})
    return numbered.withColumn("is_active", F.col("run_index") == last)


def typed_cells(payloads: DataFrame, key: str, column: str) -> DataFrame:
    """Top-level fields of a JSON object column as rows (key, field, kind, value).

    ``kind`` is text, number, boolean, json or null by the first character of the raw value.
    """
    names = F.explode(F.json_object_keys(F.col(column))).alias("field")
    each = payloads.select(key, column, names)
    raw = F.call_function("get_json_object", F.col(column), F.concat(F.lit("$."), F.col("field")))
    number = F.coalesce(raw, F.lit("")).rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$")
    kind = F.when(raw.isNull(), "null").when(number, "number").when(raw.isin("true", "false"), "boolean").when(raw.rlike(r"^[\[{]"), "json").otherwise("text")
    return each.select(key, "field", kind.alias("kind"), raw.alias("value"))
