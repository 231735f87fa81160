"""Nullable and list columns: presence, dense values, lengths, children and their rebuilding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TABLE_ROWS = 8


def nullable_forms(cells: DataFrame) -> DataFrame:
    """How each group of a nullable column is written: absent, plain, or a presence bitmap and the dense values."""
    got = cells.groupBy("column_name", "row_group").agg(F.count("*").alias("n"), F.count("v").alias("present"))
    form = F.when(F.col("present") == 0, "absent").when(F.col("present") == F.col("n"), "plain").otherwise("presence")
    bitmap = F.when(form == "presence", F.floor((F.col("n") + 7) / 8)).otherwise(0)
    return got.withColumn("form", form).withColumn("bitmap_bytes", bitmap.cast("long"))


def presence_rank(cells: DataFrame) -> DataFrame:
    """(column_name, row_group, pos, v, dense_index): present values with their index among the present of their group."""
    w = Window.partitionBy("column_name", "row_group").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("dense_index", F.count("v").over(w) - 1).where("v IS NOT NULL").select("column_name", "row_group", "pos", "v", "dense_index")


def list_lengths(parents: DataFrame, children: DataFrame, key: str, parent_key: str) -> DataFrame:
    """(key, n_children, first_child): per parent in key order its children's number and offset within its row group of keys."""
    n = children.groupBy(F.col(key).alias(parent_key)).agg(F.count("*").alias("n_children"))
    rows = parents.select(parent_key, "pos", "row_group").join(n, parent_key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    w = Window.partitionBy("row_group").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(parent_key, "row_group", "n_children", F.coalesce(F.sum("n_children").over(w), F.lit(0)).alias("first_child"))


def collected(children: DataFrame, key: str, order_by: list[str], fields: list[str]) -> DataFrame:
    """One row for each key with its children as an ordered array of structs."""
    row = F.struct(*order_by, *[f for f in fields if f not in order_by])
    return children.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("children"))


def exploded(parents: DataFrame, key: str) -> DataFrame:
    return parents.select(key, F.inline("children"))


def layout(parents: DataFrame, key: str) -> DataFrame:
    """Whether a list of rows is written as a table of columns or row by row."""
    n = F.size("children")
    return parents.select(key, n.cast("long").alias("n_rows"), F.when(n >= TABLE_ROWS, "table").otherwise("list").alias("layout"))
