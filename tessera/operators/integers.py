"""Integer columns: residuals, block widths, costs and the choice of transform for each row group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bit_length, block_bytes, unzigzag, zigzag

#: What a frame of reference, a first value or a constant takes in the clear.
BASE = 8


def _group(order: bool = False):
    w = Window.partitionBy("column_name", "row_group")
    return w.orderBy("pos") if order else w


def _whole(w):
    """All rows of an ordered window's partition: what shares its sort needs no other."""
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _residuals(v: Column, least: Column, after: Column) -> dict[str, Column]:
    step = F.try_subtract(after, v)
    return {
        "raw": F.when(least < 0, zigzag(v)).otherwise(v), "frame": F.coalesce(F.try_subtract(v, least), F.lit(-1)),
        "step": zigzag(step), "overflows": after.isNotNull() & step.isNull(),
    }


def residuals(cells: DataFrame) -> DataFrame:
    """Adds least (the group's minimum), raw, frame and step; step is null at a group's last value and where it overflows."""
    w = _group(order=True)
    out = cells.withColumns({"least": F.min("v").over(_whole(w)), "after": F.lead("v").over(w)})
    return out.withColumns(_residuals(F.col("v"), F.col("least"), F.col("after"))).drop("after")


def block_widths(cells: DataFrame, *more: Column) -> DataFrame:
    """(column_name, row_group, block, n, n_steps, raw_width, frame_width, step_width) and aggregates ``more`` of each block."""
    got = residuals(cells).groupBy("column_name", "row_group", "block").agg(
        *more,
        F.count("*").alias("n"), F.count("step").alias("n_steps"), F.bit_or("raw").alias("raw"), F.bit_or("frame").alias("frame"), F.bit_or("step").alias("step"),
        F.min("least").alias("least"), F.max("v").alias("most"), F.bool_or("overflows").alias("overflows"),
    )
    return _widths(got)


def row_widths(rows: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`block_widths` of columns beside each other, in rows that have pos, row_group and block.

    One sort of the rows serves all columns, and only what is known of a block is put one under the other: cells are never made.
    """
    w = Window.partitionBy("row_group").orderBy("pos")
    each = range(len(columns))
    out = rows.select("row_group", "pos", "block", *[F.col(c).cast("long").alias(f"v{k}") for k, c in enumerate(columns)])
    out = out.select("*", *[F.min(f"v{k}").over(_whole(w)).alias(f"least{k}") for k in each], *[F.lead(f"v{k}").over(w).alias(f"after{k}") for k in each])
    made = {f"{name}{k}": c for k in each for name, c in _residuals(F.col(f"v{k}"), F.col(f"least{k}"), F.col(f"after{k}")).items()}
    out = out.select("row_group", "block", *[f"{x}{k}" for k in each for x in ("v", "least")], *[c.alias(x) for x, c in made.items()])
    said = lambda k: (F.count(f"step{k}"), F.bit_or(f"raw{k}"), F.bit_or(f"frame{k}"), F.bit_or(f"step{k}"), F.min(f"least{k}"), F.max(f"v{k}"), F.bool_or(f"overflows{k}"))
    names = ("n_steps", "raw", "frame", "step", "least", "most", "overflows")
    got = out.groupBy("row_group", "block").agg(F.count("*").alias("n"), *[x.alias(f"{name}{k}") for k in each for name, x in zip(names, said(k), strict=True)])
    stack = ", ".join(f"'{c}', " + ", ".join(f"{name}{k}" for name in names) for k, c in enumerate(columns))
    return _widths(got.selectExpr("row_group", "block", "n", f"stack({len(columns)}, {stack}) as (column_name, {', '.join(names)})"))


def _widths(got: DataFrame) -> DataFrame:
    return got.select(
        "column_name", "row_group", "block", "n", "n_steps", bit_length(F.col("raw")).alias("raw_width"), bit_length(F.col("frame")).alias("frame_width"),
        F.coalesce(bit_length(F.col("step")), F.lit(0)).alias("step_width"), "least", "most", "overflows", *[c for c in got.columns if c not in OWN],
    )


#: What :func:`block_widths` aggregates itself.
OWN = ("column_name", "row_group", "block", "n", "n_steps", "raw", "frame", "step", "least", "most", "overflows")


def column_stats(widths: DataFrame) -> DataFrame:
    """(column_name, row_group, n, least, most, is_constant, overflows) of what :func:`block_widths` or :func:`row_widths` say."""
    g = widths.groupBy("column_name", "row_group")
    got = g.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.bool_or("overflows").alias("overflows"))
    return got.select("column_name", "row_group", "n", "least", "most", (F.col("least") == F.col("most")).alias("is_constant"), "overflows")


def transform_costs(cells: DataFrame, blocks: tuple[Column, ...] = (), groups: tuple[Column, ...] = ()) -> DataFrame:
    """Payload bytes of each transform, the transform taken and the size of each row group of each column.

    ``blocks`` are further aggregates of each block's cells, ``groups`` those of a group's blocks.

    In the order raw, frame, delta, constant a later one is taken only if it is strictly smaller.
    """
    return costs_of(block_widths(cells, *blocks), groups)


def costs_of(widths: DataFrame, groups: tuple[Column, ...] = ()) -> DataFrame:
    """:func:`transform_costs` of what :func:`block_widths` or :func:`row_widths` say."""
    got = widths.groupBy("column_name", "row_group").agg(
        *groups, F.sum("n").alias("n"), F.sum(block_bytes(F.col("n"), F.col("raw_width"))).alias("raw_cost"), (BASE + F.sum(block_bytes(F.col("n"), F.col("frame_width")))).alias("frame_cost"),
        (BASE + F.sum(F.when(F.col("n_steps") > 0, block_bytes(F.col("n_steps"), F.col("step_width"))).otherwise(0))).alias("delta_cost"),
        (F.min("least") == F.max("most")).alias("is_constant"), F.bool_or("overflows").alias("overflows"),
    )
    far = F.lit(1 << 62)
    delta = F.when(F.col("overflows") | (F.col("n") < 2), far).otherwise(F.col("delta_cost"))
    constant = F.when(F.col("is_constant"), F.lit(BASE).cast("long")).otherwise(far)
    best = F.least("raw_cost", "frame_cost", delta, constant)
    taken = F.when(F.col("raw_cost") == best, "raw").when(F.col("frame_cost") == best, "frame").when(delta == best, "delta").otherwise("constant")
    return got.select("column_name", "row_group", "n", "raw_cost", "frame_cost", "delta_cost", taken.alias("transform"), (best + 1).alias("size"), *got.columns[2 : 2 + len(groups)])


def short_scan(cells: DataFrame) -> DataFrame:
    """(column_name, row_group, low, high, steps): least, greatest and the OR of all zigzag steps, from 0 at the first value, of each group."""
    before = F.lag("v").over(_group(order=True))
    got = cells.withColumn("step", F.coalesce(zigzag(F.try_subtract(F.col("v"), before)), F.lit(0).cast("long"))).groupBy("column_name", "row_group")
    return got.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.bit_or("step").alias("steps"))


def sizes(costs: DataFrame) -> DataFrame:
    """(column_name, n, size, groups) over all row groups, of what :func:`transform_costs` says."""
    got = costs.groupBy("column_name")
    return got.agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("groups"))


def delta_encoded(cells: DataFrame) -> DataFrame:
    """(column_name, row_group, pos, base, residual): the step to each value, none at a group's first."""
    before = F.lag("v").over(_group(order=True))
    base = F.first("v").over(_group(order=True))
    return cells.select("column_name", "row_group", "pos", base.alias("base"), zigzag(F.col("v") - before).alias("residual"))


def delta_decoded(encoded: DataFrame) -> DataFrame:
    w = _group(order=True).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return encoded.select("column_name", "row_group", "pos", (F.col("base") + F.sum(F.coalesce(unzigzag(F.col("residual")), F.lit(0))).over(w)).alias("v"))


def frame_encoded(cells: DataFrame) -> DataFrame:
    least = F.min("v").over(_group())
    return cells.select("column_name", "row_group", "pos", least.alias("base"), (F.col("v") - least).alias("residual"))


def frame_decoded(encoded: DataFrame) -> DataFrame:
    return encoded.select("column_name", "row_group", "pos", (F.col("base") + F.col("residual")).alias("v"))


def suppressed(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, is_constant, is_zero) of whole columns: numbers that are all zero, and texts all empty, are not written."""
    aggs: list[Column] = []
    types = dict(df.dtypes)
    for c in columns:
        zero = F.lit("") if types[c] == "string" else F.lit(0)
        aggs += [(F.min(c).eqNullSafe(F.max(c))).alias(f"{c}__constant"), F.bool_and(F.col(c) == zero).alias(f"{c}__zero")]
    got = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__constant").alias("is_constant"), F.col(f"{c}__zero").alias("is_zero")) for c in columns])
    return got.select(F.inline(rows))
