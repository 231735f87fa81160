"""Positions of rows under a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import BLOCK, GROUP

#: Rows that one window partition is meant to sort, and the most stretches: beyond, stretches grow and their sort spills.
STRETCH, STRETCHES = 100_000, 4096
#: Quantiles that come with the count.
FEW = 64
#: Rows that one task is meant to hold, and to take at least where there are cores for more tasks.
PART, PART_LEAST = 400_000, 25_000


def parts(df: DataFrame, rows: int) -> int:
    """Partitions for so many rows: tasks of about ``PART`` rows, however many there are."""
    return max(1, -(-rows // PART), min(-(-rows // PART_LEAST), df.sparkSession.sparkContext.defaultParallelism))


def with_positions(df: DataFrame, order_by: list[str], pos: str = "pos", row_group: str = "row_group", block: str | None = "block", stretch: int = STRETCH, grouped: bool = False) -> DataFrame:
    """Adds pos (from 0), row_group and block, under the names given.

    The first key's quantiles cut the rows into stretches that keep the order; positions are counted in
    each and shifted by the sizes of those before. Only the bounds and sizes, ``STRETCHES`` of each at most, reach the
    driver. The keys must order the rows wholly for the result to be the same every time. With ``grouped`` the rows of a row
    group are in one partition.
    """
    lead = _ordinal(df, order_by[0])
    seen = df.agg(F.count("*"), F.percentile_approx(lead, [i / FEW for i in range(1, FEW)], 10_000)).first()
    cuts, tasks = min(STRETCHES, -(-seen[0] // stretch)), parts(df, seen[0])
    cut, base = df.withColumn("stretch_", F.lit(0)), F.lit(0).cast("long")
    if cuts > 1:
        # a few quantiles come with the count; a large table asks for more
        got = seen[1][FEW // cuts - 1 :: max(1, FEW // cuts)] if cuts <= FEW else df.agg(F.percentile_approx(lead, [i / cuts for i in range(1, cuts)], 10_000)).first()[0]
        cut = df.withColumn("stretch_", _place(lead, sorted({x for x in got or () if x is not None})))
        total, before = 0, {}
        for r in sorted(cut.groupBy("stretch_").count().collect()):
            before[r["stretch_"]] = total
            total += r["count"]
        if before:
            # a position in an array, not a chain of cases or a map: the work of a row doesn't grow with the stretches
            bases = [before.get(k, 0) for k in range(-1, max(before) + 1)]
            base = F.get(F.array(*[F.lit(x).cast("long") for x in bases]), F.col("stretch_") + 1)
        cut = cut.repartition(tasks, "stretch_")
    row = F.row_number().over(Window.partitionBy("stretch_").orderBy(*order_by))
    out = cut.withColumn(pos, base + row - 1).drop("stretch_").withColumn(row_group, F.floor(F.col(pos) / GROUP))
    out = out.withColumn(block, F.floor(F.col(pos) % GROUP / BLOCK)) if block else out
    return out.repartition(tasks, row_group) if grouped else out


def _ordinal(df: DataFrame, key: str) -> Column:
    """A number that ascends with the key; texts and binaries by their first seven bytes."""
    name = df.schema[key].dataType.simpleString()
    if name in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(F.col(key).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    if name == "boolean":
        return F.col(key).cast("int")
    plain = name in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz") or name.startswith("decimal")
    return F.col(key) if plain else F.lit(0)


def _place(lead: Column, bounds: list) -> Column:
    """How many of the ascending bounds are less than a value, by halving; -1 for a null value."""
    if not bounds:
        return F.when(lead.isNotNull(), F.lit(0)).otherwise(F.lit(-1))
    every = F.array(*[F.lit(x) for x in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    found = lambda x: F.aggregate(steps, F.lit(0), lambda at, step: F.when(x > F.get(every, at + step - 1), at + step).otherwise(at))
    # the one-element list keeps the value from being computed at every step
    return F.when(lead.isNotNull(), F.get(F.transform(F.array(lead), found), F.lit(0))).otherwise(F.lit(-1))


def cells(df: DataFrame, columns: list[str], kind: str = "long") -> DataFrame:
    """(column_name, pos, row_group, block, v): the named columns one under the other.

    Rows that are grouped have gone to their row group's partition before they multiply, so windows and aggregates over a
    column's row groups need no shuffle of cells.
    """
    stack = ", ".join(f"'{c}', cast(`{c}` as {kind})" for c in columns)
    return df.selectExpr("pos", "row_group", "block", f"stack({len(columns)}, {stack}) as (column_name, v)")
