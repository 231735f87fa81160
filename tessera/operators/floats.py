"""Decimal-scaled float columns: the exponent from a sample, integers and exceptions, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bit_length
from .integers import _whole, transform_costs

EXPONENT, SAMPLE, SPAN = 18, 32, 1 << 51


def scaled(v: Column, power: Column) -> Column:
    """The integer of ``v`` times a power of ten if dividing gives ``v`` back bit for bit, else null."""
    i = F.rint(v * power)
    whole = F.when((i >= -SPAN) & (i < SPAN) & ~F.isnan(v), i)
    minus_zero = (v == 0) & v.cast("string").startswith("-")
    return F.when((whole / power == v) & ~minus_zero, whole.try_cast("long"))


def by_value(v: Column, power: Column) -> Column:
    """:func:`scaled` by value, as the SQL twins compare: minus zero is the integer 0, and products count from -SPAN to SPAN, both exclusive."""
    product = v * power
    i = F.rint(product)
    return F.when((F.abs(product) < SPAN) & (i / power == v), i.try_cast("long"))


def _sampled(cells: DataFrame) -> DataFrame:
    """Adds at, the sample's number of a sampled value (null for others): every n-th of a group, 32 at most."""
    w = Window.partitionBy("column_name", "row_group").orderBy("pos")
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(_whole(w)) / SAMPLE))
    at = F.row_number().over(w) - 1
    rows = cells.withColumns({"step": step, "at": at})
    return rows.withColumn("at", F.when((F.col("at") % F.col("step") == 0) & (F.col("at") / F.col("step") < SAMPLE), F.col("at"))).drop("step")


def _powers(most: int) -> list[tuple[int, float]]:
    return [(e, float(10**e)) for e in range(most + 1)]


def exponents(cells: DataFrame, most: int = EXPONENT, exact=scaled) -> DataFrame:
    """(column_name, row_group, exponent, reached, sampled): the smallest exponent that reaches most of at most 32 sampled values."""
    sample = _sampled(cells).where("at IS NOT NULL")
    powers = F.array(*[F.struct(F.lit(e).alias("exponent"), F.lit(p).alias("power")) for e, p in _powers(most)])
    tried = sample.select("column_name", "row_group", "v", F.inline(powers))
    got = tried.groupBy("column_name", "row_group", "exponent").agg(F.count(exact(F.col("v"), F.col("power"))).alias("reached"), F.count("*").alias("sampled"))
    best = F.max_by(F.struct("exponent", "reached", "sampled"), F.struct(F.col("reached"), -F.col("exponent"))).alias("best")
    return got.groupBy("column_name", "row_group").agg(best).select("column_name", "row_group", "best.*")


def with_exponent(cells: DataFrame, exact=scaled) -> DataFrame:
    """Adds each group's exponent, as :func:`exponents` chooses it, by windows alone.

    A sampled value's mask says which exponents give it back; the least exponent that most masks have is the group's.
    """
    w = _whole(Window.partitionBy("column_name", "row_group").orderBy("pos"))
    mask = sum((F.when(exact(F.col("v"), F.lit(p)).isNotNull(), F.lit(1 << e)).otherwise(F.lit(0)) for e, p in _powers(EXPONENT)), F.lit(0))
    rows = _sampled(cells).withColumn("mask", F.when(F.col("at").isNotNull(), mask))
    masks = F.collect_list("mask").over(w)
    hits = lambda e: F.aggregate(masks_, F.lit(0), lambda a, m: a + F.when(m.bitwiseAND(F.lit(1 << e)) != 0, 1).otherwise(0))
    masks_ = F.col("masks")
    best = F.array_max(F.array(*[F.struct(hits(e).alias("reached"), F.lit(-e).alias("low")) for e, _ in _powers(EXPONENT)]))["low"]
    rows = rows.withColumn("masks", masks).withColumn("own", F.when(F.col("at") == 0, -best))
    return rows.withColumn("exponent", F.max("own").over(w)).drop("at", "mask", "masks", "own")


def decimals(cells: DataFrame, chosen: DataFrame | None = None, exact=scaled) -> DataFrame:
    """Adds exponent, is_exception and i: the integer, or the last one before an exception (0 before any).

    The exponent is each group's own unless ``chosen`` (column_name, row_group, exponent) says another.
    """
    rows = with_exponent(cells, exact) if chosen is None else cells.join(chosen.select("column_name", "row_group", "exponent"), ["column_name", "row_group"])
    power = F.element_at(F.array(*[F.lit(p) for _, p in _powers(EXPONENT)]), F.col("exponent") + 1)
    own = exact(F.col("v"), power)
    w = Window.partitionBy("column_name", "row_group").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("own", own)
    return rows.withColumn("is_exception", F.col("own").isNull()).withColumn("i", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit(0))).drop("own")


def decimal_sizes(cells: DataFrame, exact=scaled) -> DataFrame:
    """(column_name, row_group, n, exponent, exceptions, size): bytes of the integers, exceptions counted beside them.

    Exponents, integers and exceptions are windows and aggregates over the same groups: no join, no further shuffle.
    """
    rows = decimals(cells, exact=exact).select("column_name", "pos", "row_group", "block", F.col("i").alias("v"), "exponent", "is_exception")
    blocks = (F.first("exponent").alias("exponent"), F.count_if("is_exception").alias("exceptions"))
    groups = (F.first("exponent").alias("exponent"), F.sum("exceptions").alias("exceptions"))
    return transform_costs(rows, blocks, groups).select("column_name", "row_group", "n", "exponent", "exceptions", (F.col("size") + 6).alias("size"))


def worth_converting(cells: DataFrame, exact=scaled) -> DataFrame:
    """(column_name, row_group, exponent, reached, sampled, worth): whether the sample lets decimals be smaller than bits.

    Half of the sample must be exact; then the integers' spread, and 76 bits for each exception, must not be over the spread
    of the bit patterns (here of the values' order-preserving patterns as decimals, which a double's bits are as a long).
    """
    sample = _sampled(cells).where("at IS NOT NULL").drop("block")
    rows = sample.join(exponents(cells, exact=exact), ["column_name", "row_group"])
    power = F.element_at(F.array(*[F.lit(p) for _, p in _powers(EXPONENT)]), F.col("exponent") + 1)
    rows = rows.withColumn("i", exact(F.col("v"), power)).withColumn("bits", double_bits(F.col("v")))
    got = rows.groupBy("column_name", "row_group", "exponent", "reached", "sampled").agg(*[f(c).alias(f"{n}_{c}") for c in ("i", "bits") for n, f in (("low", F.min), ("high", F.max))])
    far = lambda c: F.try_subtract(F.col(f"high_{c}"), F.col(f"low_{c}"))
    # a spread over the largest signed number has 64 bits
    spread = lambda c: F.when(F.col(f"high_{c}").isNull(), 0).when(far(c).isNull(), 64).otherwise(bit_length(far(c)))
    worth = (F.col("reached") * 2 >= F.col("sampled")) & (spread("i") * F.col("sampled") + 76 * (F.col("sampled") - F.col("reached")) <= spread("bits") * F.col("sampled"))
    return got.select("column_name", "row_group", "exponent", "reached", "sampled", worth.alias("worth"))


def double_bits(v: Column) -> Column:
    """The bit pattern of a finite double as a long, from its sign, exponent and fraction."""
    size = F.abs(v)
    exponent = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(size)).cast("int")))
    # the logarithm may be off by one next to a power of two
    scale = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.when(size < scale(exponent), exponent - 1).when(size >= scale(exponent + 1), exponent + 1).otherwise(exponent)
    exponent = F.greatest(F.lit(-1022), exponent)
    fraction = ((size / scale(exponent) - 1) * F.lit(float(1 << 52))).cast("long")
    whole = F.shiftleft((exponent + 1023).cast("long"), 52) + fraction
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")  # below the normal range the fraction is the value
    pattern = F.when(size == 0, F.lit(0).cast("long")).when(size < F.lit(2.0**-1022), tiny).otherwise(whole)
    minus = (v < 0) | ((v == 0) & v.cast("string").startswith("-"))
    return F.when(minus, pattern.bitwiseOR(F.lit(-(1 << 63)))).otherwise(pattern)
