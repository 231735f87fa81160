"""A synthetic set of shop tables with exact totals, drawn from hashes of the row's number alone.

Everything follows from a seed and the numbers of rows, whatever the partitioning, so a table is the same on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 7


def share(*parts: Column | str) -> Column:
    """A number from 0 to below 1 that the parts choose."""
    return F.pmod(F.xxhash64(F.lit(SEED), *[F.lit(p) if isinstance(p, str) and not p.isidentifier() else p for p in parts]), F.lit(1 << 30)) / F.lit(float(1 << 30))


def below(n: int, *parts: Column | str) -> Column:
    return F.floor(share(*parts) * n)


def tail(rate: float, *parts: Column | str) -> Column:
    """A whole number from 1 on, where each further one is ``rate`` times as frequent."""
    return 1 + F.floor(F.log(F.lit(1.0) - share(*parts)) / F.log(F.lit(rate)))


def shops(spark: SparkSession, rows: int) -> DataFrame:
    """(shop, town, opened, area): towns repeat, areas are whole square metres."""
    n = spark.range(rows).withColumnRenamed("id", "shop")
    return n.select("shop", F.concat(F.lit("town "), below(40, "shop", F.lit(1)).cast("string")).alias("town"), F.date_add(F.lit("2001-03-01").cast("date"), below(6000, "shop", F.lit(2)).cast("int")).alias("opened"), (60 + below(900, "shop", F.lit(3))).alias("area"))


def goods(spark: SparkSession, rows: int) -> DataFrame:
    """(item, label, cents, tags): prices in steps of five cents, up to three tags."""
    n = spark.range(rows).withColumnRenamed("id", "item")
    tags = F.transform(F.sequence(F.lit(0).cast("long"), below(3, "item", F.lit(4))), lambda k: F.concat(F.lit("tag"), below(12, "item", k, F.lit(5)).cast("string")))
    return n.select("item", F.concat(F.lit("item no. "), F.col("item").cast("string")).alias("label"), (5 * tail(0.995, "item", F.lit(6))).alias("cents"), tags.alias("tags"))


def receipts(spark: SparkSession, rows: int, shops: int = 30, goods: int = 1000) -> DataFrame:
    """(receipt, shop, minute, lines, net, vat, gross): net is the sum of the lines, vat a fifth of it rounded down, gross both."""
    n = spark.range(rows).withColumnRenamed("id", "receipt")
    line = lambda k: F.struct(below(goods, "receipt", k, F.lit(7)).alias("item"), tail(0.4, "receipt", k, F.lit(8)).alias("pieces"), (5 * tail(0.995, "receipt", k, F.lit(9))).alias("cents"))
    n = n.withColumn("lines", F.transform(F.sequence(F.lit(1).cast("long"), tail(0.8, "receipt", F.lit(10))), line))
    net = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["pieces"] * x["cents"])
    n = n.withColumn("net", net).withColumn("vat", F.floor(F.col("net") / 5))
    return n.select("receipt", below(shops, "receipt", F.lit(11)).alias("shop"), (F.col("receipt") * 3 + below(3, "receipt", F.lit(12))).alias("minute"), "lines", "net", "vat", (F.col("net") + F.col("vat")).alias("gross"))


def readings(spark: SparkSession, rows: int) -> DataFrame:
    """(reading, shop, celsius, open, note): a tenth of the temperatures are unknown, notes are rare."""
    n = spark.range(rows).withColumnRenamed("id", "reading")
    celsius = F.when(share("reading", F.lit(13)) >= 0.1, F.round(15 + 10 * share("reading", F.lit(14)), 1))
    return n.select("reading", below(30, "reading", F.lit(15)).alias("shop"), celsius.alias("celsius"), (share("reading", F.lit(16)) < 0.6).alias("open"), F.when(share("reading", F.lit(17)) < 0.02, F.lit("door left open")).alias("note"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, sum, xor): of the hashes of all rows, so in whatever order they come; equal frames have equal ones."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("sum"), F.bit_xor(row).alias("xor"))
