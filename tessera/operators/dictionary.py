"""Dictionaries of text columns: values by first appearance, whether one pays, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bit_length, length_prefix

SAMPLE, ENTRIES = 1024, 1 << 16


def values(cells: DataFrame) -> DataFrame:
    """(column_name, value, first_pos, uses) of every distinct value but null."""
    return cells.where("v IS NOT NULL").groupBy("column_name", F.col("v").alias("value")).agg(F.min("pos").alias("first_pos"), F.count("*").alias("uses"))


def build(cells: DataFrame) -> DataFrame:
    """(column_name, id, value, first_pos, uses): ids from 0 by first appearance. Nulls have none.

    A column of more than 65536 values never pays, so it gets no dictionary; what is numbered in one task is bounded by that.
    """
    got = values(cells)
    # uses and positions are asked for, always true, so that both sides read the values of one exchange: the cells are made once
    counts = got.groupBy("column_name").agg(F.count("*").alias("entries"), F.sum("uses").alias("uses"), F.min("first_pos").alias("first_pos"))
    small = counts.where((F.col("entries") <= ENTRIES) & (F.col("uses") > 0) & F.col("first_pos").isNotNull()).select("column_name")
    return got.join(small, "column_name", "left_semi").withColumn("id", F.row_number().over(Window.partitionBy("column_name").orderBy("first_pos")) - 1)


def decide(cells: DataFrame) -> DataFrame:
    """Whether each column, taken as one table of one message, pays as a dictionary.

    A column is refused if over 7/8 of its first 1024 rows are new values, if over half of its rows are, if it has
    more than 65536 values or only empty ones, and if ids, entries and their counts don't cost less than the texts.
    """
    size = F.octet_length("value") + length_prefix(F.octet_length("value"))
    # the values and their uses say what the rows do: cells are made and grouped once
    rows = values(cells).groupBy("column_name").agg(
        F.sum("uses").alias("n"), F.sum(F.col("uses") * size).alias("raw"), F.max(F.octet_length("value")).alias("longest"),
        F.count("*").alias("entries"), F.sum(size).alias("added"), F.count_if(F.col("first_pos") < SAMPLE).alias("early"),
    )
    width = bit_length(F.col("entries") - 1)
    ids = F.floor((F.col("n") * width + 7) / 8) + F.floor((F.col("n") + 127) / 128) + 1
    cost = F.col("added") + ids + length_prefix(F.col("entries")) + 1
    refused = (F.col("early") > SAMPLE * 7 // 8) | (F.col("entries") > F.floor(F.col("n") / 2)) | (F.col("entries") > ENTRIES) | (F.col("longest") == 0) | (F.col("cost") >= F.col("raw"))
    return rows.withColumn("cost", cost).select("column_name", "n", "entries", "raw", "cost", (~refused).alias("accepted"))


def encode(cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(column_name, pos, id); a null value has a null id. The entries of a column that pays are at most 65536."""
    return cells.join(dictionary.select("column_name", F.col("value").alias("v"), "id"), ["column_name", "v"], "left").select("column_name", "pos", "id")


def decode(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    return encoded.join(dictionary.select("column_name", "id", F.col("value").alias("v")), ["column_name", "id"], "left").select("column_name", "pos", "v")
