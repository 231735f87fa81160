"""Token counts from an exact histogram of encoded lengths.

Documents are encoded once and counted by length. Sums over all longer lengths answer
totals, quantiles and truncated totals for every context limit; they are taken in two
levels (blocks of lengths, then within a block), so no window holds the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partition, ship, slices
from .tokens import encoder

BLOCK = 1024


def histogram(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """(length, n_docs): how many rows of ``docs`` have so many ids. Null and empty texts have none."""

    @partition
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = encoder(tokenizer).encode([(t or "").encode() for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64())], ["length"])

    ship(docs.sparkSession)
    lengths = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "length long")
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length as a context limit: documents and tokens at it, of at least it, and what truncation keeps.

    Columns length, n_docs, n_tokens, docs_at_least, tokens_at_least, docs_below, truncated_total
    (the sum of min(own length, limit)), total_docs, total_tokens. The smallest length whose
    docs_below + n_docs reaches q * total_docs is the q-quantile.
    """
    hist = Scratch(hist.sparkSession).save(hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK)), "lengths")
    whole = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("later_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, "block").select(
        "length", "n_docs", "n_tokens",
        (F.col("later_docs") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("later_tokens") + F.sum("n_tokens").over(inside)).alias("tokens_at_least"),
    )
    out = out.withColumn("docs_below", F.lit(whole.d) - F.col("docs_at_least"))
    out = out.withColumn("truncated_total", F.lit(whole.t) - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"))
    return out.withColumn("total_docs", F.lit(whole.d)).withColumn("total_tokens", F.lit(whole.t))


def answer(sums: DataFrame, limits: list[int], quantiles: list[float]) -> DataFrame:
    """(kind, parameter, value) for any context limits and quantiles, looked up in :func:`suffix_sums`.

    A limit is answered by the least length that reaches it: what is at least so long counts as the limit, all else whole.
    The q-quantile is the least length that docs_below + n_docs says q of all documents reach. One pass for all; nulls of an empty table.
    """
    found = [F.min(F.when(F.col("length") >= limit, F.struct("length", "docs_at_least", "tokens_at_least"))).alias(f"limit_{k}") for k, limit in enumerate(limits)]
    found += [F.min(F.when(F.col("docs_below") + F.col("n_docs") >= F.lit(q) * F.col("total_docs"), F.col("length"))).alias(f"quantile_{k}") for k, q in enumerate(quantiles)]
    one = sums.agg(F.max("total_tokens").alias("total"), *found)
    rows = []
    for k, limit in enumerate(limits):
        at = F.col(f"limit_{k}")
        kept = F.col("total") - F.coalesce(at["tokens_at_least"] - limit * at["docs_at_least"], F.lit(0))
        rows.append(F.struct(F.lit("truncated_total").alias("kind"), F.lit(float(limit)).alias("parameter"), kept.cast("long").alias("value")))
    rows += [F.struct(F.lit("quantile").alias("kind"), F.lit(float(q)).alias("parameter"), F.col(f"quantile_{k}").cast("long").alias("value")) for k, q in enumerate(quantiles)]
    return one.select(F.inline(F.array(*rows)))


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """:func:`suffix_sums` of the rows of ``docs``: one row for each length that occurs.

    Null and empty texts count as documents of length 0; rows repeated count each time;
    whole texts are encoded; an empty table gives an empty result; other columns are not read.
    """
    return suffix_sums(histogram(docs, tokenizer))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_token_counts": op9_token_counts}
