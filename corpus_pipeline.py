"""From raw documents to packed training sequences, one operator a stage.

A document that is toxic goes; of near duplicates one stays; passages that repeat are cut;
secrets are masked; what is left is packed. Every stage works on all rows that the one before it
kept, and its rows are written as Parquet before the next reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.ngram_join import ngram_jaccard_join, text_key
from tessera.llm.packing import pack
from tessera.llm.secrets import redact
from tessera.llm.suffix_dedup import cut_repeats
from tessera.llm.toxicity import THRESHOLD, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; others go, as later stages could not tell whose they are."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold.

    Null and empty texts have no evidence and stay; every row is judged by its own text, so repeated rows and
    repeated doc_ids stay or go each for itself; an empty table gives an empty one.
    """
    rows = score(_documents(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=COLUMNS[1:])
    return rows.where(F.col("score") < THRESHOLD).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document: that of smallest doc_id.

    Rows without doc_id or without words are in no group and stay. Where a doc_id comes with several texts each
    is judged by its own group; of rows equal in doc_id and words one stays. An empty table gives an empty one.
    """
    docs = _documents(docs).withColumn("text_key", text_key(F.col("text")))
    found = ngram_jaccard_join(docs, keys=True).where("doc_id IS NOT NULL AND n_shingles > 0")
    stays = F.col("keeper") & (F.col("doc_id") == F.col("component_id"))
    out = docs.join(found.where(~stays).select("doc_id", "text_key").distinct(), ["doc_id", "text_key"], "left_anti")
    again = found.where(stays).groupBy("doc_id").agg(F.count("*").alias("rows_")).where("rows_ > 1").select("doc_id")
    if again.limit(1).count():
        # one row of each set; rows whose text has no words are not among the found ones
        sets = found.where(stays).join(again, "doc_id", "left_semi").select("doc_id", "text_key", "key").distinct()
        once = out.join(sets, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "key"]).drop("key")
        out = out.join(sets, ["doc_id", "text_key"], "left_anti").unionByName(once)
    return out.select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages cut.

    Where nothing is cut the text stays as it is, null texts too; a cut within a character takes the whole
    character; repeated rows lose what they repeat, all of it if it is long enough; an empty table gives an empty one.
    """
    docs = _documents(docs)
    rows = cut_repeats(docs, carry=("lang", "source"), as_text=True)
    return rows.select("doc_id", "text", "lang", "source").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets masked.

    Null and empty texts, repeated rows and rows without doc_id stay as they are; n_chars is null for a null text;
    an empty table gives an empty one.
    """
    return redact(_documents(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences: null and empty texts as one closing id, repeated rows each by itself; none of an empty table."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: Learned scores and components of links have no SQL; tests/llm/test_pipeline.py compares the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"{k}-{name}")
            if k:
                scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")  # the last input stays: the result reads it
    return docs
