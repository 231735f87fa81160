"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are dealt to blocks of a bounded number of bytes; every block of queries
meets every block of candidates in one task. A tile multiplies int8 codes; with
``x = s*q + e`` the true product differs from ``s_x s_y q_x.q_y`` by at most
``|x^||e_y| + |e_x||y^| + |e_x||e_y|``. Pairs whose upper bound stays below the
k-th best lower bound of their query are dropped, the others are multiplied again
in double precision. Heaps keep a task's k best of each query; of what the tasks
found the k best by rank are the result.

Rows alike in id and vector travel once with their number, so neither an id nor a
vector that holds a third of all rows makes a large block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import grouped, ship

#: Bytes (as doubles) of a block of candidates and of a block of queries: they bound a task's memory. A candidate is sent
#: once for each block of queries, so these are the larger ones.
CANDIDATE_BYTES, QUERY_BYTES = 16 << 20, 32 << 20
#: Candidates and queries multiplied at a time, and components whose int8 products single precision adds exactly.
TILE_ROWS, TILE_QUERIES, EXACT = 2_048, 1_024, 1_024


def clean_vectors(df: DataFrame, id_column: str, column: str, zero: bool) -> DataFrame:
    """(id, v): vectors without null or non-finite components; ``zero`` keeps all-zero ones. Null ids go. Vectors of floats stay so."""
    kind = df.schema[column].dataType.simpleString()
    v = F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    df = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    return df if zero else df.where(F.exists("v", lambda x: x != 0))


def block_join(df: DataFrame, is_query, prepare, k: int, score_type: str, candidate_rows: int = 0, query_rows: int = 0) -> DataFrame:
    """Runs ``prepare(ids, matrix)(query ids, query matrix)`` on each pair of blocks and keeps each query's k best.

    The search returns (query index, candidate index, score) arrays with no more than k entries a query.
    Vectors of different lengths never meet. Rows of a block follow from ``*_BYTES`` unless given.
    """
    spark = df.sparkSession
    ship(spark)
    df = df.groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("d", F.size("v")).withColumn("key", F.xxhash64("id", "v"))
    counts = df.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.coalesce(F.max("d"), F.lit(1)).alias("d")).first()
    # small tables are cut finer, so that all cores have work
    candidate_rows = candidate_rows or min(max(1, CANDIDATE_BYTES // (8 * counts.d)), max(1024, -(-counts.n // spark.sparkContext.defaultParallelism)))
    query_rows = query_rows or max(1, QUERY_BYTES // (8 * counts.d))
    nc, nq = max(1, -(-counts.n // candidate_rows)), max(1, -(-counts.q // query_rows))
    block = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    right = df.withColumn("cb", block(1, nc)).withColumn("qb", every(nq))
    left = df.where(is_query).withColumn("qb", block(2, nq)).withColumn("cb", every(nc))

    @grouped
    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["asks"] == side].sort_values(["id", "key"], kind="stable") for side in (True, False))
        parts = [pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "times": [], "score": []})]
        if len(a) and len(b):
            ids, times = b["id"].to_numpy(), b["times"].to_numpy()
            search = prepare(ids, np.vstack(b["v"].to_list()).astype(np.float64))
            q_ids, q_keys, q = a["id"].to_numpy(), a["key"].to_numpy(), np.vstack(a["v"].to_list()).astype(np.float64)
            for first in range(0, len(a), TILE_QUERIES):
                part = slice(first, first + TILE_QUERIES)
                qi, ci, score = search(q_ids[part], q[part])
                parts.append(pd.DataFrame({"query_id": q_ids[part][qi], "query_key": q_keys[part][qi], "vec_id": ids[ci], "times": times[ci], "score": score}))
        return pd.concat(parts[1:] or parts)

    columns = ["qb", "cb", "d", "id", "key", "v", "times"]
    both = left.select(*columns, F.lit(True).alias("asks")).unionByName(right.select(*columns, F.lit(False).alias("asks")))
    found = both.groupBy("qb", "cb", "d").applyInPandas(tile, f"query_id long, query_key long, vec_id long, times long, score {score_type}")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def int8_codes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes as float32 (their products are exact), scale, norm of what the codes stand for, norm of the rest."""
    scale = np.abs(m).max(1, initial=0) / 127
    scale[~(scale > 0)] = 1.0
    code = np.rint(m / scale[:, None])
    near = code * scale[:, None]
    return code.astype(np.float32), scale, np.sqrt((near * near).sum(1)), np.sqrt(((m - near) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, component after component, so equal vectors give equal scores."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of codes: single precision adds up to EXACT of them without rounding, double precision the rest."""
    out = np.zeros((len(a), len(b)))
    for j in range(0, a.shape[1], EXACT):
        out += a[:, j : j + EXACT] @ b[:, j : j + EXACT].T
    return out


def nearest(k: int):
    """The search of one block for :func:`block_join`."""

    def prepare(ids: np.ndarray, m: np.ndarray):
        tiles = [(first, int8_codes(m[first : first + TILE_ROWS])) for first in range(0, len(ids), TILE_ROWS)]

        def search(q_ids: np.ndarray, q: np.ndarray):
            q_code, q_scale, q_norm, q_rest = int8_codes(q)
            heaps: list[list[tuple[float, int, int]]] = [[] for _ in q_ids]
            for first, (code, scale, norm, rest) in tiles:
                part, part_ids = m[first : first + TILE_ROWS], ids[first : first + TILE_ROWS]
                near = code_products(q_code, code) * q_scale[:, None] * scale
                slack = q_norm[:, None] * rest + q_rest[:, None] * (norm + rest)
                slack = slack * (1 + 1e-9) + 1e-12 * (q_norm + q_rest)[:, None] * (norm + rest)
                low = near - slack
                low[q_ids[:, None] == part_ids] = -np.inf
                floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
                if low.shape[1] > k:
                    floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
                qi, ci = np.nonzero((near + slack >= floor[:, None]) & (q_ids[:, None] != part_ids))
                score = products(q[qi], part[ci])
                for i, s, c, at in zip(qi.tolist(), score.tolist(), part_ids[ci].tolist(), (ci + first).tolist(), strict=True):
                    entry = (s, -c, at)
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], entry)
                    elif entry > heaps[i][0]:
                        heapq.heapreplace(heaps[i], entry)
            rows = [(i, at, s) for i, h in enumerate(heaps) for s, _, at in h]
            return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64)

        return search

    return prepare


def nearest_neighbours(df: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", column: str = "embedding", candidate_rows: int = 0, query_rows: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product with each query.

    ``is_query`` is a predicate on the column ``id``. The bounds are proven for any number of components, so the result
    is exact (recall 1). Null ids, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part; ties go to the smaller id; a query never
    finds rows of its own id. Of a repeated id every row is a candidate of its own; as queries rows of one id with
    different vectors are answered each, ranked from 1 each, rows alike once. An empty table
    gives an empty result; columns other than the two named are not read, so their names can't clash.
    """
    return block_join(clean_vectors(df, id_column, column, zero=False), is_query, nearest(k), k, "double", candidate_rows, query_rows)


def op1_ann_block_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


_CLEAN = """
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""
QUERIES = {"op1_ann_block_int8": op1_ann_block_int8}
ORACLE_SQL = {
    "op1_ann_block_int8": f"""
WITH e AS (SELECT * FROM ({_CLEAN}) WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
