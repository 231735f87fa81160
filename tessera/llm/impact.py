"""Exact top-k inner products by an impact-ordered index, score at a time.

A block of candidates becomes an inverted index: for each quantised level of impact, from the
largest down, and each component a posting list (rows, impacts). A pass adds the lists of one
level to the accumulators of all queries still open. What the lists not yet read can add to any
score is at most ``sum |q_j| * (largest impact left in component j)``, so a query closes on proof
only: when at most ``k`` rows, or few enough to rescore, can still belong to the best. Rows that
may belong are rescored exactly on whole vectors. The index of a block is built once for all
queries that meet it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import _CLEAN, block_join, clean_vectors

#: Quantised impacts: a posting's level is the number of the first limit it reaches, as a share of the largest.
LEVELS = (0.75, 0.55, 0.4, 0.28, 0.18, 0.1, 0.04, 0.0)
#: A query with no more possible members than this many times k is closed and rescored.
RESCORE = 4
#: Share of a level's cells from which its lists are added as one product of matrices, which is the same sum.
DENSE = 0.02


class ImpactIndex:
    """Posting lists of a matrix by level and component."""

    def __init__(self, m: np.ndarray) -> None:
        self.m = m
        size = np.abs(m)
        limits = np.array(LEVELS) * float(size.max(initial=0))
        row, component = np.nonzero(size)
        level = len(LEVELS) - np.searchsorted(limits[::-1], size[row, component], "right")
        order = np.lexsort((row, component, level))
        self.row, component, level = row[order], component[order], level[order]
        self.impact = m[self.row, component]
        d = m.shape[1]
        self.start = np.searchsorted(level * d + component, np.arange(len(LEVELS) * d + 1))
        # the largest impact of each component below a level
        self.left = np.stack([np.where(size < limit, size, 0).max(0, initial=0) for limit in limits])

    def add(self, level: int, q: np.ndarray, total: np.ndarray) -> None:
        """Adds the lists of a level to ``total`` (row, query)."""
        d = self.m.shape[1]
        start = self.start[level * d : (level + 1) * d + 1]
        if start[-1] - start[0] > DENSE * self.m.size:
            # lists as columns of a matrix that holds this level alone
            tile = np.zeros_like(self.m)
            tile[self.row[start[0] : start[-1]], np.repeat(np.arange(d), np.diff(start))] = self.impact[start[0] : start[-1]]
            total += tile @ q.T
            return
        for j in np.flatnonzero(np.diff(start)).tolist():
            part = slice(start[j], start[j + 1])
            total[self.row[part]] += np.outer(self.impact[part], q[:, j])

    def search(self, q: np.ndarray, banned: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows for every query; ``banned`` (row, query) pairs are left out."""
        total = np.zeros((len(self.m), len(q)))
        total[banned] = -np.inf
        live = np.arange(len(q))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for level in range(len(LEVELS)):
            self.add(level, q[live], total)
            rest = np.abs(q[live]) @ self.left[level]
            floor = np.partition(total, -k, axis=0)[-k] - rest if len(self.m) > k else np.full(len(live), -np.inf)
            may = (total + rest >= floor) & (total > -np.inf)
            shut = (may.sum(0) <= RESCORE * k) | (level == len(LEVELS) - 1)
            for c in np.flatnonzero(shut).tolist():
                rows = np.flatnonzero(may[:, c])
                score = self.m[rows] @ q[live[c]]
                best = np.lexsort((ids[rows], -score))[:k]
                found.append((np.full(len(best), live[c]), rows[best], score[best]))
            if shut.all():
                break
            if shut.any():
                live, total = live[~shut], total[:, ~shut]
        query, rows, score = (np.concatenate([x[n] for x in found]) for n in range(3))
        return query, rows, score


#: Queries whose accumulators are open at a time.
OPEN = 256


def score_at_a_time(k: int, scale: float):
    def prepare(ids: np.ndarray, m: np.ndarray):
        index = ImpactIndex(np.floor(scale * m))

        def search(q_ids: np.ndarray, q: np.ndarray):
            q, out = np.floor(scale * q), []
            for first in range(0, len(q), OPEN):
                part = slice(first, first + OPEN)
                i, rows, score = index.search(q[part], ids[:, None] == q_ids[part], ids, k)
                out.append((i + first, rows, np.rint(score).astype(np.int64)))
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))

        return search

    return prepare


def top_k(df: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", column: str = "embedding", scale: float = 256.0, candidate_rows: int = 0, query_rows: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of integer vectors ``floor(scale * x)``.

    Exact while scores stay below 2**53. Null ids and vectors that are null, empty or
    hold null or non-finite components take no part; zero vectors do. Ties go to the
    smaller id; a query never finds rows of its own id. Of a repeated id every row is a candidate of its own; as
    queries rows of one id with different vectors are answered each, rows alike once. An empty table gives an empty
    result; other columns are not read, so their names can't clash.
    """
    return block_join(clean_vectors(df, id_column, column, zero=True), is_query, score_at_a_time(k, scale), k, "long", candidate_rows, query_rows)


def op2_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


QUERIES = {"op2_impact_topk": op2_impact_topk}
ORACLE_SQL = {
    "op2_impact_topk": f"""
WITH e AS (SELECT vec_id, list_transform(v, lambda x: CAST(floor(256 * x) AS BIGINT)) AS w FROM ({_CLEAN})),
u AS (SELECT vec_id, unnest(w) AS x, unnest(range(len(w))) AS j, len(w) AS d FROM e),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM u q JOIN u c ON q.j = c.j AND q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
