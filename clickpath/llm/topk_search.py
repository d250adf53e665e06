"""Operator 6: exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers, floor(SCALE * x). Candidates are dealt to cells and queries to
groups by a hash; every (cell, group) pair meets in one task of bounded size, each query
group once with every cell. There, a query is a sparse row of (dimension, weight) terms: each
term's posting list (candidates with a weight in that dimension) is scattered, times the
term's weight, into a dense array of scores. A partition selection gives the cell's best,
and the cells' lists are merged per query.

Defined cases: vectors that are null or hold a null or non-finite component take no part,
nor do rows without an id; a query is not its own candidate (nor is a row that repeats
its id); ties go to the smaller id; rows that repeat an id and a vector are one query and
each a candidate; vectors of other lengths count as padded with zeros. Scores are 64-bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SCALE = 1024
#: Rows a cell and a query group, on average.
CELL = 4096
GROUP = 1024


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, e: array<long>) of the rows that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("e")))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    rows = lists.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for k, r in enumerate(rows):
        out[k, :len(r)] = r
    return out


def accumulate(query: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of n candidates: each term of the query scatters its weighted postings."""
    scores = np.zeros(n, np.int64)
    for d in np.flatnonzero(query[:len(postings)]).tolist():
        at, weights = postings[d]
        scores[at] += query[d] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of every row that ``is_query`` holds for."""
    rows = integers(vectors, id_col, vector_col, scale)
    asked = integers(vectors.where(is_query), id_col, vector_col, scale).distinct().withColumn("q", F.xxhash64("id", "e"))
    cells = max(1, -(-rows.count() // CELL))
    groups = max(1, -(-asked.count() // GROUP))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(cells)).cast("int")).withColumn("grp", spread(groups))
    queries = asked.withColumn("grp", F.pmod(F.xxhash64(F.lit(2), "q"), F.lit(groups)).cast("int")).withColumn("cell", spread(cells))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, e = left.column("id").to_numpy(), _matrix(left.column("e"))
        asked_ids, marks, q = right.column("id").to_numpy(), right.column("q").to_numpy(), _matrix(right.column("e"))
        lists = [(at := np.flatnonzero(e[:, d]), e[at, d]) for d in range(e.shape[1])]
        out = [np.zeros((0, 4), np.int64)]
        for own, mark, terms in zip(asked_ids, marks, q):
            scores = accumulate(terms, lists, len(ids))
            others = np.flatnonzero(ids != own)
            top = others[best(scores[others], ids[others], k)]
            out.append(np.column_stack([np.full(len(top), own), np.full(len(top), mark), ids[top], scores[top]]))
        table = np.concatenate(out)
        return pa.table([pa.array(table[:, c].copy()) for c in range(4)], names=["query_id", "q", "id", "score"])

    schema = StructType([StructField(c, LongType()) for c in ("query_id", "q", "id", "score")])
    found = (candidates.groupBy("cell", "grp").cogroup(queries.groupBy("cell", "grp")).applyInArrow(score, schema))
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
