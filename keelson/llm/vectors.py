"""Shared parts of the two vector searches: valid rows, blocks, the merge of found rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def vector_rows(df: DataFrame, allow_zero: bool) -> DataFrame:
    """``(vec_id, v)``: rows with an id and a vector of finite components, as doubles.

    Left out: null, empty (and unless ``allow_zero`` all-zero) vectors, and
    those that hold a null, a NaN or an infinity.
    """
    rows = df.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows if allow_zero else rows.where(F.exists("v", lambda x: x != 0.0))


def matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each line times a power of two that brings its largest component near 1: the same direction, no square overflows."""
    top = np.abs(x).max(axis=1, initial=0)
    return np.ldexp(x, -np.frexp(top)[1][:, None])


class Ids:
    """The rows of each id in a block, where an id may have several vectors."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.order = np.argsort(ids, kind="stable")
        _, self.first = np.unique(ids[self.order], return_index=True)

    def bar(self, score: np.ndarray, k: int) -> np.ndarray:
        """For each line of ``score`` (a column a row of the block) the ``k``-th largest of the ids' best values."""
        if len(self.first) <= k:
            return np.full(len(score), -np.inf)
        if len(self.first) < len(self.ids):
            score = np.maximum.reduceat(score[:, self.order], self.first, axis=1)
        return np.partition(score, -k, axis=1)[:, -k]

    def best(self, some: np.ndarray, descending: np.ndarray, k: int) -> np.ndarray:
        """The places in ``some`` of the best rows of the ``k`` best ids, by ascending ``descending`` (the negated score)."""
        order = np.lexsort((self.ids[some], descending))
        _, first = np.unique(self.ids[some][order], return_index=True)
        return order[np.sort(first)[:k]]


def nearest(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best of ``found(query_id, vec_id, score)``, ranked from 1; ties to the smaller id."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
