"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components are integers.  Repeated rows of one id and vector are dropped;
the rows are dealt into blocks by a hash of both, so an id of many vectors
is in many blocks.  A block's index is its posting segments: all postings ``(row,
dimension, value)`` whose size falls in one level of ``levels`` equal steps,
stored by descending level, the quantised impact; and what each row's
values beyond a segment still amount to (their Euclidean length).

A block of queries meets a block of rows in one task.  Segments are
processed by descending impact; each adds its postings to the score
accumulators, list by list of a dimension where the segment is sparse (as
those of high impact are) and as one product where it is not.  After a segment, the rest of a score is at most the product
of the lengths of the query and of what is left of the row.  A query stops
only when that proves that no more than a few rows can be members; those
possible members are scored exactly, in integers, and the best ``k`` ids of
each block are merged.  The bar is the ``k``-th best id's, not row's.

Defined results: see ``vector_rows`` for what takes no part (zero vectors
do); vectors of different lengths are never compared; repeated rows of one
id count once, with their best score; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import scratch, temporary
from keelson.llm.vectors import Ids, matrix, nearest, vector_rows

#: Steps of a posting list that cost as much as one of a matrix product.
SPARSE = 32
SEGMENT = "block int, dim int, impact int, ids binary, rows binary, dims binary, vals binary, rest binary"


def segments(block: pa.Table, levels: int) -> pa.Table:
    """The posting segments of a block, by descending quantised impact (the first also names the rows)."""
    ids, x = block.column("vec_id").to_numpy(), matrix(block.column("v"))
    size = np.abs(x)
    step = max(1.0, float(np.ceil((size.max(initial=0) + 1) / levels)))
    level = (size // step).astype(np.int64)
    left = (x * x).sum(axis=1)
    out = []
    for impact in range(levels - 1, -1, -1):
        dim, row = np.nonzero(((level == impact) & (x != 0)).T)  # by dimension
        if len(row) == 0 and impact:
            continue
        values = x[row, dim]
        left = left - np.bincount(row, values * values, minlength=len(ids))
        out.append({"block": block.column("block")[0].as_py(), "dim": x.shape[1], "impact": impact,
                    "ids": ids.astype(np.int64).tobytes() if not out else b"", "rows": row.astype(np.int32).tobytes(),
                    "dims": dim.astype(np.int32).tobytes(), "vals": values.tobytes(),
                    "rest": np.sqrt(np.maximum(left, 0)).tobytes()})
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("impact", pa.int32())] + [
        (c, pa.binary()) for c in ("ids", "rows", "dims", "vals", "rest")]))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows with ``q``; Python integers where doubles would round."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2**53:
        return (x * q).sum(axis=1).astype(np.int64)
    full = [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in x]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in full], np.int64)


def accumulate(score: np.ndarray, q: np.ndarray, rows: np.ndarray, dims: np.ndarray, values: np.ndarray) -> None:
    """Add the postings' products with ``q`` to ``score`` (queries by rows); postings come by dimension.

    A list of ``n`` postings costs ``n`` steps a query, a product of matrices
    ``SPARSE`` times fewer for each place: whichever is less is done.
    """
    if len(rows) * SPARSE < score.shape[1] * q.shape[1]:
        cuts = np.flatnonzero(np.concatenate([[True], dims[1:] != dims[:-1], [True]])) if len(dims) else []
        for a, b in zip(cuts[:-1], cuts[1:]):  # a row stands once in a dimension's list
            score[:, rows[a:b]] += q[:, dims[a], None] * values[None, a:b]
        return
    postings = np.zeros((score.shape[1], q.shape[1]))
    postings[rows, dims] = values
    score += q @ postings.T


def score_at_a_time(index: list[dict], q: np.ndarray, query_ids: np.ndarray, k: int, few: int = 64):
    """The best ``k`` ids of a block for each query: ``(query ids, row ids, scores)``, and the postings touched.

    ``index``: the block's segments by descending impact.  A touched posting
    is one that was added to one query's accumulators.
    """
    ids = np.frombuffer(index[0]["ids"], np.int64)
    groups, touched = Ids(ids), 0
    x = np.zeros((len(ids), q.shape[1]))
    score = np.zeros((len(q), len(ids)))
    own = query_ids[:, None] == ids[None, :]
    length = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-9)
    going = np.arange(len(q))
    members: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
    for n, segment in enumerate(index):
        rows, dims = np.frombuffer(segment["rows"], np.int32), np.frombuffer(segment["dims"], np.int32)
        values = np.frombuffer(segment["vals"], np.float64)
        x[rows, dims] = values
        if len(going) == len(q):
            accumulate(score, q, rows, dims, values)
        else:
            some = score[going]
            accumulate(some, q[going], rows, dims, values)
            score[going] = some
        touched += len(rows) * len(going)
        rest = np.frombuffer(segment["rest"], np.float64)
        slack = length[going, None] * rest[None, :] + 1e-6 + np.abs(score[going]) * 1e-12
        low, high = score[going] - slack, score[going] + slack
        low[own[going]] = high[own[going]] = -np.inf
        bar = groups.bar(low, k)
        possible = (high >= bar[:, None]) & ~own[going]
        count, last = possible.sum(axis=1), n == len(index) - 1
        done = (count <= few) | last
        for i in np.flatnonzero(done):
            members[going[i]] = np.flatnonzero(possible[i])
        going = going[~done]
        if not len(going):
            break
    for segment in index[n + 1:]:  # the rest of the values, for the exact scores
        rows, dims = np.frombuffer(segment["rows"], np.int32), np.frombuffer(segment["dims"], np.int32)
        x[rows, dims] = np.frombuffer(segment["vals"], np.float64)
    out = [], [], []
    for i, some in enumerate(members):
        s = exact(x[some], q[i])
        keep = groups.best(some, -s.astype(object) if len(s) and s.min() == -(2**63) else -s, k)
        out[0].extend([query_ids[i]] * len(keep))
        out[1].extend(ids[some][keep].tolist())
        out[2].extend(s[keep].tolist())
    return out, touched


def search(df: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = 4096, query_block: int = 512,
           levels: int = 8) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row, the ``k`` other ids of largest inner product.

    ``df``, ``queries``: ``(vec_id, embedding)``; a component x counts as ``floor(scale x)``.
    """
    with temporary():
        return scratch(_search(df, queries, k, scale, block, query_block, levels), "topk-result", keep=True)


def _search(df: DataFrame, queries: DataFrame, k: int, scale: int, block: int, query_block: int, levels: int) -> DataFrame:
    def whole(t: DataFrame) -> DataFrame:
        return vector_rows(t, True).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"),
                                           F.size("v").alias("dim")).distinct()

    rows, asked = scratch(whole(df), "topk-rows"), scratch(whole(queries), "topk-queries")
    n_rows, n_asked = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // query_block))

    def build(table: pa.Table) -> pa.Table:
        return segments(table, levels)

    index = scratch(rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_rows)).cast("int"))
                    .groupBy("block", "dim").applyInArrow(build, SEGMENT), "topk-index")

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        cols = ([], [], [])
        if one.num_rows and two.num_rows:
            order = sorted(one.to_pylist(), key=lambda s: -s["impact"])
            cols, _ = score_at_a_time(order, matrix(two.column("v")), two.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.int64())})

    # Every block of queries meets every block of rows: the stated query set against all rows.
    left = index.withColumn("asks", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = (asked.withColumn("asks", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_asked)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))))
    found = (left.groupBy("block", "dim", "asks").cogroup(right.groupBy("block", "dim", "asks"))
             .applyInArrow(compare, "query_id long, vec_id long, score long"))
    return nearest(found, k)
