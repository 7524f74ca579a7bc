"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash of a vector: three rounds of random signs and a fast
Hadamard transform (a pseudo-rotation of the unit vector, padded to a power
of two), then the signed axis that lies nearest, which is the largest
component in size.  Every row is in one bucket of each table.  A query
probes its ``probes`` nearest signed axes in each table; all rows of those
buckets are candidates and are compared exactly, in double precision.

Repeated rows of one id and vector are dropped.  A bucket is cut into blocks
of about ``block`` rows by a hash of id and vector, and its queries into
blocks likewise, so a bucket (or an id) that a third of all rows share is
many small tasks; each block pair returns its best ``k`` ids a query.  The
bucket counts (two numbers for each axis of each table) are the only
thing collected.

Defined results: see ``vector_rows`` for what takes no part; vectors of
different lengths are never compared; repeated rows of one id count once,
with their best score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import scratch, temporary
from keelson.llm.vectors import Ids, matrix, nearest, scaled, vector_rows


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), orthonormal."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotations(x: np.ndarray, tables: int, seed: int):
    """The pseudo-rotated unit vectors, table by table."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    unit = np.zeros((len(x), d))
    unit[:, :x.shape[1]] = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    for t in range(tables):
        signs = np.random.Generator(np.random.PCG64([seed, t, d])).choice([-1.0, 1.0], (3, d))
        y = unit
        for s in signs:
            y = hadamard(y * s)
        yield y


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` signed axes nearest to each row, nearest first: 2 axis + (1 if negative)."""
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    probes = min(probes, both.shape[1])
    best = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, best, axis=1), axis=1, kind="stable")
    return np.take_along_axis(best, order, axis=1)


def hasher(tables: int, probes: int, seed: int):
    """mapInArrow function: ``(vec_id, v)`` with ``buckets``, for each table the ``probes`` nearest axes."""
    def run(batches):
        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                x = matrix(part.column("v"))
                found = [(np.int64(d) * tables + t) * (8 * d) + axes(y, probes)
                         for t, y in enumerate(rotations(x, tables, seed))]
                lists = np.concatenate(found, axis=1)
                yield pa.record_batch({"vec_id": part.column("vec_id"), "v": part.column("v"),
                                       "buckets": pa.array(list(lists), pa.list_(pa.int64()))})
    return run


def best_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int):
    """The ``k`` ids of largest cosine for each query, ties to the smaller id, as three columns.

    The scores of one product only choose; what is returned is summed in one
    fixed order, so equal vectors score equally wherever they stand.
    """
    x, q = scaled(x), scaled(q)
    nx, nq = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    out, groups = ([], [], []), Ids(ids)
    for at in range(0, len(q), 512):
        rough = (q[at:at + 512] / nq[at:at + 512, None]) @ (x / nx[:, None]).T
        rough[query_ids[at:at + 512, None] == ids[None, :]] = -np.inf
        for i, (r, least) in enumerate(zip(rough, groups.bar(rough, k), strict=True), at):
            some = np.flatnonzero((r >= least - 1e-9) & (r > -np.inf))
            score = (x[some] * q[i]).sum(axis=1) / (nx[some] * nq[i])
            keep = groups.best(some, -score, k)
            out[0].extend([query_ids[i]] * len(keep))
            out[1].extend(ids[some][keep].tolist())
            out[2].extend(score[keep].tolist())
    return out


def compared(index: DataFrame, asked: DataFrame, k: int, block: int, query_block: int) -> DataFrame:
    """The ``k`` best ids of each block of a bucket for each query that probes the bucket."""
    def counts(t: DataFrame, name: str, size: int) -> DataFrame:
        return (t.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
                .select("bucket", F.ceil(F.col("n") / size).cast("int").alias(name)))

    # Two numbers for each axis of each table and vector length: bounded, whatever the rows.
    plan = F.broadcast(scratch(counts(index, "rows", block).join(counts(asked, "asks", query_block), "bucket"), "ann-plan"))

    def dealt(t: DataFrame, own: str, other: str):
        at = (t.select("vec_id", "v", F.explode("buckets").alias("bucket")).join(plan, "bucket")
              .withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.col(own)).cast("int"))
              .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))))
        return at.select("bucket", "rows", "asks", "vec_id", "v").groupBy("bucket", "rows", "asks")

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        cols = ([], [], [])
        if one.num_rows and two.num_rows:
            cols = best_of(matrix(one.column("v")), one.column("vec_id").to_numpy(), matrix(two.column("v")),
                           two.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    return dealt(index, "rows", "asks").cogroup(dealt(asked, "asks", "rows")).applyInArrow(
        compare, "query_id long, vec_id long, score double")


def search(df: DataFrame, queries: DataFrame, k: int = 5, tables: int = 12, probes: int = 8, block: int = 2048,
           query_block: int = 1024, seed: int = 11) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row, the ``k`` nearest other ids found.

    ``df``, ``queries``: ``(vec_id, embedding)``.  A query whose buckets hold
    fewer than ``k`` others probes all axes of one table, that is all rows.
    """
    with temporary():
        return scratch(_search(df, queries, k, tables, probes, block, query_block, seed), "ann-result", keep=True)


def _search(df: DataFrame, queries: DataFrame, k: int, tables: int, probes: int, block: int, query_block: int, seed: int) -> DataFrame:
    kind = "vec_id long, v array<double>, buckets array<long>"
    index = scratch(vector_rows(df, False).distinct().mapInArrow(hasher(tables, 1, seed), kind), "ann-index")
    asked = scratch(vector_rows(queries, False).distinct().mapInArrow(hasher(tables, probes, seed), kind), "ann-queries")
    found = scratch(nearest(compared(index, asked, k, block, query_block), k), "ann-found")
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = scratch(asked.select("vec_id", "v").join(enough, "vec_id", "left_anti"), "ann-short")
    if short.isEmpty():
        return found
    one = index.withColumn("buckets", F.slice("buckets", 1, 1))
    every = short.mapInArrow(hasher(1, 1 << 30, seed), kind)
    same_table = F.transform("buckets", lambda b: b + F.size("v").cast("long") * (tables - 1) * (8 * F.size("v")))
    rest = nearest(compared(one, scratch(every.withColumn("buckets", same_table), "ann-every"), k, block, query_block), k)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
