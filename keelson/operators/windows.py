"""Window operators: bounded attempts (W1), gapless numbers and running totals of any size.

``row_number() <= n`` directly over the window lets Catalyst plan a
``WindowGroupLimit`` on the map side of the shuffle: each input partition
forwards at most ``n`` rows per key, so even a key holding a third of all
rows reaches the final window as ``n x partitions`` rows.

``number_rows`` and ``running_totals`` need the order of all rows of a group,
but never one task for a group: rows are range partitioned by group and
order and written once (with their task's number, so that what follows sees
the same cut); each task's part of a group is counted, those counts are summed
in order (a row for each task of a group), and every row adds its part's offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions._util import as_col, as_cols, as_names
from keelson.session import shared_path

DEFAULT_ATTEMPTS = 3


def first_attempts(events: DataFrame, key, order, n: int = DEFAULT_ATTEMPTS,
                   out: str = "attempt") -> DataFrame:
    """The first ``n`` attempts per key, numbered from 1 in ``order`` order.

    ``order`` must be unique within a key (e.g. ``(ts, id)``).
    """
    w = Window.partitionBy(*as_names(key)).orderBy(*as_cols(order))
    return events.withColumn(out, F.row_number().over(w)).where(F.col(out) <= F.lit(n))


def bounded_attempts(events: DataFrame, key, order, is_success, n: int = DEFAULT_ATTEMPTS) -> DataFrame:
    """Outcome of at most ``n`` tries per key.

    ``succeeded`` with ``attempt`` = the first successful try among the first
    ``n``; ``exhausted`` when ``n`` tries were seen without success;
    ``in_progress`` when fewer than ``n`` tries were seen, none successful.
    Tries after the ``n``-th are never looked at.
    """
    keys = as_names(key)
    tried = first_attempts(events.withColumn("_ok", F.coalesce(as_col(is_success), F.lit(False))),
                           keys, order, n)
    per_key = tried.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts_seen"),
        F.min(F.when(F.col("_ok"), F.col("attempt"))).alias("attempt"))
    outcome = (F.when(F.col("attempt").isNotNull(), F.lit("succeeded"))
               .when(F.col("attempts_seen") >= F.lit(n), F.lit("exhausted"))
               .otherwise(F.lit("in_progress")))
    return per_key.withColumn("outcome", outcome)


def _free(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _ranged(df: DataFrame, groups: list[str], orders: list[str], part: str, row: str) -> DataFrame:
    """``df`` cut by ranges of group and order, written with each row's task and its number there."""
    at = shared_path(df.sparkSession, "ranged")
    cut = df.repartitionByRange(*groups, *orders).sortWithinPartitions(*groups, *orders)
    cut = cut.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id())
    cut.write.parquet(at)
    return df.sparkSession.read.schema(cut.schema).parquet(at)


def _with_offsets(rows: DataFrame, groups: list[str], part: str, measure, offset: str, *extra) -> DataFrame:
    """Each row with its group's sum of ``measure`` in the tasks before its own."""
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    size, = _free(rows, "_size")
    parts = rows.groupBy(*groups, part).agg(measure.alias(size), *extra)
    parts = parts.withColumn(offset, F.coalesce(F.sum(size).over(before), F.lit(0)))
    keys = [*groups, part]
    parts = parts.select(*[F.col(k).alias(f"{k}_of_part") for k in keys], offset, *[c for c in parts.columns if c not in (*keys, size, offset)])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_of_part")) for k in keys])
    return rows.join(parts, match).drop(*[f"{k}_of_part" for k in keys])


def number_rows(df: DataFrame, group, order, out: str = "number") -> DataFrame:
    """Each group's rows numbered ``0, 1, 2, ...`` in ``order``, without a gap and without a task for a group.

    ``order`` should be unique within a group (ties are numbered in some
    fixed order).  Runs one job: the range partitioned table is written under
    the shared checkpoint folder.
    """
    groups, orders = as_names(group), as_names(order)
    part, row, offset, first = _free(df, "_part", "_row", "_offset", "_first")
    rows = _ranged(df, groups, orders, part, row)
    rows = _with_offsets(rows, groups, part, F.count(F.lit(1)), offset, F.min(row).alias(first))
    return rows.withColumn(out, F.col(row) - F.col(first) + F.col(offset)).drop(part, row, offset, first)


def running_totals(df: DataFrame, group, order, value: str, out: str = "before") -> DataFrame:
    """Per group and in ``order``, the sum of ``value`` over all rows before each row (0 for the first).

    The window runs within a group's part in one task's range; see ``number_rows``.
    """
    groups, orders = as_names(group), as_names(order)
    part, row, offset = _free(df, "_part", "_row", "_offset")
    rows = _with_offsets(_ranged(df, groups, orders, part, row), groups, part, F.sum(value), offset)
    inside = Window.partitionBy(*groups, part).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col(offset)).drop(part, row, offset)
