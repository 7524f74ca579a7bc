"""Aggregations: unique keys, all-of, last-write-wins properties, rendering,
topology lists and readiness with a deadline (A1-A6).

Every aggregate here is one Catalyst ``Aggregate``.  Count, min, max_by and
every combine map-side, so a hot key is a row a task at the shuffle; a
``collect_list`` does not shrink (its buffer holds every value) and is used
only where the value itself is the result.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions._util import as_col, as_cols, as_names
from keelson.functions.order import packed_order
from keelson.functions.text import escape_backslash, service_uri
from keelson.functions.times import elapsed_micros
from keelson.operators.windows import number_rows


# --------------------------------------------------------------------- A1
#: Slots of the fixed-size count that goes before an exact one.
SLOTS = 1 << 24


def _counted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def duplicate_keys(df: DataFrame, key, slots: int | None = None) -> DataFrame:
    """A1 report: every key value that occurs more than once, with its count.

    With ``slots`` (such as ``SLOTS``; worth it for wide keys that rarely
    repeat) rows are first counted by a hash of the key into that many slots:
    a table of fixed size, whatever the number and width of the keys.  Only
    rows of a slot that was met twice can be duplicates; those are counted
    exactly, so the keys that cross the second shuffle fall to them.  Where
    all slots are met twice the result is the same and only the saving goes.
    """
    keys = as_names(key)
    if slots is None:
        return _counted(df, keys)
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots))
    twice = df.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_slot")
    possible = df.select(*keys, slot.alias("_slot")).join(twice, "_slot", "left_semi")
    return _counted(possible, keys)


def unique_index(df: DataFrame, key, on_duplicate: str = "fail", slots: int | None = None) -> DataFrame:
    """A1: make ``key`` an enforced unique key of ``df``.

    ``on_duplicate``:
      * ``"fail"``   – run the duplicate check now (one action: the keyed
        count, map-side combined; at most one duplicate row reaches the
        driver) and raise ``ValueError``; else return ``df``.
      * ``"report"`` – return the duplicate report instead (lazy).
    """
    report = duplicate_keys(df, key, slots)
    if on_duplicate == "report":
        return report
    if on_duplicate != "fail":
        raise ValueError(f"unknown on_duplicate mode {on_duplicate!r}")
    found = report.limit(1).collect()
    if found:
        raise ValueError(f"duplicate key in unique index: {found[0].asDict()}")
    return df


# --------------------------------------------------------------------- A2
def all_of(groups: DataFrame, members: DataFrame, on, predicate, out: str = "all_ok") -> DataFrame:
    """A2: per group, does ``predicate`` hold for every member?

    A group without members is true (like ``All`` over an empty list);
    ``every`` alone would give NULL there.  A NULL predicate counts as false.
    """
    keys = as_names(on)
    per_group = members.groupBy(*keys).agg(
        F.every(F.coalesce(as_col(predicate), F.lit(False))).alias(out))
    return (groups.join(per_group, keys, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(True))))


# --------------------------------------------------------------------- A3
def resolve_properties(writes: DataFrame, entity, key: str, value: str, order,
                       pos: str = "pos") -> DataFrame:
    """A3: last write wins per ``(entity, key)``; keep the first write's position.

    ``order`` columns must be unique within an entity (e.g. ``(ts, id)``) so
    the winner is deterministic (of equal ones the largest value wins).
    ``pos`` is ``struct(order...)`` of the first write, the order in which
    the key entered the document.

    Where the order columns fit in one number (``packed_order``), values stay
    out of the aggregate: a hash aggregate finds each key's largest and
    smallest order, and the winner's value is fetched by a join on entity,
    key and order — a broadcast where AQE measures the winners as small, and
    otherwise a join whose rows the order spreads, however hot a key is.
    Other orders are resolved by ``max_by`` (a sort aggregate).
    """
    ents = as_names(entity)
    orders = as_names(order)
    packed = packed_order(writes.schema, orders)
    if packed is None:
        seq = F.struct(*as_cols(orders))
        return writes.groupBy(*ents, key).agg(F.max_by(F.col(value), seq).alias(value), F.min(seq).alias(pos))
    number, unpack = packed
    keys = [*ents, key]
    rows = writes.select(*keys, F.col(value).alias("_value"), number.alias("_at"))
    found = rows.groupBy(*keys).agg(F.max("_at").alias("_last"), F.min("_at").alias("_first"))
    found = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_last", "_first")
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_at") == F.col("_last")]
    won = rows.join(found, reduce(lambda a, b: a & b, match))
    # One row a key, unless writes of the same order tie.
    return (won.groupBy(*keys).agg(F.array_max(F.collect_set("_value")).alias(value), F.min("_first").alias("_first"))
            .select(*keys, value, unpack(F.col("_first")).alias(pos)))


# --------------------------------------------------------------------- A4
def collect_properties(resolved: DataFrame, entity, key: str, value: str, pos: str = "pos",
                       out: str = "props") -> DataFrame:
    """A4, first half: per entity, the ``(p, k, v)`` array in ``pos`` order.

    Runs on A3 output, where a group holds one row per distinct key of the
    entity, not one per write.
    """
    ents = as_names(entity)
    listed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(key).alias("k"),
                                                  F.col(value).alias("v"))))
    return resolved.groupBy(*ents).agg(listed.alias(out))


def render_document(props, value_fn=None) -> Column:
    """A4, second half: ``key=value`` lines joined by ``\n``, no trailing newline.

    Backslashes in values are doubled, nothing else is escaped.
    ``value_fn`` may rewrite each value first (e.g. fill placeholders from
    the row's other columns); it runs inside the array, row-locally.
    """
    fn = value_fn or (lambda v: v)
    return F.array_join(F.transform(as_col(props), lambda x: F.concat(x["k"], F.lit("="),
                                                                      escape_backslash(fn(x["v"])))), "\n")


def render_properties(resolved: DataFrame, entity, key: str, value: str, pos: str = "pos",
                      out: str = "document", entities: DataFrame | None = None) -> DataFrame:
    """A4: one properties document per entity (``collect_properties`` + ``render_document``).

    With ``entities``, entities without rows get ``''``.
    """
    ents = as_names(entity)
    rendered = (collect_properties(resolved, ents, key, value, pos, out="_props")
                .select(*ents, render_document("_props").alias(out), F.size("_props").cast("long").alias("n_keys")))
    if entities is None:
        return rendered
    return (entities.select(*ents).join(rendered, ents, "left")
            .select(*ents, F.coalesce(F.col(out), F.lit("")).alias(out),
                    F.coalesce(F.col("n_keys"), F.lit(0).cast("long")).alias("n_keys")))


def property_lines(resolved: DataFrame, entity, key: str, value: str, pos: str = "pos",
                   out: str = "line") -> DataFrame:
    """A4 in line form: one ``key=value`` row per property, no grouping.

    This is the unbounded-size path: the sink orders lines inside each
    entity's file with a sort, so no document is ever built in memory.
    """
    ents = as_names(entity)
    return resolved.select(*ents, F.col(pos),
                           F.concat(F.col(key), F.lit("="), escape_backslash(F.col(value))).alias(out))


# --------------------------------------------------------------------- A5
def topology_pieces(services: DataFrame, group, host: str, port: str, order: str,
                    sep: str = ",", chunk: int = 4096) -> DataFrame:
    """A5, the unbounded form: ``(group, bucket, piece, n)``.

    A bucket is the integral ``order`` column divided by ``chunk``; its piece
    lists its ``http://host:port/`` in order.  Pieces of a group, taken by
    bucket, are its list; no value grows with the group.
    """
    grp = as_names(group)
    uri = service_uri(F.col(host), F.col(port))
    return (services
            .select(*grp, F.col(order).alias("_o"), uri.alias("_u"))
            .groupBy(*grp, F.floor(F.col("_o") / F.lit(chunk)).alias("bucket"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_u"))),
                                          lambda x: x["_u"]), sep).alias("piece"),
                 F.count(F.lit(1)).alias("n")))


def topology(services: DataFrame, group, host: str, port: str, order: str,
             out: str = "topology", sep: str = ",", chunk: int = 4096) -> DataFrame:
    """A5: per group, the ``http://host:port/`` list in ``order`` order, as text.

    For groups whose whole list is one readable value; where a group may be
    of any size, use ``topology_pieces``.
    """
    grp = as_names(group)
    return (topology_pieces(services, grp, host, port, order, sep, chunk).groupBy(*grp)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "piece"))),
                                          lambda x: x["piece"]), sep).alias(out),
                 F.sum("n").alias("instances")))


def topology_pages(services: DataFrame, group, host: str, port: str, order, page_rows: int = 4096, sep: str = ",") -> DataFrame:
    """A5 in pages of ``page_rows`` endpoints: ``(group, page, piece, n)``, whatever the order's values.

    ``topology_pieces`` cuts by the value of an integral order, so its pieces
    may hold few rows; here rows are numbered first (``number_rows``), so
    every page but a group's last is full.
    """
    grp = as_names(group)
    numbered = number_rows(services.select(*grp, *as_names(order), service_uri(F.col(host), F.col(port)).alias("_u")), grp, order, "_n")
    listed = F.array_sort(F.collect_list(F.struct("_n", "_u")))
    return (numbered.groupBy(*grp, F.expr(f"_n div {int(page_rows)}").alias("page"))
            .agg(F.array_join(F.transform(listed, lambda x: x["_u"]), sep).alias("piece"), F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------- A6
def timeout_micros(timeout) -> int:
    """``timedelta`` or integer microseconds -> integer microseconds."""
    if isinstance(timeout, _dt.timedelta):
        return (timeout.days * 86_400 + timeout.seconds) * 1_000_000 + timeout.microseconds
    return int(timeout)


def first_success_within(events: DataFrame, key, ts: str, is_success, timeout) -> DataFrame:
    """Was the first success strictly before ``first event + timeout``?

    Per key: ``started`` (first event), ``first_ok`` (first success),
    ``ready`` (``first_ok - started < timeout``; the deadline itself is
    too late), ``seconds`` (elapsed, rounded to 2 places, only when
    ready) and ``status`` (``ready`` / ``timed_out``).
    ``timeout`` is a ``timedelta`` or microseconds.
    """
    keys = as_names(key)
    limit_us = timeout_micros(timeout)
    per_key = events.groupBy(*keys).agg(
        F.min(F.col(ts)).alias("started"),
        F.min(F.when(as_col(is_success), F.col(ts))).alias("first_ok"))
    return judge_readiness(per_key, limit_us)


def judge_readiness(per_key: DataFrame, limit_us: int) -> DataFrame:
    """Shared A6/T1 rule on ``(started, first_ok)`` rows."""
    # Elapsed time by zone-free arithmetic (see keelson.functions.times);
    # seconds to two places, half-up, in integer microseconds so the
    # rounding is exact (no binary-fraction ties).
    zoneless = isinstance(per_key.schema["started"].dataType, T.TimestampNTZType)
    return (per_key
            .withColumn("_us", elapsed_micros("started", "first_ok", zoneless))
            .withColumn("ready", F.coalesce(F.col("_us") < F.lit(limit_us), F.lit(False)))
            .withColumn("seconds", F.when(F.col("ready"), F.expr("(_us + 5000) div 10000") / F.lit(100.0)))
            .withColumn("status", F.when(F.col("ready"), F.lit("ready")).otherwise(F.lit("timed_out")))
            .drop("_us"))


def all_running(state: DataFrame, kinds: DataFrame, kind: str = "kind",
                running: str = "is_running") -> DataFrame:
    """A2 as the reference's health assertion: per kind, are all instances running?"""
    return all_of(kinds, state, kind, F.col(running), out="all_running")


__all__ = [
    "duplicate_keys", "unique_index", "all_of", "all_running", "resolve_properties",
    "collect_properties", "render_document", "render_properties", "property_lines", "topology", "topology_pieces", "topology_pages",
    "first_success_within", "judge_readiness",
]
