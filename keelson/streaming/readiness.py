"""Readiness with a deadline, live, as two chained stateful stream operators.

Same rule as A6 (``first_success_within``): per key the first event starts
the clock, the first success must come strictly within ``timeout``.

1. A windowed aggregate: the first event and the first success of each key and
   time slot.  It is Spark's own, combined before its shuffle, so a key that
   holds a third of all rows crosses it as one row a task and slot.  A slot
   is emitted when the watermark passes its end; rows of an emitted slot are
   late and dropped by it.
2. A ``StatefulProcessor`` over the slots: ``(started, first_ok, done, last)``
   a key in the state store.  An event-time timer at the end of the slot that
   holds ``started + timeout`` emits the key's result once: every slot that
   could still hold an earlier start or success has been emitted then, in the
   same batch at the latest.  So every emitted row equals A6's row for that
   key (late rows aside); keys whose timer the final watermark has not passed
   stay silent.

After its result a key leaves a small marker, so that later rows don't judge
it again.  With ``forget`` the marker leaves the state, too, once no row of the
key came for that long (event time); a key that comes back after that starts
a new clock.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from keelson.functions._util import as_col, as_names
from keelson.functions.times import micros_to_ntz, ntz_micros
from keelson.operators.aggregates import judge_readiness, timeout_micros

# The processor runs in Python workers (a driver-side one that sets up the
# state, and the executors').  Pickling this module's classes by value means
# no worker has to import this package: nothing to ship or install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "readiness"
STATE_SCHEMA = T.StructType([T.StructField("started_us", T.LongType()), T.StructField("first_ok_us", T.LongType()),
                             T.StructField("done", T.BooleanType()), T.StructField("last_us", T.LongType())])
OUTPUT_FIELDS = [T.StructField("started_us", T.LongType()), T.StructField("first_ok_us", T.LongType())]
#: Length of a slot of the first aggregate, in minutes.
SLOT_MINUTES = 10


def least(a, b):
    return b if a is None else a if b is None else min(a, b)


class ReadinessProcessor(StatefulProcessor):
    """Tracks first event and first success per key; emits when the deadline's slot is over."""

    def __init__(self, out: list[str], timeout_us: int, slot_us: int, forget_us: int | None):
        self.out, self.timeout_us, self.slot_us, self.forget_us = out, timeout_us, slot_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(STATE, STATE_SCHEMA)

    def slot_end_ms(self, us: int) -> int:
        """The end of the slot that ``us`` lies in or ends."""
        return -(-us // self.slot_us) * self.slot_us // 1000

    def handleInputRows(self, key, rows, timerValues):
        started, first_ok, done, last = self.state.get() or (None, None, False, None)
        before = started
        for r in rows:
            last = r["last_us"] if last is None else max(last, r["last_us"])
            if not done:
                started = least(started, r["started_us"])
                first_ok = least(first_ok, r["first_ok_us"])
        if not done and started != before:
            if before is not None:
                self.handle.deleteTimer(self.slot_end_ms(before + self.timeout_us))
            self.handle.registerTimer(self.slot_end_ms(started + self.timeout_us))
        self.state.update((started, first_ok, done, last))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.state.get()
        if state is None:
            return
        started, first_ok, done, last = state
        if not done:
            self.state.update((started, first_ok, True, last))
            yield Row(*self.out)(*key, started, first_ok)
        if self.forget_us is not None:
            leave = max(self.slot_end_ms(last + self.forget_us), self.slot_end_ms(started + self.timeout_us) + 1)
            if done and leave <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
            else:
                self.handle.registerTimer(leave)

    def close(self) -> None:
        pass


def readiness_stream(stream: DataFrame, key, ts: str, is_success, timeout, delay: str, slot_minutes: int = SLOT_MINUTES,
                     forget=None) -> DataFrame:
    """T1 over a streaming DataFrame; returns the streaming result (append mode).

    ``ts`` is ``timestamp_ntz`` or ``timestamp``.  Zoneless times are taken
    as they are, whatever the session time zone: they become microseconds
    since ``1970-01-01 00:00:00`` by zone-free arithmetic, the watermark
    (``delay``, e.g. ``"10 minutes"``) runs on the instant built from those
    microseconds, and the output times are zoneless again — so a daylight
    saving change in the session zone cannot shift an elapsed time, exactly
    as in A6.  ``timeout`` and ``forget``: ``timedelta`` or microseconds.
    """
    keys = as_names(key)
    timeout_us = timeout_micros(timeout)
    zoneless = isinstance(stream.schema[ts].dataType, T.TimestampNTZType)
    micros = ntz_micros(ts) if zoneless else F.unix_micros(F.col(ts))
    prepared = (stream.withColumn("event_us", micros)
                .withColumn("event_ts", F.timestamp_micros("event_us"))
                .withWatermark("event_ts", delay)
                .select(*keys, "event_ts", "event_us", F.coalesce(as_col(is_success), F.lit(False)).alias("is_ok")))
    slots = (prepared.groupBy(*keys, F.window("event_ts", f"{slot_minutes} minutes").alias("slot"))
             .agg(F.min("event_us").alias("started_us"), F.min(F.when(F.col("is_ok"), F.col("event_us"))).alias("first_ok_us"),
                  F.max("event_us").alias("last_us"))
             .select(*keys, F.window_time("slot").alias("slot_time"), "started_us", "first_ok_us", "last_us"))
    out = T.StructType([*[f for f in prepared.schema.fields if f.name in keys], *OUTPUT_FIELDS])
    processor = ReadinessProcessor(out.names, timeout_us, slot_minutes * 60_000_000, None if forget is None else timeout_micros(forget))
    emitted = slots.groupBy(*keys).transformWithState(processor, out, "append", "EventTime")

    def back(col: str):
        return micros_to_ntz(col) if zoneless else F.timestamp_micros(col)

    per_key = emitted.select(*keys, back("started_us").alias("started"), back("first_ok_us").alias("first_ok"))
    return judge_readiness(per_key, timeout_us)
