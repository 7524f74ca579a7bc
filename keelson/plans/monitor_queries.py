"""Monitoring family on the driver's tables: A2, A6, W1.

  * A2: is every line of an order finished?  (Orders without lines: true.)
    And per nation, do all its suppliers have a positive balance?
  * A6: per user, the first event starts the clock and the first purchase is
    the success; ready if it came strictly within one day.
  * W1: per user and day, each event is an attempt and an ``error`` is a
    failed one; at most three attempts count.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from keelson.operators.aggregates import all_of, all_running, first_success_within
from keelson.operators.windows import bounded_attempts
from keelson.plans.registry import register
from keelson.sources.tables import Tables

READY_TIMEOUT = dt.timedelta(days=1)


@register("a2_all_of", """
SELECT o_orderkey, coalesce(bool_and(l_linestatus = 'F'), true) AS all_ok
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey
""")
def a2_all_of(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return all_of(t.orders.select("o_orderkey"), lines, "o_orderkey", F.col("l_linestatus") == "F")


@register("a2_all_running", """
SELECT n_nationkey AS kind, coalesce(bool_and(s_acctbal > 0), true) AS all_running
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey
GROUP BY n_nationkey
""")
def a2_all_running(spark, sf_dir):
    """Per nation (a kind), are all its suppliers (instances) "running" (positive balance)?"""
    t = Tables(spark, sf_dir)
    state = t.supplier.select(F.col("s_nationkey").alias("kind"), (F.col("s_acctbal") > 0).alias("is_running"))
    return all_running(state, t.nation.select(F.col("n_nationkey").alias("kind")))


READINESS_SQL = """
WITH k AS (SELECT user_id, min(ts) AS s, min(ts) FILTER (WHERE event_type = 'purchase') AS p
           FROM events GROUP BY user_id),
e AS (SELECT user_id, epoch_us(p) - epoch_us(s) AS us, s FROM k)
SELECT user_id,
       coalesce(us < 86400000000, false) AS ready,
       CASE WHEN us < 86400000000 THEN ((us + 5000) // 10000) / 100.0 END AS seconds,
       CASE WHEN us < 86400000000 THEN 'ready' ELSE 'timed_out' END AS status
FROM e
"""


def readiness_events(t: Tables):
    return t.events.select("user_id", "ts", (F.col("event_type") == "purchase").alias("ok"))


@register("a6_first_success_within", READINESS_SQL)
def a6_first_success_within(spark, sf_dir):
    r = first_success_within(readiness_events(Tables(spark, sf_dir)), "user_id", "ts", "ok", READY_TIMEOUT)
    return r.select("user_id", "ready", "seconds", "status")


@register("w1_bounded_attempts", """
WITH r AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type <> 'error' AS ok,
         row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS n
  FROM events)
SELECT user_id, day, count(*) AS attempts_seen,
       CAST(min(n) FILTER (WHERE ok) AS INTEGER) AS attempt,
       CASE WHEN min(n) FILTER (WHERE ok) IS NOT NULL THEN 'succeeded'
            WHEN count(*) >= 3 THEN 'exhausted' ELSE 'in_progress' END AS outcome
FROM r WHERE n <= 3 GROUP BY user_id, day
""")
def w1_bounded_attempts(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select(
        "user_id", "ts", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (F.col("event_type") != "error").alias("ok"))
    return bounded_attempts(ev, ["user_id", "day"], ["ts", "event_id"], "ok", n=3)
