"""A3 + A4 on ``events``: each event is a property write.

entity = ``user_id``, key = ``event_type``, value = the event id as text,
write order = ``(ts, event_id)``.  The resolved document per user holds the
latest event id per event type, in the order the types first appeared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators.aggregates import render_properties, resolve_properties
from keelson.functions.text import int_text
from keelson.plans.registry import register
from keelson.sources.tables import Tables


def event_writes(t: Tables):
    return t.events.select("user_id", "event_type", "ts", "event_id",
                           int_text("event_id").alias("value"))


def resolved_events(t: Tables):
    return resolve_properties(event_writes(t), "user_id", "event_type", "value",
                              order=["ts", "event_id"])


@register("a3_resolve_properties", """
SELECT user_id, event_type,
       CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS value,
       arg_min(event_id, (ts, event_id)) AS first_event_id
FROM events GROUP BY user_id, event_type
""")
def a3_resolve_properties(spark, sf_dir):
    r = resolved_events(Tables(spark, sf_dir))
    return r.select("user_id", "event_type", "value", F.col("pos.event_id").alias("first_event_id"))


@register("a4_render_properties", """
WITH r AS (
  SELECT user_id, event_type,
         CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS v,
         min((ts, event_id)) AS p
  FROM events GROUP BY user_id, event_type)
SELECT user_id,
       string_agg(event_type || '=' || replace(v, '\\', '\\\\'), chr(10) ORDER BY p) AS document,
       count(*) AS n_keys
FROM r GROUP BY user_id
""")
def a4_render_properties(spark, sf_dir):
    return render_properties(resolved_events(Tables(spark, sf_dir)), "user_id", "event_type", "value")


@register("a4_render_entities", """
WITH r AS (
  SELECT user_id, event_type, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS v, min((ts, event_id)) AS p
  FROM events GROUP BY user_id, event_type),
d AS (SELECT user_id, string_agg(event_type || '=' || v, chr(10) ORDER BY p) AS document, count(*) AS n_keys FROM r GROUP BY user_id)
SELECT c_custkey AS user_id, coalesce(document, '') AS document, coalesce(n_keys, 0) AS n_keys
FROM customer LEFT JOIN d ON user_id = c_custkey
""")
def a4_render_entities(spark, sf_dir):
    """A document for every customer, empty for those without events."""
    t = Tables(spark, sf_dir)
    entities = t.customer.select(F.col("c_custkey").alias("user_id"))
    return render_properties(resolved_events(t), "user_id", "event_type", "value", entities=entities)
