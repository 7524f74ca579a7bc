"""Streams and sinks on the driver's tables: S2, S3, T1.

Each query runs its job (an ``availableNow`` stream, or a file write) into a
fresh location under the shared checkpoint folder and returns the result
read back from there — never through driver memory.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from keelson.operators.aggregates import property_lines
from keelson.plans.join_queries import CURRENT_FROM, STORED_BEFORE
from keelson.plans.monitor_queries import READINESS_SQL
from keelson.plans.properties_queries import resolved_events
from keelson.plans.registry import register
from keelson.session import ensure_streaming_conf, shared_path
from keelson.sources.sinks import export_property_files, read_property_files, write_property_files
from keelson.sources.tables import Tables, table_glob, table_path
from keelson.streaming.hop import append_hop, file_stream
from keelson.streaming.readiness import readiness_stream
from keelson.streaming.refresh import refresh_stream, snapshot

WATERMARK_DELAY = "10 minutes"
READY_TIMEOUT = dt.timedelta(days=1)
#: A judged user's marker leaves the state a year after the user's last event.
FORGET = dt.timedelta(days=365)


def events_stream(spark, sf_dir, max_files_per_trigger=None, source_dir=None):
    schema = spark.read.parquet(table_path(sf_dir, "events")).schema  # footer only
    return file_stream(spark, source_dir or table_glob(sf_dir, "events"), schema,
                       max_files_per_trigger=max_files_per_trigger)


@register("s2_append_hop", """
SELECT event_id, user_id, event_type FROM events
""")
def s2_append_hop(spark, sf_dir):
    """Hop ``events`` twice over one checkpoint: the rerun adds nothing."""
    base = shared_path(spark, "s2-hop")
    sink, ckpt = f"{base}/table", f"{base}/checkpoint"
    for _ in range(2):
        append_hop(events_stream(spark, sf_dir), sink, ckpt)
    return spark.read.parquet(sink).select("event_id", "user_id", "event_type")


@register("s3_property_files", """
SELECT user_id, event_type || '=' || replace(CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR), '\\', '\\\\') AS line
FROM events GROUP BY user_id, event_type
""")
def s3_property_files(spark, sf_dir):
    lines = property_lines(resolved_events(Tables(spark, sf_dir)), "user_id", "event_type", "value")
    path = shared_path(spark, "s3-properties")
    write_property_files(lines, path, "user_id")
    return read_property_files(spark, path, "user_id", "bigint").select("user_id", "line")


@register("s3_export_files", """
SELECT user_id, string_agg(line || chr(10), '' ORDER BY p) AS text
FROM (SELECT user_id, event_type || '=' || CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS line, min((ts, event_id)) AS p
      FROM events GROUP BY user_id, event_type) GROUP BY user_id
""")
def s3_export_files(spark, sf_dir):
    """A text file a user, read back whole (a user's file holds one line an event type)."""
    lines = property_lines(resolved_events(Tables(spark, sf_dir)), "user_id", "event_type", "value")
    path = shared_path(spark, "s3-files")
    export_property_files(lines, path, "user_id")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    # A user's lines may be cut by a range into two files, whose names follow the order.
    parts = files.select(F.regexp_extract("path", "user_id=([0-9]+)/", 1).cast("long").alias("user_id"), "path",
                         F.col("content").cast("string").alias("text"))
    return parts.groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "").alias("text"))


# A key is judged when the watermark reaches the end of its deadline's ten-minute slot.
T1_SQL = READINESS_SQL.replace(
    "FROM e\n",
    "FROM e WHERE (epoch_us(s) + 86400000000 + 599999999) // 600000000 * 600000"
    " <= (SELECT epoch_ms(max(ts)) - 600000 FROM events)\n")


def run_readiness(spark, stream, forget=FORGET):
    """Drain a T1 stream into a shared parquet table and read it back."""
    ensure_streaming_conf(spark)
    result = readiness_stream(stream, "user_id", "ts", F.col("event_type") == "purchase",
                              READY_TIMEOUT, WATERMARK_DELAY, forget=forget)
    base = shared_path(spark, "t1-readiness")
    append_hop(result, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table")


@register("t1_readiness_stream", T1_SQL)
def t1_readiness_stream(spark, sf_dir):
    return run_readiness(spark, events_stream(spark, sf_dir)).select("user_id", "ready", "seconds", "status")


@register("j6_refresh_stream", f"""
WITH cur AS (SELECT o_orderkey, o_orderstatus AS etag, o_totalprice AS price FROM orders
             WHERE o_orderdate >= TIMESTAMP '{CURRENT_FROM}'),
     sto AS (SELECT o_orderkey,
                    CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS etag,
                    -o_totalprice AS price
             FROM orders WHERE o_orderdate < TIMESTAMP '{STORED_BEFORE}')
SELECT coalesce(cur.o_orderkey, sto.o_orderkey) AS o_orderkey,
       CASE WHEN cur.o_orderkey IS NULL OR cur.etag = sto.etag THEN sto.etag ELSE cur.etag END AS etag,
       CASE WHEN cur.o_orderkey IS NULL OR cur.etag = sto.etag THEN sto.price ELSE cur.price END AS price
FROM cur FULL OUTER JOIN sto ON cur.o_orderkey = sto.o_orderkey
""")
def j6_refresh_stream(spark, sf_dir):
    """J6 as a stream: state that starts as the older snapshot, current orders streamed through it."""
    orders = Tables(spark, sf_dir).orders
    stored = (orders.where(F.col("o_orderdate") < F.lit(STORED_BEFORE).cast("timestamp_ntz"))
              .select("o_orderkey",
                      F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("X"))
                      .otherwise(F.col("o_orderstatus")).alias("etag"),
                      (-F.col("o_totalprice")).alias("price")))
    base = shared_path(spark, "j6-refresh")
    current = (file_stream(spark, table_glob(sf_dir, "orders"), orders.schema)
               .where(F.col("o_orderdate") >= F.lit(CURRENT_FROM).cast("timestamp_ntz"))
               .select("o_orderkey", F.col("o_orderstatus").alias("etag"), F.col("o_totalprice").alias("price"), "o_orderdate"))
    refresh_stream(current, f"{base}/changes", f"{base}/checkpoint", "o_orderkey", "etag", ["price"], "o_orderdate", stored)
    return snapshot(spark, f"{base}/checkpoint", stored)
