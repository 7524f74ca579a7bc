"""Streams: T1 equals A6 (one file and four files), S2 restart adds no duplicates."""

import datetime as dt
import tempfile

import pytest

from pyspark.sql import functions as F

from conftest import SF001, rows
from keelson.operators.aggregates import first_success_within
from keelson.plans.stream_queries import READY_TIMEOUT, events_stream, run_readiness
from keelson.sources.tables import Tables
from keelson.streaming.hop import append_hop, file_stream

DELAY_MS = 10 * 60 * 1000
SLOT_MS = 10 * 60 * 1000


def expected_ready(spark, events):
    """A6 restricted to keys whose deadline's slot the final watermark has passed."""
    a6 = first_success_within(events.select("user_id", "ts", (F.col("event_type") == "purchase").alias("ok")),
                              "user_id", "ts", "ok", READY_TIMEOUT)
    wm = events.agg((F.unix_millis(F.max(F.col("ts").cast("timestamp"))) - DELAY_MS).alias("wm")).first().wm
    timeout_ms = int(READY_TIMEOUT.total_seconds() * 1000)
    deadline = F.unix_micros(F.col("started").cast("timestamp")) + timeout_ms * 1000
    done = a6.where(F.ceil(deadline / (SLOT_MS * 1000)) * SLOT_MS <= F.lit(wm))
    return rows(done, "user_id", "ready", "seconds", "status")


def split_events(spark, n_files=4):
    """The sf0.001 events as ``n_files`` parquet files in time order.

    Files are named ``events-<i>.parquet`` and get increasing modification
    times, which is the order the file source reads them in.
    """
    import glob
    import os
    import shutil
    out = tempfile.mkdtemp(prefix="keelson-events-")
    ev = Tables(spark, SF001).events
    bounds = ev.approxQuantile("event_id", [i / n_files for i in range(1, n_files)], 0.0)
    edges = [None, *bounds, None]
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        part = ev
        if lo is not None:
            part = part.where(F.col("event_id") > lo)
        if hi is not None:
            part = part.where(F.col("event_id") <= hi)
        tmp = f"{out}.tmp{i}"
        part.coalesce(1).write.parquet(tmp)
        target = f"{out}/events-{i}.parquet"
        shutil.move(glob.glob(f"{tmp}/part-*.parquet")[0], target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return out


def test_t1_one_file_equals_a6(spark):
    got = rows(run_readiness(spark, events_stream(spark, SF001)), "user_id", "ready", "seconds", "status")
    want = expected_ready(spark, Tables(spark, SF001).events)
    assert got == want and len(got) > 0


def test_t1_four_files_equals_a6(spark):
    src = split_events(spark)
    stream = events_stream(spark, SF001, max_files_per_trigger=1, source_dir=src)
    got = rows(run_readiness(spark, stream), "user_id", "ready", "seconds", "status")
    assert got == expected_ready(spark, Tables(spark, SF001).events)


def test_s2_restart_adds_no_duplicates(spark):
    src = split_events(spark, 2)
    schema = spark.read.parquet(src).schema
    base = tempfile.mkdtemp(prefix="keelson-hop-")
    sink, ckpt = f"{base}/table", f"{base}/ckpt"
    append_hop(file_stream(spark, src, schema), sink, ckpt)
    first = spark.read.parquet(sink).count()
    append_hop(file_stream(spark, src, schema), sink, ckpt)      # rerun, nothing new
    assert spark.read.parquet(sink).count() == first
    # New data arrives: only it is appended.
    Tables(spark, SF001).events.where("event_id < 10").coalesce(1).write.mode("append").parquet(src)
    append_hop(file_stream(spark, src, schema), sink, ckpt)
    total = spark.read.parquet(sink)
    assert total.count() == first + 10
    assert total.count() == spark.read.parquet(src).count()


def test_t1_late_row_is_dropped(spark, tmp_path):
    """A success that arrives after its key was judged does not change the result, nor is an early start taken late."""
    stream = user_events(spark, f"{tmp_path}/src", [
        [(1, 0, "view"), (2, 72, "view"), (3, 50, "view")],
        [(2, 73, "view")],                                       # user 1 is judged in this batch
        [(1, 1, "purchase"), (3, 1, "view"), (2, 74, "purchase")],  # hours 1 are late, hour 74 is not
        [(4, 150, "view")]])
    got = rows(run_readiness(spark, stream), "user_id", "started", "ready", "status")
    t0 = dt.datetime(2024, 1, 1)
    assert got == [(1, t0, False, "timed_out"), (2, t0 + dt.timedelta(hours=72), True, "ready"),
                   (3, t0 + dt.timedelta(hours=50), False, "timed_out")]


def test_refresh_stream_across_batches(spark):
    from keelson.streaming.refresh import refresh_stream, snapshot
    base = tempfile.mkdtemp(prefix="keelson-refresh-")
    schema = "k string, etag string, v double"
    batches = [[("k1", "a", 1.0), ("k2", "b", 2.0)],
               [("k1", "b", 10.0), ("k3", "c", 3.0)],
               [("k1", "b", 99.0)]]  # same tag as stored: keeps 10.0
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
    src_schema = spark.read.parquet(f"{base}/src").schema
    for _ in range(2):  # the rerun on one checkpoint changes nothing
        stream = file_stream(spark, f"{base}/src", src_schema, max_files_per_trigger=1)
        refresh_stream(stream, f"{base}/changes", f"{base}/ckpt", "k", "etag", ["v"])
    want = [("k1", "b", 10.0), ("k2", "b", 2.0), ("k3", "c", 3.0)]
    assert rows(snapshot(spark, f"{base}/ckpt"), "k", "etag", "v") == want
    # Only changes are written; the unchanged k1 is not.
    assert rows(spark.read.parquet(f"{base}/changes"), "k", "status", "v") == [
        ("k1", "modified", 10.0), ("k1", "new", 1.0), ("k2", "new", 2.0), ("k3", "new", 3.0)]
    # A restart after new files goes on with the state.
    spark.createDataFrame([("k2", "z", 20.0), ("k1", "b", 5.0)], schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
    refresh_stream(file_stream(spark, f"{base}/src", src_schema), f"{base}/changes", f"{base}/ckpt", "k", "etag", ["v"])
    assert rows(snapshot(spark, f"{base}/ckpt"), "k", "etag", "v") == [("k1", "b", 10.0), ("k2", "z", 20.0), ("k3", "c", 3.0)]


def test_refresh_work_follows_the_batch(spark, tmp_path):
    """With 500 stored keys, a later batch of two records updates two."""
    from keelson.streaming.refresh import refresh_stream, snapshot
    stored = spark.range(500).selectExpr("id AS k", "'t' AS etag", "id * 1.0D AS v")
    src = f"{tmp_path}/src"
    schema = stored.schema
    spark.createDataFrame([(1, "u", 0.5)], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame([(2, "t", 0.5), (3, "w", 0.5)], schema).coalesce(1).write.mode("append").parquet(src)
    q = refresh_stream(file_stream(spark, src, schema, max_files_per_trigger=1), f"{tmp_path}/changes", f"{tmp_path}/ckpt", "k",
                       "etag", ["v"], stored=stored)
    updates = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    assert len(updates) == 2 and updates[0] >= 500 and updates[1] <= 2
    got = snapshot(spark, f"{tmp_path}/ckpt", stored)
    assert got.count() == 500 and rows(got.where("v = 0.5"), "k", "etag") in ([(1, "u"), (3, "w")],)


def test_refresh_keeps_keys_of_a_bucket_apart(spark, tmp_path):
    """Many keys in few buckets, null and NaN among them: few groups, and the snapshot of a plain fold over the batches."""
    from keelson.streaming.hop import append_hop
    from keelson.streaming.refresh import BUCKETS, refresh_changes, snapshot
    schema = "k double, j string, etag string, v long"
    ids = [None, float("nan"), *[float(i) for i in range(40)]]
    stored = [(k, j, "t", 2 ** 60 + i) for i, k in enumerate(ids) for j in ("a", None)]
    batches = [[(k, "a", tag, n) for k in ids] for n, tag in enumerate(["t", "u", "u", "w", "x", "y"])]
    want = {(str(k), j): ("t", v) for k, j, _, v in stored}
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
        want.update({(str(k), j): (tag, v) for k, j, tag, v in batch if want[str(k), j][0] != tag})
    first = spark.createDataFrame(stored, schema)
    source = file_stream(spark, f"{tmp_path}/src", first.schema, max_files_per_trigger=1)
    changes = refresh_changes(source, ["k", "j"], "etag", ["v"], stored=first, buckets=3)
    append_hop(changes, f"{tmp_path}/changes", f"{tmp_path}/ckpt")
    got = snapshot(spark, f"{tmp_path}/ckpt", first).collect()
    assert len(got) == len(want) and {(str(r.k), r.j): (r.etag, r.v) for r in got} == want
    assert spark.read.parquet(f"{tmp_path}/changes").count() == 4 * len(ids)
    state = spark.read.format("statestore").option("stateVarName", "stored").option("flattenCollectionTypes", "false").load(f"{tmp_path}/ckpt")
    assert state.count() == 3 and BUCKETS < 1 << 20
    # Replaced rows are at most half of a bucket.
    assert state.selectExpr("sum(size(list_value))").first()[0] <= 2 * len(want)


def test_refresh_of_an_empty_source_keeps_the_snapshot(spark, tmp_path):
    from keelson.streaming.refresh import refresh_stream, snapshot
    stored = spark.createDataFrame([("a", "t", 1.0)], "k string, etag string, v double")
    (tmp_path / "src").mkdir()
    refresh_stream(file_stream(spark, f"{tmp_path}/src", stored.schema), f"{tmp_path}/changes", f"{tmp_path}/ckpt", "k", "etag", ["v"],
                   stored=stored)
    assert rows(snapshot(spark, f"{tmp_path}/ckpt", stored)) == [("a", "t", 1.0)]


def test_t1_resume_from_checkpoint_equals_one_run(spark):
    """Stop after half the files, resume on the same checkpoint: same rows as one run."""
    from keelson.session import ensure_streaming_conf
    from keelson.streaming.readiness import readiness_stream
    ensure_streaming_conf(spark)
    src_all = split_events(spark, 4)
    files = sorted(f for f in __import__("os").listdir(src_all) if f.endswith(".parquet"))  # events-<i>
    base = tempfile.mkdtemp(prefix="keelson-resume-")
    src = f"{base}/src"
    __import__("os").makedirs(src)
    schema = spark.read.parquet(src_all).schema

    def run_once():
        stream = file_stream(spark, src, schema, max_files_per_trigger=1)
        result = readiness_stream(stream, "user_id", "ts", F.col("event_type") == "purchase",
                                  READY_TIMEOUT, "10 minutes")
        append_hop(result, f"{base}/table", f"{base}/ckpt")

    import os
    import shutil
    for i, f in enumerate(files):
        if i == 2:
            run_once()  # stop after half the files
        shutil.copy(f"{src_all}/{f}", f"{src}/{f}")
        os.utime(f"{src}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    run_once()          # resume on the same checkpoint
    got = rows(spark.read.parquet(f"{base}/table"), "user_id", "ready", "seconds", "status")
    assert got == expected_ready(spark, Tables(spark, SF001).events)


def user_events(spark, path, spec):
    """One file a batch of ``(user, hours, type)`` from 2024-01-01."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    t0 = dt.datetime(2024, 1, 1)
    for batch in spec:
        data = [(i, t0 + dt.timedelta(hours=h), u, kind, 0.0, None) for i, (u, h, kind) in enumerate(batch)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, spark.read.parquet(path).schema, max_files_per_trigger=1)


def test_t1_state_leaves(spark, tmp_path):
    """A judged key's marker goes once it was silent for ``forget``; one that comes back starts anew."""
    from keelson.session import ensure_streaming_conf
    from keelson.streaming.readiness import STATE, readiness_stream
    ensure_streaming_conf(spark)
    stream = user_events(spark, f"{tmp_path}/src", [
        [(1, 0, "view"), (1, 1, "purchase"), (2, 0, "view"), (9, 40, "view")],
        [(2, 41, "view"), (9, 90, "view")],                       # user 2 shows up again: its marker stays longer
        [(1, 91, "view"), (2, 91, "purchase"), (9, 200, "view")],  # user 1 was forgotten, user 2 was not
        [(9, 201, "view")]])
    result = readiness_stream(stream, "user_id", "ts", F.col("event_type") == "purchase", READY_TIMEOUT, "10 minutes",
                              forget=dt.timedelta(hours=60))
    append_hop(result, f"{tmp_path}/table", f"{tmp_path}/ckpt")
    got = rows(spark.read.parquet(f"{tmp_path}/table").where("user_id < 9"), "user_id", "started", "status")
    t0 = dt.datetime(2024, 1, 1)
    assert got == [(1, t0, "ready"), (1, t0 + dt.timedelta(hours=91), "timed_out"), (2, t0, "timed_out")]
    state = spark.read.format("statestore").option("stateVarName", STATE).option("operatorId", 0).load(f"{tmp_path}/ckpt")
    left = rows(state.select("key.user_id", "value.done"))
    assert left == [(9, True)]  # silent users left the state


def test_t1_combines_a_hot_key_before_the_shuffle(spark, tmp_path):
    """A third of the rows on one key: the plan combines below the exchange, and few rows reach the processor."""
    from keelson.session import ensure_streaming_conf
    from keelson.streaming.readiness import readiness_stream
    ensure_streaming_conf(spark)
    batch = [(i % 30 if i % 3 else 0, (i % 600) / 100, "view") for i in range(3000)]
    stream = user_events(spark, f"{tmp_path}/src", [batch, [(99, 100, "view")]])
    result = readiness_stream(stream, "user_id", "ts", F.col("event_type") == "purchase", READY_TIMEOUT, "10 minutes")
    q = append_hop(result, f"{tmp_path}/table", f"{tmp_path}/ckpt")
    plan = q._jsq.explainInternal(False)
    assert "partial_min" in plan[plan.index("Exchange"):]
    slots = max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"] if o["operatorName"] == "stateStoreSave")
    assert slots <= 21 * 37 + 1  # users x ten-minute slots of six hours, not rows
    assert spark.read.parquet(f"{tmp_path}/table").where("user_id = 0").count() == 1


def test_t1_is_independent_of_session_time_zone(spark):
    """Zoneless times across a daylight-saving gap of the session zone: T1 still equals A6."""
    from keelson.session import ensure_streaming_conf
    from keelson.streaming.readiness import readiness_stream
    ensure_streaming_conf(spark)
    t0 = dt.datetime(2024, 3, 10, 1, 30)  # 02:00-03:00 does not exist in New York that night
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ev = spark.createDataFrame([
        (1, t0, 1, "view", 0.0, None),
        (2, t0 + dt.timedelta(hours=1, minutes=40), 1, "purchase", 0.0, None),   # 03:10 wall time
        (3, t0, 2, "view", 0.0, None),
        (4, t0 + dt.timedelta(minutes=50), 2, "purchase", 0.0, None),            # 02:20 wall time
        (5, t0 + dt.timedelta(days=2), 3, "view", 0.0, None),                    # moves the watermark on
    ], schema)
    base = tempfile.mkdtemp(prefix="keelson-tz-")
    ev.coalesce(1).write.parquet(f"{base}/src")
    timeout = dt.timedelta(hours=1, minutes=30)
    want = rows(first_success_within(ev.select("user_id", "ts", (F.col("event_type") == "purchase").alias("ok")),
                                     "user_id", "ts", "ok", timeout).where("user_id < 3"),
                "user_id", "ready", "seconds")
    assert want == [(1, False, None), (2, True, 3000.0)]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = file_stream(spark, f"{base}/src", spark.read.parquet(f"{base}/src").schema)
        result = readiness_stream(stream, "user_id", "ts", F.col("event_type") == "purchase", timeout, "10 minutes")
        append_hop(result, f"{base}/table", f"{base}/ckpt")
        got = rows(spark.read.parquet(f"{base}/table"), "user_id", "ready", "seconds")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == want


@pytest.mark.parametrize("per_trigger", [None, 1])
def test_refresh_snapshot_does_not_depend_on_batches(spark, tmp_path, per_trigger):
    """The same records in one batch and in one per file give the same snapshot."""
    from keelson.streaming.refresh import refresh_stream, snapshot
    schema = "k string, etag string, v double, at int"
    batches = [[("k1", "a", 1.0, 1), ("k2", "b", 2.0, 1), ("s", "t", 9.0, 1)], [("k1", "b", 10.0, 2), ("k3", None, 3.0, 2)],
               [("k1", "b", 99.0, 3), ("k3", None, 4.0, 3), ("s", "t", 8.0, 3)], [("k2", "c", 5.0, 4)], [("k2", "b", 6.0, 5)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    src = spark.read.parquet(f"{tmp_path}/src").schema
    kept = spark.createDataFrame([("s", "t", 7.0), ("only", "o", 1.0)], "k string, etag string, v double")
    stream = file_stream(spark, f"{tmp_path}/src", src, max_files_per_trigger=per_trigger)
    refresh_stream(stream, f"{tmp_path}/changes", f"{tmp_path}/ckpt", "k", "etag", ["v"], order="at", stored=kept)
    assert rows(snapshot(spark, f"{tmp_path}/ckpt", kept), "k", "etag", "v") == [
        ("k1", "b", 10.0), ("k2", "b", 6.0), ("k3", None, 4.0), ("only", "o", 1.0), ("s", "t", 7.0)]


def test_refresh_without_order_rejects_a_repeated_key(spark, tmp_path):
    from keelson.streaming.refresh import refresh_stream
    schema = "k string, etag string, v double"
    spark.createDataFrame([("k1", "a", 1.0), ("k1", "b", 2.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/src")
    stream = file_stream(spark, f"{tmp_path}/src", spark.read.parquet(f"{tmp_path}/src").schema)
    with pytest.raises(Exception, match="occurs twice"):
        refresh_stream(stream, f"{tmp_path}/changes", f"{tmp_path}/ckpt", "k", "etag", ["v"])


@pytest.mark.parametrize("name", ["s2_append_hop", "t1_readiness_stream", "j6_refresh_stream"])
def test_streams_read_tables_of_many_files(spark, tmp_path, name):
    """The same rows from a one-file table and from a folder of part files beside look-alike names."""
    from keelson.plans.catalog import QUERIES
    for table in ("events", "orders"):
        df = spark.read.parquet(f"{SF001}/{table}.parquet")
        parts = df.repartition(1).sortWithinPartitions("ts") if table == "events" else df.repartition(4)
        parts.write.option("maxRecordsPerFile", 400).parquet(f"{tmp_path}/{table}.parquet")
        df.limit(5).write.parquet(f"{tmp_path}/{table}.parquet2")
    assert rows(QUERIES[name](spark, str(tmp_path))) == rows(QUERIES[name](spark, SF001))
