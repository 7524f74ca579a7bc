"""One hot key holding a third of all rows.

The given sf0.01 events are rewritten so every third event belongs to user
0.  The event-family queries must still match their oracles on that table,
and their plans must reduce the hot key map-side (partial aggregates or a
window group limit below the shuffle), so it never reaches one task as raw
rows.
"""

import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from keelson.plans.catalog import ORACLE, QUERIES
from keelson.sources.tables import Tables, table_path
from oracle_check import compare

HOT_QUERIES = ["a3_resolve_properties", "a4_render_properties", "a6_first_success_within",
               "w1_bounded_attempts", "s1_decode_props"]


@pytest.fixture(scope="module")
def skewed_dir(spark):
    out = tempfile.mkdtemp(prefix="keelson-skew-")
    ev = Tables(spark, SF01).events
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("long"))
                        .otherwise(F.col("user_id")))
    hot.coalesce(1).write.parquet(table_path(out, "events") + ".d")
    # One file named like the driver's tables.
    import glob
    import shutil
    part = glob.glob(table_path(out, "events") + ".d/part-*.parquet")[0]
    shutil.copy(part, table_path(out, "events"))
    return out


@pytest.fixture(scope="module")
def con(skewed_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{table_path(skewed_dir, 'events')}')")
    return c


def test_hot_key_share(spark, skewed_dir):
    ev = spark.read.parquet(table_path(skewed_dir, "events"))
    total, hot = ev.count(), ev.where("user_id = 0").count()
    assert hot * 3 >= total


@pytest.mark.parametrize("name", HOT_QUERIES)
def test_matches_oracle_under_skew(spark, skewed_dir, con, name):
    res = compare(spark, skewed_dir, name, QUERIES[name], ORACLE[name], con)
    assert res["status"] == "match", res


@pytest.mark.parametrize("name,partial", [
    ("a3_resolve_properties", "partial_max(_at"),
    ("a4_render_properties", "partial_collect_list"),
    ("a6_first_success_within", "partial_min"),
    ("w1_bounded_attempts", "WindowGroupLimit"),
])
def test_hot_key_reduced_before_shuffle(spark, skewed_dir, name, partial):
    df = QUERIES[name](spark, skewed_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    # The map-side operator sits below (after, in the printed tree) the first exchange.
    first_exchange = initial.index("Exchange")
    assert partial in initial[first_exchange:], initial
