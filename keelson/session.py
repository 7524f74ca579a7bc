"""Session construction and shared storage locations.

Cluster jobs get their session from the platform; ``build_session`` is for
tests, the bench and local runs.  Whatever the session, durable state
(stream checkpoints, written hop tables) goes under the shared folder the
cluster names in ``spark.checkpoint.dir``.  A private temporary folder is
only created for a local master without that setting, as in tests; on a
cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours wants.  AQE re-plans joins from runtime
# sizes (sort-merge -> broadcast only when a shuffle stage is measured small),
# splits skewed shuffle partitions, and coalesces tiny ones.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # transformWithState needs the RocksDB state store.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "keelson", extra: dict | None = None) -> SparkSession:
    """A local session with our defaults (tests, bench)."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Root of the cluster-shared folder for checkpoints and hop tables.

    Uses the checkpoint directory the session already has (set from
    ``spark.checkpoint.dir`` or by ``setCheckpointDir``).  Only when none is
    configured and the master is local, a fresh private folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not (sc.master.startswith("local") and "cluster" not in sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all machines of the cluster share")
    base = configured or tempfile.mkdtemp(prefix="keelson-ckpt-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique location under the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_streaming_conf(spark: SparkSession) -> None:
    """The RocksDB state store that transformWithState (T1) needs.

    Only replaces an unset or default (HDFS-backed) provider, so a cluster's
    own RocksDB settings win.  Time zones need nothing: the operators use
    zone-free arithmetic on zoneless timestamps.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, None) in (None, "",
                                     "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(key, SESSION_DEFAULTS[key])
