"""Session helpers: shared folder resolution and stream settings; Kafka options."""

import os
import subprocess
import sys

import pytest

from keelson.session import ensure_streaming_conf, shared_path, shared_root
from keelson.streaming.hop import KAFKA_SESSION_CONF, kafka_options


def test_shared_root_uses_session_checkpoint_dir(spark):
    root = shared_root(spark)
    assert root == spark.sparkContext.getCheckpointDir()
    a, b = shared_path(spark, "x"), shared_path(spark, "x")
    assert a != b and a.startswith(root.rstrip("/") + "/x-")


def test_streaming_conf_keeps_existing_choice(spark):
    ensure_streaming_conf(spark)
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    tz = spark.conf.get("spark.sql.session.timeZone")
    ensure_streaming_conf(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == tz


def test_kafka_options():
    sink = kafka_options("b:9092", "sink")
    assert sink["kafka.bootstrap.servers"] == "b:9092" and sink["kafka.acks"] == "all"
    assert sink["kafka.retries"] == "4" and sink["kafka.retry.backoff.ms"] == "250"
    src = kafka_options("b:9092", "source")
    assert src == {"kafka.bootstrap.servers": "b:9092", "kafkaConsumer.pollTimeoutMs": "250"}
    assert KAFKA_SESSION_CONF == {"spark.kafka.consumer.cache.capacity": "30"}
    with pytest.raises(ValueError):
        kafka_options("b", "both")


def test_a_cluster_needs_a_shared_folder():
    from keelson.session import shared_root

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_root(Session(master))


@pytest.mark.parametrize("blocked", ["tokenizers", "ahocorasick", "public_tokenizers", "keelson.llm", "corpus_pipeline"])
def test_entry_without_an_optional_import(blocked):
    """The library's own queries stay when what the training-data queries need cannot be imported."""
    code = ("import sys; sys.modules[%r] = None; import __spark_entry__ as e; from keelson.plans.catalog import QUERIES; "
            "assert set(QUERIES) <= set(e.queries()); print(len(e.queries()) - len(QUERIES))" % blocked)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == 0 or blocked == "corpus_pipeline"
