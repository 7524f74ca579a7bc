"""M1 deployment plan against the golden counts derived from the reference.

Per started instance: gate 25 keys, management API 24, stream API 26,
stream manager 19; init 8.  The reference's test count vectors become cases.
"""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from keelson.operators.aggregates import duplicate_keys
from keelson.plans import fixtures as fx
from keelson.plans.deployment import deployment_plan

SCHEMA = ("cluster_id string, base_directory string, gate int, management_api int, "
          "stream_api int, stream_manager int")

# (case, counts, instances, property rows with init)
CASES = [
    ("gate only", (1, 0, 0, 0), 1, 33),
    ("management API only", (0, 1, 0, 0), 1, 32),
    ("stream API only", (0, 0, 1, 0), 1, 34),
    ("stream manager only", (0, 0, 0, 1), 1, 27),
    ("size 1", (1, 1, 1, 1), 4, 102),
    ("size 3", (3, 3, 3, 3), 12, 290),
    ("all zero", (0, 0, 0, 0), 0, 8),
]


@pytest.fixture(scope="module")
def plan(spark):
    clusters = spark.createDataFrame([(name, "/srv/h", *counts) for name, counts, _, _ in CASES]
                                     + [("defaults", None, None, None, None, None),
                                        ("negative", "", -1, 1, 0, 0)], SCHEMA)
    return deployment_plan(clusters)


def test_golden_counts(plan):
    inst = {r.cluster_id: r["count"] for r in plan.instances.where("kind <> 'init'").groupBy("cluster_id").count().collect()}
    props = {r.cluster_id: r["count"] for r in plan.properties.groupBy("cluster_id").count().collect()}
    for name, _, n_inst, n_props in CASES:
        assert inst.get(name, 0) == n_inst, name
        assert props[name] == n_props, name
    assert props["defaults"] == 102  # NULL counts mean 1 each


def test_documents_agree_with_properties(plan):
    per_doc = plan.documents.groupBy("cluster_id").agg(F.sum("n_keys").alias("n"))
    per_prop = plan.properties.groupBy("cluster_id").count()
    assert rows(per_doc) == rows(per_prop)


def test_keys_per_kind_and_no_repeats(plan):
    size1 = plan.properties.where("cluster_id = 'size 1'")
    keys = {r.kind: r["count"] for r in size1.groupBy("kind").count().collect()}
    assert keys == {"gate": 25, "management-api": 24, "stream-api": 26, "stream-manager": 19, "init": 8}
    assert duplicate_keys(plan.properties, ["cluster_id", "kind", "instance_id", "key"]).count() == 0


def test_negative_count_rejected(plan):
    assert rows(plan.rejected, "cluster_id", "kind", "count", "placed", "reason") == [("negative", "gate", -1, 0, "count")]


def test_directories_and_arguments(plan):
    inst = {(r.kind, r.instance_id): (r.directory, r.arguments)
            for r in plan.instances.where("cluster_id = 'size 3'").collect()}
    names = {kind: name for _, kind, name in fx.COMPONENTS}
    assert inst[("init", None)] == (f"/srv/h/{names['init']}", "init-zk=true init-kafka=true")
    assert inst[("stream-api", 2)] == (f"/srv/h/{names['stream-api']}-2", "")
    dflt = {r.kind: r.directory for r in plan.instances.where("cluster_id = 'defaults'").collect()}
    assert dflt["gate"] == f"./{names['gate']}-0"


def test_rendered_gate_document(plan):
    doc = (plan.documents.where("cluster_id = 'gate only' AND kind = 'gate'").first().document).split("\n")
    service = [(k, v) for t, _, k, v in fx.TEMPLATES if t == "service"]
    assert doc[:8] == [f"{k}={'0' if v == '{instance_id}' else v}" for k, v in service]
    assert doc[3] == "metrics.period=2147483647" and doc[4] == "context.instance.id=0"
    assert doc[8] == "curator.connectString=localhost:2181"
    assert "gate.event.sender.producer.retry.backoff.ms=250" in doc
    port = plan.instances.where("cluster_id = 'gate only' AND kind = 'gate'").first().port
    assert port == 20004  # after the four services of 'defaults' on the same host
    assert doc[-4:] == ["http.server.host=localhost", f"http.server.port={port}",
                        "application.host=localhost", f"application.port={port}"]
    init = plan.documents.where("cluster_id = 'gate only' AND kind = 'init'").first().document.split("\n")
    assert init == ["zk.connectString=localhost:2181", "zk.connectionTimeout=10000", "zk.sessionTimeout=30000",
                    "zk.retryPolicy.baseSleepTime=1000", "zk.retryPolicy.maxRetries=3",
                    "zk.retryPolicy.maxSleepTime=3000", "kafka.bootstrap.servers=localhost:9092",
                    "kafka.replication.factor=3"]


def test_restart_overwrites_start_keys(spark):
    clusters = spark.createDataFrame([("c", None, 1, 1, 1, 1)], SCHEMA)
    once = deployment_plan(clusters)
    twice = deployment_plan(clusters, starts=2)
    assert twice.writes.count() - once.writes.count() == 16  # 4 start keys x 4 services
    assert rows(twice.documents, "kind", "document") == rows(once.documents, "kind", "document")


def test_backslash_in_connect_string(spark):
    clusters = spark.createDataFrame([("c", None, 1, 0, 0, 0, "C:\\zk", "k")],
                                     SCHEMA + ", zk_connect string, kafka_connect string")
    doc = deployment_plan(clusters).documents.where("kind = 'gate'").first().document
    assert "curator.connectString=C:\\\\zk" in doc.split("\n")


def test_percent_in_values_is_literal(spark):
    clusters = spark.createDataFrame([("c", None, 1, 0, 0, 0, "zk%1$s%%", "k%s")],
                                     SCHEMA + ", zk_connect string, kafka_connect string")
    doc = deployment_plan(clusters).documents.where("kind = 'gate'").first().document.split("\n")
    assert "curator.connectString=zk%1$s%%" in doc
    assert "gate.event.sender.producer.bootstrap.servers=k%s" in doc


def test_rules_and_topology(plan):
    from keelson.operators.joins import RULE_PATH_PREFIX
    rules = rows(plan.rules.where("cluster_id = 'size 3'"), "right", "path")
    assert rules == sorted((r, f"{RULE_PATH_PREFIX}{fx.API_KEY}.*.{r}") for r in ("read", "write", "manage"))
    topo = {r.kind: (r.topology, r.instances) for r in plan.topology.where("cluster_id = 'size 3'").collect()}
    ports = {r.kind: r.first_port for r in plan.ranges.where("cluster_id = 'size 3'").collect()}
    gate = ports["gate"]
    assert topo["gate"] == (f"http://localhost:{gate}/,http://localhost:{gate + 1}/,http://localhost:{gate + 2}/", 3)
    assert topo["stream-manager"][0].startswith(f"http://localhost:{gate + 9}/")
    assert "init" not in topo
    assert plan.topology.where("cluster_id = 'all zero'").count() == 0


def test_any_count_is_expanded(spark):
    """1001 of a kind are 1001 documents; each has an endpoint of its own."""
    clusters = spark.createDataFrame([("big", None, 1001, 1, 0, 2), ("small", "/x", 1, 0, 1, 0)], SCHEMA)
    plan = deployment_plan(clusters)
    assert plan.documents.where("cluster_id = 'big' AND kind = 'gate'").select("document").distinct().count() == 1001
    assert plan.topology.where("cluster_id = 'big' AND kind = 'gate'").first().instances == 1001
    assert plan.rejected.count() == 0


def test_endpoints_never_repeat(spark):
    """Clusters share hosts; ports follow the order of cluster and kind on each."""
    clusters = spark.createDataFrame([(f"c{i:03}", None, i % 4, 2, None, i % 7, f"h{i % 3}" if i % 5 else None) for i in range(200)],
                                     SCHEMA + ", host string")
    plan = deployment_plan(clusters)
    ends = [(r.host, r.port) for r in plan.instances.where("port is not null").collect()]
    assert len(ends) == len(set(ends)) == sum(i % 4 + 2 + 1 + i % 7 for i in range(200))
    for host in {h for h, _ in ends}:
        ports = sorted(p for h, p in ends if h == host)
        assert ports == list(range(20000, 20000 + len(ports)))
    assert plan.rejected.count() == 0


def test_a_host_without_ports_left(spark):
    clusters = spark.createDataFrame([("a", None, 4, 0, 0, 3, "h"), ("b", None, 5, 1, 0, 0, "h"), ("c", None, 2, 0, -3, 0, "g")],
                                     SCHEMA + ", host string")
    plan = deployment_plan(clusters, port_base=65526)
    assert rows(plan.rejected) == [("b", "gate", "h", 5, 3, "no port"), ("b", "management-api", "h", 1, 0, "no port"),
                                   ("c", "stream-api", "g", -3, 0, "count")]
    planned = rows(plan.instances.where("port is not null"), "cluster_id", "kind", "instance_id", "port")
    assert [p for *_, p in planned if p <= 65535] == [p for *_, p in planned] and len(planned) == 4 + 3 + 3 + 2
    assert plan.documents.where("kind <> 'init'").count() == 12
    assert rows(plan.topology, "cluster_id", "kind", "instances") == [("a", "gate", 4), ("a", "stream-manager", 3),
                                                                     ("b", "gate", 3), ("c", "gate", 2)]
