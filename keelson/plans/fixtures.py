"""Fixed dimension tables of the deployment plan.

These are values the rendered configuration must equal, stated as data:
component kinds and names, property templates, and which kind takes which
template under which prefix.  Each is a handful of rows, so broadcasting
them is bounded by construction.  ``values_sql`` renders the same rows as a
SQL ``VALUES`` list for the DuckDB oracle, so both sides read one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# The configuration keys and settings; names are our own.
# ---------------------------------------------------------------------------

# Component kinds: (ord, kind, name).  ``ord`` is the order in which service
# kinds are appended to the cluster; init is not a service (NULL ord).
COMPONENTS = [
    (None, "init", "core-init"),
    (0, "gate", "core-gate"),
    (1, "management-api", "core-management-api"),
    (2, "stream-api", "core-stream-api"),
    (3, "stream-manager", "core-stream-manager"),
]
COMPONENT_SCHEMA = "ord int, kind string, name string"
INIT_NAME = next(name for _, kind, name in COMPONENTS if kind == "init")

INIT_KIND = "init"
INIT_ARGUMENTS = "init-zk=true init-kafka=true"
SERVICE_HOST = "localhost"
ADMIN_API_KEY = "admin_api_key"
API_KEY = "client_api_key"

# Property templates: (template, pos, suffix, value).  ``{name}`` marks a
# value filled per instance.
TEMPLATES = [
    ("service", 0, "metrics.graphite.server.addr", "localhost"),
    ("service", 1, "metrics.graphite.server.port", "2003"),
    ("service", 2, "metrics.graphite.prefix", "core"),
    ("service", 3, "metrics.period", "2147483647"),
    ("service", 4, "context.instance.id", "{instance_id}"),
    ("service", 5, "context.environment", "dev"),
    ("service", 6, "context.zone", "default"),
    ("service", 7, "consumer.metric.reporters", "metrics.reporter.GraphiteReporter"),
    ("start", 0, "http.server.host", "{host}"),
    ("start", 1, "http.server.port", "{port}"),
    ("start", 2, "application.host", "{host}"),
    ("start", 3, "application.port", "{port}"),
    ("zookeeper", 0, "connectString", "{zk}"),
    ("zookeeper", 1, "connectionTimeout", "10000"),
    ("zookeeper", 2, "sessionTimeout", "30000"),
    ("zookeeper", 3, "retryPolicy.baseSleepTime", "1000"),
    ("zookeeper", 4, "retryPolicy.maxRetries", "3"),
    ("zookeeper", 5, "retryPolicy.maxSleepTime", "3000"),
    ("kafka_common", 0, "bootstrap.servers", "{kafka}"),
    ("kafka_common", 1, "acks", "all"),
    ("kafka_common", 2, "batch.size", "65536"),
    ("kafka_common", 3, "linger.ms", "1"),
    ("kafka_common", 4, "buffer.memory", "335544320"),
    ("producer_extra", 0, "retries", "4"),
    ("producer_extra", 1, "retry.backoff.ms", "250"),
    ("consumer_extra", 0, "retries", "0"),
    ("consumer_extra", 1, "poll.timeout", "250"),
    ("pool", 0, "size", "30"),
    ("admin_keys", 0, "keys", "{admin_key}"),
    ("kafka_bootstrap", 0, "bootstrap.servers", "{kafka}"),
    ("init_extra", 0, "replication.factor", "3"),
]
TEMPLATE_SCHEMA = "template string, pos int, suffix string, value string"

# Binding: (kind, step, template, prefix), steps in write order.
BINDINGS = [
    ("gate", 0, "service", None),
    ("gate", 1, "zookeeper", "curator"),
    ("gate", 2, "kafka_common", "gate.event.sender.producer"),
    ("gate", 3, "producer_extra", "gate.event.sender.producer"),
    ("gate", 4, "start", None),
    ("management-api", 0, "service", None),
    ("management-api", 1, "zookeeper", "curator"),
    ("management-api", 2, "kafka_common", "kafka"),
    ("management-api", 3, "admin_keys", None),
    ("management-api", 4, "start", None),
    ("stream-api", 0, "service", None),
    ("stream-api", 1, "zookeeper", "curator"),
    ("stream-api", 2, "kafka_common", "stream.api.pool.consumer"),
    ("stream-api", 3, "consumer_extra", "stream.api.pool.consumer"),
    ("stream-api", 4, "pool", "stream.api.pool"),
    ("stream-api", 5, "start", None),
    ("stream-manager", 0, "service", None),
    ("stream-manager", 1, "kafka_bootstrap", "kafka"),
    ("stream-manager", 2, "zookeeper", "curator"),
    ("stream-manager", 3, "start", None),
    ("init", 0, "zookeeper", "zk"),
    ("init", 1, "kafka_bootstrap", "kafka"),
    ("init", 2, "init_extra", "kafka"),
]
BINDING_SCHEMA = "kind string, step int, template string, prefix string"

# Placeholders in template values and the entity column that fills each.
PLACEHOLDERS = {
    "{instance_id}": "instance_id",
    "{host}": "host",
    "{port}": "port",
    "{zk}": "zk_connect",
    "{kafka}": "kafka_connect",
    "{admin_key}": "admin_key",
}
START_TEMPLATE = "start"

# ---------------------------------------------------------------------------


def components(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPONENTS, COMPONENT_SCHEMA)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, TEMPLATE_SCHEMA)


def bindings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BINDINGS, BINDING_SCHEMA)


def _sql_literal(v, sql_type: str) -> str:
    if v is None:
        return f"CAST(NULL AS {sql_type})"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def values_sql(rows, schema: str) -> str:
    """``(VALUES ...) AS t(cols)`` body for DuckDB, typed by ``schema``."""
    fields = [f.strip().split() for f in schema.split(",")]
    types = {"int": "INTEGER", "string": "VARCHAR", "bigint": "BIGINT"}
    names = [f[0] for f in fields]
    body = ", ".join("(" + ", ".join(_sql_literal(v, types[t]) for v, (_, t) in zip(r, fields)) + ")"
                     for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"
