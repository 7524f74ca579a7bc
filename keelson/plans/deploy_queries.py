"""Deployment family on the driver's tables: G1, U1, P2, J4, A5, M1.

  * G1 expands each part into ``p_size - 1`` instances (so 0 occurs).
  * U1 appends suppliers after customers; P2 selects one kind back.
  * J4 binds each customer to a component kind by market segment and
    expands that kind's property templates.
  * A5 lists supplier endpoints per nation (port = supplier key).
  * M1 plans one cluster per customer, sized by its orders: gate = finished
    orders, management API = open, stream API = pending, stream manager =
    urgent.  Base directories: none for AUTOMOBILE (default), empty for
    BUILDING (default), ``/srv/<segment>`` otherwise.  BUILDING clusters all
    share the default host, the others a host for each 500 customers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators.aggregates import topology, topology_pages, topology_pieces
from keelson.operators.joins import RULE_PATH_PREFIX, expand_template
from keelson.operators.select import select_kind
from keelson.operators.sets import expand_instances, ordered_union, rejected_counts
from keelson.plans import fixtures as fx
from keelson.plans.deployment import deployment_plan
from keelson.plans.registry import register
from keelson.sources.tables import Tables

COMPONENTS_SQL = fx.values_sql(fx.COMPONENTS, fx.COMPONENT_SCHEMA)
TEMPLATES_SQL = fx.values_sql(fx.TEMPLATES, fx.TEMPLATE_SCHEMA)
BINDINGS_SQL = fx.values_sql(fx.BINDINGS, fx.BINDING_SCHEMA)

SEGMENT_KIND = [("AUTOMOBILE", "gate"), ("BUILDING", "management-api"), ("FURNITURE", "stream-api"),
                ("HOUSEHOLD", "stream-manager"), ("MACHINERY", "init")]
SEGMENT_KIND_SQL = fx.values_sql(SEGMENT_KIND, "c_mktsegment string, kind string")


@register("g1_expand_instances", """
SELECT p_partkey, unnest(range(p_size - 1)) AS instance_id FROM part
""")
def g1_expand_instances(spark, sf_dir):
    part = Tables(spark, sf_dir).part.select("p_partkey", (F.col("p_size") - 1).cast("long").alias("n"))
    return expand_instances(part, "n").drop("n")


@register("g1_expand_instances_split", """
SELECT p_partkey, unnest(range(p_size - 1)) AS instance_id FROM part
""")
def g1_expand_instances_split(spark, sf_dir):
    """Same result with ranges of 8 ids, so most counts are cut."""
    part = Tables(spark, sf_dir).part.select("p_partkey", (F.col("p_size") - 1).cast("long").alias("n"))
    return expand_instances(part, "n", chunk=8).drop("n")


@register("g1_rejected_counts", """
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size - 10 END AS n FROM part
WHERE p_size % 7 = 0 OR p_size < 10
""")
def g1_rejected_counts(spark, sf_dir):
    """G1's reject side: NULL and negative counts."""
    n = F.when(F.col("p_size") % 7 != 0, F.col("p_size") - 10)
    return rejected_counts(Tables(spark, sf_dir).part.select("p_partkey", n.alias("n")), "n")


def _members(t: Tables):
    cust = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                             F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("kind"))
    supp = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                             F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("kind"))
    return ordered_union(cust, supp)


@register("u1_ordered_union", """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, 'customer' AS kind, 0 AS ord FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, 'supplier', 1 FROM supplier
""")
def u1_ordered_union(spark, sf_dir):
    return _members(Tables(spark, sf_dir))


@register("p2_select_kind", """
SELECT s_suppkey AS id, s_name AS name FROM supplier
""")
def p2_select_kind(spark, sf_dir):
    return select_kind(_members(Tables(spark, sf_dir)), "supplier", columns=["id", "name"])


@register("j4_expand_template", f"""
WITH seg AS (SELECT * FROM {SEGMENT_KIND_SQL}),
     b AS (SELECT * FROM {BINDINGS_SQL}),
     tm AS (SELECT * FROM {TEMPLATES_SQL})
SELECT c.c_custkey, seg.kind, b.step, tm.pos, concat_ws('.', b.prefix, tm.suffix) AS key, tm.value
FROM customer c JOIN seg USING (c_mktsegment) JOIN b ON b.kind = seg.kind JOIN tm ON tm.template = b.template
""")
def j4_expand_template(spark, sf_dir):
    seg = F.broadcast(spark.createDataFrame(SEGMENT_KIND, "c_mktsegment string, kind string"))
    ents = Tables(spark, sf_dir).customer.select("c_custkey", "c_mktsegment").join(seg, "c_mktsegment")
    out = expand_template(ents, fx.bindings(spark), fx.templates(spark))
    return out.select("c_custkey", "kind", "step", "pos", "key", "value")


@register("a5_topology", """
SELECT s_nationkey, s_suppkey // 1000 AS site,
       string_agg('http://localhost:' || CAST(s_suppkey AS VARCHAR) || '/', ',' ORDER BY s_suppkey) AS topology,
       count(*) AS instances
FROM supplier GROUP BY s_nationkey, s_suppkey // 1000
""")
def a5_topology(spark, sf_dir):
    """One readable list a nation and site; a site has a thousand suppliers at most."""
    supp = Tables(spark, sf_dir).supplier.select("s_nationkey", F.expr("s_suppkey div 1000").alias("site"), "s_suppkey",
                                                 F.lit("localhost").alias("host"))
    return topology(supp, ["s_nationkey", "site"], "host", "s_suppkey", "s_suppkey", chunk=16)


@register("a5_topology_pages", """
WITH n AS (SELECT s_nationkey, 's' || CAST(s_nationkey AS VARCHAR) || '.local' AS host, s_suppkey,
                  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name DESC, s_suppkey) - 1 AS n FROM supplier)
SELECT s_nationkey, n // 16 AS page,
       string_agg('http://' || host || ':' || CAST(s_suppkey AS VARCHAR) || '/', ',' ORDER BY n) AS piece, count(*) AS n
FROM n GROUP BY s_nationkey, n // 16
""")
def a5_topology_pages(spark, sf_dir):
    """Full pages of 16 endpoints in an order that is not a number."""
    supp = Tables(spark, sf_dir).supplier.withColumn("host", F.format_string("s%d.local", "s_nationkey"))
    return topology_pages(supp.withColumn("down", F.translate("s_name", "0123456789", "9876543210")), "s_nationkey", "host",
                          "s_suppkey", ["down", "s_suppkey"], page_rows=16)


@register("a5_topology_pieces", """
SELECT s_nationkey, s_suppkey // 16 AS bucket,
       string_agg('http://localhost:' || CAST(s_suppkey AS VARCHAR) || '/', ',' ORDER BY s_suppkey) AS piece,
       count(*) AS n
FROM supplier GROUP BY s_nationkey, s_suppkey // 16
""")
def a5_topology_pieces(spark, sf_dir):
    supp = Tables(spark, sf_dir).supplier.select("s_nationkey", "s_suppkey", F.lit("localhost").alias("host"))
    return topology_pieces(supp, "s_nationkey", "host", "s_suppkey", "s_suppkey", chunk=16)


def clusters_from_orders(t: Tables):
    o = t.orders
    counts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("gate"),
        F.count_if(F.col("o_orderstatus") == "O").alias("management_api"),
        F.count_if(F.col("o_orderstatus") == "P").alias("stream_api"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("stream_manager"))
    base = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit(None).cast("string"))
            .when(F.col("c_mktsegment") == "BUILDING", F.lit(""))
            .otherwise(F.concat(F.lit("/srv/"), F.lower("c_mktsegment"))))
    host = F.when(F.col("c_mktsegment") != "BUILDING", F.format_string("node-%d", F.expr("c_custkey div 500")))
    return (t.customer.select("c_custkey", "c_mktsegment").join(counts, "c_custkey", "left")
            .select(F.col("c_custkey").alias("cluster_id"), base.alias("base_directory"), host.alias("host"),
                    "gate", "management_api", "stream_api", "stream_manager"))


def _placeholder_sql() -> str:
    cases = " ".join(f"WHEN '{ph}' THEN CAST({col} AS VARCHAR)" for ph, col in fx.PLACEHOLDERS.items())
    return f"CASE tm.value {cases} ELSE tm.value END"


M1_SQL = f"""
WITH counts AS (
  SELECT o_custkey,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS gate,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS management_api,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS stream_api,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS stream_manager
  FROM orders GROUP BY o_custkey),
settled AS (
  SELECT c_custkey AS cluster_id,
         coalesce(nullif(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN NULL
                              WHEN c_mktsegment = 'BUILDING' THEN ''
                              ELSE '/srv/' || lower(c_mktsegment) END, ''), '.') AS base_directory,
         CASE WHEN c_mktsegment = 'BUILDING' THEN '{fx.SERVICE_HOST}'
              ELSE 'node-' || CAST(c_custkey // 500 AS VARCHAR) END AS service_host,
         coalesce(gate, 1) AS gate, coalesce(management_api, 1) AS management_api,
         coalesce(stream_api, 1) AS stream_api, coalesce(stream_manager, 1) AS stream_manager
  FROM customer LEFT JOIN counts ON c_custkey = o_custkey),
long AS (
  SELECT cluster_id, base_directory, service_host, 'gate' AS kind, gate AS cnt FROM settled
  UNION ALL SELECT cluster_id, base_directory, service_host, 'management-api', management_api FROM settled
  UNION ALL SELECT cluster_id, base_directory, service_host, 'stream-api', stream_api FROM settled
  UNION ALL SELECT cluster_id, base_directory, service_host, 'stream-manager', stream_manager FROM settled),
comp AS (SELECT * FROM {COMPONENTS_SQL}),
starts AS (
  SELECT l.*, c.name, CAST(20000 + coalesce(sum(cnt) OVER (PARTITION BY service_host ORDER BY cluster_id, c.ord
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_port
  FROM long l JOIN comp c USING (kind) WHERE cnt > 0),
ports AS (SELECT *, least(cnt, greatest(0, 65536 - first_port)) AS placed FROM starts),
services AS (SELECT cluster_id, base_directory, service_host, kind, name, first_port, unnest(range(placed)) AS instance_id FROM ports),
ents AS (
  SELECT cluster_id, base_directory, service_host AS host, kind, instance_id, first_port + instance_id AS port, name FROM services
  UNION ALL
  SELECT cluster_id, base_directory, CAST(NULL AS VARCHAR), 'init', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), '{fx.INIT_NAME}' FROM settled),
attrs AS (
  SELECT *, concat_ws('/', base_directory, concat_ws('-', name, CAST(instance_id AS VARCHAR))) AS directory,
         CASE WHEN name = '{fx.INIT_NAME}' THEN '{fx.INIT_ARGUMENTS}' ELSE '' END AS arguments,
         'localhost:2181' AS zk_connect, 'localhost:9092' AS kafka_connect,
         '{fx.ADMIN_API_KEY}' AS admin_key
  FROM ents),
b AS (SELECT * FROM {BINDINGS_SQL}),
tm AS (SELECT * FROM {TEMPLATES_SQL}),
props AS (
  SELECT a.cluster_id, a.kind, a.instance_id, a.directory, a.arguments, b.step, tm.pos,
         concat_ws('.', b.prefix, tm.suffix) AS key, {_placeholder_sql()} AS value
  FROM attrs a JOIN b ON b.kind = a.kind JOIN tm ON tm.template = b.template)
SELECT cluster_id, kind, instance_id, directory, arguments,
       string_agg(key || '=' || replace(value, '\\', '\\\\'), chr(10) ORDER BY step, pos) AS document,
       count(*) AS n_keys
FROM props GROUP BY cluster_id, kind, instance_id, directory, arguments
"""


M1_PROPS_SQL = M1_SQL[:M1_SQL.index("SELECT cluster_id, kind, instance_id, directory, arguments,\n       string_agg")].rstrip()


@register("m1_properties", M1_PROPS_SQL + """
SELECT cluster_id, kind, instance_id, key, value FROM props
""")
def m1_properties(spark, sf_dir):
    """Every resolved property of every instance."""
    plan = deployment_plan(clusters_from_orders(Tables(spark, sf_dir)))
    return plan.properties.select("cluster_id", "kind", "instance_id", "key", "value")


@register("m1_restart_writes", M1_PROPS_SQL + """,
rounds AS (SELECT 'start' AS template, unnest([1, 2]) AS start_round UNION ALL
           SELECT DISTINCT template, 0 FROM tm WHERE template <> 'start')
SELECT a.cluster_id, a.kind, a.instance_id, concat_ws('.', b.prefix, tm.suffix) AS key,
       """ + _placeholder_sql() + """ AS value, r.start_round, b.step, tm.pos
FROM attrs a JOIN b ON b.kind = a.kind JOIN tm ON tm.template = b.template JOIN rounds r ON r.template = tm.template
""")
def m1_restart_writes(spark, sf_dir):
    """Every property write of a deployment whose services start twice."""
    plan = deployment_plan(clusters_from_orders(Tables(spark, sf_dir)), starts=2)
    return plan.writes.select("cluster_id", "kind", "instance_id", "key", "value", "start_round", "step", "pos")


M1_BASE_SQL = M1_SQL[:M1_SQL.index("b AS (SELECT * FROM")].rstrip().rstrip(",")


@register("m1_service_topology", M1_BASE_SQL + """
SELECT cluster_id, kind,
       string_agg('http://' || host || ':' || CAST(port AS VARCHAR) || '/', ',' ORDER BY instance_id) AS topology,
       count(*) AS instances
FROM attrs WHERE kind <> 'init' GROUP BY cluster_id, kind
""")
def m1_service_topology(spark, sf_dir):
    return deployment_plan(clusters_from_orders(Tables(spark, sf_dir))).topology


M1_PORTS_SQL = M1_SQL[:M1_SQL.index("services AS (SELECT")].rstrip().rstrip(",")


@register("m1_port_plan", M1_PORTS_SQL + """
SELECT cluster_id, kind, service_host AS host, first_port, placed FROM ports
""")
def m1_port_plan(spark, sf_dir):
    """The ports of every cluster's services on its host, given out by running totals."""
    ranges = deployment_plan(clusters_from_orders(Tables(spark, sf_dir))).ranges
    return ranges.select("cluster_id", "kind", F.col("service_host").alias("host"), "first_port", "placed")


@register("m1_rejected", M1_PORTS_SQL.replace("20000 + coalesce", "62000 + coalesce").replace(
    "coalesce(stream_api, 1) AS stream_api", "coalesce(stream_api, 1) - 1 AS stream_api") + """
SELECT cluster_id, kind, service_host AS host, cnt AS count, placed, 'no port' AS reason FROM ports WHERE placed < cnt
UNION ALL SELECT cluster_id, kind, service_host, cnt, 0, 'count' FROM long WHERE cnt < 0
""")
def m1_rejected(spark, sf_dir):
    """Services that were not planned: negative counts, and those that their host has no port for."""
    clusters = clusters_from_orders(Tables(spark, sf_dir)).withColumn("stream_api", F.coalesce(F.col("stream_api"), F.lit(1)) - 1)
    return deployment_plan(clusters, port_base=62000).rejected


@register("m1_access_rules", f"""
SELECT c_custkey AS cluster_id, r.right_name AS "right",
       '{RULE_PATH_PREFIX}{fx.API_KEY}.*.' || r.right_name AS path
FROM customer CROSS JOIN (VALUES ('read'), ('write'), ('manage')) AS r(right_name)
""")
def m1_access_rules(spark, sf_dir):
    plan = deployment_plan(clusters_from_orders(Tables(spark, sf_dir)))
    return plan.rules.select("cluster_id", "right", "path")


@register("m1_deployment_plan", M1_SQL)
def m1_deployment_plan(spark, sf_dir):
    plan = deployment_plan(clusters_from_orders(Tables(spark, sf_dir)))
    return plan.documents.select("cluster_id", "kind", "instance_id", "directory", "arguments",
                                 "document", "n_keys")
