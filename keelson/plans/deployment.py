"""M1: the deployment plan as one lazy DataFrame over any number of clusters.

Input: one row per cluster with its settings — ``cluster_id``,
``base_directory`` (NULL or empty -> ``default_dir``) and the four service
counts ``gate``, ``management_api``, ``stream_api``, ``stream_manager``
(NULL -> 1; negative -> rejected).  Optional ``zk_connect`` /
``kafka_connect`` columns override the connection strings.

Steps, each a library operator:
  P3 defaults -> unpivot counts -> port ranges per host (running totals)
  -> G1 instance ids -> U1 services + init
  -> J3 strict component lookup -> J4 template expansion (kind -> template
  -> key, resolved by A3 last write wins) -> placeholders -> A4 rendered
  ``application.properties``.

No step shuffles the instances: the J3/J4 joins are against fixed,
broadcast dimensions, and A3/A4's grouping runs on the template writes
(see ``deployment_plan``).  G1 shuffles its range rows, one for each
(cluster, kind) and 65,536 instances, to spread huge counts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.paths import join_path, with_suffix
from keelson.functions.text import escape_backslash, when_equals
from keelson.operators.aggregates import collect_properties, render_document, resolve_properties, service_uri
from keelson.operators.joins import expand_rights, expand_template, strict_lookup
from keelson.operators.select import with_defaults
from keelson.operators.sets import expand_instances, ordered_union, rejected_counts
from keelson.operators.windows import running_totals
from keelson.plans import fixtures as fx

COUNT_COLUMNS = {"gate": "gate", "management_api": "management-api",
                 "stream_api": "stream-api", "stream_manager": "stream-manager"}
ENTITY = ["cluster_id", "kind", "instance_id", "name", "directory", "arguments"]


def settle(clusters: DataFrame, default_dir: str, zk: str, kafka: str) -> DataFrame:
    """P3 on every setting."""
    out = with_defaults(clusters, {"base_directory": default_dir, **{c: 1 for c in COUNT_COLUMNS}})
    extra = {}
    if "zk_connect" not in out.columns:
        extra["zk_connect"] = F.lit(zk)
    if "kafka_connect" not in out.columns:
        extra["kafka_connect"] = F.lit(kafka)
    extra["service_host"] = (F.coalesce(F.col("host"), F.lit(fx.SERVICE_HOST)) if "host" in out.columns
                             else F.lit(fx.SERVICE_HOST))
    return out.withColumns(extra) if extra else out


BASE = ["cluster_id", "base_directory", "zk_connect", "kafka_connect", "service_host"]
#: The last port of a host.
LAST_PORT = 65535


def service_counts(settled: DataFrame) -> DataFrame:
    """One row for each cluster and service kind, with the kind's place in the append order."""
    ordinal = F.create_map(*[F.lit(x) for o, kind, _ in fx.COMPONENTS if o is not None for x in (kind, o)])
    return (settled.unpivot(BASE, list(COUNT_COLUMNS), "count_column", "count")
            .withColumn("kind", F.replace(F.col("count_column"), F.lit("_"), F.lit("-")))
            .withColumn("kind_ord", ordinal[F.col("kind")]).drop("count_column"))


def place_ports(counts: DataFrame, port_base: int) -> DataFrame:
    """Each cluster's kind gets the next ``count`` ports of its host: ``first_port`` and how many are ``placed``.

    Ports of a host are given in the order of cluster and kind, so no endpoint
    repeats, whatever clusters share a host.  What lies beyond the host's
    last port is not placed.
    """
    before = running_totals(counts.where(F.col("count") > 0), "service_host", ["cluster_id", "kind_ord", "count"], "count")
    first = (F.lit(port_base) + F.col("before")).cast("long")
    room = F.greatest(F.lit(0), F.lit(LAST_PORT + 1) - F.col("first_port"))
    return (before.withColumn("first_port", first).drop("before")
            .withColumn("placed", F.least(F.col("count").cast("long"), room)))


def plan_instances(spark, settled: DataFrame, ranges: DataFrame) -> DataFrame:
    services = (expand_instances(ranges, "placed").withColumn("port", F.col("first_port") + F.col("instance_id"))
                .drop("placed", "first_port", "count", "kind_ord"))
    kinds = {f.name: f.dataType for f in services.schema}
    init = settled.select(*BASE, F.lit(fx.INIT_KIND).alias("kind"),
                          *[F.lit(None).cast(kinds[c]).alias(c) for c in ("instance_id", "port")])
    # Init first, then the services; ``ord`` proper comes from the component table.
    entities = ordered_union(init, services, ord_col="_group")
    comp = F.broadcast(fx.components(spark))  # fixed five rows, unique kinds
    entities = strict_lookup(entities, comp, "kind", ["ord", "name"], unique=True)
    is_service = F.col("kind") != F.lit(fx.INIT_KIND)
    return (entities.withColumns({
        "directory": join_path("base_directory", with_suffix("name", "instance_id")),
        "arguments": when_equals("name", fx.INIT_NAME, fx.INIT_ARGUMENTS),
        "host": F.when(is_service, F.col("service_host")),
        "admin_key": F.lit(fx.ADMIN_API_KEY),
    }).drop("_group", "service_host"))


def fill_placeholders(value) -> Column:
    """Replace each ``{name}`` marker with the entity column that fills it.

    A linear chain of ``replace`` calls (each step reads the previous one
    once), so the expression stays small inside ``transform`` lambdas.  A
    NULL filler leaves its marker untouched; markers appear only where the
    entity has the value.
    """
    v = F.col(value) if isinstance(value, str) else value
    filled = v
    for ph, col in fx.PLACEHOLDERS.items():
        filled = F.replace(filled, F.lit(ph), F.coalesce(F.col(col).cast("string"), F.lit(ph)))
    # Most values hold no marker: one ``contains`` test skips the chain.
    return F.when(v.contains("{"), filled).otherwise(v)


def document_templates(kind_props: DataFrame) -> DataFrame:
    """A4 at the kind level, as printf templates: one per kind.

    The kind's rendered document (fixed values already escaped) with ``%``
    doubled and each ``{name}`` marker turned into the positional argument
    of its filler (``%1$s`` ...), so an instance's document is one
    ``format_string`` call over its (escaped) values.
    """
    template = F.replace(render_document("props"), F.lit("%"), F.lit("%%"))
    for i, ph in enumerate(fx.PLACEHOLDERS, start=1):
        template = F.replace(template, F.lit(ph), F.lit(f"%{i}$s"))
    return kind_props.select("kind", template.alias("template"), F.size("props").cast("long").alias("n_keys"))


def template_writes(spark, starts: int) -> DataFrame:
    """J4 at the kind level: every property write a kind performs, in order.

    ``starts`` > 1 replays the start template once per start (a restart).
    """
    kinds = fx.components(spark).select("kind")
    rounds = F.when(F.col("template") == F.lit(fx.START_TEMPLATE), F.sequence(F.lit(1), F.lit(starts))) \
        .otherwise(F.array(F.lit(0)))
    return (expand_template(kinds, fx.bindings(spark), fx.templates(spark))
            .withColumn("start_round", F.explode(rounds))
            .select("kind", "key", "value", "start_round", "step", "pos"))


class DeploymentPlan:
    """The plan's outputs, each a lazy DataFrame built on first access.

    ranges     – per cluster and service kind, its host's ports: first one and how many
    instances  – one row per service instance and one init per cluster
    rejected   – (cluster, kind) with a negative count, or with instances that its host has no port for
    writes     – every property assignment, in write order
    properties – A3: resolved ``(entity, key, value, pos)``
    documents  – A4: one rendered properties document per instance
    rules      – J5: the cluster API key's access-rule paths
    topology   – A5: per cluster and service kind, the URI list in instance order

    Only what is used is planned: a query of the documents does not build
    (or pay driver round trips for) the write log, the rules or the topology.
    """

    def __init__(self, clusters: DataFrame, default_dir: str, zk: str, kafka: str, port_base: int, starts: int):
        self._spark = clusters.sparkSession
        self._starts, self._port_base = starts, port_base
        self.settled = settle(clusters, default_dir, zk, kafka)
        self._counts = service_counts(self.settled)

    @cached_property
    def ranges(self) -> DataFrame:
        return place_ports(self._counts, self._port_base)

    @cached_property
    def instances(self) -> DataFrame:
        return plan_instances(self._spark, self.settled, self.ranges)

    @cached_property
    def rejected(self) -> DataFrame:
        """``(cluster_id, kind, host, count, placed, reason)``; the first ``placed`` instances are planned."""
        negative = rejected_counts(self._counts, "count").select(
            "cluster_id", "kind", "service_host", "count", F.lit(0).cast("long").alias("placed"), F.lit("count").alias("reason"))
        beyond = self.ranges.where("placed < count").select(
            "cluster_id", "kind", "service_host", "count", "placed", F.lit("no port").alias("reason"))
        return negative.unionByName(beyond).withColumnRenamed("service_host", "host")

    @cached_property
    def kind_writes(self) -> DataFrame:
        return template_writes(self._spark, self._starts)

    @cached_property
    def resolved(self) -> DataFrame:
        return resolve_properties(self.kind_writes, "kind", "key", "value",
                                  order=["start_round", "step", "pos"])

    @cached_property
    def documents(self) -> DataFrame:
        # Derived from the fixed dimensions only: bounded, so broadcast.
        kind_docs = F.broadcast(document_templates(collect_properties(self.resolved, "kind", "key", "value")))
        fillers = [F.coalesce(escape_backslash(F.col(c).cast("string")), F.lit(ph))
                   for ph, c in fx.PLACEHOLDERS.items()]
        return (self.instances.join(kind_docs, "kind")
                .select(*ENTITY, F.call_function("format_string", F.col("template"), *fillers).alias("document"),
                        "n_keys"))

    @cached_property
    def properties(self) -> DataFrame:
        return (self.instances.join(F.broadcast(self.resolved), "kind")
                .withColumn("value", fill_placeholders("value"))
                .select(*ENTITY, "key", "value", "pos"))

    @cached_property
    def writes(self) -> DataFrame:
        return (self.instances.join(F.broadcast(self.kind_writes), "kind")
                .withColumn("value", fill_placeholders("value"))
                .select(*ENTITY, "key", "value", "start_round", "step", "pos"))

    @cached_property
    def rules(self) -> DataFrame:
        grants = self.settled.select("cluster_id", F.lit(fx.API_KEY).alias("api_key"), F.lit("*").alias("pattern"))
        return expand_rights(grants)

    @cached_property
    def topology(self) -> DataFrame:
        """Row-local: the list is a range of the host's ports (so it is never longer than those)."""
        last = F.col("first_port") + F.col("placed") - 1
        uris = F.transform(F.sequence(F.col("first_port"), last), lambda port: service_uri(F.col("service_host"), port))
        return self.ranges.where("placed > 0").select(
            "cluster_id", "kind", F.array_join(uris, ",").alias("topology"), F.col("placed").alias("instances"))


def deployment_plan(clusters: DataFrame, default_dir: str = ".", zk: str = "localhost:2181",
                    kafka: str = "localhost:9092", port_base: int = 20000, starts: int = 1) -> DeploymentPlan:
    """Build the plan; ``starts`` > 1 replays the per-start writes (a restart).

    An optional ``host`` column (default ``localhost``) says where a cluster's
    services run; clusters may share hosts.  Each service takes the next port
    of its host (``place_ports``: one job, which cuts the cluster rows by
    ranges), from ``port_base`` on.  Instances beyond the last port are not
    planned but returned by ``rejected``.

    Every write of an instance comes from its kind's template list; the
    instance only fills the placeholders.  So last-write-wins (A3) and the
    rendering (A4) run once per kind on the template writes — a few dozen
    rows, bounded by the fixed dimensions — giving one printf template per
    kind, broadcast to the instances, where each document is one
    ``format_string`` call (codegen, row-local).  The aggregates are pushed
    below the expanding join; rendering needs no shuffle at all.
    ``writes`` and ``properties`` still offer the per-instance rows.
    """
    return DeploymentPlan(clusters, default_dir, zk, kafka, port_base, starts)
