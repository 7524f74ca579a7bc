"""J6, streaming form: a keyed snapshot in Spark's state store, refreshed by version tag.

The state of a key is its stored tag and values.  It starts from the rows of
an initial snapshot (loaded once, with the first batch); then each record
with another tag than the stored one replaces it, and the change is emitted.
A record with the stored tag changes nothing; a NULL tag equals none.  State
and commits are Spark's, and a restart on the same checkpoint goes on where it
was.  ``snapshot`` reads the stored rows back through the ``statestore`` source.

Spark hands each group of a stateful operator to Python, and its output back,
on its own, which takes longer than all work on a key.  Keys are therefore
dealt by hash over a fixed number of ``buckets`` (part of the checkpoint), and
a bucket's state is the list of its stored rows.  A batch reads the buckets
that it touches and appends what it changes, later rows of a key replacing
earlier ones; a bucket is written anew when replaced rows are half of it.

Where a key may occur several times in a batch, ``order`` names the columns
that order its records; they are taken in that order, so the snapshot is the
same from one batch and from many.  Without ``order`` such a key is an error.
A key's records of one batch meet in one task: bound the batch with
``max_files_per_trigger`` where a key may be hot.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from keelson.functions._util import as_names
from keelson.session import ensure_streaming_conf
from keelson.streaming.hop import append_hop

# Pickled by value, so that no state worker has to import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "stored"
#: Groups of keys whose state is read together.
BUCKETS = 1 << 15


class RefreshProcessor(StatefulProcessor):
    """Keeps the stored ``(key, (tag, *values))`` of a bucket's keys and emits what replaces them."""

    def __init__(self, keys: list[str], fields: list[str], orders: list[str], state_schema: T.StructType, out: list[str]):
        self.keys, self.fields, self.orders, self.state_schema, self.out = keys, fields, orders, state_schema, out

    @staticmethod
    def same(value):
        """What equals for equal key values, as in a join or grouping."""
        if isinstance(value, (tuple, list)):
            return tuple(RefreshProcessor.same(v) for v in value)
        if isinstance(value, bytearray):
            return bytes(value)
        return "NaN" if isinstance(value, float) and value != value else value

    def by_key(self, pairs) -> dict:
        return {self.same(key): (key, value) for key, value in pairs}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState(STATE, self.state_schema)
        self.loaded = None

    def handleInitialState(self, key, initialState, timerValues) -> None:
        pairs = [(tuple(r["key"].values()), tuple(r["value"].values())) for r in initialState["rows"]]  # structs come as dicts
        self.loaded = key, list(self.by_key(pairs).values())
        self.state.appendList(self.loaded[1])

    def handleInputRows(self, key, rows, timerValues):
        groups: dict = {}
        for r in rows:
            groups.setdefault(self.same(tuple(r[k] for k in self.keys)), []).append(r)
        if self.loaded is not None and self.loaded[0] == key:  # not read back just after its start was written
            held = self.loaded[1]
        else:
            held = [(tuple(k), tuple(v)) for k, v in self.state.get()]
        self.loaded = None
        kept = self.by_key(held)
        changed, changes = [], []
        for at, records in groups.items():
            names = tuple(records[0][k] for k in self.keys)
            if len(records) > 1:
                if not self.orders:
                    raise ValueError(f"key occurs twice in a batch without an order: {names}")
                by = [*self.orders, *self.fields]
                records.sort(key=lambda r: [(r[c] is not None, r[c] if r[c] is not None else 0) for c in by])
            stored = kept[at][1] if at in kept else None
            status = None
            for r in records:
                tag = r[self.fields[0]]
                if stored is None:
                    status = "new"
                elif tag is not None and tag == stored[0]:
                    continue
                else:
                    status = status or "modified"
                stored = tuple(r[f] for f in self.fields)
            if status is not None:
                kept[at] = (names, stored)
                changed.append(kept[at])
                changes.append((*names, status, *stored))
        if len(held) + len(changed) > 2 * len(kept):
            self.state.clear()
            self.state.appendList(list(kept.values()))
        elif changed:
            self.state.appendList(changed)
        out = Row(*self.out)
        for change in changes:
            yield out(*change)

    def close(self) -> None:
        pass


def refresh_changes(current: DataFrame, key, etag: str = "etag", values=(), order=(), stored: DataFrame | None = None,
                    buckets: int = BUCKETS) -> DataFrame:
    """J6 over a stream: the changed rows ``(keys, status, etag, values)``, status ``new`` or ``modified``.

    A key's last change of a batch is emitted.  ``stored``: the initial
    snapshot, one row a key.
    """
    ensure_streaming_conf(current.sparkSession)
    keys, vals, orders = as_names(key), as_names(values), as_names(order)
    fields = [etag, *vals]
    state_schema = T.StructType([T.StructField(part, T.StructType([T.StructField(c, current.schema[c].dataType) for c in cols]))
                                 for part, cols in (("key", keys), ("value", fields))])
    out = T.StructType([*[T.StructField(k, current.schema[k].dataType) for k in keys], T.StructField("status", T.StringType()),
                        *[T.StructField(f, current.schema[f].dataType) for f in fields]])
    columns = list(dict.fromkeys([*keys, *fields, *orders]))
    name = "bucket"
    while name in columns:
        name = f"_{name}"
    # The keys as the stream has them, so that both sides hash alike.
    bucket = F.pmod(F.xxhash64(*[F.col(k).cast(current.schema[k].dataType) for k in keys]), F.lit(buckets)).alias(name)
    rows = current.select(bucket, *columns).groupBy(name)
    start = None
    if stored is not None:
        row = F.struct(*[F.struct(*[F.col(c).cast(current.schema[c].dataType).alias(c) for c in cols]).alias(part)
                         for part, cols in (("key", keys), ("value", fields))])
        start = stored.select(bucket, row.alias("row")).groupBy(name).agg(F.collect_list("row").alias("rows")).groupBy(name)
    processor = RefreshProcessor(keys, fields, orders, state_schema, out.names)
    return rows.transformWithState(processor, out, "Append", "None", start)


def refresh_stream(current: DataFrame, changes_path: str, checkpoint: str, key, etag: str = "etag", values=(), order=(),
                   stored: DataFrame | None = None):
    """Drain a stream of current records through ``refresh_changes`` into a table of changes."""
    return append_hop(refresh_changes(current, key, etag, values, order, stored), changes_path, checkpoint)


def snapshot(spark: SparkSession, checkpoint: str, stored: DataFrame | None = None) -> DataFrame:
    """The stored rows ``(keys, etag, values)`` after the last batch of the query with this checkpoint.

    Before a first batch (a source without files) that is ``stored``.
    """
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = commits.getFileSystem(spark._jsc.hadoopConfiguration())
    if stored is not None and not (fs.exists(commits) and len(fs.listStatus(commits))):
        return stored
    lists = (spark.read.format("statestore").option("stateVarName", STATE).option("flattenCollectionTypes", "false")
             .load(checkpoint).select(F.posexplode("list_value").alias("pos", "row")))
    last = lists.groupBy("row.key").agg(F.max_by("row.value", "pos").alias("value"))
    return last.select("key.*", "value.*")
