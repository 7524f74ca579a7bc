"""S3: the property lines of many entities, as a table that replaces entity by entity.

Input is A4's line form (``property_lines``): ``(entity, pos, line)``.  The
table has hash buckets of entities, a folder each; its files hold the lines
sorted by entity and position.  A write replaces the entities it brings and
keeps all others: it reads the buckets that it touches, drops the replaced
entities, and swaps those buckets by dynamic partition overwrite.

The number of buckets is set when the table is created, from the number of
lines (``LINES_A_BUCKET``), and stands in the folder names
(``buckets=<n>/bucket=<b>``), so later writes need not be told; how many
tasks write a bucket follows the lines that it then has.  Small writes thus
touch few small buckets, and neither files nor tasks are fixed in number.

``export_property_files`` writes one folder of text files per entity, for
entities that someone reads as files; it too replaces only those.  Spark's
text writer ends every line with ``\n``, so a file ends with a newline where
the in-memory document (``render_properties``) has none.
"""

from __future__ import annotations

import os
import sys
import uuid

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions._util import as_names

# Pickled by value, so that no worker has to import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS, BUCKET = "buckets", "bucket"
#: Lines for which a new table gets a bucket, and lines that one task writes.
LINES_A_BUCKET = 200_000
LINES_A_TASK = 1_000_000


def table_buckets(spark: SparkSession, path: str) -> int | None:
    """The number of buckets of the table at ``path``; None if there is no table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return next((int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKETS}=")), None)


def write_property_files(lines: DataFrame, path: str, entity, pos: str = "pos", line: str = "line",
                         lines_a_bucket: int = LINES_A_BUCKET, lines_a_task: int = LINES_A_TASK) -> None:
    """Replace the entities of ``lines`` in the table at ``path``.

    A bucket's lines are spread by a hash of the position over as many tasks
    as they need, so one long entity is not written by one task.
    """
    ents = as_names(entity)
    spark = lines.sparkSession
    given = table_buckets(spark, path)
    buckets = given or 1 + lines.count() // lines_a_bucket
    new = lines.select(*ents, pos, line).withColumns({
        BUCKETS: F.lit(buckets), BUCKET: F.pmod(F.xxhash64(*ents), F.lit(buckets)).cast("int")})
    if given is not None:
        old = spark.read.schema(new.schema).parquet(path)
        touched = new.select(*ents, BUCKET).distinct()
        kept = (old.join(touched.select(BUCKET).distinct(), BUCKET, "left_semi")
                .join(touched.select(*ents), ents, "left_anti").select(*new.columns))
        new = new.unionByName(kept)
    # One row a bucket, joined to its lines: how many tasks write it.
    sizes = new.groupBy(BUCKET).agg((F.floor(F.count(F.lit(1)) / lines_a_task) + 1).alias("_tasks"))
    spread = F.pmod(F.xxhash64(pos), F.col("_tasks"))
    (new.join(sizes, BUCKET).withColumn("_task", spread).repartition(BUCKET, "_task")
     .sortWithinPartitions(BUCKET, *ents, pos).select(*new.columns)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKETS, BUCKET).parquet(path))


def read_property_files(spark: SparkSession, path: str, entity: str, entity_type: str = "string",
                        line: str = "line", pos: str = "pos", pos_type: str = "int") -> DataFrame:
    """The table as ``(entity, pos, line)`` rows (the schema is given, so nothing is inferred)."""
    schema = T.StructType.fromDDL(f"`{entity}` {entity_type}, `{pos}` {pos_type}, `{line}` string, {BUCKETS} int, {BUCKET} int")
    return spark.read.schema(schema).parquet(path).drop(BUCKETS, BUCKET)


def _folder(name: str, value: str | None) -> str:
    """A partition folder's name, as Spark writes it."""
    def escaped(x: str) -> str:
        return "".join(f"%{ord(c):02X}" if c in '"#%\'*/:=?\\{[]^\x7f' or "\0" < c < " " else c for c in x)

    return f"{escaped(name)}={escaped(value) if value else '__HIVE_DEFAULT_PARTITION__'}"


def _write_folders(root: str, names: list[str], run: str):
    """mapInArrow function: hidden files of the lines of each run of equal entities; ``(folder, file, hidden)`` of each."""
    def write(batches):
        context = TaskContext.get()
        file = f"part-{context.partitionId():08d}-{run}.txt"
        hidden = f".{file}.{context.taskAttemptId()}"
        at, out = None, None
        try:
            for batch in batches:
                done = []
                *values, lines = (c.to_pylist() for c in batch.columns)
                for key, line in zip(zip(*values), lines):
                    if key != at:
                        if out is not None:
                            out.close()
                        folder = "/".join(map(_folder, names, key))
                        os.makedirs(f"{root}/{folder}", exist_ok=True)
                        at, out = key, open(f"{root}/{folder}/{hidden}", "wb")
                        done.append(folder)
                    out.write((line or b"") + b"\n")
                yield pa.record_batch({"folder": pa.array(done, pa.string()), "file": pa.array([file] * len(done), pa.string()),
                                       "hidden": pa.array([hidden] * len(done), pa.string())})
        finally:
            if out is not None:
                out.close()
    return write


def _publish_folders(root: str, run: str):
    """foreachPartition function: the files get their names, and other runs' files go."""
    def publish(rows):
        for r in rows:
            folder = f"{root}/{r.folder}"
            if os.path.exists(f"{folder}/{r.hidden}"):  # else an earlier attempt did it
                os.replace(f"{folder}/{r.hidden}", f"{folder}/{r.file}")
            for name in os.listdir(folder):
                if run not in name:
                    try:
                        os.remove(f"{folder}/{name}")
                    except FileNotFoundError:  # another part's task was faster
                        pass
    return publish


def export_property_files(lines: DataFrame, path: str, entity, pos: str = "pos", line: str = "line") -> None:
    """One folder of text files per entity of ``lines``, lines in ``pos`` order; other entities' folders stay.

    On a mounted file system (scheme ``file``) the tasks write the files
    themselves, hidden ones that a second job publishes when all are written:
    there, Spark's writer starts several processes a file to set its mode, and
    the driver moves files one at a time.  Elsewhere Spark's writer is used.
    """
    ents = as_names(entity)
    spark = lines.sparkSession
    # Empty and null texts have one folder.
    lines = lines.withColumns({e: F.nullif(F.col(e), F.lit("")) for e in ents if isinstance(lines.schema[e].dataType, T.StringType)})
    ordered = lines.repartitionByRange(*ents, pos).sortWithinPartitions(*ents, pos)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        (ordered.select(*ents, F.col(line))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*ents).text(path))
        return
    root, run = fs.makeQualified(place).toUri().getPath(), uuid.uuid4().hex
    listing = f"{path}/_export-{run}"
    columns = [F.col(e).cast("string").alias(f"e{i}") for i, e in enumerate(ents)]
    (ordered.select(*columns, F.col(line).cast("binary").alias("line"))
     .mapInArrow(_write_folders(root, ents, run), "folder string, file string, hidden string").write.parquet(listing))
    spark.read.schema("folder string, file string, hidden string").parquet(listing).foreachPartition(_publish_folders(root, run))
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(listing), True)
