"""S1, cached manifests: one file a document, read whole and tested against what is expected.

A cached document lies in a folder named by the SHA-256 of its name (so names
need no escaping), as one text file; writing it again replaces that folder
and no other (dynamic partition overwrite).  Reading joins the names that
are expected to the files that are there: a document without a file is
``absent`` and yields nothing, one that does not decode is ``damaged`` and
goes to quarantine, any other is ``ok``.  Neither fails the job: a cache that
cannot be read is as good as none.

Files are read with the ``binaryFile`` source, whole and in parallel; the
number of files follows the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.aggregates import unique_index
from keelson.sources.manifest import ASSET_SCHEMA, CORRUPT

FOLDER = "doc"
STATUSES = ("ok", "absent", "damaged")


def _digest(name: str):
    return F.sha2(F.col(name).cast("string"), 256)


def write_cached(docs: DataFrame, path: str, name: str = "name", body: str = "body") -> None:
    """Write each document of ``docs`` (unique names) as a file of its own; others in ``path`` stay.

    A NULL body is not written (and leaves an older file as it is).
    """
    some = unique_index(docs.where(F.col(body).isNotNull()), name)
    (some.select(_digest(name).alias(FOLDER), F.col(body).cast("string").alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).text(path))


def cached_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, body)`` of every file under ``path``: the digest of its name and its bytes (none if there is no folder)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{FOLDER} string, body binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    # The text writer ends the file with a newline of its own.
    return files.select(F.regexp_extract("path", f"{FOLDER}=([0-9a-f]+)/[^/]*$", 1).alias(FOLDER),
                        F.expr("substring(content, 1, length(content) - 1)").alias("body"))


def read_cached(expected: DataFrame, path: str, name: str = "name", item_schema: T.StructType = ASSET_SCHEMA,
                array_field: str = "assets") -> DataFrame:
    """``expected`` with ``status``, ``body`` and the decoded items of each name's file."""
    schema = T.StructType([T.StructField(array_field, T.ArrayType(item_schema)), T.StructField(CORRUPT, T.StringType())])
    files = cached_files(expected.sparkSession, path)
    joined = expected.withColumn("_doc", _digest(name)).join(files.withColumnRenamed(FOLDER, "_doc"), "_doc", "left").drop("_doc")
    text = F.when(F.is_valid_utf8("body"), F.col("body").cast("string"))
    parsed = joined.withColumn("_m", F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    status = (F.when(F.col("body").isNull(), "absent")
              .when(F.col("_m").isNull() | F.col(f"_m.{CORRUPT}").isNotNull(), "damaged").otherwise("ok"))
    return (parsed.withColumn("status", status)
            .withColumn(array_field, F.when(F.col("status") == "ok", F.col(f"_m.{array_field}"))).drop("_m"))


def cached_items(cached: DataFrame, keep, array_field: str = "assets") -> DataFrame:
    """One row per item of the documents that are ``ok``, with the ``keep`` columns."""
    return cached.where("status = 'ok'").select(*([keep] if isinstance(keep, str) else keep), F.inline(array_field))


def quarantined(cached: DataFrame) -> DataFrame:
    """The documents that are there but do not decode, with their bytes."""
    return cached.where("status = 'damaged'")
