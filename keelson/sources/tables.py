"""Reading the driver's Parquet tables.

Parquet carries its own schema, so nothing is inferred.  Reads are lazy:
Catalyst prunes columns and pushes filters into the scan of whatever the
query touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table_glob(sf_dir: str, name: str) -> str:
    """A pattern that only the table itself matches, be it one file or a folder of part files.

    A file stream takes a folder or a pattern; the plain path of a
    single-file table is neither.
    """
    path = table_path(sf_dir, name)
    return f"{path[:-1]}[{path[-1]}]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


class Tables:
    """``Tables(spark, sf_dir).orders`` -> DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # One reader per table and instance: each read lists files and reads
        # the footer on the driver, so reuse the DataFrame (lazy, uncached).
        if name not in self._frames:
            self._frames[name] = read_table(self._spark, self._dir, name)
        return self._frames[name]
