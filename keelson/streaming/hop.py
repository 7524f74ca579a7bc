"""Restart-safe append hop from a file source to an append-only table.

``readStream`` -> ``writeStream.format("parquet")`` with a checkpoint.  The
file source records which files each batch read and the file sink commits
each batch's files to its ``_spark_metadata`` log, so a rerun (or a retried
task, or a lost executor) on the same checkpoint never writes a row twice.
Readers of the sink see only committed files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Options for a Kafka deployment of the same hop (documentation; the Kafka
# connector is not on this classpath).  Fixed values from the reference's
# producer and consumer settings.
KAFKA_SINK_OPTIONS = {
    "kafka.acks": "all",
    "kafka.batch.size": "65536",
    "kafka.linger.ms": "1",
    "kafka.buffer.memory": "335544320",
    "kafka.retries": "4",
    "kafka.retry.backoff.ms": "250",
}
KAFKA_SOURCE_OPTIONS = {
    "kafkaConsumer.pollTimeoutMs": "250",
}
# The consumer pool's size is a session setting: consumers that an executor keeps open.
KAFKA_SESSION_CONF = {
    "spark.kafka.consumer.cache.capacity": "30",
}


def kafka_options(bootstrap_servers: str, side: str) -> dict:
    """Options for a Kafka source (``side="source"``) or sink (``"sink"``) of this hop.

    The sink carries the producer settings; the source only the consumer's
    poll timeout (the connector itself is not on this classpath).
    """
    if side not in ("source", "sink"):
        raise ValueError("side must be 'source' or 'sink'")
    extra = KAFKA_SINK_OPTIONS if side == "sink" else KAFKA_SOURCE_OPTIONS
    return {"kafka.bootstrap.servers": bootstrap_servers, **extra}


def file_stream(spark: SparkSession, source_dir: str, schema: T.StructType, fmt: str = "parquet",
                path_glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over the files of ``source_dir`` (explicit schema)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(source_dir)


def append_hop(stream: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
               partition_by=None, query_name: str | None = None, wait: bool = True):
    """Drain ``stream`` into an append-only table at ``sink_path``.

    ``trigger(availableNow=True)``: process everything present now (in as
    many batches as the source's rate limits make), then stop.  Returns the
    ``StreamingQuery`` (already finished when ``wait``).
    """
    writer = (stream.writeStream.format(fmt).outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", sink_path)
              .trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if query_name:
        writer = writer.queryName(query_name)
    q = writer.start()
    if wait:
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(f"hop failed: {q.exception()}")
    return q
