"""The corpus pipeline: reject toxic text, drop near copies, mix the sources, pack.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``;
what it returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import mixing, near_dedup, packing, toxicity
from keelson.llm.common import stored
from keelson.sources.tables import read_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_windows)]

#: The stages fit a model and pack by a tokenizer, which SQL can't say; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the ``documents`` table.

    Defined results are those of the stages: rows with null ids, null or empty
    texts stay as far as a stage keeps them (mixing takes no blank text),
    repeated rows are one after near duplicates, an empty table gives no rows,
    other columns are carried along up to packing.
    """
    docs, remove = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, gone = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if remove is not None:
            remove()  # what the stage before it wrote has been read
        remove = gone
    return STAGES[-1][1](spark, docs, sf_dir)
