"""One query per operator over the driver's tables, and its SQL where SQL can say it.

The queries are thin: they call the operator with its production
parameters on the whole table and derive the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import (
    ann,
    codes,
    conversations,
    licenses,
    mixing,
    near_dedup,
    packing,
    suffix_tree,
    token_counts,
    topk,
    toxicity,
    url_rules,
    warc,
)
from keelson.session import shared_path
from keelson.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sum_of_squares_packing(spark, sf_dir):
    """Every document's pieces in gap-free sequences of 4096 tokens."""
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "sequence_length")


@query
def op2_cross_polytope_neighbours(spark, sf_dir):
    """The 5 nearest found of every fiftieth vector."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where("vec_id % 50 = 0"))


# The rules of the query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op3_url_rules(spark, sf_dir):
    """Host, path, rule and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(read_table(spark, sf_dir, "pages"), rules)


ORACLE["op3_url_rules"] = """
WITH r(h, p, v) AS (VALUES %s),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (SELECT page_id, row_number() OVER () AS n,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT n, arg_max(h || p, length(h) * 1000 + length(p)) AS rule, arg_max(v, length(h) * 1000 + length(p)) AS verdict
      FROM x JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM x LEFT JOIN m USING (n)
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query
def op4_license_scan(spark, sf_dir):
    """Licence places and labels of every document."""
    word = F.transform("places", lambda x: x["word"])
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"), F.array_join("base", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


@query
def op5_impact_ordered_topk(spark, sf_dir):
    """The 5 highest integer inner products of every fiftieth vector."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(rows, rows.where("vec_id % 50 = 0"))


ORACLE["op5_impact_ordered_topk"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, x -> floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(max(list_dot_product(q.v, c.v)) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op6_warc_revisits(spark, sf_dir):
    """Every page written as a WARC record and read back, responses with their payloads."""
    path = shared_path(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    return warc.verified(spark, path).select(
        F.col("record_id").cast("long").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query
def op7_toxicity_severity(spark, sf_dir):
    """Expected severity of every document, fitted on the ``labels`` table."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.score(docs, toxicity.fit(docs, labels))


@query
def op8_sainte_lague_mix(spark, sf_dir):
    """The words that the mix takes of every document."""
    return mixing.takes(read_table(spark, sf_dir, "documents"))


@query
def op9_minhash_components(spark, sf_dir):
    """Near-duplicate component of every document."""
    found = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op10_suffix_tree_scores(spark, sf_dir):
    """Unigram and suffix-tree scores of every document."""
    return suffix_tree.score(read_table(spark, sf_dir, "documents"))


@query
def op11_scalar_weight_repair(spark, sf_dir):
    """Faults, cheapest edits and repaired digest of every damaged conversation."""
    return conversations.repair(conversations.damaged(read_table(spark, sf_dir, "conversations")))


@query
def op12_adaptive_bound_codes(spark, sf_dir):
    """Product code of every vector, its error and its label's, and the codebooks' digest."""
    coded, books = codes.compress(read_table(spark, sf_dir, "embeddings"))
    return codes.with_label_error(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


@query
def op13_heap_token_counts(spark, sf_dir):
    """Token count of every document."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
