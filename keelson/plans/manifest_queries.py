"""Manifest family on the driver's tables: S1, P1, P3, P4, A1, F3/F4.

Table roles:
  * ``events.props`` is a JSON document per row (S1 record decode); among
    cached copies lie ``documents.text``, which are none (lenient decode and
    quarantine).
  * ``lineitem`` packed per order is a manifest whose assets are its lines
    (S1 pack -> unpack round trip).
  * ``part`` yields release asset file names:
    ``<type>-<name words>-<size>.<partkey>.jar`` (``.jar.asc`` for sizes
    over 45, a signature file that matches the same component name).
  * ``pages`` are fetched responses: code 200 over https, 301 over plain
    http; the body is the whole page (every eleventh came empty).
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.paths import last_segment, parent_dir
from keelson.functions.text import seconds_text
from keelson.operators.aggregates import SLOTS, duplicate_keys, unique_index
from keelson.operators.joins import keep_listed, pending
from keelson.operators.select import (
    ASSET_NAME_GROUPS,
    ASSET_NAME_PATTERN,
    audit_responses,
    extract_groups,
    split_responses,
    with_default,
)
from keelson.plans.registry import register
from keelson.session import shared_path
from keelson.sources.cached import cached_items, read_cached, write_cached
from keelson.sources.manifest import (
    decode_document,
    pack_manifest,
    pack_pages,
    quarantine_document,
    quarantine_manifest,
    unpack_manifest,
)
from keelson.sources.tables import Tables

PROPS_SCHEMA = T.StructType([T.StructField("k", T.IntegerType())])
LINE_ASSET = T.StructType([T.StructField("l_partkey", T.LongType()),
                           T.StructField("l_linenumber", T.IntegerType())])
URL_PATTERN = r"^(https?)://([^/?#]+)"
QUERY_PATTERN = r"[?]([^#]*)"


@register("s1_decode_props", """
SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events
""")
def s1_decode_props(spark, sf_dir):
    return decode_document(Tables(spark, sf_dir).events, "props", PROPS_SCHEMA, keep=["event_id"])


def cached_props(t: Tables):
    """Cached copies: ``events.props``, and whole document texts, which are no JSON objects."""
    return (t.events.select(F.col("event_id").alias("id"), F.col("props").alias("doc"))
            .unionByName(t.documents.select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("doc"))))


CACHED_SQL = """
  SELECT event_id AS id, props AS doc FROM events UNION ALL SELECT -1 - doc_id, text FROM documents"""


@register("s1_lenient_decode", f"""
WITH c AS ({CACHED_SQL})
SELECT id, CAST(doc->>'$.k' AS INTEGER) AS k FROM c WHERE json_valid(doc)
""")
def s1_lenient_decode(spark, sf_dir):
    return decode_document(cached_props(Tables(spark, sf_dir)), "doc", PROPS_SCHEMA, mode="lenient",
                           keep=["id"])


@register("s1_quarantine", f"""
WITH c AS ({CACHED_SQL})
SELECT id, doc FROM c WHERE NOT json_valid(doc)
""")
def s1_quarantine(spark, sf_dir):
    return quarantine_document(cached_props(Tables(spark, sf_dir)), "doc", PROPS_SCHEMA)


@register("s1_pack_unpack_lineitem", """
SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem
""")
def s1_pack_unpack_lineitem(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    packed = pack_manifest(li, "l_orderkey", ["l_partkey", "l_linenumber"], out="body",
                           order=["l_linenumber", "l_partkey"])
    return unpack_manifest(packed, "body", LINE_ASSET, mode="strict", keep=["l_orderkey"])


@register("s1_pack_pages", """
WITH n AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS n
           FROM lineitem),
     p AS (SELECT *, n // 1000 AS page FROM n)
SELECT l_returnflag, page, count(*) OVER (PARTITION BY l_returnflag, page) AS n_items, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM p
""")
def s1_pack_pages(spark, sf_dir):
    """Few groups, each a good part of the table, as documents of a thousand items; decoded again."""
    line = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = Tables(spark, sf_dir).lineitem.select("l_returnflag", *line)
    pages = pack_pages(lines, "l_returnflag", line, 1000)
    item = T.StructType([lines.schema[c] for c in line])
    return unpack_manifest(pages, "body", item, mode="strict", keep=["l_returnflag", "page", "n_items"])


def order_manifests(t: Tables):
    """Lines packed per order; every seventh document is cut in the middle, every eleventh is NULL."""
    packed = pack_manifest(t.lineitem, "l_orderkey", ["l_partkey", "l_linenumber"], out="body", order=["l_linenumber", "l_partkey"])
    half = F.expr("substring(body, 1, length(body) div 2)")
    body = F.when(F.col("l_orderkey") % 11 == 0, F.lit(None)).when(F.col("l_orderkey") % 7 == 0, half).otherwise(F.col("body"))
    return packed.withColumn("body", body)


@register("s1_lenient_manifest", """
SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0
""")
def s1_lenient_manifest(spark, sf_dir):
    """Items of the cached manifests that decode; the others yield none."""
    return unpack_manifest(order_manifests(Tables(spark, sf_dir)), "body", LINE_ASSET, mode="lenient", keep=["l_orderkey"])


@register("s1_quarantine_manifest", """
SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 7 = 0 AND l_orderkey % 11 <> 0
""")
def s1_quarantine_manifest(spark, sf_dir):
    """The cached manifests that are there but do not decode."""
    return quarantine_manifest(order_manifests(Tables(spark, sf_dir)), "body", LINE_ASSET).select("l_orderkey")


def asset_names(t: Tables):
    name = F.concat(F.lower(F.col("p_type")), F.lit("-"), F.regexp_replace("p_name", " ", "-"),
                    F.lit("-"), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"),
                    F.when(F.col("p_size") > 45, F.lit(".jar.asc")).otherwise(F.lit(".jar")))
    return t.part.select("p_partkey", name.alias("asset"))


ASSET_NAME_SQL = """
  SELECT p_partkey,
         lower(p_type) || '-' || replace(p_name, ' ', '-') || '-' || CAST(p_size AS VARCHAR) || '.'
           || CAST(p_partkey AS VARCHAR) || CASE WHEN p_size > 45 THEN '.jar.asc' ELSE '.jar' END AS asset
  FROM part"""


@register("p1_asset_names", f"""
WITH a AS ({ASSET_NAME_SQL})
SELECT p_partkey, asset,
       regexp_extract(asset, '([a-z-]+)-(\\d[\\w\\.-]*)\\.jar', 1) AS name,
       regexp_extract(asset, '([a-z-]+)-(\\d[\\w\\.-]*)\\.jar', 2) AS version
FROM a
""")
def p1_asset_names(spark, sf_dir):
    return extract_groups(asset_names(Tables(spark, sf_dir)), "asset", ASSET_NAME_PATTERN, ASSET_NAME_GROUPS)


@register("p1_url_parts", f"""
SELECT page_id,
       regexp_extract(url, '{URL_PATTERN}', 1) AS scheme,
       regexp_extract(url, '{URL_PATTERN}', 2) AS host
FROM pages
""")
def p1_url_parts(spark, sf_dir):
    return extract_groups(Tables(spark, sf_dir).pages.select("page_id", "url"), "url", URL_PATTERN,
                          ["scheme", "host"]).drop("url")


@register("a1_duplicate_asset_names", f"""
WITH a AS ({ASSET_NAME_SQL})
SELECT regexp_extract(asset, '([a-z-]+)-(\\d[\\w\\.-]*)\\.jar', 1) AS name, count(*) AS count
FROM a GROUP BY 1 HAVING count(*) > 1
""")
def a1_duplicate_asset_names(spark, sf_dir):
    named = extract_groups(asset_names(Tables(spark, sf_dir)), "asset", ASSET_NAME_PATTERN, ASSET_NAME_GROUPS)
    return duplicate_keys(named, "name", SLOTS)  # names are wide


@register("a1_duplicate_line_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS count
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def a1_duplicate_line_keys(spark, sf_dir):
    return duplicate_keys(Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@register("p3_with_default", f"""
SELECT page_id, coalesce(nullif(regexp_extract(url, '{QUERY_PATTERN}', 1), ''), 'none') AS query
FROM pages
""")
def p3_with_default(spark, sf_dir):
    pages = Tables(spark, sf_dir).pages
    q = pages.select("page_id", F.regexp_extract("url", QUERY_PATTERN, 1).alias("query"))
    return with_default(q, "query", "none")


@register("p3_count_default", """
SELECT d.doc_id, coalesce(l.quality, 1) AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def p3_count_default(spark, sf_dir):
    t = Tables(spark, sf_dir)
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return with_default(joined, "quality", 1)


RESPONSE_SQL = """
  SELECT page_id, url, CASE WHEN url LIKE 'https://%' THEN 200 ELSE 301 END AS code,
         CASE WHEN page_id % 11 = 0 THEN '' ELSE html END AS body
  FROM pages"""
AUDIT_SQL = """CASE WHEN code <> 200 THEN 'status ' || CAST(code AS VARCHAR) || ' from ' || url
            WHEN coalesce(length(body), 0) = 0 THEN 'no content from ' || url END"""


def responses(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select(
        "page_id", "url", F.when(F.col("url").startswith("https://"), F.lit(200)).otherwise(F.lit(301)).alias("code"),
        F.when(F.col("page_id") % 11 == 0, F.lit("")).otherwise(F.col("html")).alias("body"))


@register("p4_audit_responses", f"""
WITH r AS ({RESPONSE_SQL})
SELECT page_id, url, code, {AUDIT_SQL} AS error FROM r
""")
def p4_audit_responses(spark, sf_dir):
    return audit_responses(responses(spark, sf_dir)).drop("body")


@register("p4_split", f"""
WITH r AS ({RESPONSE_SQL})
SELECT page_id, {AUDIT_SQL} IS NULL AS accepted, {AUDIT_SQL} AS error, length(body) AS n FROM r
""")
def p4_split(spark, sf_dir):
    """Both sides of the split, marked."""
    ok, bad = split_responses(responses(spark, sf_dir))
    n = F.length("body").cast("long").alias("n")
    return (ok.select("page_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("error"), n)
            .unionByName(bad.select("page_id", F.lit(False).alias("accepted"), "error", n)))


@register("f3_f4_url_paths", """
SELECT page_id, string_split(url, '/')[-1] AS file_name,
       regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent
FROM pages
""")
def f3_f4_url_paths(spark, sf_dir):
    pages = Tables(spark, sf_dir).pages
    return pages.select("page_id", last_segment("url").alias("file_name"), parent_dir("url").alias("parent"))


FILE_ASSET = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("asset", T.StringType())])


@register("release_pipeline", f"""
WITH a AS ({ASSET_NAME_SQL}),
     n AS (SELECT p_partkey, asset, regexp_extract(asset, '([a-z-]+)-(\\d[\\w\\.-]*)\\.jar', 1) AS name FROM a),
     wanted AS (SELECT DISTINCT name FROM n JOIN part USING (p_partkey) WHERE p_size > 40),
     done AS (SELECT asset FROM n WHERE p_partkey % 3 = 0)
SELECT p_partkey, asset, name FROM n
WHERE name IN (SELECT name FROM wanted) AND asset NOT IN (SELECT asset FROM done)
""")
def release_pipeline(spark, sf_dir):
    """S1 -> P1 -> J1 -> J2 -> A1: manifests to the unique index of the listed files not stored yet."""
    t = Tables(spark, sf_dir)
    files = asset_names(t).join(t.part.select("p_partkey", "p_size"), "p_partkey")
    # A release has a thousand files at most; the number of releases follows the table.
    manifests = pack_manifest(files.withColumn("release", F.expr("p_partkey div 1000")), "release", ["p_partkey", "asset"])
    named = extract_groups(unpack_manifest(manifests, "body", FILE_ASSET, mode="strict"), "asset",
                           ASSET_NAME_PATTERN, ASSET_NAME_GROUPS)
    wanted = extract_groups(files.where("p_size > 40"), "asset", ASSET_NAME_PATTERN, ASSET_NAME_GROUPS)
    done = files.where(F.col("p_partkey") % 3 == 0)
    index = pending(keep_listed(named, wanted, "name"), done, "asset")
    return unique_index(index, "asset", slots=SLOTS).select("p_partkey", "asset", "name")


@register("s1_cached_files", f"""
WITH a AS ({ASSET_NAME_SQL}), r AS (SELECT *, p_partkey // 100 AS release FROM a)
SELECT release, 'ok' AS status, p_partkey, asset FROM r WHERE release % 5 <> 1 AND release % 7 <> 3
UNION ALL
SELECT DISTINCT release, CASE WHEN release % 5 = 1 THEN 'absent' ELSE 'damaged' END, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
FROM r WHERE release % 5 = 1 OR release % 7 = 3
""")
def s1_cached_files(spark, sf_dir):
    """Releases of a hundred files cached as manifest files; some never stored, some cut short; read back whole."""
    files = asset_names(Tables(spark, sf_dir)).withColumn("release", F.expr("p_partkey div 100"))
    name = F.format_string("release-%d.json", "release").alias("name")
    docs = pack_manifest(files, "release", ["p_partkey", "asset"]).select("release", name, "body")
    path = shared_path(spark, "s1-cache")
    write_cached(docs.where("release % 5 <> 1"), path)
    # Some are written again, cut as a broken write leaves them; the other files stay.
    write_cached(docs.where("release % 7 = 3 AND release % 5 <> 1").withColumn("body", F.expr("substring(body, 1, length(body) - 5)")), path)
    cached = read_cached(files.select("release", name).distinct(), path, item_schema=FILE_ASSET)
    lost = cached.where("status <> 'ok'").select("release", "status", F.lit(None).cast("long").alias("p_partkey"),
                                                 F.lit(None).cast("string").alias("asset"))
    return cached_items(cached, ["release", "status"]).unionByName(lost)


@register("f8_seconds_text", r"""
SELECT o_orderkey, regexp_replace(printf('%.2f', o_totalprice), '\.?0+$', '') AS seconds FROM orders
""")
def f8_seconds_text(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderkey", seconds_text("o_totalprice").alias("seconds"))
