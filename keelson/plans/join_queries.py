"""Join family on the driver's tables: J1, J2, J3, J5, J6.

  * J1 keeps listed rows: parts of two listed brands (a fixed list, like the
    component list), and lines of urgent orders (a data-sized list).
  * J2 finds pending work: orders that have no lines yet.
  * J3 looks up each line's order strictly, and reports lines whose order
    is outside the finished/open set.
  * J5 expands per-customer grants into access-rule paths.
  * J6 refreshes an older snapshot of orders from the current one by tag.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators.joins import (
    RULE_PATH_PREFIX,
    conditional_refresh,
    expand_rights,
    keep_listed,
    missing_keys,
    observed_lookup,
    pending,
    pending_filtered,
    strict_lookup,
)
from keelson.plans.registry import register
from keelson.sources.tables import Tables

LISTED_BRANDS = ("Brand#2", "Brand#17")


@register("j1_keep_listed", """
SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#2', 'Brand#17')
""")
def j1_keep_listed(spark, sf_dir):
    wanted = spark.createDataFrame([(b,) for b in LISTED_BRANDS], "p_brand string")
    # A literal list: the planner knows its size.
    return keep_listed(Tables(spark, sf_dir).part.select("p_partkey", "p_brand"), wanted, "p_brand")


@register("j1_keep_listed_large", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def j1_keep_listed_large(spark, sf_dir):
    t = Tables(spark, sf_dir)
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey"))
    # Data-sized list: a shuffle join unless AQE measures the list as small.
    return keep_listed(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), urgent, "l_orderkey")


@register("j2_pending", """
SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
""")
def j2_pending(spark, sf_dir):
    t = Tables(spark, sf_dir)
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return pending(t.orders.select("o_orderkey", "o_custkey"), done, "o_orderkey")


@register("j2_pending_filtered", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def j2_pending_filtered(spark, sf_dir):
    """Lines of orders that are not urgent: lines that the filter rules out skip the join."""
    t = Tables(spark, sf_dir)
    done = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey"))
    return pending_filtered(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), done, "l_orderkey")


@register("j3_strict_lookup", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_custkey, o.o_orderstatus
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""")
def j3_strict_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    dim = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return strict_lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), dim, "l_orderkey")


@register("j3_observed_lookup", """
WITH dim AS (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')
             UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'),
     n AS (SELECT o_orderkey, count(*) AS times FROM dim GROUP BY o_orderkey)
SELECT count(*) AS "rows", count(*) FILTER (WHERE times IS NULL) AS missing, count(*) FILTER (WHERE times > 1) AS repeated
FROM lineitem LEFT JOIN n ON l_orderkey = o_orderkey
""")
def j3_observed_lookup(spark, sf_dir):
    """What a lookup with missing and repeated keys reports once its one action has run."""
    t = Tables(spark, sf_dir)
    dim = (t.orders.where(F.col("o_orderstatus").isin("F", "O"))
           .unionByName(t.orders.where(F.col("o_orderpriority") == "1-URGENT"))
           .select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"))
    out, seen = observed_lookup(t.lineitem.select("l_orderkey", "l_linenumber"), dim, "l_orderkey")
    out.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[c] for c in ("rows", "missing", "repeated"))], "rows long, missing long, repeated long")


@register("j3_missing_keys", """
SELECT l_orderkey, count(*) AS n_rows FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O'))
GROUP BY l_orderkey
""")
def j3_missing_keys(spark, sf_dir):
    t = Tables(spark, sf_dir)
    settled = (t.orders.where(F.col("o_orderstatus").isin("F", "O"))
               .select(F.col("o_orderkey").alias("l_orderkey")))
    return missing_keys(t.lineitem, settled, "l_orderkey")


SEGMENT_RIGHTS = {"AUTOMOBILE": "r", "BUILDING": "rw", "FURNITURE": "rwm", "HOUSEHOLD": "wm", "MACHINERY": "mm"}


def _segment_rights_col():
    expr = None
    for seg, letters in SEGMENT_RIGHTS.items():
        expr = (F.when(F.col("c_mktsegment") == seg, F.lit(letters)) if expr is None
                else expr.when(F.col("c_mktsegment") == seg, F.lit(letters)))
    return expr.otherwise(F.lit(""))


def _segment_rights_sql():
    whens = " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in SEGMENT_RIGHTS.items())
    return f"CASE c_mktsegment {whens} ELSE '' END"


@register("j5_expand_rights", f"""
SELECT c_custkey, r.right_name AS "right",
       '{RULE_PATH_PREFIX}' || c_name || '.' || '*' || '.' || r.right_name AS path
FROM customer CROSS JOIN (VALUES ('read'), ('write'), ('manage')) AS r(right_name)
""")
def j5_expand_rights(spark, sf_dir):
    grants = Tables(spark, sf_dir).customer.select("c_custkey", F.col("c_name").alias("api_key"),
                                                    F.lit("*").alias("pattern"))
    return expand_rights(grants).select("c_custkey", "right", "path")


@register("j5_expand_right_letters", f"""
WITH g AS (SELECT c_custkey, c_name, {_segment_rights_sql()} AS rights FROM customer),
     letters AS (SELECT DISTINCT c_custkey, c_name, unnest(string_split(rights, '')) AS letter FROM g),
     dim AS (SELECT * FROM (VALUES ('r', 'read'), ('w', 'write'), ('m', 'manage')) AS d(letter, right_name))
SELECT c_custkey, right_name AS "right",
       '{RULE_PATH_PREFIX}' || c_name || '.*.' || right_name AS path
FROM letters JOIN dim USING (letter)
""")
def j5_expand_right_letters(spark, sf_dir):
    grants = Tables(spark, sf_dir).customer.select("c_custkey", F.col("c_name").alias("api_key"),
                                                    F.lit("*").alias("pattern"), _segment_rights_col().alias("rights"))
    return expand_rights(grants, rights="rights").select("c_custkey", "right", "path")


# Snapshot windows for J6: the stored copy was taken before 2000, the current
# one covers orders from February 1995 on; urgent orders changed since, and
# the stored price is kept negated so the output shows which side won.
STORED_BEFORE = "2000-01-01"
CURRENT_FROM = "1995-02-01"


@register("j6_conditional_refresh", f"""
WITH cur AS (SELECT o_orderkey, o_orderstatus AS etag, o_totalprice AS price FROM orders
             WHERE o_orderdate >= TIMESTAMP '{CURRENT_FROM}'),
     sto AS (SELECT o_orderkey,
                    CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS etag,
                    -o_totalprice AS price
             FROM orders WHERE o_orderdate < TIMESTAMP '{STORED_BEFORE}')
SELECT coalesce(cur.o_orderkey, sto.o_orderkey) AS o_orderkey,
       CASE WHEN cur.o_orderkey IS NULL THEN 'missing'
            WHEN sto.o_orderkey IS NULL THEN 'new'
            WHEN cur.etag = sto.etag THEN 'not_modified'
            ELSE 'modified' END AS status,
       CASE WHEN cur.o_orderkey IS NULL OR cur.etag = sto.etag THEN sto.etag ELSE cur.etag END AS etag,
       CASE WHEN cur.o_orderkey IS NULL OR cur.etag = sto.etag THEN sto.price ELSE cur.price END AS price
FROM cur FULL OUTER JOIN sto ON cur.o_orderkey = sto.o_orderkey
""")
def j6_conditional_refresh(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    cur = (orders.where(F.col("o_orderdate") >= F.lit(CURRENT_FROM).cast("timestamp_ntz"))
           .select("o_orderkey", F.col("o_orderstatus").alias("etag"), F.col("o_totalprice").alias("price")))
    sto = (orders.where(F.col("o_orderdate") < F.lit(STORED_BEFORE).cast("timestamp_ntz"))
           .select("o_orderkey",
                   F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("X"))
                   .otherwise(F.col("o_orderstatus")).alias("etag"),
                   (-F.col("o_totalprice")).alias("price")))
    return conditional_refresh(cur, sto, "o_orderkey", "etag", ["price"], include_missing=True)


@register("j6_refresh_with_codes", f"""
WITH cur AS (SELECT o_orderkey, o_orderstatus AS etag, o_totalprice AS price,
                    CASE o_orderkey % 5 WHEN 0 THEN 304 WHEN 1 THEN 503 WHEN 2 THEN NULL ELSE 200 END AS code
             FROM orders WHERE o_orderdate >= TIMESTAMP '{CURRENT_FROM}'),
     sto AS (SELECT o_orderkey,
                    CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS etag,
                    -o_totalprice AS price
             FROM orders WHERE o_orderdate < TIMESTAMP '{STORED_BEFORE}'),
     j AS (SELECT cur.o_orderkey, cur.etag AS ce, cur.price AS cp, sto.etag AS se, sto.price AS sp,
                  CASE WHEN code = 304 AND sto.o_orderkey IS NOT NULL THEN 'not_modified'
                       WHEN code IS DISTINCT FROM 200 THEN 'error'
                       WHEN sto.o_orderkey IS NULL THEN 'new'
                       WHEN cur.etag = sto.etag THEN 'not_modified' ELSE 'modified' END AS status
           FROM cur LEFT JOIN sto ON cur.o_orderkey = sto.o_orderkey)
SELECT o_orderkey, status, CASE WHEN status IN ('new', 'modified') THEN ce ELSE se END AS etag,
       CASE WHEN status IN ('new', 'modified') THEN cp ELSE sp END AS price
FROM j
""")
def j6_refresh_with_codes(spark, sf_dir):
    """J6 on responses: 304 keeps the stored row, 200 compares tags, other codes are errors that change nothing."""
    orders = Tables(spark, sf_dir).orders
    k = F.col("o_orderkey") % 5
    code = F.when(k == 0, 304).when(k == 1, 503).when(k > 2, 200)
    cur = (orders.where(F.col("o_orderdate") >= F.lit(CURRENT_FROM).cast("timestamp_ntz"))
           .select("o_orderkey", F.col("o_orderstatus").alias("etag"), F.col("o_totalprice").alias("price"), code.alias("code")))
    sto = (orders.where(F.col("o_orderdate") < F.lit(STORED_BEFORE).cast("timestamp_ntz"))
           .select("o_orderkey",
                   F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("X"))
                   .otherwise(F.col("o_orderstatus")).alias("etag"),
                   (-F.col("o_totalprice")).alias("price")))
    return conditional_refresh(cur, sto, "o_orderkey", "etag", ["price"], code="code")
