"""Joins (J1-J6).

Broadcast policy: only our fixed dimension tables are hinted.  Any other
side is left to the planner: a shuffle join on the key, which AQE turns into
a broadcast join only after measuring the shuffled side in bytes, and whose
skewed partitions it splits (``spark.sql.adaptive.skewJoin.enabled``).
Lists that are only tested for membership are made distinct first, which
combines map-side, so a key repeated millions of times costs one row a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from keelson.functions._util import as_col, as_names
from keelson.functions.text import prefixed_key

# Access rights, their letters, and the rule path layout.
RIGHTS = ("read", "write", "manage")
RIGHT_LETTERS = {"r": "read", "w": "write", "m": "manage"}
RULE_PATH_PREFIX = "/auth/rules/"


# --------------------------------------------------------------------- J1
def keep_listed(df: DataFrame, wanted: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key is in ``wanted`` (left semi join).

    Duplicates in ``df`` are kept; duplicates in ``wanted`` do not multiply
    (they are combined before the shuffle).
    """
    keys = as_names(on)
    return df.join(wanted.select(*keys).distinct(), keys, "left_semi")


# --------------------------------------------------------------------- J2
def pending(df: DataFrame, done: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key is not in ``done`` (left anti join).

    With the full file name as key a new version counts as not done.
    """
    keys = as_names(on)
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


#: Bits of the filter over done keys: 131,072 words of 64 bits.
FILTER_BITS = 1 << 23


def pending_filtered(df: DataFrame, done: DataFrame, on, bits: int = FILTER_BITS) -> DataFrame:
    """J2 for few done keys beside many rows: what is surely not done skips the join.

    A Bloom filter of fixed size is built from ``done`` (two hash bits a key,
    merged word by word before and after its shuffle) and broadcast, at most
    ``bits / 64`` rows.  A row that misses a bit is pending for certain and is
    not shuffled; the others are confirmed by ``pending``.  A full filter
    lets all rows through to the join, with the same result.
    """
    keys = as_names(on)
    words = bits // 64

    def places(cols) -> list[tuple[Column, Column]]:
        h = F.xxhash64(*cols)
        # The low and the high half of one 64-bit hash.
        return [(F.pmod(x, F.lit(words)).cast("int"), F.pmod(F.shiftright(x, 20), F.lit(64)).cast("int"))
                for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]

    hit = F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in places([F.col(k) for k in keys])]))
    word = done.select(hit.alias("h")).groupBy(F.col("h.word").alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h.bit"))).alias("_bits"))
    marked = df
    tests = []
    for i, (w, b) in enumerate(places([F.col(k) for k in keys])):
        marked = marked.withColumns({f"_word{i}": w, f"_bit{i}": b})
        side = F.broadcast(word.select(F.col("_word").alias(f"_word{i}"), F.col("_bits").alias(f"_bits{i}")))
        marked = marked.join(side, f"_word{i}", "left")
        tests.append(F.getbit(F.coalesce(F.col(f"_bits{i}"), F.lit(0).cast("long")), F.col(f"_bit{i}")) == 1)
    maybe = reduce(lambda x, y: x & y, tests)
    sure = marked.where(~maybe).select(*df.columns)
    return sure.unionByName(pending(marked.where(maybe).select(*df.columns), done, keys))


# --------------------------------------------------------------------- J3
def _one_per_key(dim: DataFrame, keys: list[str], values: list[str], unique: bool) -> DataFrame:
    """``dim`` with one row a key: ``_found`` (its values) and ``_times`` (how often the key stands there)."""
    found = F.struct(*values) if values else F.struct(F.lit(True).alias("_hit"))
    if unique:
        return dim.select(*keys, found.alias("_found"), F.lit(1).cast("long").alias("_times"))
    # Grouped by the join key, so the join needs no shuffle of its own for it.
    return dim.groupBy(*keys).agg(F.first(found).alias("_found"), F.count(F.lit(1)).alias("_times"))


def strict_lookup(df: DataFrame, dim: DataFrame, on, values=None, unique: bool = False) -> DataFrame:
    """Attach ``dim`` columns; a key that ``dim`` lacks, or has more than once, fails the job.

    ``dim`` is reduced to one row a key first, so it never multiplies rows;
    ``unique=True`` says that its keys are known to be unique and saves that.
    The failure is an expression on the looked-up columns, so it fires when
    they are computed.  A plan that never reads them (e.g. a bare count) may
    prune it — call ``require_keys``, or ``observed_lookup`` for a check that
    rides on the action and is never pruned.
    """
    keys = as_names(on)
    values = as_names(values) if values is not None else [c for c in dim.columns if c not in keys]
    right = _one_per_key(dim, keys, values, unique)
    key = F.to_json(F.struct(*[F.col(k) for k in keys]))
    failed = (F.when(F.col("_times").isNull(), F.raise_error(F.concat(F.lit("missing key "), key)))
              .when(F.col("_times") > 1, F.raise_error(F.concat(F.lit("repeated key "), key))))
    joined = df.join(right, keys, "left")
    return joined.select(*[F.col(c) for c in df.columns],
                         *[F.coalesce(failed.cast(dim.schema[v].dataType), F.col("_found")[v]).alias(v) for v in values])


def observed_lookup(df: DataFrame, dim: DataFrame, on, values=None, name: str | None = None) -> tuple[DataFrame, Observation]:
    """J3 without a second job: ``dim`` columns attached (null where there are none) and an observation.

    Once an action has run over the result, ``observation.get`` holds
    ``rows``, ``missing`` (rows whose key ``dim`` lacks) and ``repeated`` (rows
    whose key ``dim`` has more than once; they get one of its rows).  The
    counts ride on the action as metrics of the plan, so no projection prunes
    them — a bare count reports them too.  ``check_lookup`` raises on them.
    """
    keys = as_names(on)
    values = as_names(values) if values is not None else [c for c in dim.columns if c not in keys]
    seen = Observation(name) if name else Observation()
    joined = df.join(_one_per_key(dim, keys, values, False), keys, "left")
    watched = joined.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_times").isNull()).alias("missing"),
                             F.count_if(F.col("_times") > 1).alias("repeated"))
    return watched.select(*[F.col(c) for c in df.columns], *[F.col("_found")[v].alias(v) for v in values]), seen


def check_lookup(seen: Observation) -> None:
    """Raise if the observed lookup met a missing or repeated key (after its action)."""
    got = seen.get
    if got["missing"] or got["repeated"]:
        raise KeyError(f"lookup of {got['rows']} rows: {got['missing']} with a missing key, {got['repeated']} with a repeated one")


def missing_keys(df: DataFrame, dim: DataFrame, on) -> DataFrame:
    """J3 report: keys of ``df`` absent from ``dim``, with how many rows carry each.

    Rows are counted per key before the join, so a hot key is one row a task.
    """
    keys = as_names(on)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(dim.select(*keys).distinct(), keys, "left_anti")


def require_keys(df: DataFrame, dim: DataFrame, on) -> None:
    """J3 check as its own action: raise if any key of ``df`` is missing from ``dim``."""
    found = missing_keys(df, dim, on).limit(1).collect()
    if found:
        raise KeyError(f"missing key: {found[0].asDict()}")


# --------------------------------------------------------------------- J4
def expand_template(entities: DataFrame, binding: DataFrame, template: DataFrame,
                    on: str = "kind", template_col: str = "template") -> DataFrame:
    """One row per (entity, templated key) through a kind -> template binding.

    ``binding``: ``(kind, step, template, prefix)``; ``template``:
    ``(template, pos, suffix, value)``.  Output adds ``step``, ``pos``,
    ``key = prefix.suffix`` (bare suffix for a NULL prefix) and ``value``.
    Both are plain equi-joins; the planner broadcasts the fixed tables, whose
    size it knows.
    """
    return (entities.join(binding, on)
            .join(template, template_col)
            .withColumn("key", prefixed_key("prefix", "suffix")))


# --------------------------------------------------------------------- J5
def expand_rights(grants: DataFrame, api_key: str = "api_key", pattern: str = "pattern",
                  rights: str | None = None, out: str = "right") -> DataFrame:
    """One access-rule row per right, with its rule path.

    ``rights=None``: every right (``read, write, manage``) per grant.
    ``rights=<col>``: the letter form (``"rwm"``); each known letter once,
    unknown letters dropped.  A generator, not a join: row-local.
    Paths should be unique; check with ``unique_index(.., "path")``.
    """
    if rights is None:
        expanded = grants.withColumn(out, F.explode(F.array(*[F.lit(r) for r in RIGHTS])))
    else:
        letter_map = F.create_map(*[x for kv in RIGHT_LETTERS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        letters = F.array_distinct(F.filter(F.split(as_col(rights), ""), lambda x: x != F.lit("")))
        named = F.filter(F.transform(letters, lambda x: letter_map[x]), lambda x: x.isNotNull())
        expanded = grants.withColumn(out, F.explode(named))
    path = F.concat(F.lit(RULE_PATH_PREFIX), F.col(api_key), F.lit("."), F.col(pattern), F.lit("."), F.col(out))
    return expanded.withColumn("path", path)


# --------------------------------------------------------------------- J6
def conditional_refresh(current: DataFrame, stored: DataFrame, key, etag: str = "etag",
                        values=(), include_missing: bool = False, code: str | None = None) -> DataFrame:
    """Refresh a stored snapshot from the current one by version tag.

    With ``code`` (the response's status column): 304 keeps the stored row,
    200 compares the tags, any other code or none is an ``error`` that
    leaves the stored row as it is (its columns are NULL if there is none).
    A 304 for a key that is not stored is an error too.

    Per key: ``new`` (not stored), ``not_modified`` (same tag: keep the
    stored values), ``modified`` (other tag: take current values and tag),
    and with ``include_missing`` ``missing`` (stored only: kept as stored).
    Tags are compared as they are; a NULL tag never matches.
    """
    keys = as_names(key)
    vals = as_names(values)
    cur = current.select(*keys, F.col(etag).alias("_cur_tag"), *[F.col(v).alias(f"_cur_{v}") for v in vals],
                         (F.col(code) if code else F.lit(200)).alias("_code"), F.lit(True).alias("_in_cur"))
    sto = stored.select(*keys, F.col(etag).alias("_sto_tag"), *[F.col(v).alias(f"_sto_{v}") for v in vals],
                        F.lit(True).alias("_in_sto"))
    joined = cur.join(sto, keys, "full" if include_missing else "left")
    status = (F.when(F.col("_in_cur").isNull(), F.lit("missing"))
              .when((F.col("_code") == 304) & F.col("_in_sto").isNotNull(), F.lit("not_modified"))
              .when(F.coalesce(F.col("_code") != 200, F.lit(True)), F.lit("error"))
              .when(F.col("_in_sto").isNull(), F.lit("new"))
              .when(F.col("_cur_tag") == F.col("_sto_tag"), F.lit("not_modified"))
              .otherwise(F.lit("modified")))
    keep_stored = F.col("status").isin("not_modified", "missing", "error")
    return (joined.withColumn("status", status)
            .select(*keys, "status",
                    F.when(keep_stored, F.col("_sto_tag")).otherwise(F.col("_cur_tag")).alias(etag),
                    *[F.when(keep_stored, F.col(f"_sto_{v}")).otherwise(F.col(f"_cur_{v}")).alias(v)
                      for v in vals]))
