"""Decoding release manifests (JSON documents) into rows, and back.

A manifest is a JSON document with an ``assets`` array of fixed-shape
items.  Decoding is ``from_json`` with an explicit schema (nothing inferred)
followed by ``inline`` — a generator, row-local, no shuffle.

Modes follow the two ways the reference treats a document:
  * ``strict``  – a fresh response: malformed JSON fails the job (FAILFAST).
  * ``lenient`` – a cached copy: malformed JSON yields no items and the row
    goes to the quarantine frame instead (``quarantine_manifest``).
A NULL document (no cache) yields no items in either mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions._util import as_col, as_names
from keelson.operators.windows import number_rows

CORRUPT = "_corrupt_record"

# Fixed value: the item shape of a release manifest.
ASSET_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("browser_download_url", T.StringType()),
])


def _doc_schema(item_schema: T.StructType, array_field: str, lenient: bool) -> T.StructType:
    fields = [T.StructField(array_field, T.ArrayType(item_schema))]
    if lenient:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    return T.StructType(fields)


def _options(lenient: bool) -> dict:
    if lenient:
        return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return {"mode": "FAILFAST"}


def decode_document(df: DataFrame, json_col, schema: T.StructType, mode: str = "strict",
                    keep=()) -> DataFrame:
    """Decode one JSON object per row into the columns of ``schema``."""
    lenient = _check_mode(mode)
    full = T.StructType(list(schema.fields) + ([T.StructField(CORRUPT, T.StringType())] if lenient else []))
    parsed = df.select(*as_names(keep), F.from_json(as_col(json_col), full, _options(lenient)).alias("_d"))
    if lenient:
        parsed = parsed.where(F.col(f"_d.{CORRUPT}").isNull())
    return parsed.select(*as_names(keep), *[F.col(f"_d.{f.name}").alias(f.name) for f in schema.fields])


def unpack_manifest(df: DataFrame, json_col, item_schema: T.StructType = ASSET_SCHEMA,
                    mode: str = "strict", keep=(), array_field: str = "assets") -> DataFrame:
    """One row per item of each document's ``array_field``, with ``keep`` columns."""
    lenient = _check_mode(mode)
    schema = _doc_schema(item_schema, array_field, lenient)
    parsed = df.select(*as_names(keep), F.from_json(as_col(json_col), schema, _options(lenient)).alias("_m"))
    if lenient:
        parsed = parsed.where(F.col(f"_m.{CORRUPT}").isNull())
    return parsed.select(*as_names(keep), F.inline(F.col(f"_m.{array_field}")))


def _quarantine(df: DataFrame, json_col, schema: T.StructType) -> DataFrame:
    parsed = df.withColumn("_m", F.from_json(as_col(json_col), schema, _options(True)))
    return parsed.where(F.col(f"_m.{CORRUPT}").isNotNull()).drop("_m")


def quarantine_manifest(df: DataFrame, json_col, item_schema: T.StructType = ASSET_SCHEMA,
                        array_field: str = "assets") -> DataFrame:
    """Rows of ``df`` whose manifest is present but does not decode (lenient mode's warnings)."""
    return _quarantine(df, json_col, _doc_schema(item_schema, array_field, True))


def quarantine_document(df: DataFrame, json_col, schema: T.StructType) -> DataFrame:
    """Rows of ``df`` whose record document is present but does not decode."""
    return _quarantine(df, json_col, T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())]))


def pack_manifest(df: DataFrame, group, item_cols, out: str = "body", array_field: str = "assets",
                  order=None) -> DataFrame:
    """Inverse of ``unpack_manifest``: one JSON document per group.

    Items are listed in ``order`` (default: the item columns) so the text is
    deterministic.  ``to_json`` leaves out NULL fields.  The document is the
    output value itself, so a group's items necessarily meet in one row; where
    a group may be of any size, use ``pack_pages``.
    """
    grp = as_names(group)
    items = as_names(item_cols)
    order = as_names(order) if order is not None else items
    sort_fields = [F.col(c).alias(f"_s{i}") for i, c in enumerate(order)]
    listed = F.array_sort(F.collect_list(F.struct(*sort_fields, F.struct(*items).alias("_i"))))
    doc = F.to_json(F.struct(F.transform(listed, lambda x: x["_i"]).alias(array_field)))
    return df.groupBy(*grp).agg(doc.alias(out))


def pack_pages(df: DataFrame, group, item_cols, page_rows: int, out: str = "body", page: str = "page",
               array_field: str = "assets", order=None) -> DataFrame:
    """``pack_manifest`` for groups of any size: documents of at most ``page_rows`` items.

    Each group's rows are numbered in ``order`` (default: the item columns)
    without a gap and without one task for a group; page ``p`` holds the items
    ``p * page_rows`` and on, so every page but a group's last is full, and a
    group's pages, taken in order, are its list.
    """
    grp, items = as_names(group), as_names(item_cols)
    numbered = number_rows(df, grp, order if order is not None else items, "_n")
    listed = F.array_sort(F.collect_list(F.struct("_n", F.struct(*items).alias("_i"))))
    doc = F.to_json(F.struct(F.transform(listed, lambda x: x["_i"]).alias(array_field)))
    return (numbered.withColumn(page, F.expr(f"_n div {int(page_rows)}")).groupBy(*grp, page)
            .agg(doc.alias(out), F.count(F.lit(1)).alias("n_items")))


def _check_mode(mode: str) -> bool:
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be 'strict' or 'lenient', not {mode!r}")
    return mode == "lenient"
