"""Projections and filters (P1-P4).  All row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions._util import as_col

# Fixed value: the release asset file-name pattern (unanchored, first match).
# Group 1 is the component name, group 2 the version.
ASSET_NAME_PATTERN = r"(?<name>[a-z-]+)-(?<version>\d[\w\.-]*)\.jar"
ASSET_NAME_GROUPS = ("name", "version")


def extract_groups(df: DataFrame, col, pattern: str, names, prefix: str = "") -> DataFrame:
    """One column per capture group of ``pattern`` (first match).

    ``names[i]`` receives group ``i + 1``.  No match gives ``''``, as an
    unmatched group reads in .NET.
    """
    src = as_col(col)
    return df.withColumns({f"{prefix}{n}": F.regexp_extract(src, pattern, i + 1)
                           for i, n in enumerate(names)})


def select_kind(df: DataFrame, kind: str, kind_col: str = "kind", columns=None) -> DataFrame:
    """Rows of one kind (``Where(is T)``), optionally projected.

    A plain filter: on a partitioned or sorted table it prunes at the scan.
    """
    out = df.where(F.col(kind_col) == F.lit(kind))
    return out.select(*columns) if columns else out


def _filled(df: DataFrame, col: str, default):
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.StringType):
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return F.coalesce(c, F.lit(default))


def with_default(df: DataFrame, col: str, default, out: str | None = None) -> DataFrame:
    """Fill a missing setting.

    Text: NULL **or empty** -> ``default``.  Anything else: NULL -> ``default``.
    """
    return df.withColumn(out or col, _filled(df, col, default))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """P3 for several settings at once (one projection): ``{column: default}``."""
    return df.withColumns({c: _filled(df, c, d) for c, d in defaults.items()})


def audit_responses(df: DataFrame, url: str = "url", code: str = "code", body: str = "body",
                    ok_code: int = 200, out: str = "error") -> DataFrame:
    """Annotate each response with its failure text, NULL when accepted.

    The code is tested before the body; a NULL or zero-length body is empty.
    """
    c, u = F.col(code), F.col(url)
    error = (F.when(c.isNull() | (c != F.lit(ok_code)),
                    F.concat(F.lit("status "), F.coalesce(c.cast("string"), F.lit("none")), F.lit(" from "), u))
             .when(F.coalesce(F.length(F.col(body)), F.lit(0)) == 0,
                   F.concat(F.lit("no content from "), u)))
    return df.withColumn(out, error)


def split_responses(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """P4 split: ``(accepted, rejected)``; both share one annotated plan."""
    annotated = audit_responses(df, **kw)
    err = kw.get("out", "error")
    return (annotated.where(F.col(err).isNull()).drop(err),
            annotated.where(F.col(err).isNotNull()))
