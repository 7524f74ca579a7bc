"""Path and name expressions.

All are built-in column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions._util import as_col


def join_path(*parts) -> Column:
    """``a/b/c``.  NULL parts are skipped, like an absent segment."""
    return F.concat_ws("/", *[as_col(p) for p in parts])


def with_suffix(name, suffix, sep: str = "-") -> Column:
    """``name-suffix``, or just ``name`` when the suffix is NULL.

    ``concat_ws`` skips NULL, which is the optional-instance-id rule;
    plain ``concat`` would turn the whole value NULL.
    """
    return F.concat_ws(sep, as_col(name), as_col(suffix).cast("string"))


def last_segment(path) -> Column:
    """text after the last ``/``; whole value without ``/``; ``''`` after a trailing ``/``."""
    return F.element_at(F.split(as_col(path), "/"), -1)


def parent_dir(path) -> Column:
    """text before the last ``/``; ``''`` when there is none."""
    return F.regexp_extract(as_col(path), r"^(.*)/[^/]*$", 1)
