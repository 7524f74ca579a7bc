"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions._util import as_col


def escape_backslash(value) -> Column:
    """double every backslash and touch nothing else.

    Literal ``replace``, not ``regexp_replace`` (no pattern semantics).
    """
    return F.replace(as_col(value), F.lit("\\"), F.lit("\\\\"))


def int_text(value) -> Column:
    """integer -> decimal text."""
    return as_col(value).cast("string")


def seconds_text(seconds) -> Column:
    """F8: seconds as ``0.##`` text (at most two decimals, trailing zeros dropped).

    Rounds half-even on the binary value; compare numbers, not this text.
    """
    return F.call_function("format_number", as_col(seconds), F.lit("0.##"))


def service_uri(host, port, scheme: str = "http") -> Column:
    """``scheme://host:port/``."""
    return F.format_string(f"{scheme}://%s:%d/", as_col(host), as_col(port))


def prefixed_key(prefix, suffix) -> Column:
    """``prefix.suffix``; a NULL prefix gives the bare suffix."""
    return F.concat_ws(".", as_col(prefix), as_col(suffix))


def when_equals(value, match: str, then: str, otherwise: str = "") -> Column:
    """fixed text when ``value == match``, else ``otherwise`` (``''``)."""
    return F.when(as_col(value) == F.lit(match), F.lit(then)).otherwise(F.lit(otherwise))
