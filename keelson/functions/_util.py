from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Column name or Column -> Column."""
    return F.col(c) if isinstance(c, str) else c


def as_cols(cs) -> list[Column]:
    if isinstance(cs, (str, Column)):
        cs = [cs]
    return [as_col(c) for c in cs]


def as_names(cs) -> list[str]:
    if isinstance(cs, str):
        return [cs]
    return list(cs)
