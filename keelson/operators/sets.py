"""Set operations and generators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



# --------------------------------------------------------------------- U1
def ordered_union(*dfs: DataFrame, ord_col: str = "ord", allow_missing: bool = False) -> DataFrame:
    """Bag union by column name, tagging each input with its position.

    ``ord`` carries the append order the reference keeps in its list; a
    ``Union`` is a narrow plan node, so this costs no shuffle.
    """
    if not dfs:
        raise ValueError("ordered_union needs at least one DataFrame")
    tagged = [df.withColumn(ord_col, F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), tagged)


# --------------------------------------------------------------------- G1
def expand_instances(df: DataFrame, count: str, out: str = "instance_id", chunk: int = 1 << 16) -> DataFrame:
    """G1: ``count`` rows per input row with ids ``0 .. count-1``; 0 gives none.

    Negative and NULL counts give no rows here; ``rejected_counts`` lists
    them.  Each row is first cut into ranges of at most ``chunk`` ids; the
    range rows are spread over the cluster, and the ids are generated from
    them, so one huge count is expanded by many tasks and never becomes one
    array.
    """
    taken = {c.lower() for c in df.columns}
    lo = next(n for n in ("_lo", "__lo", "___lo") if n not in taken)
    n = F.col(count)
    first = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(chunk).cast("long"))))
    ranges = df.withColumn(lo, first).repartition(*df.columns, lo)
    last = F.least(F.col(lo) + F.lit(chunk), n.cast("long")) - 1
    kind = df.schema[count].dataType
    return ranges.withColumn(out, F.explode(F.sequence(F.col(lo), last))).withColumn(out, F.col(out).cast(kind)).drop(lo)


def rejected_counts(df: DataFrame, count: str) -> DataFrame:
    """G1 reject side: rows whose count is negative or NULL."""
    return df.where(F.col(count).isNull() | (F.col(count) < 0))


__all__ = ["ordered_union", "expand_instances", "rejected_counts"]
