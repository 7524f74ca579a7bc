"""Zone-free arithmetic on zoneless timestamps (``timestamp_ntz``).

Spark's ``timestampdiff`` / ``timestampadd`` on ``timestamp_ntz`` go through
the session time zone, so a wall time inside a daylight-saving gap of that
zone moves by an hour.  These helpers use only zone-free pieces — the date,
hour, minute and second fields, and adding a day-time interval — so the
result is the same under any session time zone.  All built-ins (codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions._util import as_col

_US_PER_DAY = 86_400_000_000


def ntz_micros(ts) -> Column:
    """Microseconds from ``1970-01-01 00:00:00`` to a zoneless timestamp."""
    c = as_col(ts)
    seconds_us = (F.call_function("date_part", F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long")
    return (F.unix_date(c.cast("date")).cast("long") * F.lit(_US_PER_DAY)
            + F.hour(c).cast("long") * F.lit(3_600_000_000)
            + F.minute(c).cast("long") * F.lit(60_000_000)
            + seconds_us)


def micros_to_ntz(us) -> Column:
    """Inverse of ``ntz_micros``: ``1970-01-01 00:00:00`` plus the microseconds."""
    u = as_col(us)
    days = F.floor(u / F.lit(_US_PER_DAY))
    rest_seconds = ((u - days * F.lit(_US_PER_DAY)) / F.lit(1_000_000)).cast("decimal(18,6)")
    interval = F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), rest_seconds)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + interval


def elapsed_micros(start, end, zoneless: bool = True) -> Column:
    """``end - start`` in microseconds.

    Zoneless values: by their fields (zone-free).  Zoned values are instants:
    the difference of their epoch microseconds.
    """
    if zoneless:
        return ntz_micros(end) - ntz_micros(start)
    return F.unix_micros(as_col(end)) - F.unix_micros(as_col(start))
