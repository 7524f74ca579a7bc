"""Several order columns as one number of fixed width.

A tuple of integral, date and time columns compares like one mixed-radix
integer: each column's value, moved to start at 1 (NULL is 0, so it comes
first, as in a struct), is a digit whose base is the size of its type.  As a
``decimal(38, 0)`` the number fits in a hash aggregate's buffer, where a
struct of the same columns does not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.times import micros_to_ntz, ntz_micros

NUMBER = T.DecimalType(38, 0)
#: Bits of a type's values.  Times lie within 73,000 years of 1970.
BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.DateType: 32, T.LongType: 64, T.TimestampType: 62, T.TimestampNTZType: 62}


def _whole(col: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(col))
    if isinstance(kind, T.TimestampNTZType):
        return ntz_micros(col)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(col))
    return F.col(col)


def _back(whole: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(whole.cast("int"))
    if isinstance(kind, T.TimestampNTZType):
        return micros_to_ntz(whole)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(whole)
    return whole.cast(kind)


def packed_order(schema: T.StructType, orders: list[str]) -> tuple[Column, Callable[[Column], Column]] | None:
    """The columns as one number, and the way back to their struct; None where their types don't fit."""
    kinds = [schema[c].dataType for c in orders]
    if any(type(k) not in BITS for k in kinds):
        return None
    bits = [BITS[type(k)] for k in kinds]
    bases = [(1 << b) + 1 for b in bits]
    size = 1
    for base in bases:
        size *= base
    if size >= 10 ** 38:
        return None

    def literal(n: int) -> Column:
        return F.lit(str(n)).cast(NUMBER)

    number = None
    for col, kind, b, base in zip(orders, kinds, bits, bases):
        digit = F.coalesce(_whole(col, kind).cast(NUMBER) + literal((1 << (b - 1)) + 1), literal(0)).cast(NUMBER)
        number = digit if number is None else (number * literal(base)).cast(NUMBER) + digit
        number = number.cast(NUMBER)

    def unpack(packed: Column) -> Column:
        fields = []
        for col, kind, b, base in reversed(list(zip(orders, kinds, bits, bases))):
            digit = (packed % literal(base)).cast(NUMBER)
            whole = (digit - literal((1 << (b - 1)) + 1)).cast("long")
            fields.append(F.when(digit > 0, _back(whole, kind)).alias(col))
            packed = ((packed - digit) / literal(base)).cast(NUMBER)  # divides evenly
        return F.struct(*reversed(fields))

    return number, unpack
