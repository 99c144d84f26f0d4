"""Text of values, and conversions between instants, days, bytes and bits. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "yyyy-MM-dd HH:mm:ss.SSS"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_string(value: Column | str) -> Column:
    """The value as text; null is empty."""
    return F.coalesce(_c(value).cast("string"), F.lit(""))


def timestamp_string(value: Column | str, pattern: str = PATTERN, zone: str | None = None) -> Column:
    """A timestamp in a pattern, shifted to a zone; null is empty."""
    value = _c(value).cast("timestamp")
    return F.coalesce(F.date_format(F.from_utc_timestamp(value, zone) if zone else value, pattern), F.lit(""))


def binary_string(value: Column | str, as_hex: bool = False) -> Column:
    """Bytes as UTF-8 text or lower-case hex; bytes that are no UTF-8 are <unprintable>, null is empty."""
    value = _c(value)
    text = F.lower(F.hex(value)) if as_hex else F.when(F.is_valid_utf8(value.cast("string")), value.cast("string")).otherwise(F.when(value.isNotNull(), F.lit("<unprintable>")))
    return F.coalesce(text, F.lit(""))


def list_string(value: Column | str) -> Column:
    """[a,b,null]; a null list is null as text."""
    value = _c(value)
    inner = F.array_join(F.transform(value, lambda x: x.cast("string")), ",", "null")
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), inner, F.lit("]")))


def struct_string(value: Column | str, fields: list[str]) -> Column:
    """{a,b}, null fields empty; a null struct is empty."""
    value = _c(value)
    inner = F.concat_ws(",", *(as_string(value[f]) for f in fields))
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("{"), inner, F.lit("}")))


def instant(value: Column | str, unit: str) -> Column:
    """A timestamp from a count of units since 1970; nanoseconds are floored to microseconds."""
    value = _c(value).cast("long")
    if unit == "ns":
        value, unit = F.floor(value / F.lit(1000).cast("decimal(20,0)")).cast("long"), "us"
    return {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}[unit](value)


def _micros(ts: Column | str) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))



def epoch(ts: Column | str, unit: str) -> Column:
    """Units since 1970, floored."""
    micros = _micros(ts)
    if unit == "ns":
        return micros * 1000
    by = {"s": 1_000_000, "ms": 1_000, "us": 1}[unit]
    return micros if by == 1 else _div(micros, by)


def _div(x: Column, by: int) -> Column:
    """Integer division, floored."""
    x = x - F.pmod(x, F.lit(by).cast("long"))
    return F.call_function("div", x, F.lit(by).cast("long"))


def date32(ts: Column | str) -> Column:
    """Days since 1970, floored, so an instant before 1970 falls on its own day."""
    return _div(_micros(ts), 86_400_000_000).cast("int")


def date64(ts: Column | str) -> Column:
    """Milliseconds since 1970, floored."""
    return epoch(ts, "ms")


def from_date32(days: Column | str) -> Column:
    return F.date_from_unix_date(_c(days).cast("int"))


def time_of_day(ts: Column | str, unit: str = "us") -> Column:
    """Units since midnight."""
    by = {"s": 1_000_000, "ms": 1_000, "us": 1}[unit]
    return _div(F.pmod(_micros(ts), F.lit(86_400_000_000).cast("long")), by)


def to_bytes(text: Column | str) -> Column:
    return F.encode(_c(text), "UTF-8")


def from_bytes(data: Column | str) -> Column:
    return F.decode(_c(data), "UTF-8")


def bit(data: Column | str, index: Column) -> Column:
    """Bit `index` of bytes, the lowest of each byte first: 0 or 1."""
    index = index.cast("int")
    byte = F.conv(F.hex(F.substring(_c(data), F.call_function("div", index, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(index, F.lit(8))).cast("int")


def with_bit(byte: Column | str, index: Column, on: bool) -> Column:
    """An integer with one bit set or cleared."""
    one = F.lit(1)
    mask = F.call_function("shiftleft", one, index.cast("int"))
    return _c(byte).bitwiseOR(mask) if on else _c(byte).bitwiseAND(F.bitwise_not(mask))


def aligned(size: Column | str, to: int = 64) -> Column:
    """The size rounded up to a multiple."""
    size = _c(size).cast("long")
    return size + F.pmod(-size, F.lit(to).cast("long"))
