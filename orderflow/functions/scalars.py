"""Scalar helpers: enums, intervals, identifiers, saturating arithmetic, 32-byte words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Interval names and seconds. Week and month are epoch aligned.
INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "2h": 7200, "4h": 14400, "1d": 86400, "1w": 604800, "1M": 2629746}
#: Enum codes; unknown codes fall back to NONE and BUY.
STATUS = ["NONE", "OPEN", "PARTIALLY_FILLED", "FILLED", "CANCELLED", "EXPIRED"]
SIDE = ["BUY", "SELL"]
ACTIVE = ("OPEN", "PARTIALLY_FILLED")
MAX_DECIMAL = 38


def enum(code: Column, names: list[str], default: str) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), code.cast("int")), F.lit(default))


def status(code: Column) -> Column:
    return enum(code, STATUS, "NONE")


def side(code: Column) -> Column:
    return enum(code, SIDE, "BUY")


def is_active(status_col: Column) -> Column:
    return status_col.isin(*ACTIVE)


def bucket_open(ts: Column, seconds: int) -> Column:
    return ts - F.pmod(ts, F.lit(seconds))


#: The type of amounts, prices and quantities. What needs more than 38 digits is null there, and its row
#: goes to a quarantine.
AMOUNT = "decimal(38,0)"
MOST = 10**MAX_DECIMAL - 1


def amount_of(column: Column | str) -> Column:
    """A number of any type, or its decimal text, as an amount; null where it does not fit."""
    return (F.col(column) if isinstance(column, str) else column).try_cast(AMOUNT)


def sat_sub(a: Column, b: Column) -> Column:
    """a - b, but not below 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.try_subtract(a, b))


def sat_add(a: Column, b: Column) -> Column:
    """a + b of two amounts, but not above the largest one."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_add(amount_of(a), amount_of(b)), F.lit(str(MOST)).cast(AMOUNT)))


def ident(*parts: Column | str) -> Column:
    return F.concat_ws("_", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def seq_of(block: Column, log_index: Column) -> Column:
    """One long that orders events by (block, log index)."""
    return block * (1 << 20) + log_index


def interval_dim(spark: SparkSession) -> DataFrame:
    names = {"m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK", "M": "MONTH"}
    return spark.createDataFrame([(k, v, f"{names[k[-1]]}_{k[:-1]}") for k, v in INTERVALS.items()], "interval string, seconds bigint, enum_name string")


# Words of the contract encoding: 64 hex digits each, after "0x".


def word(data: Column, i: int) -> Column:
    return F.substring(data, 3 + 64 * i, 64)


#: The digits of 10^38 - 1 in the lower half of a word.
_MOST_HEX = f"{MOST:032x}"


def fits_uint64(w: Column) -> Column:
    """Whether a word is a whole one and below 2^63: told from its digits alone."""
    return (F.length(w) == 64) & (F.substring(w, 1, 48) == "0" * 48) & (F.substring(w, 49, 1) < "8")


def fits_uint256(w: Column) -> Column:
    """Whether a word is a whole one and an amount of 38 digits."""
    return (F.length(w) == 64) & (F.substring(w, 1, 32) == "0" * 32) & (F.lower(F.substring(w, 33, 32)) <= _MOST_HEX)


def uint64(w: Column) -> Column:
    """A word as a long; null beyond 2^63 - 1."""
    return F.when(fits_uint64(w), F.conv(F.substring(w, 49, 16), 16, 10).try_cast("bigint"))


def uint256(w: Column) -> Column:
    """A word as decimal(38,0); null beyond 10^38 - 1 (the row then goes to quarantine)."""
    part = lambda at: F.conv(F.substring(w, at, 16), 16, 10).try_cast("decimal(20,0)")
    return F.when(fits_uint256(w), F.try_add(F.try_multiply(part(33), F.lit(str(1 << 64)).cast("decimal(20,0)")), part(49)).try_cast(AMOUNT))


def address(w: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.substring(w, 25, 40)))


def hex_of(value: Column) -> Column:
    """Bytes as 0x and lower-case hex digits."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value.cast("binary"))))


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def now_micros() -> Column:
    return F.unix_micros(F.current_timestamp())
