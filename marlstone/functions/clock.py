"""Time expressions. Instants are BIGINT nanoseconds UTC; timestamps serve display and local clocks only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
EXCHANGE_ZONE = "America/Chicago"

Value = Column | str


def _c(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ns(ts: Value) -> Column:
    """Nanoseconds of a timestamp, exactly (microseconds are what timestamps hold)."""
    return F.unix_micros(_c(ts).cast("timestamp")) * 1000


def ts(instant: Value) -> Column:
    """The timestamp of an instant, cut to microseconds."""
    return F.timestamp_micros(floor_div(instant, 1000))


def floor_div(x: Value, y: int) -> Column:
    """Floor division of integers; DIV cuts towards zero."""
    a = _c(x)
    return ((a - F.pmod(a, F.lit(y))) / y).cast("long") if y == 1 else F.call_function("div", a - F.pmod(a, F.lit(y).cast("long")), F.lit(y).cast("long"))


def floor_to(x: Value, step: int) -> Column:
    a = _c(x)
    return a - F.pmod(a, F.lit(step).cast("long"))


def ceil_to(x: Value, step: int) -> Column:
    return floor_to(_c(x) + (step - 1), step)


def available_at(event: Value, interval: int, latency: int) -> Column:
    """When a bar can be known: its event time, its interval and the publication latency."""
    return _c(event) + interval + latency


def decision_at(available: Value, event: Value, step: int = MINUTE) -> Column:
    """The first whole minute at which a bar may be used; entry and label follow from it."""
    return ceil_to(F.greatest(_c(available), _c(event)), step)


def utc_date(instant: Value) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(instant, DAY).cast("int"))


def local(instant_ts: Value, zone: str = EXCHANGE_ZONE) -> Column:
    return F.from_utc_timestamp(_c(instant_ts), zone)


def session_date(instant_ts: Value, zone: str = EXCHANGE_ZONE, roll_hour: int = 17) -> Column:
    """Exchange session date: the local date, one later from the roll hour on."""
    return F.to_date(local(instant_ts, zone) + F.make_dt_interval(hours=F.lit(24 - roll_hour)))


def session_start(instant_ts: Value, zone: str = EXCHANGE_ZONE, roll_hour: int = 17) -> Column:
    """When the exchange session of an instant began, in UTC."""
    day = F.date_sub(session_date(instant_ts, zone, roll_hour), 1).cast("timestamp")
    return F.to_utc_timestamp(day + F.make_dt_interval(hours=F.lit(roll_hour)), zone)


def local_bucket(instant_ts: Value, hours: int, zone: str = EXCHANGE_ZONE) -> Column:
    """Start, in UTC, of the wall-clock bucket of so many hours since local midnight."""
    here = local(instant_ts, zone)
    midnight = F.date_trunc("day", here)
    return F.to_utc_timestamp(midnight + F.make_dt_interval(hours=(F.floor(F.hour(here) / hours) * hours).cast("int")), zone)


def bucket(instant_ts: Value, timeframe: str) -> Column:
    """Start of a candle: whole minutes and hours in UTC, 4h by the exchange's wall clock, 1d by its session."""
    number, unit = parse_timeframe(timeframe)
    if timeframe == "1d":
        return session_start(instant_ts)
    if timeframe == "4h":
        return local_bucket(instant_ts, 4)
    return ts(floor_to(ns(instant_ts), number * {"s": SECOND, "m": MINUTE, "h": HOUR}[unit]))


TIMEFRAMES = ("1m", "5m", "15m", "30m", "1h", "4h", "1d")


def parse_timeframe(timeframe: str) -> tuple[int, str]:
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"{timeframe} isn't one of {', '.join(TIMEFRAMES)}")
    return int(timeframe[:-1]), timeframe[-1]


def in_local_clock(instant_ts: Value, first: str, last: str, zone: str = EXCHANGE_ZONE) -> Column:
    """Whether the local time of day lies in [first, last], both as HH:mm:ss."""
    return F.date_format(local(instant_ts, zone), "HH:mm:ss").between(first, last)


def normalised(x: Value) -> Column:
    """Nanoseconds of an integer that counts seconds, milli-, micro- or nanoseconds, told by its size."""
    a = _c(x)
    size = F.abs(a)
    return F.when(size < 10**11, a * SECOND).when(size < 10**14, a * 1_000_000).when(size < 10**17, a * 1000).otherwise(a)


def minute_of_session(instant_ts: Value) -> Column:
    """Minutes since the exchange's roll at 17:00."""
    here = local(instant_ts)
    return F.pmod(F.hour(here) * 60 + F.minute(here) - 17 * 60, F.lit(1440))


def cyclic(minute: Value, period: int = 1440) -> tuple[Column, Column]:
    angle = 2 * 3.141592653589793 * _c(minute) / period
    return F.sin(angle), F.cos(angle)
