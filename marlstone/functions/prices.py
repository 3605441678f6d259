"""Exact price arithmetic on integer nano-units and ticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import Value, _c, floor_div, floor_to

NANO = 1_000_000_000
UNDEFINED_PRICE = 2**63 - 1


def defined(nano: Value) -> Column:
    """The price, or null for the undefined-price sentinel."""
    return F.when(_c(nano) != UNDEFINED_PRICE, _c(nano))


def as_decimal(nano: Value) -> Column:
    """decimal(30,9), exact: wider products would lose digits."""
    return (defined(nano).cast("decimal(20,0)") * F.lit("0.000000001").cast("decimal(9,9)")).cast("decimal(30,9)")


def as_float(nano: Value) -> Column:
    return defined(nano) / NANO


def tick_floor(nano: Value, tick: int) -> Column:
    return floor_to(nano, tick)


def tick_ceil(nano: Value, tick: int) -> Column:
    return floor_to(_c(nano) + (tick - 1), tick)


def tick_valid(nano: Value, tick: int) -> Column:
    return F.pmod(_c(nano), F.lit(tick).cast("long")) == 0


def ticks(nano: Value, tick: int) -> Column:
    return floor_div(nano, tick)


def gross_pnl(direction: Value, entry: Value, exit_: Value, tick: int, tick_value_cents: int, quantity: Value | int = 1) -> Column:
    """Signed ticks times quantity times the tick's value, in cents."""
    q = F.lit(quantity) if isinstance(quantity, int) else _c(quantity)
    return _c(direction) * (ticks(exit_, tick) - ticks(entry, tick)) * q * tick_value_cents


def scenario_cost(fees: Value, slippage: Value, fee_factor: float, slip_factor: float, least_slip: float) -> Column:
    return _c(fees) * fee_factor + F.greatest(_c(slippage) * slip_factor, F.lit(least_slip))


def planned_loss(stop_ticks: Value, cost_ticks: int, tick_value_cents: int, fee_cents: int) -> Column:
    return (_c(stop_ticks) + cost_ticks) * tick_value_cents + 2 * fee_cents


def near_limit(price: Value, lower: Value, upper: Value, reference: Value, fraction: float) -> Column:
    """Whether a price is within a fraction of the reference of either price limit."""
    distance = F.abs(_c(reference)) * fraction
    return (_c(price) <= _c(lower) + distance) | (_c(price) >= _c(upper) - distance)
