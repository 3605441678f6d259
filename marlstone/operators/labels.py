"""Outcome labels of decisions, from the bars that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock


def grid_outcome(decisions: DataFrame, bars: DataFrame, keys: list[str], at: str, identity: list[str], step: int, first: int, last: int, roll_first: bool = False) -> DataFrame:
    """Return from the open at ``first`` to the open at ``last`` steps after the decision, if every step has its bar.

    Every step needs exactly one eligible bar of the decision's identity. MISSING_SOURCE and ROLL_UNRESOLVED say what
    fails at the earliest failing step; with ``roll_first`` any identity change outranks missing bars.
    """
    path = decisions.select(*keys, at, *(F.col(c).alias(f"_own_{c}") for c in identity), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("_k"))
    path = path.withColumn("event_at_ns", F.col(at) + F.col("_k") * step)
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    seen = path.join(bars.select(*keys, "event_at_ns", "open_nano", "disposition", *identity), [*keys, "event_at_ns"], "left").groupBy(*keys, at, "_k").agg(
        F.count("open_nano").alias("_n"), F.max("open_nano").alias("_open"), F.coalesce(F.bool_and(F.col("disposition") == "ELIGIBLE"), F.lit(False)).alias("_ok"), F.coalesce(F.bool_and(same), F.lit(False)).alias("_same"))
    code = F.when((F.col("_n") != 1) | ~F.col("_ok"), "MISSING_SOURCE").when(~F.col("_same"), "ROLL_UNRESOLVED").when(F.col("_open") <= 0, "MISSING_SOURCE")
    by_step = seen.withColumn("_code", code)
    fails = F.min_by(F.col("_code"), F.when(F.col("_code").isNotNull(), F.col("_k")))
    if roll_first:
        fails = F.coalesce(F.max(F.when((F.col("_n") == 1) & ~F.col("_same"), "ROLL_UNRESOLVED")), fails)
    price = lambda k: F.max(F.when(F.col("_k") == k, F.col("_open")))
    out = by_step.groupBy(*keys, at).agg(F.coalesce(fails, F.lit("MATURED")).alias("status"), price(first).alias("_a"), price(last).alias("_b"))
    return out.withColumn("outcome", F.when(F.col("status") == "MATURED", F.col("_b") / F.col("_a") - 1)).drop("_a", "_b")


def bracket(decisions: DataFrame, bars: DataFrame, keys: list[str], at: str, identity: list[str], step: int, hold: int, stop_atr: float = 1.5, target_r: float = 2.0) -> DataFrame:
    """Event-ordered barriers: entry at the next bar's open, a stop and a target, at most ``hold`` bars.

    ``decisions`` has direction (1 or -1) and atr. On each bar a gap through the stop comes first, then a gap through
    the target, then the stop, then the target (a bar that touches both stops out). A roll exits at the close before,
    a missing bar abstains. The earliest event decides; every decision has a row.
    """
    own = decisions.select(*keys, at, "direction", "atr", F.explode(F.sequence(F.lit(1), F.lit(hold))).alias("_k")).withColumn("event_at_ns", F.col(at) + F.col("_k") * step)
    b = bars.select(*keys, "event_at_ns", "open_nano", "high_nano", "low_nano", "close_nano", *identity)
    path = own.join(b, [*keys, "event_at_ns"], "left")
    entry = path.where("_k = 1").select(*keys, at, "direction", F.col("open_nano").alias("entry_nano"), *(F.col(c).alias(f"_own_{c}") for c in identity))
    d = F.col("direction")
    risk = F.ceil(F.col("atr") * stop_atr).cast("long")
    walk = path.join(entry, [*keys, at, "direction"]).withColumn("_stop", F.col("entry_nano") - d * risk).withColumn("_target", F.col("entry_nano") + d * F.floor(risk * target_r).cast("long"))
    rolled = F.lit(False)
    for c in identity:
        rolled = rolled | (F.col(c) != F.col(f"_own_{c}"))
    past = lambda price, level, sign: (price - level) * d * sign >= 0
    o, h, low = F.col("open_nano"), F.col("high_nano"), F.col("low_nano")
    worst, best = F.when(d > 0, low).otherwise(h), F.when(d > 0, h).otherwise(low)
    gap = F.col("_k") > 1
    none = F.lit(None).cast("long")
    what = lambda name, price: F.struct(F.lit(name).alias("what"), price.cast("long").alias("price"))
    event = (
        F.when(F.col("entry_nano").isNull() | o.isNull(), what("ABSTAIN_GAP", none))
        .when(rolled, what("ROLL_EXIT", none))
        .when(gap & past(o, F.col("_stop"), -1), what("STOP_GAP", o))
        .when(gap & past(o, F.col("_target"), 1), what("TARGET_GAP", o))
        .when(past(worst, F.col("_stop"), -1), what("STOP", F.col("_stop")))
        .when(past(best, F.col("_target"), 1), what("TARGET", F.col("_target")))
        .when(F.col("_k") == hold, what("TIMEOUT", F.col("close_nano"))))
    walk = walk.withColumn("_event", event)
    hit = F.when(F.col("_event").isNotNull(), F.col("_k"))
    out = walk.groupBy(*keys, at, "direction").agg(F.max("entry_nano").alias("entry_nano"), F.min(hit).alias("exit_step"), F.min_by("_event", hit).alias("_event"), F.map_from_entries(F.collect_list(F.struct("_k", "close_nano"))).alias("_closes"))
    exit_ = F.when(F.col("_event.what") == "ROLL_EXIT", F.element_at("_closes", F.col("exit_step") - 1)).otherwise(F.col("_event.price"))
    return out.select(*keys, at, "direction", "entry_nano", "exit_step", F.col("_event.what").alias("exit_reason"), exit_.alias("exit_nano")).withColumn("gross_nano", d * (F.col("exit_nano") - F.col("entry_nano")))


def limit_path(decisions: DataFrame, bars: DataFrame, keys: list[str], at: str, step: int, tick: int, wait: int, hold: int) -> DataFrame:
    """A limit order at the decision's ``limit_nano`` fills only on a bar that goes through it by a tick.

    Filled within ``wait`` bars, it's held ``hold`` bars and leaves at the first close reported from then on, within
    the same number of bars again. States: FILLED_CLOSED, FILLED_OPEN and NOT_FILLED.
    """
    d = F.col("direction")
    path = decisions.select(*keys, at, "direction", "limit_nano", F.explode(F.sequence(F.lit(1), F.lit(wait + 2 * hold))).alias("_k")).withColumn("event_at_ns", F.col(at) + F.col("_k") * step)
    seen = path.join(bars.select(*keys, "event_at_ns", "high_nano", "low_nano", "close_nano"), [*keys, "event_at_ns"], "left")
    through = F.when(d > 0, F.col("low_nano") <= F.col("limit_nano") - tick).otherwise(F.col("high_nano") >= F.col("limit_nano") + tick)
    fill = F.min(F.when(through & (F.col("_k") <= wait), F.col("_k")))
    held = seen.groupBy(*keys, at, "direction", "limit_nano").agg(fill.alias("fill_step"), F.array_sort(F.collect_list(F.when(F.col("close_nano").isNotNull(), F.struct("_k", "close_nano")))).alias("_closes"))
    later = F.filter("_closes", lambda x: (x["_k"] >= F.col("fill_step") + hold) & (x["_k"] <= F.col("fill_step") + 2 * hold))
    out = held.withColumn("_exit", F.get(later, 0))
    state = F.when(F.col("fill_step").isNull(), "NOT_FILLED").when(F.col("_exit").isNull(), "FILLED_OPEN").otherwise("FILLED_CLOSED")
    return out.select(*keys, at, "direction", "limit_nano", "fill_step", F.col("_exit._k").alias("exit_step"), (d * (F.col("_exit.close_nano") - F.col("limit_nano"))).alias("gross_nano"), state.alias("state"))


def first_trigger(decisions: DataFrame, bars: DataFrame, keys: list[str], at: str, within: int) -> DataFrame:
    """The first bar that becomes available after each decision and within ``within``; two at once are a tie."""
    near = decisions.select(*keys, at).withColumn("_step", F.explode(F.sequence(clock.floor_div(at, within), clock.floor_div(F.col(at) + within, within))))
    b = bars.select(*keys, "available_at_ns", "event_at_ns", "open_nano").withColumn("_step", clock.floor_div("available_at_ns", within))
    ok = (F.col("available_at_ns") > F.col(at)) & (F.col("available_at_ns") <= F.col(at) + within) & (F.col("event_at_ns") >= F.col(at))
    hits = near.join(b, [*keys, "_step"]).where(ok)
    key = F.struct("available_at_ns", "event_at_ns")
    firsts = hits.groupBy(*keys, at).agg(F.min(key).alias("_first"), F.min_by("open_nano", key).alias("open_nano"))
    same = hits.join(firsts.select(*keys, at, "_first"), [*keys, at]).where(key == F.col("_first")).groupBy(*keys, at).count()
    out = decisions.select(*keys, at).join(firsts, [*keys, at], "left").join(same, [*keys, at], "left")
    state: Column = F.when(F.col("count").isNull(), "NO_TRIGGER").when(F.col("count") > 1, "AMBIGUOUS").otherwise("TRIGGERED")
    return out.select(*keys, at, state.alias("state"), F.col("_first.event_at_ns").alias("trigger_ns"), F.when(state == "TRIGGERED", F.col("open_nano")).alias("open_nano"))


def cost_fills(
    entries: DataFrame, bars: DataFrame, keys: list[str], scenarios: tuple[tuple[str, int], ...], step: int, tick: int, tick_cents: int, fee_cents: int, cap_cents: int, hold: int, path: int, last: Column | None = None, net_target: bool = False) -> DataFrame:
    """Bracket fills of ``entries`` (entry_at, entry_open, direction, atr) with costs, one row for each and scenario.

    A scenario is the round trip's cost in ticks: half of it worsens the entry, half the exit. The stop is 1.5 atr away,
    rounded up to ticks; the planned loss is the stop, the costs and two fees, and more than ``cap_cents`` is refused.
    The target is the first whole tick that earns twice that after fees (with ``net_target`` after costs, too). The
    first bar that fires decides: from ``hold`` after the entry, or ``last`` if that's sooner, its open; before, an
    open beyond the stop, the stop, the target, in this order. Gross is net with all costs added again.
    """
    d, t = F.col("direction"), F.col("ticks")
    s = entries.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(c).cast("long").alias("ticks")) for n, c in scenarios)))).select(*entries.columns, "_s.*")
    s = s.withColumn("stop_ticks", clock.floor_div(3 * F.col("atr") + 2 * tick - 1, 2 * tick)).withColumn("planned_cents", (F.col("stop_ticks") + t) * tick_cents + 2 * fee_cents)
    half = clock.floor_div(t * tick, 2)
    earned = 2 * F.col("planned_cents") + (clock.floor_div(t * tick_cents, 2) + fee_cents if net_target else F.lit(2 * fee_cents))
    s = s.withColumn("entry", F.col("entry_open") + d * half).withColumn("stop", F.col("entry") - d * F.col("stop_ticks") * tick).withColumn("target", F.col("entry") + d * clock.floor_div(earned + tick_cents - 1, tick_cents) * tick)
    timeout = F.col("entry_at") + hold
    s = s.withColumn("close_at", timeout if last is None else F.least(timeout, last)).withColumn("why", F.lit("TIMEOUT") if last is None else F.when(last <= timeout, "SESSION_LIQUIDATION").otherwise("TIMEOUT"))
    own = [*keys, "entry_at", "scenario"]
    walk = s.withColumn("event_at_ns", F.explode(F.sequence("entry_at", F.col("entry_at") + path - step, F.lit(step).cast("long")))).join(bars.select(*keys, "event_at_ns", "open_nano", "high_nano", "low_nano"), [*keys, "event_at_ns"])
    o = F.col("open_nano")
    worst, best = (F.when(d > 0, F.col(a)).otherwise(F.col(b)) for a, b in (("low_nano", "high_nano"), ("high_nano", "low_nano")))
    what = F.when(F.col("event_at_ns") >= F.col("close_at"), F.struct(F.col("why").alias("why"), o.alias("price")))
    for fires, name, price in ((d * (o - F.col("stop")) <= 0, "STOP_GAP", o), (d * (worst - F.col("stop")) <= 0, "STOP", F.col("stop")), (d * (best - F.col("target")) >= 0, "TARGET", F.col("target"))):
        what = what.when(fires, F.struct(F.lit(name).alias("why"), price.alias("price")))
    hit = walk.withColumn("_what", what).where("_what is not null").groupBy(*own).agg(F.min("event_at_ns").alias("exit_at"), F.min_by("_what", "event_at_ns").alias("_what"))
    out = s.join(hit, own, "left")
    ok = F.col("planned_cents") <= cap_cents
    moved = clock.floor_div(d * (F.col("_what.price") - d * half - F.col("entry")), tick) * tick_cents
    return out.select(
        *entries.columns, "scenario", "planned_cents", "stop", "target", F.when(~ok, "OVER_PLANNED_LOSS").otherwise(F.coalesce("_what.why", F.lit("NO_EXIT"))).alias("reason"),
        F.when(ok, F.col("exit_at")).alias("exit_at"), F.when(ok, moved - 2 * fee_cents).alias("net_cents"), F.when(ok, moved + t * tick_cents).alias("gross_cents"))


def stopped_path(entries: DataFrame, bars: DataFrame, keys: list[str], step: int, steps: int, distance: int) -> DataFrame:
    """``entries`` (at, entry, direction) held over ``steps`` steps: complete if every bar is there, and the exit price.

    The stop is ``distance`` away. From the second bar on an open beyond it is the exit, else the stop where a bar
    touches it; without either it's the open of the last bar, which is not looked at otherwise.
    """
    d = F.col("direction")
    stop = F.col("entry") - d * distance
    walk = entries.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("event_at_ns", F.col("at") + F.col("_k") * step).join(bars.select(*keys, "event_at_ns", "open_nano", "high_nano", "low_nano"), [*keys, "event_at_ns"])
    worst = F.when(d > 0, F.col("low_nano")).otherwise(F.col("high_nano"))
    gap = (F.col("_k") > 0) & (d * (F.col("open_nano") - stop) <= 0)
    out = F.when(F.col("_k") == steps, F.col("open_nano")).when(gap, F.col("open_nano")).when(d * (worst - stop) <= 0, stop)
    found = walk.withColumn("_out", out).groupBy(*entries.columns).agg((F.count("*") == steps + 1).alias("complete"), F.min_by("_out", F.when(F.col("_out").isNotNull(), F.col("_k"))).alias("exit"))
    return found
