"""Point-in-time resolution: what a log of changes says at an instant, and whether it changed while one looked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof, scans

#: What stands for no value in 64-bit fields.
NO_VALUE = 2**63 - 1


def replayed(log: DataFrame, keys: list[str], received: str, order: list[str], action: str, values: list[str], known: tuple[str, ...]) -> DataFrame:
    """The log as states: one row per key and receive time, the last by ``order`` of equal times.

    ``odd`` says whether any action up to then is none of ``known``; an update is a whole state, so the last one wins.
    """
    once = log.groupBy(*keys, received).agg(F.max_by(F.struct(action, *values), F.struct(*order)).alias("_last"), F.bool_or(~F.col(action).isin(*known)).alias("_odd"))
    w = Window.partitionBy(*keys).orderBy(received).rowsBetween(Window.unboundedPreceding, 0)
    return once.select(*keys, received, *(F.col(f"_last.{c}").alias(c) for c in (action, *values)), F.max("_odd").over(w).alias("odd"))


def definition_of(bars: DataFrame, log: DataFrame, keys: list[str], at: str, decided: str, order: list[str], values: list[str]) -> DataFrame:
    """Each bar's definition, replayed from ADD, MODIFY and DELETE in the order of receipt, with a code.

    The state is the last one received by the bar's time ``at``; a later update that was known by ``decided`` makes the
    bar unusable. ``log`` has received_ns, action, class, active_ns and expired_ns besides ``order`` and ``values``. The
    keys hold the UTC date, so a day's log of an instrument is what is replayed.
    """
    fields = ["class", "active_ns", "expired_ns", *values]
    states = replayed(log, keys, "received_ns", order, "action", fields, ("ADD", "MODIFY", "DELETE"))
    then = asof.as_of(bars, states, keys, at, "received_ns", ["action", "odd", *fields])
    then = asof.as_of(then.withColumnRenamed("known_at", "_received"), states.select(*keys, "received_ns"), keys, decided, "received_ns", [])
    code = (
        F.when(F.col("_received").isNull(), "NO_DEFINITION_BY_START").when(F.col("odd"), "UNKNOWN_ACTION").when(F.col("action") == "DELETE", "DELETED")
        .when(F.col("class") != "FUTURE", "NOT_OUTRIGHT").when((F.col("active_ns") > F.col(at)) | (F.col("expired_ns") <= F.col(at)), "NOT_ACTIVE")
        .when(F.col("known_at") > F.col(at), "CHANGED_BEFORE_DECISION").otherwise("RESOLVED"))
    return then.select(*bars.columns, code.alias("code"), *(F.when(code == "RESOLVED", F.col(v)).alias(v) for v in values))


def statistic_of(decisions: DataFrame, log: DataFrame, keys: list[str], at: str, order: list[str], declared: Column) -> DataFrame:
    """The state of a published figure by each decision: its price and quantity only where they are known."""
    found = asof.as_of(decisions, replayed(log, keys, "received_ns", order, "action", ["price_nano", "quantity"], ("NEW", "DELETE")), keys, at, "received_ns", ["action", "price_nano", "quantity"])
    unknown = (F.col("price_nano") == NO_VALUE) | (F.col("quantity") == NO_VALUE)
    state = (
        F.when(F.col("known_at").isNull(), "UNRESOLVED").when(F.col("action") == "DELETE", "DELETED").when(F.col("action") != "NEW", "UNKNOWN_UPDATE_ACTION")
        .when(unknown, "NEW_UNKNOWN_VALUE").when(declared, "NEW_KNOWN").otherwise("NEW_UNDECLARED_ROLE"))
    is_new = state.isin("NEW_KNOWN", "NEW_UNDECLARED_ROLE")
    return found.select(*decisions.columns, state.alias("state"), *(F.when(is_new, F.col(c)).alias(c) for c in ("price_nano", "quantity")))


def identity_of(bars: DataFrame, seen: DataFrame, keys: list[str], at: str, decided: str, meaning: list[str]) -> DataFrame:
    """Each bar's contract, from observations with a time of receipt and one of availability, with a code.

    The latest receipt of what was available by the bar's time counts; files that tie on it must tell the same sequence
    of meanings. Whatever became visible between then and the decision makes the bar unusable. ``seen`` has received_ns,
    available_ns, file, ordinal, action, class, active_ns and expired_ns; ``keys`` hold the UTC date, so that a bar
    meets a day's observations of its instrument.

    No bar is paired with observations. What was told can only change when something becomes visible, so it is worked
    out once for each such moment, from the observations of the latest receipt by then, and bars look up their moment.
    """
    told = seen.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*keys, "received_ns", "available_ns"))))
    told = told.select(*keys, "received_ns", F.greatest("received_ns", "available_ns").alias("_seen"), "file", "ordinal", F.struct("action", "class", "active_ns", "expired_ns", *meaning).alias("_is"))
    so_far = Window.partitionBy(*keys).orderBy("_seen").rowsBetween(Window.unboundedPreceding, 0)
    moments = told.groupBy(*keys, "_seen").agg(F.max("received_ns").alias("_newest"))
    moments = moments.select(*keys, F.col("_seen").alias("_moment"), F.max("_newest").over(so_far).alias("received_ns"))
    # files tell the same where, place by place of their sequences, all of them have the same meaning
    own = Window.partitionBy(*keys, "_moment", "file").orderBy("ordinal", "_is")
    place = F.row_number().over(own)
    placed = told.join(moments, [*keys, "received_ns"]).where("_seen <= _moment").withColumns({"_place": place, "_again": (place > 1) & F.col("ordinal").eqNullSafe(F.lag("ordinal").over(own))})
    places = placed.groupBy(*keys, "_moment", "_place").agg(F.count("*").alias("_files"), F.min("_is").alias("_is"), F.max("_is").alias("_other"), F.bool_or("_again").alias("_again"))
    differ = (F.min("_files") != F.max("_files")) | F.bool_or(~F.col("_is").eqNullSafe(F.col("_other")))
    states = places.groupBy(*keys, "_moment").agg(F.bool_or("_again").alias("_repeats"), differ.alias("_differ"), F.max_by("_is", "_place").alias("_is"))
    start = F.when(F.col(at).isNotNull() & F.col(decided).isNotNull(), F.least(at, decided))
    found = asof.as_of(bars.withColumn("_start", start), states, keys, "_start", "_moment", ["_repeats", "_differ", "_is"]).withColumnRenamed("known_at", "_known")
    found = asof.as_of(found, moments.select(*keys, "_moment"), keys, decided, "_moment", [])
    i = lambda c: F.col(f"_is.{c}")
    code = (
        F.when(F.col("_known").isNull(), "NO_DEFINITION_BY_START").when(F.col("_repeats"), "REPEATED_ORDINAL").when(F.col("_differ"), "CONFLICTING_FILES").when(F.col("known_at") > F.col(at), "CHANGED_BEFORE_DECISION")
        .when((i("action") == "DELETE") | (i("class") != "FUTURE") | ~((i("active_ns") <= F.col(at)) & (F.col(at) < i("expired_ns"))), "NOT_AN_ACTIVE_FUTURE").otherwise("RESOLVED"))
    return found.select(*bars.columns, code.alias("code"), *(F.when(code == "RESOLVED", i(m)).alias(m) for m in meaning))


def first_quote(targets: DataFrame, quotes: DataFrame, keys: list[str], start: str, deadline: str, own: str, span: int) -> DataFrame:
    """The first quote available in each target's closed window, by availability and ordinal.

    A quote before the window is never used, and one of another instrument inside it makes the target unavailable.
    ``quotes`` has available_ns, ordinal and instrument_id; a key's rows are dealt over steps of ``span``.

    No target is paired with quotes: it looks up the next time of a quote, and what stands there says when the next
    instrument comes that isn't the one there. A window holds a foreign one if that is its first or comes by the deadline.
    """
    q = quotes.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*keys, "available_ns"))))
    times = q.groupBy(*keys, "available_ns").agg(F.min("ordinal").alias("ordinal"), F.min("instrument_id").alias("_low"), F.max("instrument_id").alias("_high"))
    told = times.where("_low is not null").select(*keys, "available_ns", "_low", "_high")
    was = scans.previous(told, keys, ["available_ns"], {"_low": "_low0", "_high": "_high0"}, span)
    turns = was.where("_low <> _high or _low <> _low0 or _high <> _high0").select(*keys, F.col("available_ns").alias("_turn"))
    told = asof.upcoming(told, turns, keys, "available_ns", "_turn", [], True, span).withColumnRenamed("next_at", "_turn")
    told = told.select(*keys, F.col("available_ns").alias("_told"), "_low", F.when(F.col("_low") != F.col("_high"), F.col("available_ns")).otherwise(F.col("_turn")).alias("_other"))
    found = asof.upcoming(targets, times.select(*keys, "available_ns", "ordinal"), keys, start, "available_ns", ["ordinal"], False, span).withColumnRenamed("next_at", "available_ns")
    found = asof.upcoming(found, told, keys, start, "_told", ["_low", "_other"], False, span)
    foreign = ((F.col("next_at") <= F.col(deadline)) & (F.col("_low") != F.col(own))) | (F.col(own).isNotNull() & (F.col("_other") <= F.col(deadline)))
    state = F.when(F.coalesce(F.col("available_ns") <= F.col(deadline), F.lit(False)), F.when(foreign, "FOREIGN_INSTRUMENT").otherwise("COMPLETE")).otherwise("NO_QUOTE_BY_DEADLINE")
    return found.select(*targets.columns, state.alias("state"), *(F.when(state == "COMPLETE", F.col(c)).alias(c) for c in ("available_ns", "ordinal")))
