"""As-of and interval joins.

The as-of join is a union of both sides and one window over it, so its cost is one sort per key, or per key and span
of time, and no pair of rows is made: at equal times knowledge stands before decisions, since what is received at an instant is known at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(decisions: DataFrame, changes: DataFrame, keys: list[str], at: str, received: str, values: list[str], strict: bool = False, span: int | None = None) -> DataFrame:
    """Each decision with the ``values`` of the last change received by then (before it, if ``strict``), or nulls.

    Changes that tie on a key and time must have been resolved, see ``tied``. With ``span`` a key's rows are dealt over
    buckets of so much time, and the state at a bucket's beginning, of which there is one for each bucket with a
    change, is carried on: a key with very many rows is then the work of many tasks.
    """
    extra = [c for c in decisions.columns if c not in keys and c != at]
    left = decisions.select(*keys, F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.struct(*extra).alias("_row") if extra else F.struct(F.lit(1)).alias("_row"), F.lit(None).cast(_struct(changes, received, values)).alias("_state"))
    right = changes.select(*keys, F.col(received).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct(F.col(received).alias("_received"), *values).alias("_state"))
    both = left.unionByName(right)
    if span is not None:
        both = both.withColumn("_bucket", F.floor(F.col("_at") / span).cast("long"))
    own = [*keys, *["_bucket"] * (span is not None)]
    w = Window.partitionBy(*own).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last("_state", ignorenulls=True).over(w)
    if span is not None:
        change = F.col("_state").isNotNull()
        ends = both.groupBy(*own).agg(F.max_by("_state", F.when(change, F.col("_at"))).alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        both = both.join(ends.select(*own, F.last("_end", ignorenulls=True).over(before).alias("_carried")), own, "left" if keys else "inner")
        state = F.coalesce(state, "_carried")
    both = both.withColumn("_state", state)
    kept = both.where(F.col("_side") == (0 if strict else 1))
    return kept.select(*keys, F.col("_at").alias(at), *(F.col(f"_row.{c}").alias(c) for c in extra), F.col("_state._received").alias("known_at"), *(F.col(f"_state.{v}").alias(v) for v in values))


def upcoming(decisions: DataFrame, changes: DataFrame, keys: list[str], at: str, received: str, values: list[str], strict: bool = False, span: int | None = None) -> DataFrame:
    """Each decision with ``next_at`` and the ``values`` of the first change from then on (after it, if ``strict``), or nulls: ``as_of`` with time reversed."""
    back = as_of(decisions.withColumn("_back", -F.col(at)), changes.select(*keys, (-F.col(received)).alias("_next"), *values), keys, "_back", "_next", values, strict, span)
    return back.select(*decisions.columns, (-F.col("known_at")).alias("next_at"), *values)


def _struct(df: DataFrame, received: str, values: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "struct<" + ",".join(f"`{n}`:{kinds[c]}" for n, c in [("_received", received), *((v, v) for v in values)]) + ">"


def tied(changes: DataFrame, keys: list[str], received: str, source: str, ordinal: str, values: list[str]) -> DataFrame:
    """One change per key and time: of each source its last, and a conflict flag where sources differ.

    The source that sorts first lends the values.
    """
    w = Window.partitionBy(*keys, received, source).orderBy(F.desc(ordinal))
    last = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    meant = F.struct(*values)
    return last.groupBy(*keys, received).agg(F.min_by(meant, source).alias("_v"), (F.count_distinct(F.to_json(meant, {"ignoreNullFields": "false"})) > 1).alias("conflict")).select(*keys, received, *(F.col(f"_v.{v}").alias(v) for v in values), "conflict")


def in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, values: list[str], span: int) -> DataFrame:
    """Each point with the half-open interval of its key that holds it, or nulls.

    Intervals are dealt over the ``span``-wide steps that they touch, so that the join has an equality to hash on
    besides the range; intervals are expected not to overlap within a key.
    """
    step = lambda c: F.floor(c / span).cast("long")
    cut = intervals.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), *values).withColumn("_step", F.explode(F.sequence(step(F.col("_s")), step(F.col("_e") - 1))))
    p = points.withColumn("_step", step(F.col(at)))
    on = [*(p[k] == cut[k] for k in keys), p["_step"] == cut["_step"], p[at] >= cut["_s"], p[at] < cut["_e"]]
    return p.join(cut, on, "left").select(*(p[c] for c in points.columns), *(cut[v] for v in values))


def only_match(found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """absent, present or ambiguous by the number of distinct values per key."""
    n = F.count_distinct(value)
    return found.groupBy(*keys).agg(F.when(n == 0, "ABSENT").when(n == 1, "PRESENT").otherwise("AMBIGUOUS").alias("presence"))


def reconciled(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: EQUAL, DIFFERENT, LEFT_ONLY or RIGHT_ONLY for every key of either side."""
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    state: Column = F.when(F.col("_a").isNull(), "RIGHT_ONLY").when(F.col("_b").isNull(), "LEFT_ONLY").when(F.col("_a").eqNullSafe(F.col("_b")), "EQUAL").otherwise("DIFFERENT")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))
