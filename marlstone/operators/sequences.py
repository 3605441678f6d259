"""Folds over ordered rows: state machines that have no closed form over windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def folded(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, tuple]], keep: list[str], schema: str) -> DataFrame:
    """``keep`` of each row and what ``step`` gives for it, from the state of its key so far.

    Rows are dealt by key and sorted within partitions, by Spark, and then read batch by batch with the state carried
    on, so a task holds one batch and one state however many rows a key has. A key's rows are one after the other by
    nature; keys are independent of each other.
    """
    kinds = dict(rows.dtypes)
    names = [c.split()[0] for c in schema.split(", ")]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != now:
                    now, state = key, start()
                state, made = step(state, row)
                out.append(made)
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), schema]))
