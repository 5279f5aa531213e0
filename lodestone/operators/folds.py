"""Ordered folds: rules whose outcome for a row depends on the rows before it in its group.

Rows are shuffled by group, sorted within partitions and streamed through a small state, so a group is never held as a
whole: the memory is that of the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame


def ordered_fold(df: DataFrame, group: str, order: list[Column], start: Callable[[], Any], step: Callable[[Any, dict], dict], out: str) -> DataFrame:
    """df with the columns of out (a DDL string), which step(state, row) gives for each row; start() begins a group."""
    names = [c.split()[0] for c in out.split(", ")]
    cols = df.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), out])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for b in batches:
            extra = []
            for row in b.to_dict("records"):
                if row[group] != at:
                    at, state = row[group], start()
                extra.append(step(state, row))
            yield pd.concat([b[cols].reset_index(drop=True), pd.DataFrame(extra, columns=names)], axis=1)

    return df.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)
