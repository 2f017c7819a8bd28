"""Order-dependent recurrences: one pass over each key's rows in order, in bounded memory.

Null keys are one key.  Rows are shuffled by key and sorted within partitions, and each partition is read batch by batch with
the state carried along, so a key never has to fit in memory.  The recurrence itself is sequential.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: (state or None, one row as a tuple) -> (state, output tuples)
Step = Callable[[object, tuple], tuple[object, list[tuple]]]


def fold_sorted(df: DataFrame, by: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """step over each key's rows in order; the first column of df must be `by`."""
    at = df.columns.index(by)
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                own = None if row[at] != row[at] else row[at]  # a null may arrive as NaN, which is not equal to itself
                if own != key:
                    key, state = own, None
                state, rows = step(state, row)
                out += rows
            yield pd.DataFrame(out, columns=names)

    return df.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)
