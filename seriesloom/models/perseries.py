"""One pass over many series, each read from start to end by one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.ordering import series_window

Fit = Callable[[np.ndarray, pa.RecordBatch], tuple | None]


def map_series(df: DataFrame, fit: Fit, *, ts: str, y: str, keys: Sequence[str] = (), types: str) -> DataFrame:
    """``keys``, the last ``ts`` as ``last_ts``, and what ``fit`` makes of each series.

    Rows are partitioned by series and sorted by time; a task reads its series one after
    another from the stream of Arrow batches. No group is built per series, and no more than
    the values of one series, at calendar grain no more than the calendar has bins, are held.
    ``fit`` gets the values and the last row, and returns the fields of ``types`` or None for
    no row.
    """
    placed = df.withColumn("_i", F.row_number().over(series_window(keys, [ts])))  # leaves every partition sorted
    names = [field.split()[0] for field in types.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, last, done = [], None, []

        def end() -> None:
            found = fit(np.concatenate(values), last) if values else None
            if found is not None:
                done.append((last, found))

        def rows() -> pa.RecordBatch:
            lasts, fits = zip(*done)
            columns = [pa.concat_arrays([one.column(c) for one in lasts]) for c in [*keys, ts]]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in zip(*fits))], [*keys, "last_ts", *names])

        for batch in batches:
            first, numbers = batch.column("_i").to_numpy() == 1, batch.column(y).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(first[1:]) + 1), len(first)]
            for a, b in zip(edges, edges[1:]):
                if b > a and first[a]:
                    end()
                    values = []
                if b > a:
                    values.append(numbers[a:b])
                    last = batch.slice(b - 1, 1)
            if done:
                yield rows()
                done = []
        end()
        if done:
            yield rows()

    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    return placed.mapInArrow(run, ", ".join([*kinds, f"last_ts {df.schema[ts].dataType.simpleString()}", types]))
