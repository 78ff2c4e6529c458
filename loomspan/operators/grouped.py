"""Python over groups without a call for each: rows are shuffled and sorted by key, and groups are cut from Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def per_group(df: DataFrame, key: str, order: list[str], work: Callable[[object, dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """work(key, columns as arrays) -> rows, for each group.  One group is held at a time (and the batch that it ends in)."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def rows(pdf: pd.DataFrame) -> pd.DataFrame:
            keys = pdf[key].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            columns = {c: pdf[c].to_numpy() for c in pdf.columns}
            out = [r for a, b in zip(cuts, cuts[1:]) for r in work(keys[a], {c: v[a:b] for c, v in columns.items()})]
            return pd.DataFrame(out, columns=names)

        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf[key].iloc[-1]
            if rest and rest[0][key].iloc[0] == last and pdf[key].iloc[0] == last:
                rest.append(pdf)
                continue
            whole = pd.concat([*rest, pdf]) if rest else pdf
            open_rows = (whole[key] == last).to_numpy()
            if not open_rows.all():
                yield rows(whole[~open_rows])
            rest = [whole[open_rows]]
        if rest:
            yield rows(pd.concat(rest))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def starts(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The first row of each run of equal keys; null is a key of its own."""
    null, value = (np.asarray(x) for x in (keys.is_null(), keys.fill_null(0)))
    return np.r_[0, np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1]


def per_groups(df: DataFrame, key: str, order: list[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(rows of several whole groups, in order) -> rows.  The groups that a batch ends go together; one more is held open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = int(starts(batch[key])[-1])
            closed = [*rest, batch.slice(0, cut)] if cut else rest
            if not cut and rest and rest[-1][key][-1].equals(batch[key][0]):
                rest.append(batch)
                continue
            if closed:
                yield from work(pa.Table.from_batches(closed)).to_batches()
            rest = [batch.slice(cut)]
        if rest:
            yield from work(pa.Table.from_batches(rest)).to_batches()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
