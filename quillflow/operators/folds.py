"""Folds over ordered rows of a group, streamed: what is kept of a row depends on what was kept before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, start: Callable[[], Callable[[object], bool]]) -> DataFrame:
    """The rows of df that a fold keeps. For each group start() gives a fresh function of the row's value that says whether the row stays.

    Groups are dealt by their hash and sorted by Spark; a task holds one batch and one group's state, whatever the groups' sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keep = None, None
        for batch in batches:
            flags = []
            for *now, x in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*group, value])):
                if keep is None or now != key:
                    key, keep = now, start()
                flags.append(keep(x))
            yield batch.filter(pa.array(flags, pa.bool_()))

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, df.schema)


def folded(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str], name: str, start: Callable[[], Callable[[tuple], int | None]]) -> DataFrame:
    """df with a long column: what a fold over each group gives for each row's values. As `kept` otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*group, *values]}
            out = []
            for now, row in zip(zip(*(columns[c] for c in group)), zip(*(columns[c] for c in values))):
                if step is None or now != key:
                    key, step = now, start()
                out.append(step(row))
            yield batch.append_column(name, pa.array(out, pa.int64()))

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, df.select("*", F.lit(0).cast("long").alias(name)).schema)
