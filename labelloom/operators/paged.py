"""Grouped work on small groups without a data frame for each group.

Rows are hash-partitioned and sorted by the group's keys, so groups arrive whole and one after
another; a group that spans Arrow batches is put together before it is handed on. Meant for
groups of bounded size (pages), where the cost a group has in ``applyInPandas`` prevails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if rest:
            b = pa.Table.from_batches([*rest, b]).combine_chunks().to_batches()[0]
            rest = []
        new = np.zeros(b.num_rows, dtype=bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(starts[:-2], starts[1:-1]):
            yield b.slice(s, e - s)
        rest = [b.slice(starts[-2])]
    if rest:
        yield rest[0]


def by_group(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.RecordBatch], list[tuple]], schema: str) -> DataFrame:
    """``work`` gets each group as a batch in ``order`` and gives rows of ``schema``."""
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for g in _groups(batches, keys):
            rows += work(g)
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    # Partitioned by a hash of the keys, not by the keys: a repartition by columns that a join below
    # already provides would be left out, and the join may then be re-planned at run time to
    # another partitioning, as nothing above it asks for one.
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
