"""Ordered folds per track: the one place where recursion is run.

A fold is a start state and a step (state, row) -> (state, out). Batch runs it
over rows that Spark has dealt by track and sorted, a batch at a time, so a
track of any length needs the memory of its state alone. loomtide.streaming
runs the same folds with the state kept by Spark between micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Step = Callable[[Any, tuple], tuple[Any, tuple | None]]


class Fold:
    """start() gives a state; step(state, row) gives (state, out or None)."""

    #: Names and types of what step returns.
    out: str = ""

    def start(self) -> Any:
        raise NotImplementedError

    def step(self, state: Any, row: tuple) -> tuple[Any, tuple | None]:
        raise NotImplementedError


def schema_of(df: DataFrame, keep: list[str], out: str) -> StructType:
    fields = [df.schema[c] for c in keep]
    return StructType([*fields, *_parse_datatype_string(out).fields])


def scan(df: DataFrame, fold: Fold, inputs: list[str], keys: list[str] = ("track",), order: list[str] = ("frame",), keep: list[str] | None = None) -> DataFrame:
    """Runs a fold over each track, in order.

    The result has the columns keep (keys and order by default) and those of
    fold.out, a row for each input row, except where step gave None. Nulls in
    keys form a track of their own and sort first in order; ties in order
    follow the inputs.
    """
    keys, order = list(keys), list(order)
    keep = keys + order if keep is None else keep
    columns = list(dict.fromkeys([*keys, *order, *inputs, *keep]))
    at = {c: i for i, c in enumerate(columns)}
    key_at, in_at, keep_at = [at[c] for c in keys], [at[c] for c in inputs], [at[c] for c in keep]
    schema = schema_of(df, keep, fold.out)
    arrow = to_arrow_schema(schema)
    n_out = len(schema) - len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Any = object()
        state: Any = None
        for b in batches:
            rows = [c.to_pylist() for c in b.columns]
            kept: list[int] = []
            made: list[tuple] = []
            step = fold.step
            own_keys = list(zip(*(rows[i] for i in key_at)))
            for i, row in enumerate(zip(*(rows[j] for j in in_at))):
                if own_keys[i] != held:
                    held, state = own_keys[i], fold.start()
                state, out = step(state, row)
                if out is not None:
                    kept.append(i)
                    made.append(out)
            cols = list(zip(*made)) if made else [()] * n_out
            arrays = [pa.array([rows[j][i] for i in kept], arrow.field(k).type) for k, j in enumerate(keep_at)]
            arrays += [pa.array(c, arrow.field(len(keep) + k).type) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    dealt = df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order, *(c for c in inputs if c not in order))
    return dealt.mapInArrow(run, schema)
