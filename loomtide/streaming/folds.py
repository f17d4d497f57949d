"""Runs a fold on a stream, with its state kept by Spark for each track.

Batch and stream call the same step, so they agree row by row as long as a
track's frames arrive in order; within a micro-batch they are sorted.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from loomtide.operators.scan import Fold


def scan_stream(stream: DataFrame, fold: Fold, inputs: list[str], keys: list[str] = ("track",), order: list[str] = ("frame",)) -> DataFrame:
    """scan() for a stream, in append mode.

    The state is the pickled state of the fold; it goes into Spark's
    checkpoint, so a restarted query goes on where it stopped. Frames up to
    the last one seen are late and are dropped, as a fold can't go back.
    """
    keys, order = list(keys), list(order)
    columns = list(dict.fromkeys([*keys, *order, *inputs]))
    made = _parse_datatype_string(fold.out).fields
    schema = StructType([*(stream.schema[c] for c in keys + order), *made])
    names = schema.names
    n_keys = len(keys)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = pickle.loads(state.get[0]) if state.exists else (fold.start(), None)
        rows = sorted((r for pdf in frames for r in pdf[columns].itertuples(index=False, name=None)), key=lambda r: r[n_keys : n_keys + len(order)])
        at = [columns.index(c) for c in inputs]
        out = []
        for r in rows:
            place = r[n_keys : n_keys + len(order)]
            if last is not None and place <= last:
                continue
            last = place
            held, told = fold.step(held, tuple(r[i] for i in at))
            if told is not None:
                out.append((*r[: n_keys + len(order)], *told))
        state.update((pickle.dumps((held, last)),))
        yield pd.DataFrame(out, columns=names)

    kept = StructType([StructField("state", _parse_datatype_string("binary"))])
    return stream.select(*columns).groupBy(*keys).applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.NoTimeout)


def event_density(events: DataFrame, late: str = "1 minute", window: str = "1 second", slide: str | None = None) -> DataFrame:
    """Onsets a window by track and kind; events over ``late`` behind are dropped."""
    return events.withWatermark("ts", late).groupBy("track", "kind", F.window("ts", window, slide) if slide else F.window("ts", window)).agg(F.count("*").alias("n"))


def latest_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], order: str = "frame", key: str = "track"):
    """A writer that passes each micro-batch's newest row of each track on."""
    def newest(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        write(batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*"), number)

    return stream.writeStream.outputMode("append").foreachBatch(newest)
