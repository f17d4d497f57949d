"""Splits long tracks for bounded windows.

A window over a track makes the track one task. Where a row needs only the
rows a bounded number of frames before and after it, the track can be cut into
chunks that each get those rows of their neighbours as well. Any number of
tasks then work on one track, and what is moved twice is the overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunked(df: DataFrame, work: Callable[[DataFrame, list[str]], DataFrame], before: int, after: int = 0, chunk: int = 8192, keys: list[str] = ("track",)) -> DataFrame:
    """work(rows, keys) on chunks of the tracks, each with its surroundings.

    Frames must count the rows of a track without gaps. work gets keys that
    tell the chunk, must keep the column ``inner``, and may drop rows; what it
    gives for rows of the surroundings is dropped.
    """
    if before >= chunk or after >= chunk:
        raise ValueError("a chunk must be longer than what it borrows")
    own = F.floor(F.col("frame") / chunk)
    place = F.pmod("frame", F.lit(chunk))
    where = F.array_compact(F.array(
        F.struct(own.alias("part"), F.lit(True).alias("inner")),
        F.when(place >= chunk - before, F.struct((own + 1).alias("part"), F.lit(False).alias("inner"))) if before else F.lit(None).cast("struct<part:bigint,inner:boolean>"),
        F.when(place < after, F.struct((own - 1).alias("part"), F.lit(False).alias("inner"))) if after else F.lit(None).cast("struct<part:bigint,inner:boolean>"),
    ))
    spread = df.select("*", F.explode(where).alias("__w")).select(*df.columns, F.col("__w.part").alias("part"), F.col("__w.inner").alias("inner"))
    return work(spread, [*keys, "part"]).where("inner").drop("inner", "part")
