"""What the operators share: tables in the shared folder, and components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir, on one machine, as in tests.
FALLBACK_DIR = "file:///tmp/checkpoints/loomtide"
#: Bits that tell which rows can't be in a set of keys; one hash, bounded memory.
SIEVE_BITS = 1 << 23
#: Rows in a batch that goes to Python, where rows hold whole texts.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session was told to pass fewer rows to Python at once.

    The default of 10,000 whole documents can fill a worker and the JVM's
    buffers; a smaller setting of the session stays as it is.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "0")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomtide-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Writes df once into the shared folder and reads it back.

    This cuts the lineage in a way that outlives executors, and unlike an
    eager checkpoint it computes the rows a single time. The rows of a slim
    table, of a few numbers each, are dealt out anew into files of an even
    size, so that there is no crowd of tiny ones; the job that makes them
    keeps all its tasks, however few rows come out of it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if slim:
        df = df.hint("rebalance")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomtide_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Removes all that this application has put into the shared folder.

    Results read their intermediate tables, so this is for when they are done.
    """
    drop_path(spark, f"{shared_dir(spark)}/loomtide-{spark.sparkContext.applicationId}")


def release(df: DataFrame) -> None:
    """Removes what materialize() wrote, once nothing reads it any more."""
    drop_path(df.sparkSession, df._loomtide_path)


def sieve(keys: DataFrame, name: str) -> Callable[[Column | str], Column]:
    """A test of a column that holds for all of keys' column and few other values.

    It keeps rows out of a shuffle that a join would drop anyway. SIEVE_BITS
    bits come to the driver, whatever the number of keys; if there are very
    many, the test lets more through and the join after it does the rest.
    """
    place = f"pmod(xxhash64(`{name}`), {SIEVE_BITS})"
    words = keys.selectExpr(f"cast({place} div 64 as int) as w", f"shiftleft(1L, cast({place} % 64 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(SIEVE_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    packed = bits.view(np.uint64)

    @F.pandas_udf("boolean")
    def holds(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series((packed[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1)

    return lambda column: holds(F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS)))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): root is the component's least node.

    Nodes are of one type that has an order, such as long or binary.

    Alternating large-star and small-star steps: each is an aggregation and a
    join on the node, so no component is ever gathered in one task, and the
    number of rounds grows with the logarithm of the longest path. Nodes
    without links, loops and nulls give no rows; repeated links count once.
    """
    def stars(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges", slim=True,
    )
    before = state(e)
    while before[0]:
        after = materialize(stars(e), "edges", slim=True)
        release(e)
        e, now = after, state(after)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
