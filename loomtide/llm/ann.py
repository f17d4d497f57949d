"""Nearest neighbours by inner product, from randomly rotated one-bit codes.

A vector o is turned by a random rotation, into STRETCH times as many dimensions
and at least BITS, and kept as the signs of its components: a packed code x, its
length |o| and the correction <x, o/|o|>, where x stands for the unit vector of
those signs. Codes are made once for each vector and stored. For a query q of
unit length <x, q> / <x, o> estimates <o, q> / |o| without bias, and the error
exceeds EPSILON * sqrt((1 - <x,o>^2) / <x,o>^2 / (bits - 1)) only very rarely.
The turned query is rounded to LEVELS bits a component; so its product with a
code is a sum of numbers of common bits, and the rounding has a bound too. Each
block of codes is scanned: the best guesses get their exact product, and then
all others whose upper bound reaches the k-th best of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtide.llm.common import materialize

#: Standard deviations that the bounds allow for.
EPSILON = 3.3
#: Bits of a code, as a multiple of the dimensions and at least; bits of a query's component.
STRETCH, BITS, LEVELS = 4, 128, 4
#: Vectors in an index block and in a query block, about.
INDEX_ROWS, QUERY_ROWS = 16384, 8192
#: Index blocks at least, unless they would have fewer vectors than LEAST_ROWS.
LEAST_BLOCKS, LEAST_ROWS = 12, 256
SEED = 20240521


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """(dim, bits) with orthonormal rows, the same wherever it is made: bits is a multiple of 64."""
    bits = -(-max(BITS, STRETCH * dim) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((bits, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, lengths), none of them zero; large components don't overflow."""
    top = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / top
    size = np.sqrt((scaled * scaled).sum(1))
    return scaled / size[:, None], size * top[:, 0]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs as words, lengths, corrections) of the rows, none of them zero."""
    unit, size = _unit(vectors)
    turned = unit @ rotation(vectors.shape[1])
    return np.packbits(turned > 0, axis=1, bitorder="little").view("<u8"), size, np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


def planes(turned: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(packed bits of each level, step, least component) of a turned query."""
    low = float(turned.min())
    step = max((float(turned.max()) - low) / ((1 << LEVELS) - 1), 1e-300)
    whole = np.rint((turned - low) / step).astype(np.uint8)
    return np.packbits(whole[None, :] >> np.arange(LEVELS, dtype=np.uint8)[:, None] & 1, axis=1, bitorder="little").view("<u8"), step, low


def products(bits: np.ndarray, ones: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """<x, q> for each code x, whose words are the rows of bits (transposed), from common bits alone."""
    rounded, step, low = planes(turned)
    total = np.zeros(bits.shape[1], np.int64)
    for level, words in enumerate(rounded):
        total += np.bitwise_count(bits & words[:, None]).sum(0, dtype=np.int64) << level
    n = len(turned)
    whole = sum(int(np.bitwise_count(w).sum()) << level for level, w in enumerate(rounded))
    # The signs are +-1 / sqrt(n): twice the sum over the ones less the sum over all.
    return (2 * (step * total + low * ones) - (step * whole + low * n)) / np.sqrt(n)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products with the rows, summed in the order of components."""
    return np.cumsum((vectors * query).T, axis=0)[-1]


def search_block(qid: np.ndarray, queries: np.ndarray, vid: np.ndarray, vectors: np.ndarray, codes: tuple, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best of the block; vid rises."""
    packed, size, fit = codes
    bits, ones = np.ascontiguousarray(packed.T), np.bitwise_count(packed).sum(1, dtype=np.int64)
    unit, length = _unit(queries)
    turned = unit @ rotation(vectors.shape[1])
    n = turned.shape[1]
    ratio = size / fit
    slack = epsilon * ratio * np.sqrt(np.maximum(0, 1 - fit * fit) / max(1, n - 1)) + 1e-9 * size
    out: list[tuple] = []
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(len(qid)):
            # A guess is the product with the query of unit length. Each component
            # is rounded by half a step at most, and errors of either sign add up
            # like a random walk.
            guess = products(bits, ones, turned[i]) * ratio
            step = (turned[i].max() - turned[i].min()) / ((1 << LEVELS) - 1)
            wide = slack + epsilon * ratio * step / np.sqrt(12)
            own = np.searchsorted(vid, qid[i], "left"), np.searchsorted(vid, qid[i], "right")
            guess[own[0] : own[1]] = -np.inf
            keep, rough = np.arange(len(vid)), 1e-9 * length[i] * size
            if len(vid) > 4 * k:
                best = np.argpartition(guess, -4 * k)[-4 * k :]
                best = best[guess[best] > -np.inf]
                known = np.sort(vectors[best] @ queries[i] - rough[best])
                if len(known) >= k:
                    keep = np.flatnonzero(~((guess + wide) * length[i] + rough < known[-k]) | (guess >= guess[best].min()))
            keep = keep[(keep < own[0]) | (keep >= own[1])]
            if len(keep) > k:
                # Those that rounding could bring among the best stay, and ties until the ids decide.
                about = vectors[keep] @ queries[i]
                keep = keep[~(about + rough[keep] < np.partition(about - rough[keep], -k)[-k])]
            score = exact(queries[i], vectors[keep])
            order = np.lexsort((vid[keep], -score))[:k]
            out.append((np.full(len(order), qid[i]), vid[keep[order]], score[order]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (qid[:0], vid[:0], np.zeros(0))


def _usable(table: DataFrame, vector: str) -> DataFrame:
    """(id, vec, dim) of the rows whose vector can take part."""
    vec = F.col(vector).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return (
        table.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
        .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(fine)
        .withColumn("dim", F.size("vec"))
    )


def index(rows: DataFrame) -> DataFrame:
    """(vec_id, vec, dim) -> the same with code, size and fit, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            code, size, fit = [b""] * len(dims), np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                vectors = b.column(1).take(pa.array(own)).flatten().to_numpy().reshape(-1, dim)
                packed, size[own], fit[own] = encode(vectors)
                for i, words in zip(own, packed):
                    code[i] = words.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.binary()), pa.array(size), pa.array(fit)], names=[*b.schema.names, "code", "size", "fit"])

    return materialize(rows.select("vec_id", "vec", "dim").mapInArrow(run, "vec_id long, vec array<double>, dim int, code binary, size double, fit double"), "index")


def search(table: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """vectors -> query_id, rank, vec_id, score of each query's k nearest.

    The rows that is_query (of vec_id) selects are queries; every other row of
    the same dimension is a candidate of theirs, all of them if there are no
    more than k. Score is the inner product in double precision; ties go to
    the smaller vec_id. Rows without vec_id, and vectors that are null, empty,
    zero, or hold a null or a non-finite component, take no part. A vec_id in
    several rows is a candidate, and a query, in each of them, but never of
    itself. An empty table gives no rows; other columns are not read.

    Every query is held against the codes of every row, in blocks; what they
    save is the exact product with most vectors.
    """
    rows = index(_usable(table, vector))
    n = rows.count()
    index_n = max(1, -(-n // INDEX_ROWS), min(LEAST_BLOCKS, n // LEAST_ROWS))
    query_n = max(1, -(-n // QUERY_ROWS))
    # A cell is a block of queries against a block of the index. Queries are few
    # beside the index, so a query block is dealt out over all index blocks, and
    # an index block over as many query blocks as fill up with queries.
    asked_n = max(1, -(-rows.where(is_query).count() // QUERY_ROWS)) if query_n > 1 else 1
    block = F.pmod(F.xxhash64("vec_id"), F.lit(index_n)).cast("int")
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asked_n)).cast("int")
    against = rows.select("dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(asked_n - 1))).alias("group"), "vec_id", "vec", "code", "size", "fit")
    asked = rows.where(is_query).select("dim", F.explode(F.sequence(F.lit(0), F.lit(index_n - 1))).alias("block"), group.alias("group"), "vec_id", "vec")
    cell = ("dim", "block", "group")

    def arrays(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = t.column("vec_id").to_numpy()
        flat = pa.concat_arrays(t.column("vec").chunks).flatten().to_numpy() if len(ids) else np.zeros(0)
        order = np.argsort(ids, kind="stable")
        return ids[order], flat.reshape(-1, dim)[order], order

    def scan(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        vid, vectors, order = arrays(left, dim)
        qid, queries, _ = arrays(right, dim)
        if len(vid) and len(qid):
            packed = np.frombuffer(b"".join(left.column("code").to_pylist()), "<u8").reshape(len(vid), -1)[order]
            codes = packed, left.column("size").to_numpy()[order], left.column("fit").to_numpy()[order]
            found = search_block(qid, queries, vid, vectors, codes, k, epsilon)
        else:
            found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = against.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(scan, "query_id long, vec_id long, score double")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
