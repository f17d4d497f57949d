"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A bin is filled greedily, the longest piece that fits first; then its smallest
piece is taken out again if two unpacked pieces fill the widened gap better.
What a bin looks like depends on lengths alone, and there are at most as many
of these as a sequence has tokens. So the plan is made over the counts of each
length: a pattern of lengths is worked out once and repeated while the counts
last. The pieces then take the places of their length by rank.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtide.llm.common import materialize, small_batches

#: Pieces of one length are ranked in groups of about so many rows, or of one
#: in RANK_GROUPS of all pieces if that is more.
RANK_ROWS, RANK_GROUPS = 1000, 2000
#: Runs of white space, or without it, that the ranks' matcher may have no stack for.
_SPACES, _LONG = re.compile(r"\s{1000}"), 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(path: str, ranks: str | None):
    """text -> array of uint32 ids, as the tokenizer file at path gives them.

    ranks names a file of the same vocabulary as tiktoken ranks; it gives the
    same ids several times as fast. Texts that hold one of the tokenizer's
    special strings, which has its own rule there, or a long run without or of
    white space go to the tokenizer itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def by_tokenizer(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks is None:
        return by_tokenizer
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def long_run(text: str) -> bool:
        return len(text) >= 1000 and bool(_SPACES.search(text)) or len(text) >= _LONG and max(map(len, text.split()), default=0) >= _LONG

    def by_ranks(text: str) -> np.ndarray:
        if any(s in text for s in special) or long_run(text):
            return by_tokenizer(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return by_ranks


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None, capacity: int, end_id: int) -> DataFrame:
    """Cuts each document's ids, end_id added, into pieces of at most capacity.

    Only longer documents are cut; their first piece takes what is left over,
    so that all others are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, ranks)
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n, at, k = len(ids), 0, 0
                while at < n:
                    size = n if n <= capacity else (n % capacity or capacity) if not at else capacity
                    out.append((doc_id, k, at, size, zlib.crc32(ids[at : at + size].tobytes())))
                    at, k = at + size, k + 1
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """{length: count} -> [(number of bins, {length: pieces in each})].

    Each pattern is repeated until one of its lengths has too few pieces left,
    so there are at most sum(capacity / length) patterns, whatever the counts.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    have = [int(x) for x in np.flatnonzero(left)]
    out = []
    while have:
        gap, use = capacity, {}
        top = bisect_right(have, gap)
        while top:
            size = have[top - 1]
            use[size] = min(int(left[size]), gap // size)
            gap -= use[size] * size
            top = min(top - 1, bisect_right(have, gap))
        if gap and (two := _two_for_one(left, have, use, gap)):
            small, a, b = two
            use[small] -= 1
            use[a] = use.get(a, 0) + 1
            use[b] = use.get(b, 0) + 1
        use = {k: v for k, v in use.items() if v}
        times = min(int(left[k]) // v for k, v in use.items())
        out.append((times, use))
        for k, v in use.items():
            left[k] -= times * v
        have = [k for k in have if left[k]]
    return out


def _two_for_one(left: np.ndarray, have: list[int], use: dict[int, int], gap: int) -> tuple[int, int, int] | None:
    """The bin's smallest length, and the two that fill its place and the gap best."""
    small = min(use)
    room = small + gap
    rest = left[: room + 1].copy()
    for k, v in use.items():
        if k <= room:
            rest[k] -= v
    sizes = np.flatnonzero(rest > 0)
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return None
    partner = np.searchsorted(sizes, room - sizes, "right") - 1
    first = np.arange(len(sizes))
    partner = np.minimum(partner, first)
    same = (partner == first) & (rest[sizes] < 2)
    partner = np.where(same, partner - 1, partner)
    good = partner >= 0
    if not good.any():
        return None
    total = np.where(good, sizes + sizes[np.maximum(partner, 0)], 0)
    best = int(np.argmax(total))
    if total[best] <= small:
        return None
    return small, int(sizes[best]), int(sizes[partner[best]])


def _places(plan_: list[tuple[int, dict[int, int]]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """{length: (first rank, pieces in a bin, first bin, offset in the bin)} by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for times, use in plan_:
        offset = 0
        for size in sorted(use, reverse=True):
            rank = ranks.get(size, 0)
            rows.setdefault(size, []).append((rank, use[size], base, offset))
            ranks[size] = rank + times * use[size]
            offset += size * use[size]
        base += times
    return {size: tuple(np.array(c, np.int64) for c in zip(*r)) for size, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """documents -> a row a piece: where it comes from and where it goes.

    doc_id, piece (from 0), start (the document's ids before it), length,
    ids_crc32 (of the ids as little-endian 32-bit words), sequence_id, offset.
    A null text is empty, so its piece is end_id alone; a long one is taken
    whole, long runs of one character included; an empty table gives no rows;
    repeated rows and a null doc_id are packed like any other. Which of equal
    lengths goes where is decided by doc_id, piece and ids. Only doc_id and
    text are read.
    """
    cut = materialize(pieces(docs, tokenizer, ranks, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = _places(plan(counts, capacity), capacity)
    salts = max(1, -(-max(counts.values(), default=0) // max(RANK_ROWS, sum(counts.values()) // RANK_GROUPS)))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own).cast("long") - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own_rows in np.split(order, cuts) if len(order) else []:
                size = int(length[own_rows[0]])
                first, each, base, at = places[size]
                r = rank[own_rows]
                k = np.searchsorted(first, r, "right") - 1
                seq[own_rows] = base[k] + (r - first[k]) // each[k]
                offset[own_rows] = at[k] + (r - first[k]) % each[k] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
