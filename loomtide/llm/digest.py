"""Document fingerprints from statistically improbable features.

Every window of ``WINDOW`` bytes has an entropy; the rarer its value is in the
corpus, the better the window tells a text from others. In each stretch of as
many windows, those that reach over the ends of the text included, the rarest
(leftmost) one scores a point, and windows of ``POPULAR`` points or more are
the text's features. The rarest window of a text is in as many stretches as a
window has bytes, so every text has a feature; a text shorter than a window is
one window, filled up with zeros. Features go into a chain of Bloom filters,
and two texts are as alike as their filters' bits overlap, beyond what chance
would give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.common import small_batches

WINDOW, POPULAR = 64, 16
#: Bits and features of a filter, and bits set by a feature.
FILTER_BITS, FILTER_FEATURES, PROBES = 2048, 160, 5
#: Share of the range from chance to full overlap that counts as nothing.
CUTOFF = 0.3
#: Entropies are told apart to a thousandth of their range.
LEVELS = 1000
#: Bytes worked on at once.
CHUNK = 1 << 20
#: Documents in a bucket of neighbours, unless there would be more buckets than a
#: sample of about so many places tells apart, and the places for a bucket.
BUCKET_DOCS, SAMPLE_PLACES, PER_BUCKET = 1000, 1 << 20, 16
#: Pairs of filters that are compared at once.
PAIRS = 1 << 16

# c log2 c in whole numbers, so that sums don't depend on what stands before.
_SCALE = 1 << 16
_F = np.round(np.arange(WINDOW + 2) * np.log2(np.maximum(1, np.arange(WINDOW + 2))) * _SCALE).astype(np.int64)
_GAIN = np.diff(_F)
_TOP = int(_F[WINDOW])
_ODD = np.random.default_rng(7).integers(1, 1 << 63, WINDOW // 8, np.uint64) * np.uint64(2) + np.uint64(1)


def entropy_levels(x: np.ndarray) -> np.ndarray:
    """The level of the window that starts at each byte of x."""
    n = len(x) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    # A long text is gone through in parts that overlap by a window.
    return np.concatenate([_levels(x[lo : min(n, lo + 2 * CHUNK) + WINDOW - 1]) for lo in range(0, n, 2 * CHUNK)])


def _levels(x: np.ndarray) -> np.ndarray:
    n = len(x)
    at = np.argsort(x, kind="stable")
    # Places in the order of symbols, those of different symbols far apart.
    kind = np.int32 if n < 1 << 22 else np.int64
    key = at.astype(kind) + x[at].astype(kind) * kind(n + WINDOW)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        near = key[k:] - key[:-k] < WINDOW
        back[k:] += near
        ahead[:-k] += near
        if np.count_nonzero(near) * 8 < n:
            break
    live = np.flatnonzero(near) + k
    while len(live) and k < WINDOW - 1:
        k += 1
        live = live[live >= k]
        live = live[key[live] - key[live - k] < WINDOW]
        back[live] += 1
        ahead[live - k] += 1
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[at], after[at] = back, ahead
    total = np.cumsum(_GAIN[before])[WINDOW - 1 :]
    total[1:] -= np.cumsum(_GAIN[after])[: n - WINDOW]
    return ((_TOP - total) * (LEVELS - 1) // _TOP).astype(np.int32)


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(indices, joined bytes, starts) of texts, about CHUNK bytes at a time."""
    own, size = [], 0
    for i, t in enumerate(texts):
        own.append(i)
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            yield own, np.frombuffer(b"".join(texts[j] for j in own), np.uint8), np.cumsum([0, *(len(texts[j]) for j in own)])
            own, size = [], 0


def level_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each level."""
    total = np.zeros(LEVELS, np.int64)
    for _, x, starts in _chunks(texts):
        levels = entropy_levels(x)
        if len(levels):
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            total += np.bincount(levels[doc[: len(levels)] == doc[WINDOW - 1 :]], minlength=LEVELS)
    return total


def rarity(counts: np.ndarray) -> np.ndarray:
    """Level -> its place among all, the rarest first."""
    out = np.empty(LEVELS, np.uint32)
    out[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_rows(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each row of bytes, of a width that 8 divides."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.full(len(words), rows.shape[1] + (seed << 32), np.uint64)
    for k in range(words.shape[1]):
        h = _mix(h ^ (words[:, k] * _ODD[k % len(_ODD)]))
    return h


def _points(levels: np.ndarray, first: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How many stretches each window is the rarest of; first marks a text's first window.

    Stretches reach over the ends of their text: texts are set apart by as many
    windows that never win.
    """
    gap, text = WINDOW - 1, np.cumsum(first)
    at = np.arange(len(levels)) + text * gap
    never = np.uint64(len(ranks))
    place = np.full(len(levels) + (int(text[-1]) + 1) * gap, never << np.uint64(32), np.uint64)
    place[at] = ranks[levels].astype(np.uint64) << np.uint64(32)
    points = np.zeros(len(place), np.int32)
    for lo in range(0, len(place) - gap, 2 * CHUNK):
        part = place[lo : lo + 2 * CHUNK + gap]
        least = part | np.arange(len(part), dtype=np.uint64)
        for s in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-s], least[s:])
        points[lo : lo + len(part)] += np.bincount((least & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(part)).astype(np.int32)
    return points[at]


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's features, in the order of their places; an empty text has none."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for own, x, starts in _chunks([t.ljust(WINDOW, b"\0") if t else t for t in texts]):
        levels = entropy_levels(x)
        doc = np.repeat(np.arange(len(own), dtype=np.int32), np.diff(starts))
        inside = np.flatnonzero(doc[: len(levels)] == doc[WINDOW - 1 :])
        if not len(inside):
            continue
        points = _points(levels[inside], np.diff(doc[inside], prepend=-1) > 0, ranks)
        at = inside[points >= POPULAR]
        hashes = _hash_rows(x[at[:, None] + np.arange(WINDOW)])
        cuts = np.searchsorted(at, starts)
        for k, i in enumerate(own):
            out[i] = hashes[cuts[k] : cuts[k + 1]]
    return out


class Filters:
    """The chained Bloom filters of a text."""

    __slots__ = ("words", "counts", "ones")

    def __init__(self, hashes: np.ndarray):
        n = -(-len(hashes) // FILTER_FEATURES)
        bits = np.zeros((n, FILTER_BITS), bool)
        owner = np.arange(len(hashes)) // FILTER_FEATURES
        for k in range(PROBES):
            bits[owner, (hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = True
        self.words = np.packbits(bits, axis=1).view(np.uint64)
        self.counts = np.bincount(owner, minlength=n)
        self.ones = np.bitwise_count(self.words).sum(1, dtype=np.int64)

    def __str__(self) -> str:
        return "|".join(f"{c}:{base64.b64encode(w.tobytes()).decode()}" for c, w in zip(self.counts, self.words))

    def __eq__(self, other) -> bool:
        return np.array_equal(self.words, other.words) and np.array_equal(self.counts, other.counts)


def likeness(a: Filters, b: Filters) -> float:
    """0 to 1: each filter of the shorter chain against the best of the other."""
    if a == b:
        return 1.0
    if not len(a.counts) or not len(b.counts):
        return 0.0
    if len(a.counts) > len(b.counts):
        a, b = b, a
    stay = 1 - 1 / FILTER_BITS
    # Long chains are gone through in parts, so that no table of all pairs is held.
    best_a, best_b = np.zeros(len(a.counts)), np.zeros(len(b.counts))
    wide = min(len(b.counts), PAIRS)
    for i in range(0, len(a.counts), PAIRS // wide):
        own = slice(i, i + PAIRS // wide)
        for j in range(0, len(b.counts), wide):
            other = slice(j, j + wide)
            n, m = a.counts[own, None] * PROBES, b.counts[None, other] * PROBES
            both = np.bitwise_count(a.words[own, None, :] & b.words[None, other, :]).sum(2, dtype=np.int64)
            most = np.minimum(a.ones[own, None], b.ones[None, other])
            chance = FILTER_BITS * (1 - stay**n - stay**m + stay ** (n + m))
            floor = chance + CUTOFF * (most - chance)
            score = np.where(most > floor, np.clip((both - floor) / np.maximum(1e-9, most - floor), 0, 1), both == most)
            best_a[own] = np.maximum(best_a[own], score.max(1))
            best_b[other] = np.maximum(best_b[other], score.max(0))
    one = float((best_a * a.counts).sum() / a.counts.sum())
    if len(a.counts) < len(b.counts):
        return one
    return max(one, float((best_b * b.counts).sum() / b.counts.sum()))


def fit_rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of the levels over all windows of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            total += level_counts([t or b"" for t in b.column(0).to_pylist()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["level", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for r in rows:  # LEVELS rows at most
        counts[r["level"]] = r["n"]
    return rarity(counts)


def _in_order(docs: DataFrame) -> DataFrame:
    """(bucket, borrowed, doc_id, text): buckets are ranges of doc_id and the
    hash of the text, each in order and followed by the first row of the next
    bucket (the last by the first of all), which is marked as borrowed.

    The ranges are cut from a sample of places, so that many rows with one
    doc_id, or none, are dealt out too.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place, tie = F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text")
    total = rows.count()
    every = max(1, total // SAMPLE_PLACES)
    wanted = min(max(1, total // BUCKET_DOCS), max(1, total // every // PER_BUCKET))
    sample = rows.select(place.alias("p"), tie.alias("t"))
    sample = sample.where(F.pmod(F.xxhash64("p", "t"), F.lit(every)) == 0).toArrow()  # some SAMPLE_PLACES rows
    p, t = (sample.column(i).to_numpy() for i in range(2))
    order = np.lexsort((t, p))
    cuts = sorted({(int(p[order[i]]), int(t[order[i]])) for i in (np.arange(1, wanted) * len(order) // wanted)}) if len(order) else []
    cut_p, cut_t = (np.array([c[i] for c in cuts], np.int64) for i in range(2))

    def own(p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The number of cuts up to each place."""
        lo, hi = np.searchsorted(cut_p, p, "left"), np.searchsorted(cut_p, p, "right")
        for i in np.flatnonzero(lo < hi):
            lo[i] += np.searchsorted(cut_t[lo[i] : hi[i]], t[i], "right")
        return lo.astype(np.int32)

    @F.pandas_udf("int")
    def bucket(p: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(own(p.to_numpy(np.int64), t.to_numpy(np.int64)))

    heads = rows.select(place.alias("p"), tie.alias("t")).groupBy(bucket("p", "t").alias("bucket")).agg(F.min(F.struct("p", "t")).alias("head")).orderBy("bucket").collect()  # a row a bucket
    to = {tuple(r["head"]): heads[i - 1]["bucket"] for i, r in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def buckets(p: pd.Series, t: pd.Series) -> pd.Series:
        p, t = p.to_numpy(np.int64), t.to_numpy(np.int64)
        return pd.Series([[b, to[x]] if x in to else [b] for b, x in zip(own(p, t).tolist(), zip(p.tolist(), t.tolist()))])

    dealt = rows.select("doc_id", "text", F.posexplode(buckets(place, tie)).alias("k", "bucket")).select("bucket", (F.col("k") > 0).alias("borrowed"), "doc_id", "text")
    return dealt.repartition(max(1, len(heads)), "bucket").sortWithinPartitions("bucket", "borrowed", "doc_id", F.xxhash64("text"), "text")


def fingerprint(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """documents -> a text's fingerprint and likeness to its neighbours.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has the last floor(n_chars / 4)
    code points replaced by the first as many of the next document in the
    order of doc_id (after the last, the first); null is the least doc_id, and
    rows with the same one follow each other by their texts. A null text is
    empty; empty texts have the empty fingerprint and a likeness of 1 to each
    other, 0 to others. A long text is taken whole, in parts. Without ranks,
    they are counted from docs. Repeated rows give repeated rows, an empty
    table none; other columns aren't read.
    """
    ranks = fit_rarity(docs) if ranks is None else ranks
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (doc_id, text) in order, the last one only a neighbour."""
        edited = []
        for (_, text), (_, after) in zip(rows, rows[1:]):
            n = len(text) // 4
            edited.append((text[: len(text) - n] + after[:n]).encode("utf-8", "replace"))
        plain = [Filters(h) for h in features([t.encode("utf-8", "replace") for _, t in rows], ranks)]
        changed = [Filters(h) for h in features(edited, ranks)]
        out = [
            (i, len(t), hashlib.sha256(e).hexdigest(), str(f), str(g), likeness(f, g), likeness(f, after))
            for (i, t), e, f, g, after in zip(rows, edited, plain, changed, plain[1:])
        ]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[k.split()[0] for k in kinds.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket, size, done = None, 0, False
        for b in batches:
            for own, borrowed, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                if own != bucket:
                    held, bucket, size, done = [], own, 0, False
                if done:
                    continue
                held.append((doc_id, text.as_py() or ""))
                size += len(held[-1][1])
                done = borrowed
                if done or size >= CHUNK:
                    yield from finish(held)
                    held, size = held[-1:], 0

    return _in_order(docs).mapInArrow(run, kinds)
