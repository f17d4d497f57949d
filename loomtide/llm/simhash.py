"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints of 64 bits are linked at ``radius`` or fewer differing bits. Each
bit position gets a vector of radius+1 bits; each non-zero vector v of as many
bits gives a mask of the positions whose vector has an odd inner product with
v. The vectors of any ``radius`` positions leave some v orthogonal to all of
them, so two fingerprints that differ there agree under the mask of v: every
linked pair collides in one of the 2^(radius+1) - 1 tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.common import connected_components, materialize, sieve, small_batches
from loomtide.llm.digest import _mix

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SEED = 42
#: Buckets of up to so many fingerprints are compared inside one task.
BUCKET = 4096


def shingle_hashes(text: bytes | None, k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each k-word shingle of the text, repeats included."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= k:
        return np.array([digest(joined, seed)], np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    return np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :])), np.uint64, n - k + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    rows = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(rows[k : k + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64) for k in range(0, len(rows), 1 << 16))
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """Adds nothing but (doc_id, fp): the signed long of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([majority_bits(shingle_hashes(t, k)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector; the positions are dealt evenly."""
    size = 1 << (radius + 1)
    vector = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is reachable within the radius, one a member at most."""
    links, rest = [], fps.copy()
    while len(rest) > 1:
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                found = rest[near]
                links += [(int(root), int(x)) for x in found]
                front += list(found)
                rest = rest[~near]
    return links


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive in the order of (t, key), so a bucket's rows are together."""
        held_key, held = None, []

        def close() -> list[tuple[int, int]]:
            return _forest(np.concatenate(held), radius) if held else []

        for b in batches:
            t, key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(t):
                continue
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            links = []
            for lo, hi in zip([0, *cuts], [*cuts, len(t)]):
                if (own := (t[lo], key[lo])) != held_key:
                    links += close()
                    held_key, held = own, []
                held.append(fp[lo:hi].view(np.uint64))
            yield _pairs(links)
        yield _pairs(close())

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def _ball(radius: int, bits: int = 64) -> list[int]:
    return [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(bits), n)]


def _ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints out of very full buckets, without comparing pairs.

    Two fingerprints are within an even radius exactly if some point is within
    half of it of both. Each goes to all points of its ball, and those that
    meet at a point are linked through the least of them.
    """
    ball = F.array(*[F.lit(_signed(x)) for x in _ball(radius // 2)])
    points = fps.select("fp", F.explode(F.transform(ball, lambda x: x.bitwiseXOR(F.col("fp")))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).where("m < x").select("point", "m")
    return points.join(least, "point").where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(fp) distinct -> (a, b): pairs within the even radius that join all that is reachable."""
    if radius % 2:
        raise ValueError("radius must be even")
    table = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(radius))])).alias("x"),
    ).select("x.t", "x.key", "fp")
    full = materialize(table.groupBy("t", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1"), "buckets")
    two = full.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    met = table.join(full.where("n > 2").select("t", "key", "n"), ["t", "key"])
    some = met.where(F.col("n") <= bucket).select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_bucket_links(radius), "a long, b long")
    found = two.unionByName(some)
    if full.where(F.col("n") > bucket).limit(1).count():
        found = found.unionByName(_ball_links(met.where(F.col("n") > bucket).select("fp").distinct(), radius))
    return found


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """documents -> doc_id, fingerprint (16 hex digits), component_id.

    Texts are taken whole as UTF-8: A-Z in lower case, words between ASCII
    white space, shingles of k words joined by a space with repeats (a shorter
    text is one shingle). Null, empty and blank texts have fingerprint zero
    and are linked like any other. component_id is the least doc_id reachable
    over links, the document's own included; a null doc_id never is, unless
    the component has no other. Repeated rows give repeated rows, an empty
    table none; other columns are not read.
    """
    own = materialize(fingerprints(docs, k), "fingerprints")
    first = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(links(first.select("fp"), radius, bucket))
    joined = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = joined.join(least, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Similar texts differ in about 10 of 64 bits, too many for masks to cover. So
#: deduplicate() takes three codes of 40 bits, each with its own masks. All their
#: bits together tell which of those that collide are worth a look.
CODES, CODE_BITS, CODE_RADIUS, ALL_RADIUS = 3, 40, 4, 30
#: Buckets of up to SMALL codes are compared side by side, those of over FULL in
#: blocks of as many; CHUNK codes are held against a bucket at once.
SMALL, FULL, CHUNK = 4, 16384, 256
#: Shingles of the texts that are compared exactly in one place, about, and how
#: many texts of a larger cluster all its blocks share.
BLOCK_SHINGLES, PIVOTS = 1 << 20, 32
_SALT = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1) for i in range(2)]
#: The masks of all tables over the codes side by side, in two words of 60 bits each.
_HALF = CODES * CODE_BITS // 2
_TABLES = [(m << CODE_BITS * c & (1 << _HALF) - 1, m << CODE_BITS * c >> _HALF) for c in range(CODES) for m in masks(CODE_RADIUS, CODE_BITS)]


def _codes(text: bytes | None, k: int) -> list:
    """Class (a hash of the set), the codes as two words, and the size of a text's set of shingles."""
    h = np.unique(shingle_hashes(text, k))
    low, high = (majority_bits(_mix(h ^ s)) & (1 << _HALF) - 1 for s in _SALT)
    return [xxhash.xxh3_128_digest(h.tobytes()), low, high, len(h)]


def _node(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What stands for a pair of words in links; if two share it, their candidates are one cluster."""
    return _mix(_mix(low.astype(np.uint64)) ^ high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the words differ that stand in the first two rows."""
    return np.bitwise_count(x[0] ^ y[0]) + np.bitwise_count(x[1] ^ y[1])


def _far(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m elements can't be as similar as that."""
    return np.minimum(n, m) < similarity * np.maximum(n, m) - 1e-6


def _first_met(x: np.ndarray, y: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the words (a row each) of x and y agree under no mask before their table's."""
    gap = x ^ y
    out = np.ones(len(table), bool)
    for t in range(int(table.max(initial=0))):
        low, high = _TABLES[t]
        out &= (table <= t) | (gap[0] & low != 0) | (gap[1] & high != 0)
    return out


def _joined(words: np.ndarray, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that join all whose words are close, one for each but the first at most."""
    found, rest = [], np.arange(len(n))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            own, front = front[:CHUNK], front[CHUNK:]
            near = _gap(words[:, own, None], words[:, None, rest]) <= ALL_RADIUS
            near &= ~_far(n[own, None], n[None, rest], similarity)
            hit = near.any(0)
            found.append((own[near[:, hit].argmax(0)], rest[hit]))
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    i, j = zip(*found) if found else ((np.zeros(0, np.int64),), (np.zeros(0, np.int64),))
    return np.concatenate(i), np.concatenate(j)


def _candidates(similarity: float, full: int):
    """Rows (t, block, low, high, n), those of a bucket together -> links (a, b)
    of nodes that join the close ones of each bucket.

    A pair that has met in an earlier table isn't told again: what it joins is
    joined there. Of a bucket with over full rows nothing but its table and key
    are told, in a row of its own (a is null), and no more than so many are held.
    """
    under = np.array(_TABLES, np.int64)
    names, kinds = ["a", "b", "t", "k0", "k1"], (pa.int64(), pa.int64(), pa.int16(), pa.int64(), pa.int64())

    def links(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        good = _first_met(x[4:6, i], x[4:6, j], x[0, i])
        i, j = i[good], j[good]
        ends = [pa.array(_node(*x[4:6, k])) for k in (i, j)]
        return pa.RecordBatch.from_arrays([*ends, *(pa.nulls(len(i), kind) for kind in kinds[2:])], names=names)

    def small(x: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Buckets of up to SMALL rows, whose ends are given, all at once."""
        for d in range(1, SMALL):
            i = np.flatnonzero(np.arange(len(end)) + d < end)
            i = i[(_gap(x[4:6, i], x[4:6, i + d]) <= ALL_RADIUS) & ~_far(x[6, i], x[6, i + d], similarity)]
            if len(i):
                yield links(x, i, i + d)

    def large(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = _joined(x[4:6], x[6], similarity)
        if len(i):
            yield links(x, i, j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """x has the rows table, block, key (two words), words (two), n."""
        held: list[np.ndarray] = []
        size, skipped = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held, 1)
            yield from large(x) if x.shape[1] > SMALL else small(x, np.full(x.shape[1], x.shape[1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            t, block, low, high, n = (batch.column(i).to_numpy().astype(np.int64) for i in range(5))
            x = np.stack([t, block, low & under[t, 0], high & under[t, 1], low, high, n])
            cuts = np.concatenate([[0], np.flatnonzero((x[:4, 1:] != x[:4, :-1]).any(0)) + 1, [x.shape[1]]])
            if skipped is not None and tuple(x[:4, 0]) == skipped:
                cuts = cuts[1:]
            elif held and (x[:4, 0] == held[0][:4, 0]).all():
                held.append(x[:, : cuts[1]])
                size += int(cuts[1])
                cuts = cuts[1:]
            if held and size > full:
                skipped, held = tuple(held[0][:4, 0]), []
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((None, None, skipped[0], *skipped[2:]), kinds)], names=names)
            if len(cuts) == 1:
                continue
            if held:
                yield from close()
            held, size, skipped = [x[:, cuts[-2] :]], int(cuts[-1] - cuts[-2]), None
            sizes = np.diff(cuts[:-1])
            few = np.repeat(sizes <= SMALL, sizes)
            if few.any():
                ends = np.repeat(np.cumsum(sizes[sizes <= SMALL]), sizes[sizes <= SMALL])
                yield from small(x[:, cuts[0] : cuts[-2]][:, few], ends)
            for i in np.flatnonzero(sizes > SMALL):
                yield from large(x[:, cuts[i] : cuts[i + 1]])
        if held and size <= full:
            yield from close()

    return run


def _met(classes: DataFrame, similarity: float, full: int) -> DataFrame:
    """(low, high, n) -> links (a, b) of nodes that join all whose words agree
    under a table's masks and are close.

    A row is told once for each table, with nothing but its words; the key is
    worked out where it is needed. A bucket of over full rows is dealt out in
    blocks; each two of its blocks meet in a task, so that none holds more than
    twice as many.
    """
    spread = classes.select(F.explode(F.sequence(F.lit(0), F.lit(len(_TABLES) - 1)).cast("array<short>")).alias("t"), "low", "high", F.col("n").cast("int").alias("n"))
    k0, k1 = (F.col(word).bitwiseAND(F.element_at(F.array(*(F.lit(t[i]).cast("long") for t in _TABLES)), F.col("t") + 1)) for i, word in enumerate(("low", "high")))

    def within(rows: DataFrame, limit: int) -> DataFrame:
        dealt = rows.select("t", "block", "low", "high", "n").repartition("t", k0, k1, "block").sortWithinPartitions("t", k0, k1, "block")
        return dealt.mapInArrow(_candidates(similarity, limit), "a long, b long, t short, k0 long, k1 long")

    found = materialize(within(spread.withColumn("block", F.lit(0)), full), "met", slim=True)
    links = found.where("a is not null").select("a", "b")
    over = found.where("a is null").select("t", "k0", "k1")
    if not over.limit(1).count():
        return links
    bucket = ["t", "k0", "k1"]
    rows = spread.withColumns({"k0": k0, "k1": k1}).join(over, bucket)
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") * 2 / full).cast("int"))
    own = F.pmod(F.xxhash64("low", "high"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.least(i, "own") * 32768 + F.greatest(i, "own"))
    blocks = rows.join(sizes, bucket).withColumn("own", own).withColumn("block", F.explode(pairs))
    return links.unionByName(within(blocks, 1 << 62).select("a", "b"))


def _similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets connected by the similarity, one a set at most."""
    every, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    rest, out = np.arange(len(sets)), []

    def of(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([flat[ends[i] - sizes[i] : ends[i]] for i in members]) if len(members) else flat[:0], np.concatenate([[0], np.cumsum(sizes[members])])

    mark = np.zeros(len(every), bool)
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        around, at = of(rest)
        while front and len(rest):
            own = front.pop()
            ids = flat[ends[own] - sizes[own] : ends[own]]
            mark[ids] = True
            common = np.diff(np.concatenate([[0], np.cumsum(mark[around])])[at])
            mark[ids] = False
            hit = common >= similarity * (sizes[own] + sizes[rest] - common)
            if hit.any():
                found = rest[hit].tolist()
                out += [(own, j) for j in found]
                front += found
                rest = rest[~hit]
                around, at = of(rest)
    return out


def _verified(k: int, similarity: float):
    """Rows (root, block, cls, text) in the order of (root, block) -> links of
    classes that join all of a block that the similarity connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, sets = None, [], []

        def close() -> list[tuple[bytes, bytes]]:
            return [(ids[i], ids[j]) for i, j in _similar(sets, similarity)] if len(sets) > 1 else []

        def told(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            a, b = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            out = []
            for *own, cls, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if own != held:
                    out += close()
                    held, ids, sets = own, [], []
                ids.append(cls)
                sets.append(np.unique(shingle_hashes(text.as_py(), k)))
            if out:
                yield told(out)
        yield told(close())

    return run


def _linked(members: DataFrame, texts: DataFrame, k: int, similarity: float, block: int) -> DataFrame:
    """(root, cls, uid, n) clusters of candidates and (uid, text) -> links of
    classes that join all of a cluster that the similarity connects.

    A cluster of over ``block`` shingles is dealt out in blocks which share a few
    texts. Blocks are joined inside, which leaves one large part and others;
    then each text that isn't in the large part is held against all blocks.
    """
    sizes = members.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("total") / block).cast("int"))
    sizes = materialize(sizes.withColumn("blocks", F.greatest("blocks", F.lit(1))), "clusters", slim=True)
    dealt = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    shared = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("cls", F.lit(1)), F.col("size")) < PIVOTS)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def inside(rows: DataFrame) -> DataFrame:
        """rows: root, block, cls, uid."""
        placed = texts.join(rows, "uid").select("root", "block", "cls", "text")
        return placed.repartition("root", "block").sortWithinPartitions("root", "block").mapInArrow(_verified(k, similarity), "a binary, b binary")

    found = materialize(inside(dealt.select("root", F.explode(F.when(shared, every).otherwise(F.array("own"))).alias("block"), "cls", "uid")), "links", slim=True)
    if not sizes.where("blocks > 1").limit(1).count():
        return found
    parts = connected_components(found).withColumnRenamed("node", "cls").withColumnRenamed("root", "part")
    large = materialize(dealt.where("blocks > 1").join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls")), "parts", slim=True)
    most = large.groupBy("root", "part").agg(F.sum("n").alias("n")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("most"))
    movers = large.join(most, "root").where("part <> most")
    pieces = movers.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / block)).cast("int").alias("pieces"))
    moved = movers.join(pieces, "root").withColumn("piece", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("pieces")).cast("int"))
    against = large.join(pieces, "root").select("root", F.col("own").alias("block"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "pieces", "cls", "uid")
    meet = moved.select("root", F.explode(every).alias("block"), "piece", "pieces", "cls", "uid").unionByName(against).distinct()
    return found.unionByName(inside(meet.select("root", (F.col("block") * F.col("pieces") + F.col("piece")).alias("block"), "cls", "uid")))


def deduplicate(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """documents with one row, that of the least doc_id, of each group of
    near-duplicates: texts linked by a Jaccard similarity of their sets of
    k-word shingles of at least similarity.

    Texts with equal sets are a class. Candidates collide in a table of
    covering masks over one of CODES codes, and all their codes are close;
    whatever candidates connect is a cluster, told by links that are fewer than its
    classes in each bucket. In a cluster the sets of all its classes are
    compared exactly, so that no link between those that collide is lost.

    Texts without words (null, empty, blank) are one group; a shorter text is
    one shingle, a long one is taken whole; a null doc_id goes before others,
    and of one doc_id the row with the least hash of its text stays; of equal
    rows one stays. An empty table gives no rows. All columns are kept; only
    doc_id and text are looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, *codes = zip(*(_codes(t, k) for t in b.column(2).to_pylist())) if b.num_rows else [()] * 4
            low, high, n = (np.array(c, np.int64) for c in codes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls, pa.binary()), *map(pa.array, (_node(low, high), low, high, n))], names=["uid", "doc_id", "cls", "id", "low", "high", "n"])

    text = F.col("text").cast("binary")
    uid = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.when(text.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.lit(":").cast("binary"), text)))))
    own = materialize(
        small_batches(docs).select(uid.alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "uid binary, doc_id long, cls binary, id long, low long, high long, n long"), "codes"
    )
    repeated = own.groupBy("uid").count().where("count > 1").limit(1).count()
    equal = materialize(own.groupBy("cls", "id", "low", "high", "n").agg(F.min(F.struct("doc_id", "uid")).alias("first")), "classes")
    near = connected_components(_met(equal, similarity, FULL)).withColumnRenamed("node", "id")
    members = materialize(equal.select("id", "cls", "n", "first.uid").join(near, "id"), "members", slim=True)
    texts = docs.select(uid.alias("uid"), text.alias("text")).where(sieve(members, "uid")("uid"))
    texts = texts.dropDuplicates(["uid"]) if repeated else texts
    linked = connected_components(_linked(members, texts, k, similarity, BLOCK_SHINGLES)).withColumnRenamed("node", "cls")
    grouped = equal.select("cls", "first").join(linked, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    stay = grouped.groupBy("root").agg(F.min("first").alias("first")).select("first.uid")
    # What goes is the smaller part; rows that surely stay aren't moved.
    gone = materialize(own.select("uid").distinct().join(stay, "uid", "left_anti"), "gone", slim=True)
    rows = docs.withColumn("__uid", uid)
    may_go = sieve(gone, "uid")(F.col("__uid"))
    doubtful = rows.where(may_go).join(gone.withColumnRenamed("uid", "__uid"), "__uid", "left_anti").select(*rows.columns)
    kept = rows.where(~may_go).unionByName(doubtful)
    return (kept.dropDuplicates(["__uid"]) if repeated else kept).drop("__uid")
