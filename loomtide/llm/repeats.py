"""Exact removal of long repeated strings by suffix sorting around anchors.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
in the corpus. Sorting all suffixes of a corpus isn't possible in one place,
so the sorting is done group by group:

1. Each string of ``length`` bytes holds length - GRAM + 1 windows of GRAM
   bytes; the one with the least hash (the leftmost of them) is its anchor.
   Equal strings have equal anchors at equal places, so all occurrences of a
   repeat meet where the anchors' hashes are gathered.
2. Of occurrences with the same bytes all around, all but the first are
   repeated as far as those bytes reach. This settles the inside of repeats.
3. What remains are anchors near the ends of repeats. The suffixes that start
   at them are sorted; a stack scan over their common prefixes gives the
   interval tree, whose nodes are the groups that share so many bytes on the
   right. In each node the bytes on the left are compared with those of all
   earlier occurrences, which gives how far the repeat extends there: a node
   whose left extensions differ is a maximal repeat, one whose left bytes all
   agree is widened by them.

Anchors that a sample of documents shows to be very frequent would gather too
many occurrences. Their strings are compared as hashes of whole windows
instead, which are dealt by that hash and collapsed in each batch before.

What is called equal by its hash is compared by 128 bits; of 10^14 windows two
different ones have the same with a probability under 10^-10. Anchors meet by a
hash of 64 bits, and then their bytes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtide.llm.common import materialize, small_batches
from loomtide.llm.digest import _hash_rows, _mix

LENGTH, GRAM = 100, 32
#: Documents sampled for frequent anchors, or one in HOT_SHARE if that is more;
#: the occurrences that make one, and how many are told apart at most.
HOT_DOCS, HOT_SHARE, HOT_COUNT, HOT_MOST = 20_000, 10_000, 40, 1 << 20
#: Bytes of text worked on at once, and in a bucket of anchors or of documents.
CHUNK, BUCKET_BYTES = 1 << 20, 16 << 20
#: Stands for a null doc_id, which comes before all others.
NULL_ID = -(1 << 63)

_C = np.random.default_rng(11).integers(1, 1 << 63, GRAM // 8, np.uint64) * np.uint64(2) + np.uint64(1)
_ANCHOR = [("h", "<u8"), ("c", "<u8"), ("d", "<u8"), ("doc", "<i8"), ("dup", "<i4"), ("pos", "<i4"), ("l", "u1"), ("r", "u1")]
_WINDOW = [("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("dup", "<i4"), ("pos", "<i4")]
_SPAN = [("doc", "<i8"), ("dup", "<i4"), ("start", "<i4"), ("end", "<i4")]
_EDGE = [("h", "<u8"), ("doc", "<i8"), ("dup", "<i4"), ("pos", "<i4")]
_KIND = {0: _ANCHOR, 1: _SPAN, 2: _WINDOW, 3: _EDGE}
PACKED = "key long, kind int, data binary"


def _pack(cols: dict[str, np.ndarray], kind: int, at: np.ndarray | slice) -> bytes:
    return b"".join(np.ascontiguousarray(cols[name][at], kind_).tobytes() for name, kind_ in _KIND[kind])


def _unpack(rows: list[bytes], kind: int) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in _KIND[kind])
    parts: dict[str, list] = {name: [] for name, _ in _KIND[kind]}
    for data in rows:
        n, at = len(data) // width, 0
        for name, t in _KIND[kind]:
            parts[name].append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
    return {name: np.concatenate(p) if p else np.zeros(0, dict(_KIND[kind])[name]) for name, p in parts.items()}


def _dealt(cols: dict[str, np.ndarray], kind: int, keys: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """A packed row for each key."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for own in np.split(order, cuts):
        yield int(keys[own[0]]), kind, _pack(cols, kind, own)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    key, kind, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["key", "kind", "data"])


def merged(doc: np.ndarray, dup: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """The spans of each document, those that meet being one."""
    order = np.lexsort((start, dup, doc))
    doc, dup, start, end = doc[order], dup[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return {"doc": doc, "dup": dup, "start": start, "end": end}
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (dup[1:] != dup[:-1])
    # Ends are made to rise over documents, so that one running maximum does.
    base = (np.cumsum(fresh) - 1) << 32
    top = np.maximum.accumulate(end + base)
    fresh[1:] |= start[1:] + base[1:] > top[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return {"doc": doc[first], "dup": dup[first], "start": start[first], "end": top[last] - base[last]}


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place of x."""
    n = len(x) - GRAM + 1
    words = np.lib.stride_tricks.as_strided(x, (len(x) - 7, 8), (1, 1)).copy().view("<u8")[:, 0]
    # Mixed first: a few changed bits of two words could cancel out in a sum.
    words = _mix(words)
    h = words[:n] * _C[0]
    for k in range(1, GRAM // 8):
        h += words[8 * k : 8 * k + n] * _C[k]
    return _mix(h)


def anchors(x: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of anchors, their hashes, anchor of each string or -1) of joined texts.

    Goes through a long text in parts that overlap by a string, so that what
    is held beside it is bounded.
    """
    n = len(x) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    of, hashes, seen = np.empty(n, np.int64), np.zeros(len(x), np.uint64), np.zeros(len(x), bool)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        own, h = _leftmost(x[lo : hi + length - 1], length)
        own += lo
        own[doc[lo:hi] != doc[lo + length - 1 : hi + length - 1]] = -1
        of[lo:hi] = own
        found = np.unique(own[own >= 0])
        seen[found] = True
        hashes[found] = h[found - lo]
    at = np.flatnonzero(seen)
    return at, hashes[at], of


def _leftmost(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of the string at each place, hashes of grams) of a bounded part."""
    width = length - GRAM + 1
    h = _gram_hashes(x)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: -(width - step)], least[width - step :])
    return (least & low).astype(np.int64), h


def _around(x: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes around each anchor, zero outside its document; bytes on its left, right)."""
    left = np.minimum(side, at - first).astype(np.uint8)
    right = np.minimum(side, last - at - GRAM).astype(np.uint8)
    offset = np.arange(-side, GRAM + side)
    where = at[:, None] + offset
    rows = x[np.clip(where, 0, len(x) - 1)]
    rows[(offset < -left[:, None].astype(np.int64)) | (offset >= GRAM + right[:, None].astype(np.int64))] = 0
    return rows, left, right


def _texts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(joined bytes, starts, doc, dup) of a batch's texts, about CHUNK bytes at a time."""
    doc, dup = b.column(0).to_numpy(), b.column(1).to_numpy()
    own, texts, size = [], [], 0
    for i, value in enumerate(b.column(2)):
        t = value.as_py() or b""
        own.append(i)
        texts.append(t)
        size += len(t)
        if size >= CHUNK or i == len(doc) - 1:
            yield np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), doc[own], dup[own]
            own, texts, size = [], [], 0


def scan(length: int, buckets: int, hot: np.ndarray):
    """Texts -> packed anchors, strings at frequent anchors, and spans known at once."""
    side = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, starts, ids, dups in _texts(b):
                if len(x) < length:
                    continue
                doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(starts))
                at, h, of = anchors(x, doc, length)
                out: list[tuple[int, int, bytes]] = []
                frequent = np.isin(h, hot)
                spans = []
                # Anchors that aren't frequent, with a hash of what is around them.
                a, own = at[~frequent], doc[at[~frequent]]
                hashes = h[~frequent]
                c, d = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
                left, right = np.zeros(len(a), np.uint8), np.zeros(len(a), np.uint8)
                for lo in range(0, len(a), 1 << 16):
                    k = slice(lo, lo + (1 << 16))
                    rows, left[k], right[k] = _around(x, a[k], starts[own[k]], starts[own[k] + 1], side)
                    width = -(-rows.shape[1] // 8) * 8
                    padded = np.zeros((len(rows), width + 8), np.uint8)
                    padded[:, : rows.shape[1]] = rows
                    padded[:, width], padded[:, width + 1] = left[k], right[k]
                    c[k], d[k] = _hash_rows(padded), _hash_rows(padded, 1)
                pos = a - starts[own]
                # The texts of a chunk are in any order, so the first of equal ones is by id.
                order = np.lexsort((pos, dups[own], ids[own], d, c, hashes))
                again = np.zeros(len(a), bool)
                again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (c[order[1:]] == c[order[:-1]]) & (d[order[1:]] == d[order[:-1]])
                wide = again & (left.astype(np.int64) + right + GRAM >= length)
                spans.append((ids[own[wide]], dups[own[wide]], pos[wide] - left[wide], pos[wide] + GRAM + right[wide]))
                keep = ~again
                cols = {"h": hashes[keep], "c": c[keep], "d": d[keep], "doc": ids[own[keep]], "dup": dups[own[keep]], "pos": pos[keep], "l": left[keep], "r": right[keep]}
                out += _dealt(cols, 0, (cols["h"] % np.uint64(buckets)).astype(np.int64))
                # Strings whose anchor is frequent, by their own hash.
                is_hot = np.zeros(len(x) + 1, bool)
                is_hot[at[frequent]] = True
                p = np.flatnonzero(is_hot[of] & (of >= 0))
                if len(p):
                    w, g = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
                    width = -(-length // 8) * 8
                    for lo in range(0, len(p), 1 << 16):
                        k = slice(lo, lo + (1 << 16))
                        padded = np.zeros((len(p[k]), width), np.uint8)
                        padded[:, :length] = x[p[k][:, None] + np.arange(length)]
                        w[k], g[k] = _hash_rows(padded), _hash_rows(padded, 1)
                    own = doc[p]
                    pos = p - starts[own]
                    order = np.lexsort((pos, dups[own], ids[own], g, w))
                    again = np.zeros(len(p), bool)
                    again[order[1:]] = (w[order[1:]] == w[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
                    spans.append((ids[own[again]], dups[own[again]], pos[again], pos[again] + length))
                    keep = ~again
                    cols = {"h": w[keep], "g": g[keep], "doc": ids[own[keep]], "dup": dups[own[keep]], "pos": pos[keep]}
                    out += _dealt(cols, 2, (w[keep] % np.uint64(buckets)).astype(np.int64))
                known = merged(*(np.concatenate(s) for s in zip(*spans)))
                out += _dealt(known, 1, known["doc"] % buckets)
                yield _batch(out)

    return run


def gather(length: int, buckets: int):
    """All packed rows of a bucket -> spans, and the anchors that remain, by document."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            rows[kind].append(data)
        a = _unpack(rows[0], 0)
        order = np.lexsort((a["pos"], a["dup"], a["doc"], a["d"], a["c"], a["h"]))
        a = {k: v[order] for k, v in a.items()}
        n = len(order)
        same_h, same = np.zeros(n, bool), np.zeros(n, bool)
        same_h[1:] = a["h"][1:] == a["h"][:-1]
        same[1:] = same_h[1:] & (a["c"][1:] == a["c"][:-1]) & (a["d"][1:] == a["d"][:-1])
        wide = same & (a["l"].astype(np.int64) + a["r"] + GRAM >= length)
        pos = a["pos"].astype(np.int64)
        spans = [(a["doc"][wide], a["dup"][wide], pos[wide] - a["l"][wide], pos[wide] + GRAM + a["r"][wide])]
        w = _unpack(rows[2], 2)
        order = np.lexsort((w["pos"], w["dup"], w["doc"], w["g"], w["h"]))
        w = {k: v[order] for k, v in w.items()}
        again = np.zeros(len(order), bool)
        again[1:] = (w["h"][1:] == w["h"][:-1]) & (w["g"][1:] == w["g"][:-1])
        spans.append((w["doc"][again], w["dup"][again], w["pos"][again], w["pos"][again].astype(np.int64) + length))
        s = _unpack(rows[1], 1)
        spans.append((s["doc"], s["dup"], s["start"], s["end"]))
        known = merged(*(np.concatenate(x) for x in zip(*spans)))
        # An anchor's group has work left if its first occurrences differ around it.
        first = ~same
        group = np.cumsum(~same_h) - 1
        many = np.bincount(group[first], minlength=int(group[-1]) + 1 if n else 0) > 1 if n else np.zeros(0, bool)
        edge = first & many[group] if n else first
        cols = {k: a[k][edge] for k, _ in _EDGE}
        out = [*_dealt(known, 1, known["doc"] % buckets), *_dealt(cols, 3, cols["doc"] % buckets)]
        return pa.Table.from_batches([_batch(out)])

    return run


EDGES = "h long, doc long, dup int, pos int, before binary, after binary"


def surroundings(length: int):
    """Documents of a bucket and its remaining anchors -> the bytes before them, and from them on."""
    side = length - GRAM

    def run(key: tuple, docs: pa.Table, packed: pa.Table) -> pa.Table:
        e = _unpack(packed.filter(pa.compute.equal(packed.column("kind"), 3)).column("data").to_pylist(), 3)
        before, after = [], []
        text = {(i, d): t for i, d, t in zip(docs.column("doc").to_pylist(), docs.column("dup").to_pylist(), docs.column("text"))} if len(e["h"]) else {}
        order = np.lexsort((e["pos"], e["dup"], e["doc"]))
        e = {k: v[order] for k, v in e.items()}
        last, raw = None, b""
        for i, d, p in zip(e["doc"].tolist(), e["dup"].tolist(), e["pos"].tolist()):
            if (i, d) != last:
                last, raw = (i, d), text[i, d].as_py()
            before.append(raw[max(0, p - side) : p])
            after.append(raw[p : p + GRAM + side])
        return pa.table([pa.array(e["h"].view(np.int64)), pa.array(e["doc"]), pa.array(e["dup"]), pa.array(e["pos"]), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["h", "doc", "dup", "pos", "before", "after"])

    return run


def intervals(shared: list[int]) -> list[tuple[int, int, int]]:
    """(depth, first, last) of all nodes of the interval tree of a suffix array.

    shared[i] is the length of the common prefix of suffixes i - 1 and i;
    shared[0] isn't used. A node is pushed when prefixes get longer, and is
    complete when they get shorter than its depth.
    """
    out, stack = [], []
    for i in range(1, len(shared)):
        start = i - 1
        while stack and stack[-1][0] > shared[i]:
            depth, start = stack.pop()
            out.append((depth, start, i - 1))
        if not stack or stack[-1][0] < shared[i]:
            stack.append((shared[i], start))
    while stack:
        depth, start = stack.pop()
        out.append((depth, start, len(shared) - 1))
    return out


def _common(a: int, b: int, width: int) -> int:
    return width - ((a ^ b).bit_length() + 7) // 8


def left_extensions(lefts: list[tuple[bytes, int, int]]) -> list[int]:
    """For each occurrence, in the order of time, the most left bytes it shares
    with an earlier one, -1 for the first.

    lefts: (bytes from the anchor leftwards, them as a padded number, width).
    In the order of the left bytes, the best earlier occurrence is the nearest
    one on either side, which a stack keeps.
    """
    best = [-1] * len(lefts)
    order = sorted(range(len(lefts)), key=lambda i: lefts[i][0])
    for way in (order, order[::-1]):
        stack: list[list[int]] = []  # [time, bytes shared with the one after it]
        prev = None
        for i in way:
            if prev is not None:
                a, b = lefts[prev], lefts[i]
                run = min(_common(a[1], b[1], a[2]), len(a[0]), len(b[0]))
                stack.append([prev, run])
                while len(stack) > 1 and stack[-1][0] > i:
                    run = stack.pop()[1]
                    stack[-1][1] = min(stack[-1][1], run)
                if stack[-1][0] < i:
                    best[i] = max(best[i], stack[-1][1])
                else:
                    stack.pop()
            prev = i
    return best


def extents(group: list[tuple[bytes, bytes]], need: int) -> list[tuple[int, int] | None]:
    """How far each occurrence of an anchor is repeated on its left and right.

    group holds (bytes before, bytes after) in the order of time; need is the
    number of bytes that a repeat has beside the anchor at least.
    """
    n = len(group)
    side = max(1, max(max(len(a), len(b)) for a, b in group))
    left = [(a[::-1], int.from_bytes(a[::-1].ljust(side, b"\0")), side) for a, _ in group]
    right = [int.from_bytes(b.ljust(side, b"\0")) for _, b in group]
    order = sorted(range(n), key=lambda i: group[i][1])
    shared = [0] * n
    for k in range(1, n):
        i, j = order[k - 1], order[k]
        shared[k] = min(_common(right[i], right[j], side), len(group[i][1]), len(group[j][1]))
    out: list[tuple[int, int] | None] = [None] * n
    limit = max(left_extensions(left))
    for depth, a, b in intervals(shared):
        if limit + depth < need:
            continue
        members = sorted(order[a : b + 1])
        for i, most in zip(members, left_extensions([left[i] for i in members])):
            if most >= 0 and most + depth >= need:
                was = out[i] or (0, 0)
                out[i] = (max(was[0], most), max(was[1], depth))
    return out


def maximal(length: int, buckets: int):
    """Anchors in the order of their hash -> the spans of their repeats, by document."""
    need = length - GRAM

    def solve(rows: list[tuple], out: list[tuple]) -> None:
        """rows have the same hash; those with the same bytes are a group."""
        if len(rows) < 2:
            return
        groups: dict[bytes, list[tuple]] = {}
        for r in sorted(rows, key=lambda r: r[:3]):
            groups.setdefault(r[4][:GRAM], []).append(r)
        for own in groups.values():
            if len(own) > 1:
                for (doc, dup, pos, _, _), found in zip(own, extents([(r[3], r[4][GRAM:]) for r in own], need)):
                    if found:
                        out.append((doc, dup, pos - found[0], pos + GRAM + found[1]))

    def flush(out: list[tuple]) -> pa.RecordBatch:
        cols = np.array(out, np.int64).reshape(-1, 4)
        known = merged(cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3])
        return _batch(list(_dealt(known, 1, known["doc"] % buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for b in batches:
            out: list[tuple] = []
            for h, *row in zip(*(c.to_pylist() for c in b.columns)):
                if h != held:
                    solve(rows, out)
                    held, rows = h, []
                rows.append(tuple(row))
            yield flush(out)
        out = []
        solve(rows, out)
        yield flush(out)

    return run


def cut(key: tuple, docs: pa.Table, packed: pa.Table) -> pa.Table:
    """Documents of a bucket and their spans -> what was removed and what stays."""
    s = _unpack(packed.filter(pa.compute.equal(packed.column("kind"), 1)).column("data").to_pylist(), 1)
    s = merged(s["doc"], s["dup"], s["start"], s["end"])
    of: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, d, a, b in zip(*(s[k].tolist() for k in ("doc", "dup", "start", "end"))):
        of.setdefault((i, d), []).append((a, b))
    starts, ends, kept = [], [], []
    for i, d, value in zip(docs.column("doc").to_pylist(), docs.column("dup").to_pylist(), docs.column("text")):
        raw, own = value.as_py() or b"", of.get((i, d), [])
        parts, at = [], 0
        for a, b in own:
            parts.append(raw[at:a])
            at = b
        starts.append([a for a, _ in own])
        ends.append([b for _, b in own])
        kept.append(b"".join([*parts, raw[at:]]))
    return pa.table([docs.column("doc_id"), pa.array([len(k) for k in kept], pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_kept", "starts", "ends", "kept"])


def _frequent(rows: DataFrame, n: int, length: int) -> np.ndarray:
    """Hashes of anchors with HOT_COUNT occurrences or more in a sample.

    The sample grows with the corpus, so that an anchor with more than some
    hundred thousand occurrences is found at any size; HOT_MOST of them come
    to the driver at most. Which ones are found has no influence on the result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, starts, ids, _ in _texts(b):
                doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(starts))
                h, count = np.unique(anchors(x, doc, length)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count)], names=["h", "n"])

    sample = rows.where(F.pmod(F.xxhash64("doc", "dup"), F.lit(max(1, n // max(HOT_DOCS, n // HOT_SHARE)))) == 0)
    found = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "h").limit(HOT_MOST).select("h").collect()
    return np.array([r["h"] for r in found], np.int64).view(np.uint64)


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return max(2, n)


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents -> doc_id, n_bytes, spans, kept.

    spans are the maximal removed runs as (start, end) in bytes, kept is the
    text's remaining bytes. Texts are whole UTF-8, a null one is empty, and
    strings never cross documents. Earlier means a smaller doc_id (null the
    least), or an earlier start; rows with the same doc_id are documents of
    their own, in the order of their texts. A long text is gone through in
    parts and taken whole. An empty table gives no rows; other columns are not
    read.
    """
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("doc"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    repeated = source.groupBy("doc").count().where("count > 1").limit(1).count()
    if repeated:
        source = source.withColumn("dup", F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1)
        source = materialize(source, "rows")
    else:
        source = source.withColumn("dup", F.lit(0))
    n, size = source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    buckets = _prime(max(8, size // BUCKET_BYTES))
    rows = source.select("doc", "dup", "text")
    hot = _frequent(rows, n, length)
    packed = rows.mapInArrow(scan(length, buckets, hot), PACKED)
    first = materialize(packed.groupBy("key").applyInArrow(gather(length, buckets), PACKED), "anchors")
    by_bucket = source.withColumn("key", F.pmod("doc", F.lit(buckets)))
    edges = by_bucket.groupBy("key").cogroup(first.where("kind = 3").groupBy("key")).applyInArrow(surroundings(length), EDGES)
    more = edges.repartition("h").sortWithinPartitions("h").mapInArrow(maximal(length, buckets), PACKED)
    spans = first.where("kind = 1").unionByName(more)
    done = by_bucket.groupBy("key").cogroup(spans.groupBy("key")).applyInArrow(cut, "doc_id long, n_kept long, starts array<long>, ends array<long>, kept binary")
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda t, x: t + x)
    return done.select("doc_id", (F.col("n_kept") + removed).alias("n_bytes"), F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("start"), b.alias("end"))).alias("spans"), "kept")


def digests(removed: DataFrame) -> DataFrame:
    """remove() -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
