"""Removal of repeats against brute force over every string."""

import hashlib
import random

import numpy as np
import pytest

from loomtide.llm import repeats


def brute(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, (rows[i][1] or "").encode()))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((rows[i][0], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [prose(r.randint(15, 60)) for _ in range(12)]
    rows = []
    for i in range(220):
        t = prose(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            k = r.randint(0, len(p) // 2)
            t += prose(r.randint(0, 8)) + p[k : k + r.randint(20, 400)]
        rows.append((i * 3, t))
    rows += [(1000 + i, rows[i][1]) for i in range(25)] + [(2000 + i, rows[i][1][: 200 + i] + "X" + rows[i][1][200 + i :]) for i in range(40)]
    rows += [(5, "a" * 700), (4001, "b" + "a" * 333 + "c"), (4002, "ab" * 300), (4003, None), (4004, ""), (4005, "x" * 99), (4006, "x" * 100), (4007, "x" * 101), (None, rows[7][1])]
    rows += [(7, rows[9][1]), (7, rows[9][1]), (7, None), (4008, "\0" * 250), (4009, "k\0" + "\0" * 150)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [150, 997, 1 << 20])
def test_parts_of_a_long_text_change_nothing(monkeypatch, part):
    x = np.frombuffer(" ".join(t or "" for _, t in corpus(4))[:30_000].encode() + b"a" * 3000, np.uint8)
    doc = np.repeat(np.arange(40, dtype=np.int32), -(-len(x) // 40))[: len(x)]
    want = repeats.anchors(x, doc, 100)
    monkeypatch.setattr(repeats, "CHUNK", part)
    assert all(np.array_equal(a, b) for a, b in zip(want, repeats.anchors(x, doc, 100)))


@pytest.mark.parametrize("seed,hot", [(1, 40), (2, 10**9), (3, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT_COUNT", hot)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, key int").repartition(5)
    got = sorted((tuple(r) for r in repeats.digests(repeats.remove(docs, 100)).collect()), key=str)
    assert got == brute(rows, 100)


@pytest.mark.parametrize("hot", [40, 2])
def test_edits_a_word_apart(spark, monkeypatch, hot):
    """Two changed bytes, 8, 16 or 24 apart, in copies of which there are many."""
    monkeypatch.setattr(repeats, "HOT_COUNT", hot)
    r = random.Random(7)
    base = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(300))
    rows = [(0, base)]
    for i in range(1, 240):
        own, at = list(base), r.randrange(60, 200)
        for p in (at, at + (8, 16, 24)[i % 3]):
            own[p] = chr(r.randrange(33, 126))
        rows.append((i, "".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((tuple(x) for x in repeats.digests(repeats.remove(docs, 100)).collect()), key=str) == brute(rows, 100)


def test_hashes_of_edits_differ():
    """Grams that differ in the top bytes of two words."""
    r = np.random.default_rng(5)
    gram = r.integers(33, 126, repeats.GRAM, np.uint8)
    rows = np.repeat(gram[None], 8464, 0)
    a, b = np.meshgrid(np.arange(33, 125), np.arange(33, 125))
    rows[:, 7], rows[:, 15] = a.ravel(), b.ravel()
    hashes = {int(repeats._gram_hashes(x)[0]) for x in rows}
    assert len(hashes) == len({x.tobytes() for x in rows})


def test_very_long_texts(spark):
    r = random.Random(4)
    part = "".join(r.choice("abcdefgh ") for _ in range(150_000))
    rows = [(1, part + part[:70_000]), (2, "z" * 130_000), (3, part[50_000:51_000] + "z" * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in repeats.digests(repeats.remove(docs, 100)).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [70_000, 130_000 - 100 + 1 + 98, 1000] and [got[i]["n_spans"] for i in (1, 2, 3)] == [1, 1, 1]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.digests(repeats.remove(docs)).collect() == []


def test_interval_tree():
    # suffixes a, ab, abc, b: common prefixes 1, 2, 0
    assert sorted(repeats.intervals([0, 1, 2, 0])) == [(0, 0, 3), (1, 0, 2), (2, 1, 2)]
    assert repeats.left_extensions([(b"ab", 0x6162, 2), (b"ac", 0x6163, 2), (b"ab", 0x6162, 2)]) == [-1, 1, 2]
