"""The pipeline's near-duplicates: no link between texts that collide is lost."""

import random

import duckdb
import numpy as np
import pytest

from loomtide.llm import simhash


def text(lo, n=40):
    return " ".join(f"w{i}" for i in range(lo, lo + n))


def sets_of(rows):
    return [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for _, t in rows]


def brute(rows, similarity=0.8):
    """doc_ids that stay: the least of each group over all pairs."""
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        met = {}
        for x in s or {None}:
            for j in where.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            where[x].append(i)
        for j, n in met.items():
            if n >= similarity * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, (d is not None, d or 0)), (d is not None, d or 0))
    return sorted(str(d if some else None) for some, d in least.values())


def stay(spark, rows, parts=4):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, cls string, root int").repartition(parts)
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    return sorted(str(r["doc_id"]) for r in out.select("doc_id").collect())


def near_copies(r, n, words=60):
    """Copies of one text with more and more edits, so that many are linked through others only."""
    base = [f"b{i}" for i in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        own = list(base)
        for _ in range(r.choice([0, 1, 1, 1, 2, 3])):
            own[r.randrange(words)] = f"x{r.randrange(4)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("chunk,full", [(256, 16384), (2, 16384), (256, 3)])
def test_links_through_any_member_of_a_group(spark, monkeypatch, chunk, full):
    """All collide; y is close to w and x, but the closest to x is one of another text."""
    rows = [(1, text(0), 1), (2, text(6), 0b111), (3, text(3), 0), (4, text(900), 0b110), (5, text(500), 0b1100), (6, text(700), 0b1001)]
    words = {t: word for _, t, word in rows}
    w, y, x = sets_of([(0, text(0)), (0, text(3)), (0, text(6))])
    assert len(w & y) >= 0.8 * len(w | y) and len(x & y) >= 0.8 * len(x | y) and len(w & x) < 0.8 * len(w | x)
    codes = simhash._codes
    monkeypatch.setattr(simhash, "_codes", lambda t, k: [codes(t, k)[0], 0, words[t.decode()] << 52, codes(t, k)[3]])
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "FULL", full)
    assert stay(spark, [(i, t) for i, t, _ in rows]) == ["1", "4", "5", "6"]


@pytest.mark.parametrize("block,full", [(1 << 20, 16384), (4000, 16384), (1 << 20, 100)])
def test_a_large_group_of_near_copies(spark, monkeypatch, block, full):
    """Over a thousand in a bucket; in blocks, whatever their number, the result is the same."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(simhash, "FULL", full)
    r = random.Random(9)
    rows = near_copies(r, 1400) + [(5000 + i, text(10_000 + 100 * i, 30)) for i in range(50)]
    want, got = brute(rows), stay(spark, rows)
    lost = len(got) - len(want)
    assert set(want) <= set(got) and lost <= 0.02 * (len(rows) - len(want))


def test_few_links_are_told_of_a_large_bucket(spark):
    rows = near_copies(random.Random(3), 900)
    codes = [simhash._codes(t.encode(), 5) for t in {t for _, t in rows}]
    table = spark.createDataFrame([(i, *c[1:]) for i, c in enumerate(codes)], "id long, low long, high long, n long")
    found = simhash._met(table, 0.8, simhash.FULL)
    assert found.distinct().count() == found.count() < 20 * len(codes)


def test_odd_rows(spark):
    rows = [(None, "same words in a row here"), (3, "same words in a row here"), (4, None), (5, ""), (6, " \t"), (7, "one"), (7, "one"), (7, "two"), (8, "one"), (9, "w " * 200_000), (10, "w " * 150_000), (11, "long " + " ".join(f"l{i}" for i in range(60_000)))]
    assert stay(spark, rows) == brute(rows) == ["11", "4", "7", "7", "9", "None"]
    assert stay(spark, rows[:0]) == []


def test_recall_on_the_documents(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf.replace('0.001', '0.01')}/documents.parquet'").fetchall()
    want, got = brute(rows), stay(spark, rows)
    gone = len(rows) - len(want)
    assert set(want) <= set(got) and gone > 50 and len(rows) - len(got) >= 0.99 * gone


def test_sets_are_joined_by_their_similarity():
    r = np.random.default_rng(2)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(100) < 0.93], r.integers(1000, 9999, 4).astype(np.uint64)])) for _ in range(120)]
    links = simhash._similar(sets, 0.8)
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    assert all(alike(sets[i], sets[j]) for i, j in links) and len(links) < len(sets)
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in links:
        root[find(j)] = find(i)
    assert all(find(i) == find(j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j]))
