"""The operators against brute force, on fixtures with every odd case."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtide.llm import ann, chat, common, digest, langid, mixing, packing, secrets, simhash

R = random.Random(5)
WORDS = ["".join(R.choice(string.ascii_lowercase) for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    """Rows (doc_id, text) beside columns that clash with the operators' own."""
    full = [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), "x", 1, "y") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp string, length int, spans string").repartition(4)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "null id"), (7, "é" * 50_000), (8, "naïve Ünïcode テキスト"), (9, "word " * 20_000)]


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash_components(spark, bucket):
    rows = list(ODD)
    for i in range(25):
        base = prose(120).split()
        rows.append((100 + 40 * i, " ".join(base)))
        for j in range(R.randint(0, 12)):
            near = list(base)
            near[R.randrange(120)] = R.choice(WORDS)
            rows.append((101 + 40 * i + j, " ".join(near)))
    got = simhash.near_duplicates(docs_of(spark, rows), bucket=bucket).collect()

    def fingerprint(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
        shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    own = [(i, fingerprint(t)) for i, t in rows]
    fps = {f for _, f in own}
    linked = groups([(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4], fps)
    least = {}
    for i, f in own:
        if i is not None:
            least[linked[f]] = min(least.get(linked[f], i), i)
    want = sorted((str(i), f"{f:016x}", str(least.get(linked[f]))) for i, f in own)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert len(set(linked.values())) < len(fps)


def test_masks_cover_every_pair_within_the_radius():
    for bits, radius in ((64, 4), (40, 4), (16, 2)):
        tables = simhash.masks(radius, bits)
        for _ in range(3000):
            d = sum(1 << b for b in R.sample(range(bits), radius))
            assert any(not m & d for m in tables)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5)] + [(200, 200 + i) for i in range(1, 40)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == groups(edges, {n for e in edges for n in e if e[0] != e[1]})


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = list(ODD)
    for i in range(20):
        base = prose(200).split()
        rows.append((1000 * (i + 1), " ".join(base)))
        for j in range(6):
            near = list(base)
            for _ in range(R.randint(1, 2)):
                near[R.randrange(200)] = R.choice(WORDS)
            rows.append((1000 * (i + 1) + j + 1, " ".join(near)))
    docs = docs_of(spark, rows)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect())
    sets = {}
    for i, t in rows:
        sets.setdefault(str(i), set(simhash.shingle_hashes((t or "").encode(), 5).tolist()))
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert not [(a, b) for a in ids for b in ids if a < b and alike(a, b)]
    assert all(str(1000 * (i + 1)) in ids for i in range(20)) and "4" in ids and "5" not in ids and "None" in ids


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    hidden = langid.identify(docs.withColumn("lang", F.when(langid.held_out(), None).otherwise(F.col("lang"))).withColumn("source", F.lit(None)))
    assert sorted(map(tuple, hidden.collect())) == sorted(map(tuple, langid.identify(docs).collect()))
    odd = docs_of(spark, [*ODD, (20, "123 !?"), (21, "et la que les"), *((30 + k, prose(30)) for k in range(30))])
    got = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert {got[i]["lang_pred"] for i in (1, 2, 3, 20)} == {"und"} and got[21]["lang_pred"] == "en"
    assert all(r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0) for i, r in got.items())
    assert langid.identify(odd.where("false")).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.label(docs)
    assert kept.columns == docs.columns and kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


@pytest.mark.parametrize("block,warm", [(256, 48), (16, 3), (5, 1)])
def test_phrases_are_greedy_longest_matches(monkeypatch, block, warm):
    """Exactly, symbols that a language or no language saw included, over any blocks."""
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "WARM", warm)
    learned = {"a": prose(60), "b": "zyx é " + prose(50), "c": "日本語 テキスト " * 4}
    parser = langid.Parser(tuple(sorted(learned.items())))
    texts = [prose(40), "qqqq éé " + prose(5), "z", "the é the é the", "日本 x " * 30, prose(300), "ж", " ".join(learned["b"].split()[5:30])]
    symbols = [langid._symbols(t) for t in texts]
    got = parser.phrases(np.concatenate(symbols), np.cumsum([len(x) for x in symbols]))
    for k, lang in enumerate(parser.langs):
        known = "".join(map(chr, langid._symbols(learned[lang])))
        for j, x in enumerate(symbols):
            t, count, at = "".join(map(chr, x)), 0, 0
            while at < len(t):
                n = 1
                while at + n < len(t) and t[at : at + n + 1] in known:
                    n += 1
                count, at = count + 1, at + n
            assert got[k][j] == count


def test_languages_of_many_symbols_need_little_memory():
    """Thousands of symbols, as Chinese has, don't multiply the states."""
    r = random.Random(8)
    text = "".join(chr(0x4E00 + r.randrange(4000)) for _ in range(15_000))
    table = langid.Parser((("zh", text),)).tables[0]
    assert table.places.nbytes < 2_000_000


def test_clashing_columns_change_no_prediction(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.withColumn("n_chars", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("score", F.lit("x")).withColumn("at", F.lit(1)).withColumn("rank", F.lit(2))
    assert sorted(map(tuple, langid.identify(odd).collect())) == sorted(map(tuple, langid.identify(docs.drop("n_chars")).collect()))
    few = langid.sample(docs, sample_docs=3, sample_chars=40)
    assert all(len(t) <= 3 * (40 + langid.PIECES) for t in few.values())


def pack_args():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_packing_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(docs_of(spark, ODD).select("doc_id", "text"))
    docs = docs.withColumn("piece", F.lit(9)).withColumn("salt", F.lit("x"))
    out = packing.pack(docs, *pack_args()).collect()
    slow = Tokenizer.from_file(pack_args()[0])
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(places) <= -(-total // 2048) + 2
    made = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    want = []
    for i, text in docs.select("doc_id", "text").collect():
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, len(ids)] if len(ids) <= 2048 else sorted({0, *range(len(ids) % 2048, len(ids) + 1, 2048)})
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert made == sorted(want)
    assert packing.pack(docs.where("false"), *pack_args()).count() == 0


def test_fast_ids_equal_the_tokenizers():
    fast, slow = packing._encoder(*pack_args()), Tokenizer.from_file(pack_args()[0])
    for text in ("", " ", "a\n\n b  c\t", "don't  STOP '123'", "<|endoftext|> x<|endoftext|>", "日本語 émigré 🙂‍", "x" * 5000, "\0\r\n\x85  end ", prose(300)):
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_long_runs(spark):
    """A million spaces, tabs, newlines or letters have ids too."""
    runs = [" " * 1_000_000, "\t" * 1_000_000, "\n" * 1_000_000, "a " + "\u3000" * 300_000 + " b", " \n" * 300_000, "x" * 200_000, "7" * 100_000, "!" * 200_000, "é" * 100_000]
    slow = Tokenizer.from_file(pack_args()[0])
    got = {}
    for r in packing.pack(docs_of(spark, list(enumerate(runs))), *pack_args()).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(runs)}


def test_best_two_fit_plan():
    # Greedy takes 7 and 2; the gap of 1 is better filled by 1 and 2 in the place of the 2.
    assert packing.plan({7: 1, 2: 2, 1: 1}, 10)[0] == (1, {7: 1, 2: 1, 1: 1})
    # 6 + 3 leaves 1; 2 + 2 in the place of the 3 fill the bin.
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [(1, {6: 1, 2: 2}), (1, {3: 1})]
    for _ in range(50):
        counts = {R.randint(1, 64): R.randint(1, 10**6) for _ in range(20)}
        plan = packing.plan(counts, 64)
        assert {k: sum(t * use.get(k, 0) for t, use in plan) for k in counts} == counts
        assert all(sum(k * v for k, v in use.items()) <= 64 for _, use in plan)
        assert len(plan) < sum(64 // k + 1 for k in range(1, 65))


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(digest, "BUCKET_DOCS", 7)
    rows = [*ODD, *((100 + 3 * k, prose(R.randint(1, 900))) for k in range(60)), (400, "a" * 900), (401, "b" * 30)]
    rows.append((500, rows[20][1]))
    got = digest.fingerprint(docs_of(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in order]
    want = []
    for k, (i, _) in enumerate(order):
        t, after = texts[k], texts[(k + 1) % len(order)]
        n = len(t) // 4
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    by = {r["doc_id"]: r for r in got}
    assert by[rows[20][0]]["fingerprint"] == by[500]["fingerprint"]
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    long = [r for r in got if r["n_chars"] > 2000 and r["doc_id"] and r["doc_id"] >= 100]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 and np.mean([r["near_next"] for r in long]) < 0.1
    assert by[4]["near_next"] == 1.0 and by[1]["near_next"] == 1.0 and by[1]["fingerprint"] == ""
    assert digest.fingerprint(docs_of(spark, ODD).where("false")).count() == 0


def test_entropy_levels_by_counting():
    x = np.frombuffer(prose(200).encode() + b"\0" * 80, np.uint8)
    levels = digest.entropy_levels(x)
    for i in range(0, len(levels), 13):
        counts = np.unique(x[i : i + 64], return_counts=True)[1]
        assert levels[i] == (digest._TOP - int(digest._F[counts].sum())) * (digest.LEVELS - 1) // digest._TOP


def brute_features(text, ranks):
    """Every stretch of windows, clipped at the ends of the text, looked at one by one."""
    raw = text.ljust(64, b"\0") if text else b""
    n = len(raw) - 63
    if n <= 0:
        return []
    level = [int((digest._TOP - int(digest._F[np.unique(np.frombuffer(raw[i : i + 64], np.uint8), return_counts=True)[1]].sum())) * (digest.LEVELS - 1) // digest._TOP) for i in range(n)]
    points = [0] * n
    for a in range(-63, n):
        points[min(range(max(0, a), min(n, a + 64)), key=lambda i: (ranks[level[i]], i))] += 1
    return [raw[i : i + 64] for i in range(n) if points[i] >= digest.POPULAR]


def brute_likeness(a, b):
    """Filters as sets of bits, one pair after the other."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    chains = []
    for hashes in (a, b):
        chains.append([(len(part), {int(h) >> 11 * k & 2047 for h in part for k in range(5)}) for part in (hashes[i : i + 160] for i in range(0, len(hashes), 160))])
    a, b = sorted(chains, key=len)

    def score(x, y):
        n, m, stay = x[0] * 5, y[0] * 5, 1 - 1 / 2048
        chance, most, both = 2048 * (1 - stay**n - stay**m + stay ** (n + m)), min(len(x[1]), len(y[1])), len(x[1] & y[1])
        floor = chance + 0.3 * (most - chance)
        return min(1.0, max(0.0, (both - floor) / (most - floor))) if most > floor else float(both == most)

    def mean(xs, ys):
        return sum(x[0] * max(score(x, y) for y in ys) for x in xs) / sum(x[0] for x in xs)

    return mean(a, b) if len(a) < len(b) else max(mean(a, b), mean(b, a))


def test_features_and_likeness_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(digest, "PAIRS", 3)
    texts = ["", "a", "one two", "x" * 63, "y" * 64, "z" * 300, prose(12), prose(25), prose(40), prose(90), "b" * 500 + prose(20), prose(400)]
    texts += [texts[9][:300] + texts[8], texts[11][500:] + prose(60)]
    raw = [t.encode() for t in texts]
    ranks = digest.rarity(digest.level_counts(raw))
    hashes = lambda own: [int(h) for h in digest._hash_rows(np.frombuffer(b"".join(own), np.uint8).reshape(-1, 64))] if own else []
    want = [hashes(brute_features(t, ranks)) for t in raw]
    assert [[int(h) for h in f] for f in digest.features(raw, ranks)] == want and all(want[1:])
    filters = [digest.Filters(f) for f in digest.features(raw, ranks)]
    for i, f in enumerate(filters):
        for j, g in enumerate(filters):
            assert digest.likeness(f, g) == pytest.approx(brute_likeness(want[i], want[j]), abs=1e-9)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in digest.fingerprint(docs_of(spark, rows)).collect()}
    for i, t in rows:
        after = texts[(i + 1) % len(texts)]
        n = len(t) // 4
        edited = (t[: len(t) - n] + after[:n]).encode()
        own, other, nxt = (hashes(brute_features(x, ranks)) for x in (t.encode(), edited, after.encode()))
        assert got[i]["near_edited"] == pytest.approx(brute_likeness(own, other)) and got[i]["near_next"] == pytest.approx(brute_likeness(own, nxt))
        assert got[i]["fingerprint"] == str(digest.Filters(np.array(own, np.uint64))) and got[i]["edited_fingerprint"] == str(digest.Filters(np.array(other, np.uint64)))


def test_neighbours_of_many_rows_without_an_id(spark, monkeypatch):
    """They are in several buckets, and each row still follows the one before."""
    monkeypatch.setattr(digest, "BUCKET_DOCS", 5)
    monkeypatch.setattr(digest, "PER_BUCKET", 1)
    rows = [(None if i % 3 else i, f"{i % 40} " + prose(3 + i % 5)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = [r["text"] for r in docs.select("text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("p"), F.xxhash64("text").alias("t")).orderBy("p", "t").collect()]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 4] + order[(k + 1) % 90][: len(t) // 4]).encode()).hexdigest() for k, t in enumerate(order))
    assert sorted(r["edited_sha256"] for r in digest.fingerprint(docs).collect()) == want
    assert digest._in_order(docs).select("bucket").distinct().count() > 10


@pytest.mark.parametrize("part", [100, 777])
def test_parts_of_a_long_text_give_the_same_features(monkeypatch, part):
    texts = [prose(k).encode() for k in (900, 3, 40, 700)] + [b"", b"x" * 3000]
    ranks = digest.rarity(digest.level_counts(texts))
    want = digest.features(texts, ranks)
    levels = digest.entropy_levels(np.frombuffer(texts[0], np.uint8))
    monkeypatch.setattr(digest, "CHUNK", part)
    assert np.array_equal(levels, digest.entropy_levels(np.frombuffer(texts[0], np.uint8)))
    assert all(np.array_equal(a, b) for a, b in zip(want, digest.features(texts, ranks)))


def random_token(alphabet, n):
    return "".join(R.choice(alphabet) for _ in range(n))


def test_secret_spans(spark):
    b64 = string.ascii_letters + string.digits + "+/"
    planted = {k: random_token(b64, 40) + "7aZ" for k in range(20)}
    rows = [*ODD, (30, 'Password = "hunter22" and API_KEY:abc pwd'), (31, "token='short' secret=x SECRET: abcdef" + "AKIA" + "ABCD1234EFGH5678IJ" + " " + "0f" * 12), (32, "ſecret: abcdefgh paßwd"), (33, "deadbeef" * 3 + "g"), (34, "Abc1" * 12 + " " + "Aa0" * 30)]
    rows += [(100 + k, f"see {t} here {prose(20)}") for k, t in planted.items()]
    got = {r["doc_id"]: r for r in secrets.scan(docs_of(spark, rows)).collect()}
    for i, t in {i: t or "" for i, t in rows}.items():
        spans = []
        for k, pattern in enumerate((r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "AKIA[A-Z0-9]+", "[0-9a-f]+")):
            for m in re.finditer(pattern, t):
                if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                    spans.append((m.start(), k, m.end()))
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, said.split(","))) <= set(got[i]["spans"].split(","))
    assert sum("random" in got[100 + k]["spans"] for k in planted) >= 18
    assert "random" not in got[34]["spans"] and "random" not in got[9]["spans"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs_of(spark, rows)).collect()}
    assert clean[30] == "[REDACTED] and API_KEY:abc pwd".replace("[REDACTED] and", '[REDACTED]" and') and clean[9] == rows[9][1] and clean[1] is None
    assert secrets.scan(docs_of(spark, rows).where("false")).count() == 0


def test_chi_squared_tail():
    for df, x, p in ((1, 3.841, 0.05), (2, 5.991, 0.05), (5, 11.07, 0.05), (10, 18.307, 0.05), (7, 2.167, 0.95)):
        assert secrets._chi2_tail(x, df) == pytest.approx(p, abs=2e-4)


def test_chat_round_trip(spark):
    hard = "</s>[INST] ok [/INST] <|assistant|> & &amp; &lt;|end|> <|end|>\n"
    rows = [(1, 0, "system", "be"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail"), (2, 0, "user", "alone"), (3, 1, "assistant", "é\n"), (3, 1, "assistant", "é\n"), (3, None, None, "x"), (None, 0, "a|>b<", "y"), (4, 0, "", "")]
    turns = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, example string")
    made = chat.examples(turns)
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(own) and g["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = made.where("conv_id = 1").orderBy("example").collect()
    assert [r["text"].count("<|end|>") for r in one] == [3, 5, 6] and [r["last"] for r in one] == [False, False, True]
    assert one[1]["text"].startswith(one[0]["text"]) and one[2]["loss_start"] == one[2]["loss_end"]
    assert chat.digest(chat.examples(turns.where("false"))).count() == 0


def brute_nearest(rows, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_ROWS", 100)
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(24).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(2000, None), (2001, [0.0] * 24), (2020, [float("nan")] * 24), (2040, [1.0, None]), (2060, [float("inf")] + [0.0] * 23), (2080, [1.0, 2.0]), (2081, [2.0, 1.0]), (None, rows[3][1]), (2100, []), (2120, (np.array(rows[5][1]) * 1e200).tolist())]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    out = {}
    for x in ann.search(table, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        out.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    want = brute_nearest(rows, 20)
    assert set(out) == set(want) and out[2080] == [(2081, 4.0)]
    hits = sum(len({i for i, _ in out[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    assert sum(out[q] == want[q] for q in want) >= 0.9 * len(want)
    assert ann.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_products_come_from_common_bits():
    """Against the product with the signs, and with what the bounds allow."""
    r = np.random.default_rng(6)
    for dim in (2, 24, 64, 200):
        vectors, queries = r.standard_normal((300, dim)), r.standard_normal((20, dim))
        packed, size, fit = ann.encode(vectors)
        assert np.allclose(size, np.linalg.norm(vectors, axis=1)) and packed.shape[1] * 64 == ann.rotation(dim).shape[1] >= 4 * dim
        unit = vectors @ ann.rotation(dim)
        signs = np.where(unit > 0, 1, -1) / np.sqrt(unit.shape[1])
        bad = 0
        for q in queries / np.linalg.norm(queries, axis=1)[:, None]:
            turned = q @ ann.rotation(dim)
            got = ann.products(np.ascontiguousarray(packed.T), np.bitwise_count(packed).sum(1, dtype=np.int64), turned)
            assert np.abs(got - signs @ turned).max() < 4 * (turned.max() - turned.min()) / 15
            slack = ann.EPSILON * size / fit * np.sqrt((1 - fit**2) / (unit.shape[1] - 1))
            bad += int((np.abs(got * size / fit - vectors @ q) > slack * 1.25).sum())
        assert bad <= 20


def test_recall_on_the_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute_nearest([(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table.collect()], 20)
    got = {}
    for x in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.99 * sum(map(len, want.values()))


def test_mixing(spark):
    rows = [(k, prose(10 + k % 5)) for k in range(400)] + ODD
    full = docs_of(spark, rows).withColumn("source", F.when(F.col("doc_id") % 10 == 0, "small").when(F.col("doc_id") % 10 == 1, None).otherwise("large")).withColumn("block", F.lit("x"))
    sizes = {r["s"]: r["n"] for r in full.groupBy(F.coalesce("source", F.lit("?")).alias("s")).agg(F.sum(mixing.n_tokens(F.col("text"))).alias("n")).collect()}
    out = mixing.mix(full, max_repeat=3.0)
    assert set(out.columns) == set(full.columns) | {"n_tokens", "order_key"}
    got = {r["s"]: (r["n"], r["most"]) for r in out.groupBy(F.coalesce("source", F.lit("?")).alias("s")).agg(F.sum("n_tokens").alias("n"), F.max("block").alias("most")).collect()}
    passes = {s: got[s][0] / sizes[s] for s in sizes}
    assert min(passes.values()) == pytest.approx(1.0, abs=0.05) and max(passes.values()) == pytest.approx(3.0, abs=0.35)
    assert out.where("block = 0").count() == full.count()
    even = mixing.mix(full, target_entropy=1.5, budget=6000)
    n = [r["n"] for r in even.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()]
    p = np.array(n) / sum(n)
    assert -(p * np.log2(p)).sum() == pytest.approx(1.5, abs=0.06) and sum(n) <= 6000
    assert mixing.mix(full.where("false"), max_repeat=2.0).count() == 0
    assert mixing.mix(full.where("text is null"), max_repeat=2.0).count() == 1
    with pytest.raises(ValueError):
        mixing.mix(full)


def test_cells_are_parted_until_they_are_small(spark, monkeypatch):
    rows = [(k, prose(5 + k % 7)) for k in range(300)] + [(7, prose(9))] * 3 + ODD
    docs = docs_of(spark, rows).withColumn("source", F.when(F.col("doc_id") % 10 == 0, "small").when(F.col("doc_id") % 10 == 1, None).otherwise("large"))

    def drawn():
        return sorted(map(repr, mixing.mix(docs, max_repeat=2.5).select("doc_id", "source", "block", "n_tokens", "order_key").collect()))

    whole = drawn()
    monkeypatch.setattr(mixing, "CELL_DIGITS", 1)
    monkeypatch.setattr(mixing, "CELL_ROWS", 1)
    assert drawn() == whole
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert drawn() == whole


def test_exponent_is_bisected(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "p double")
    a = mixing.exponent(shares, max_repeat=3.5)
    assert 7 ** (1 - a) == pytest.approx(3.5, rel=1e-9)
    a = mixing.exponent(shares, target_entropy=1.4)
    w = np.array([0.7, 0.2, 0.1]) ** a
    w /= w.sum()
    assert -(w * np.log2(w)).sum() == pytest.approx(1.4, rel=1e-9)
    assert mixing.exponent(shares, max_repeat=8) == 0.0 and mixing.exponent(shares, target_entropy=0.5) == 1.0


def test_intermediate_tables_can_be_cleaned(spark):
    kept = common.materialize(spark.range(5), "test")
    folder = spark._jvm.org.apache.hadoop.fs.Path(kept._loomtide_path).getParent()
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    assert kept.count() == 5 and fs.exists(folder)
    common.clean(spark)
    assert not fs.exists(folder)
