"""Random runs of every length and alphabet are reported, wherever they stand."""

import random
import re
import string

import numpy as np
import pytest

from loomtide.llm import secrets

B64 = string.ascii_letters + string.digits + "+/"


def token(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    return [[(texts[i][int(a) : int(b)]) for k, a, b in (s.split(":") for s in out[i].split(",") if s) if k == "random"] for i in range(len(texts))]


def test_long_random_runs_are_reported(spark):
    """Among many paths and identifiers, which are not random."""
    r = random.Random(3)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(6)) for _ in range(50)]
    paths = ["/".join(r.choice(words).title() + str(r.randrange(9)) for _ in range(r.choice([8, 20, 90]))) for _ in range(1000)]
    keys = [token(r, B64, n) for n in (64, 100, 200, 450, 1000, 2000, 5000) for _ in range(20)]
    got = found(spark, paths + keys)
    assert sum(map(bool, got[:1000])) <= 7
    for lo in range(1000, 1140, 20):
        assert sum(g == [k] for g, k in zip(got[lo : lo + 20], keys[lo - 1000 :])) >= 15


@pytest.mark.parametrize("alphabet", [string.ascii_lowercase + string.digits, string.ascii_lowercase + "234567", string.ascii_uppercase + string.digits, string.ascii_letters, string.ascii_lowercase])
def test_alphabets(alphabet):
    r = random.Random(4)
    p = [secrets.candidates(token(r, alphabet, n), []) for n in (24, 40, 100) for _ in range(50)]
    assert all(len(x) == 1 for x in p) and sum(x[0][2] > 0.05 for x in p) >= 135


def test_words_are_not_random():
    for word in ("internationalization", "counterrevolutionaries", "AbstractSingletonProxyFactoryBean", "rechtsschutzversicherungsgesellschaften"):
        assert all(p < 0.05 for _, _, p in secrets.candidates(word, [])), word


def test_parts_of_runs():
    r = random.Random(5)
    key, low = token(r, B64, 38) + "7a", token(r, string.ascii_lowercase + string.digits, 32) + "z9"
    hexes = token(r, "0123456789abcdef", 24)
    for text, want in (
        (f"AWS_SECRET_ACCESS_KEY={key}", [key]), (f"sig={key}==", [f"{key}=="]), (f"a={key}=b={key}", [key, key]),
        (f"sk_live_{low}", [low]), (f"{hexes}_{key}", [f"_{key}"]), (f"{key}/{hexes}", [f"{key}/"]), (f"{key}={hexes}", [f"{key}="]),
    ):
        raw = text.encode()
        said = [text[a:e] for a, e, _ in secrets.candidates(text, secrets.base_spans(text, raw))]
        assert said == want, text


NAMES = "get set user account by id handler factory bean service config main activity view model http request response error index list item value parse string buffer stream reader writer test case data base table column row key map tree node edge path file name type class method field proxy cache queue event listener manager builder context session token state".split()


def identifier(r):
    style, words = r.randrange(4), [r.choice(NAMES) for _ in range(r.randint(4, 9))]
    if style == 0:
        return "".join(w.title() for w in words) + str(r.randrange(3000))
    if style == 1:
        return "/".join(words[:2]) + "/App" + str(r.randrange(9)) + "/" + "".join(w.title() for w in words[2:])
    if style == 2:
        return "_".join(w.title() if r.random() < 0.5 else w for w in words) + str(r.randrange(99))
    return "".join(words) + str(r.randrange(100))


def test_p_values_of_random_runs_are_spread_evenly():
    r = random.Random(12)
    for kind, alphabet in (("base62", string.ascii_letters + string.digits), ("base64", B64), ("base36", string.ascii_lowercase + string.digits)):
        p = [secrets.p_value(token(r, alphabet, r.randint(20, 60)), kind) for _ in range(1500)]
        for t in (0.05, 0.25, 0.5, 0.8):
            assert abs(sum(x > t for x in p) / len(p) - (1 - t)) < 0.08, (kind, t)


@pytest.mark.parametrize("n", [0, 60, 600])
def test_few_of_the_reported_runs_are_names(spark, n):
    """Whatever their share, and with no secret at all."""
    r = random.Random(13)
    names = list({identifier(r) for _ in range(2500)})
    keys = [token(r, string.ascii_letters + string.digits, r.randint(20, 44)) for _ in range(n)]
    got = found(spark, names + keys)
    false, true = sum(map(bool, got[: len(names)])), sum(map(bool, got[len(names) :]))
    assert true >= 0.7 * n and false <= 5 + 0.07 * (true + false)


def test_names_that_were_taken_for_keys(spark):
    for name in ("GetUserAccountById2024Handler", "com/example/App2/MainActivityView"):
        assert secrets.p_value(name, secrets.encoding(name)) < 0.01
    key = token(random.Random(1), string.ascii_letters + string.digits, 40)
    assert found(spark, ["GetUserAccountById2024Handler x com/example/App2/MainActivityView", f"a {key} b"]) == [[], [key]]


def test_cut():
    even = np.round(np.diff(secrets.reference()) * 100_000).astype(np.int64)
    assert secrets.cut(even) == secrets.LAST and secrets.cut(even * 0) == secrets.LAST
    crowded = even.copy()
    crowded[10:60] += 40_000
    assert 4 <= secrets.cut(crowded) <= 11


def test_added_spans_are_those_of_the_tests(spark):
    """Against every run, its parts and their p-values worked out one by one."""
    r = random.Random(21)
    texts = [" ".join(r.choice([identifier(r), token(r, B64, r.randint(15, 60)), "word", token(r, string.ascii_lowercase + string.digits, 30)]) for _ in range(12)) for _ in range(60)]
    cells, told = np.zeros((secrets.CLASSES, secrets.CELLS), np.int64), set()
    every = []
    for i, t in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            base = [(a.start(), a.end()) for p in (r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}") for a in re.finditer(p, t)]
            assert not any(a < m.end() and e > m.start() for a, e in base)
            for part in re.finditer(r"[^=]+(?:=+$)?", m[0]):
                if len(part[0]) < 20:
                    continue
                own = [part] if secrets.encoding(part[0]) else list(re.finditer(r"[A-Za-z0-9]{20,}", part[0]))
                for x in own:
                    a = m.start() + x.start() + (0 if x is part else part.start())
                    if kind := secrets.encoding(x[0]):
                        p, c = secrets.p_value(x[0], kind), secrets._class(len(x[0]))
                        cells[c, secrets._cell(p)] += x[0] not in told
                        told.add(x[0])
                        every.append((i, a, a + len(x[0]), p, c))
    ends = secrets.cuts(cells)
    want = sorted((i, t[a:e]) for i, a, e, p, c in every for t in [texts[i]] if secrets._cell(p) < ends[c])
    assert sorted((i, x) for i, own in enumerate(found(spark, texts)) for x in own) == want and len(want) > 50


def test_redact_keeps_rows(spark):
    key = token(random.Random(2), B64, 60)
    rows = [(1, f"a {key} b", 9), (1, f"a {key} b", 9), (None, None, 0), (2, "x" * 300_000 + " " + key, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, secrets.redact(docs).collect()), key=str)
    assert got == sorted([(1, "a [REDACTED] b", 14), (1, "a [REDACTED] b", 14), (None, None, None), (2, "x" * 300_000 + " [REDACTED]", 300_011)], key=str)
    assert secrets.redact(docs.where("false")).count() == 0
