"""Secrets in texts: fixed patterns, and runs of characters that look random.

Beside the patterns, every run of at least ``MIN_RUN`` characters that could
be an encoded key gets an encoding (hexadecimal, base 32 or 36 in one case,
base 62, base 64, or letters alone) and a battery of tests of the hypothesis that its symbols are drawn at random
from that alphabet: chi-squared uniformity over equal cells, the number of
runs about the middle symbol, and the correlation of neighbours. Symbols are in
the order of their frequency in words, so that words and names fill few of the
cells. The least p-value, corrected for the number of tests, is the run's own.

Random runs have p-values that are spread evenly, others are crowded near 0. So
the density near 1 over the whole corpus tells how many random runs there are,
and what goes beyond it at smaller values is false. In each class of lengths,
whose tests are equally sharp, the cut is the smallest p-value beyond which at
most a share of ``FDR`` of what is reported is false.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.common import small_batches

KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
#: Share of runs that aren't random among those reported that is accepted.
FDR = 0.05
#: p-values are counted in cells of a quarter of a power of two, down to 2^-128.
CELLS, PER_OCTAVE = 513, 4
#: Cells up to which the density of random runs is taken, the last cell that can
#: be reported (p over 0.01), and the runs that a cut is made from at least, those
#: of neighbouring classes of lengths included, if there are as many.
TOPS, LAST, LEAST_RUNS = (1, 4), 26, 200
#: Random runs that are made to see how their p-values are spread.
MADE = 3000
#: Classes of lengths, each of twice the length of the one before; the last is open.
CLASSES = 9

_ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_UPPER, _LOWER, _DIGIT = re.compile("[A-Z]"), re.compile("[a-z]"), re.compile("[0-9]")
#: Pieces of a run between "=", the padding at its end included, and between signs.
_PIECE, _WORD = re.compile(r"[^=]+(?:=+\Z)?"), re.compile("[A-Za-z0-9]{20,}")
#: Letters from the most to the least frequent.
_LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": _LETTERS + "234567",
    "base36": _LETTERS + "0123456789",
    "letters": _LETTERS,
    "base52": _LETTERS + _LETTERS.upper(),
    "base62": _LETTERS + _LETTERS.upper() + "0123456789",
    "base64": _LETTERS + _LETTERS.upper() + "0123456789+/",
}
_INDEX = {name: {c: i for i, c in enumerate(a)} for name, a in _ALPHABETS.items()}
_INDEX["base64"] |= {"-": 62, "_": 63}

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str, raw: bytes) -> list[Span]:
    """The fixed patterns' matches, sorted; raw is the text as UTF-8."""
    found: list[Span] = []
    low = raw.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in _RUN.finditer(text):
        a, b = run.span()
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    found.sort()
    return found


def encoding(run: str) -> str | None:
    """The narrowest alphabet a run fits, if it could be an encoded key."""
    body = run.rstrip("=")
    if "=" in body or len(body) < MIN_RUN:
        return None
    upper, lower, digit = bool(_UPPER.search(body)), bool(_LOWER.search(body)), bool(_DIGIT.search(body))
    if not (upper and lower):
        if not (upper or lower) or not body.isalnum():
            return None
        if all(c in _INDEX["hex"] for c in body.lower()):
            return "hex"
        if not digit:
            return "letters"
        return "base32" if all(c in _INDEX["base32"] for c in body.lower()) else "base36"
    if not body.isalnum():
        return "base64"
    return "base62" if digit else "base52"


def _symbols(run: str, kind: str) -> str:
    """The run without padding, in the case of its alphabet."""
    body = run.rstrip("=")
    return body.lower() if kind in ("hex", "base32", "base36", "letters") else body


def _chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom > x), in closed form."""
    half = x / 2
    if df % 2:
        total, term, k = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5), 1
    else:
        total, term, k = math.exp(-half), math.exp(-half) * half, 2
    while k < df:
        total += term
        k += 2
        term *= half / (k / 2)
    return min(1.0, total)


def _normal_tails(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def p_value(run: str, kind: str) -> float:
    """How likely a random run of the alphabet fits randomness no better than this."""
    index, size = _INDEX[kind], len(_ALPHABETS[kind])
    x = np.array([index[c] for c in _symbols(run, kind)])
    n = len(x)
    cells = max(2, min(16, n // 5))
    owner = np.arange(size) * cells // size
    expected = np.bincount(owner, minlength=cells) * n / size
    chi = float(((np.bincount(owner[x], minlength=cells) - expected) ** 2 / expected).sum())
    tests = [_chi2_tail(chi, cells - 1)]
    high = x >= size // 2
    n1 = int(high.sum())
    n2 = n - n1
    if n1 and n2:
        mean = 2 * n1 * n2 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        tests.append(_normal_tails((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        tests.append(2.0 ** (1 - n))
    d = x - x.mean()
    power = float((d * d).sum())
    tests.append(_normal_tails((float((d[1:] * d[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0)
    return 1 - (1 - min(1.0, *tests)) ** len(tests)


def _pieces(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """What the runs hold outside the base spans, cut at inner "=" signs."""
    taken: list[list[int]] = []
    for a, _, e in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([a, e])
    ends = [e for _, e in taken]
    for run in _RUN.finditer(text):
        at, end = run.span()
        k = bisect_right(ends, at)
        while at < end:
            a, e = taken[k] if k < len(taken) else (end, end)
            for piece in _PIECE.finditer(text, at, max(at, min(a, end))):
                yield piece.span()
            at, k = max(at, e), k + 1


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, float]]:
    """(start, end, p) of the pieces of runs that have an encoding.

    One in a single case that has none, because of its signs, is cut at them.
    """
    found = []
    for a, e in _pieces(text, base):
        if e - a < MIN_RUN:
            continue
        parts = [(a, e)] if encoding(text[a:e]) else [m.span() for m in _WORD.finditer(text, a, e)]
        for a, e in parts:
            if kind := encoding(text[a:e]):
                found.append((a, e, p_value(text[a:e], kind)))
    return found


def _class(length: int) -> int:
    return min(CLASSES, (length // MIN_RUN).bit_length()) - 1


def _cell(p: float) -> int:
    return CELLS - 1 if p <= 0 else min(CELLS - 1, int(-math.log2(p) * PER_OCTAVE))


@lru_cache(maxsize=1)
def reference() -> np.ndarray:
    """The share of random runs in the cells before each, measured on MADE of them.

    The tests' p-values are nearly, but not quite, spread evenly: runs are short
    and the least of several p-values is taken.
    """
    random = np.random.default_rng(17)
    cells = np.zeros(CELLS, np.int64)
    for i in range(MADE):
        kind = ("base62", "base64")[i % 2]
        symbols = np.array(list(_ALPHABETS[kind]))
        cells[_cell(p_value("".join(symbols[random.integers(0, len(symbols), int(random.integers(MIN_RUN, 4 * MIN_RUN)))]), kind))] += 1
    return np.concatenate([[0], np.cumsum(cells)]) / MADE


def cut(counts: np.ndarray, fdr: float = FDR) -> int:
    """Number of runs in each cell of p-values -> the first cell that isn't reported.

    If the cells up to TOPS hold random runs alone, they tell how many of these
    the others have; what they have beyond that is false. Cells are added as
    long as the false ones, less one, are few enough by the wider of the TOPS,
    and not surely too many by the narrower, which has few runs to go by.
    """
    random = reference()
    reported = np.concatenate([[0], np.cumsum(counts)])
    best = TOPS[-1]
    for k in range(TOPS[-1], LAST + 1):
        fine = True
        for top in TOPS:
            share = random[k] / random[top] - 1
            false = reported[k] - reported[top] * (1 + share)
            chance = 1.0 if top == TOPS[-1] else 1 + math.sqrt(reported[k] - reported[top] + reported[top] * share * share)
            fine &= false - chance <= fdr * reported[k]
        best = k if fine else best
    return best


def cuts(counts: np.ndarray, fdr: float = FDR) -> list[int]:
    """A row of counts for each class of lengths -> its cut.

    A class with few runs is judged with its neighbours, as many as it takes.
    """
    out = []
    for c in range(len(counts)):
        wide = 0
        while wide < len(counts) and counts[max(0, c - wide) : c + wide + 1, :LAST].sum() < LEAST_RUNS:
            wide += 1
        out.append(cut(counts[max(0, c - wide) : c + wide + 1].sum(0), fdr))
    return out


def threshold(docs: DataFrame, fdr: float = FDR) -> list[int]:
    """The first cell of p-values that isn't reported any more, for each class
    of lengths, over all documents.

    A run counts once, however often it occurs. Only the counts of the CELLS
    cells of each class come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, tuple[int, int]] = {}
            for value in b.column(0):
                raw = value.as_py()
                if raw and len(raw) >= MIN_RUN:
                    text = raw.decode("utf-8", "replace")
                    if _RUN.search(text):
                        for a, e, p in candidates(text, base_spans(text, raw)):
                            seen[xxhash.xxh3_64_intdigest(text[a:e]) >> 1] = (_class(e - a), _cell(p))
            cols = np.array([(c, k, h) for h, (c, k) in seen.items()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(cols[:, 0].astype(np.int32)), pa.array(cols[:, 1].astype(np.int32)), pa.array(cols[:, 2])], names=["class", "cell", "run"])

    found = small_batches(docs).select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "class int, cell int, run long")
    cells = found.distinct().groupBy("class", "cell").agg(F.count("*").alias("n")).collect()
    counts = np.zeros((CLASSES, CELLS), np.int64)
    for r in cells:
        counts[r["class"], r["cell"]] = r["n"]
    return cuts(counts, fdr)


def spans_of(text: str, raw: bytes, first_cells: list[int]) -> tuple[list[Span], list[Span]]:
    """All spans, and the base ones, in the order of start and kind."""
    base = base_spans(text, raw)
    added = [(a, 3, e) for a, e, p in candidates(text, base) if _cell(p) < first_cells[_class(e - a)]]
    return sorted(base + added), base


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """documents -> doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end by start, then kind, in code points, the end
    exclusive; base_sha256 is the SHA-256 of that list without the spans that
    the test battery adds. A null text is empty and has no spans; a long one
    is scanned whole; spans that start together are in the order of kinds;
    repeated rows give repeated rows, an empty table none. Only doc_id and
    text are read. The corpus is read twice: for the threshold, then for the
    spans.
    """
    first_cells = threshold(docs, fdr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for value in b.column(1):
                raw = value.as_py() or b""
                every, base = spans_of(raw.decode("utf-8", "replace"), raw, first_cells)
                n = [sum(s[1] == k for s in base) for k in range(3)]
                rows.append((*n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(every)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[REDACTED]", fdr: float = FDR) -> DataFrame:
    """documents with every span replaced by mark; n_chars follows the text.

    A document without secrets stays as it is, a null text stays null, a long
    one is gone through whole; spans that overlap are one. Repeated rows stay
    repeated, an empty table gives no rows, and other columns stay as they are.
    """
    first_cells = threshold(docs, fdr)
    at = docs.columns.index("text")

    def clean(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        text = raw.decode("utf-8", "replace")
        out, done = [], 0
        for a, _, e in spans_of(text, raw, first_cells)[0]:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([clean(v.as_py()) for v in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    cleaned = docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cleaned
