"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text for each language holds all its
substrings. A text is cut into phrases, each the longest match from where the
last one ended; a language that needs c phrases for n symbols, learned from N,
has a cross entropy of c * log2(N) / n bits a symbol. The least one wins.

Symbols are letters in lower case, and one space for anything else. A symbol
that a language never saw is a phrase of its own. A text is parsed in blocks of
``BLOCK`` symbols, all blocks of a batch side by side: a step of numpy moves
each of them by a symbol. The state in which a block begins is guessed from the
``WARM`` symbols before it; blocks for which the one before ends in another
state are parsed again, so phrases go on over the ends of blocks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtide.llm.common import small_batches

#: Defaults of the labelled sample: so many documents a language, each whole up to
#: so many letters, and the pieces, spread over the whole of a longer text, in which
#: as many letters of it come.
SAMPLE_DOCS, SAMPLE_CHARS, PIECES = 80, 10_000, 5
#: Symbols in a block, before a block, and in what is parsed at once.
BLOCK, WARM, CHUNK = 256, 48, 1 << 19
UNKNOWN = "und"


def held_out() -> F.Column:
    """crc32 of doc_id as text, modulo 5, is 0; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _spread(text: F.Column, chars: int) -> F.Column:
    """Pieces of the letters of a text, from its beginning to its end."""
    letters = F.trim(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " "))
    size, n = max(1, chars // PIECES), F.length(letters)
    pieces = [F.substring(letters, F.floor((n - size) * i / (PIECES - 1)).cast("int") + 1, F.lit(size)) for i in range(PIECES)]
    return F.when(n <= chars, letters).otherwise(F.concat_ws("\n", *pieces))


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """{lang: learned text} of a bounded sample of the rows that aren't held out.

    The documents are those with the least hash of doc_id and text. The hashes
    alone tell which they are; a second pass reads their texts.
    """
    labelled = small_batches(docs).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("binary")).alias("at")
    ).where(F.col("text").rlike(r"\p{L}"))

    def least(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= sample_docs)

    last = least(labelled.select("lang", "at"), "at").groupBy("lang").agg(F.max("at").alias("last"))
    some = labelled.join(F.broadcast(last), "lang").where("at <= last").select("lang", "at", _spread(F.col("text"), sample_chars).alias("text"))
    rows = least(some, "at", "text").collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(texts) for lang, texts in out.items()}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
        elif unicodedata.category(c)[0] == "M":
            out[i] = i
    return out


def _symbols(text: str) -> np.ndarray:
    """Lower-case letters, each stretch of anything else as one space."""
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    return x[keep]


def automaton(x: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of x; state 0 is its root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in x:
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return go


class Table:
    """A suffix automaton whose rows of transitions are laid over each other.

    A state is known by its base, 0 for the root; it goes with class c to the
    state in place base + c, if that place is its own. Each place holds its
    owner and the state it leads to in one word. Random free bases are tried
    for many states at once, those with the most transitions while there is
    most room; so the size is about two places a transition, whatever the
    number of classes.
    """

    def __init__(self, go: list[dict[int, int]], width: int):
        degree = np.array([len(step) for step in go])
        begin = np.cumsum(degree) - degree
        sym = np.array([c for step in go for c in step], np.int64)
        to = np.array([t for step in go for t in step.values()], np.int64)
        random, size = np.random.default_rng(1), max(1024, 2 * len(sym), 2 * len(go))
        base, taken, owner = np.zeros(len(go), np.int64), np.zeros(size, bool), np.full(size + width, -1, np.int64)
        taken[0], owner[sym[: degree[0]]] = True, 0
        level = np.frexp(degree)[1]
        level[0] = -1
        for k in range(level.max(), -1, -1):
            left = np.flatnonzero(level == k)
            while len(left):
                tried = random.integers(1, size, len(left))
                who = np.repeat(np.arange(len(left)), degree[left])
                edge = np.arange(len(who)) + np.repeat(begin[left] - np.cumsum(degree[left]) + degree[left], degree[left])
                place = tried[who] + sym[edge]
                bad = taken[tried]
                bad[np.setdiff1d(np.arange(len(left)), np.unique(tried, return_index=True)[1])] = True
                bad[who[owner[place] >= 0]] = True
                order = np.argsort(place, kind="stable")
                bad[who[order[1:][place[order[1:]] == place[order[:-1]]]]] = True
                good = ~bad[who]
                owner[place[good]] = tried[who[good]]
                base[left[~bad]], taken[tried[~bad]] = tried[~bad], True
                left = left[bad]
        src = np.repeat(base, degree)
        self.places = np.full(size + width, -1 << 32, np.int64)
        self.places[src + sym] = src << 32 | base[to]
        self.first, self.unseen = np.zeros(width, np.int64), np.ones(width, np.int64)
        for c, t in go[0].items():
            self.first[c], self.unseen[c] = base[t], 0

    def run(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that end in each block, state at its end), from its state at the beginning."""
        count, state = np.zeros(len(sizes), np.int64), begin.astype(np.int64)
        lanes = CHUNK // BLOCK
        for lo in range(0, len(sizes), lanes):
            part = np.arange(lo, min(len(sizes), lo + lanes))
            order = part[np.argsort(-sizes[part], kind="stable")]
            steps = int(sizes[order[0]])
            alive = np.searchsorted(-sizes[order], -np.arange(steps), "left")
            s, n = state[order], np.zeros(len(order), np.int64)
            rows = codes[np.minimum(starts[order][None, :] + np.arange(steps)[:, None], len(codes) - 1)]
            for t in range(steps):
                now, c = s[: alive[t]], rows[t, : alive[t]]
                found = self.places[now + c]
                miss = np.flatnonzero(found >> 32 != now)
                unknown = c[miss]
                n[miss] += (now[miss] > 0) + self.unseen[unknown]
                found &= 0xFFFFFFFF
                found[miss] = self.first[unknown]
                s[: alive[t]] = found
            count[order], state[order] = n, s
        return count, state


class Parser:
    """The automata of all languages, each over the symbols that it has learned."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        learned = {lang: _symbols(text) for lang, text in texts}
        self.langs = sorted(learned)
        known = np.unique(np.concatenate([*learned.values(), np.array([32], np.uint32)]))
        # Class 0 is any symbol that no sample, or not this language's, holds.
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[known] = np.arange(1, len(known) + 1)
        self.tables, self.own, self.bits = [], [], []
        for lang in self.langs:
            x = self.classes[learned[lang]]
            seen = np.unique(x)
            own = np.zeros(len(known) + 1, np.int64)
            own[seen] = np.arange(1, len(seen) + 1)
            self.own.append(own)
            self.tables.append(Table(automaton(own[x].tolist()), len(seen) + 1))
            self.bits.append(np.log2(len(x) + 2))

    def phrases(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of each text, for each language; texts are joined and none is empty."""
        begin = np.concatenate([[0], ends[:-1]])
        blocks = [np.arange(a, b, BLOCK) for a, b in zip(begin, ends)]
        starts = np.concatenate(blocks)
        doc = np.repeat(np.arange(len(ends)), [len(b) for b in blocks])
        sizes = np.minimum(starts + BLOCK, ends[doc]) - starts
        later = np.flatnonzero(starts > begin[doc])
        last = np.append(doc[1:] != doc[:-1], True)
        known = self.classes[x]
        out = np.zeros((len(self.langs), len(ends)))
        for k, (table, own) in enumerate(zip(self.tables, self.own)):
            codes = own[known]
            guess = np.zeros(len(starts), np.int64)
            guess[later] = table.run(codes, starts[later] - WARM, np.full(len(later), WARM), guess[later])[1]
            count, state = table.run(codes, starts, sizes, guess)
            while len(wrong := later[guess[later] != state[later - 1]]):
                guess[wrong] = state[wrong - 1]
                count[wrong], state[wrong] = table.run(codes, starts[wrong], sizes[wrong], guess[wrong])
            out[k] = np.bincount(doc, count + (last & (state > 0)), len(ends))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        group: list[int] = []
        size = 0
        for i, text in enumerate([*texts, None]):
            last = i == len(texts)
            if not last and text and any(map(str.isalpha, text)):
                group.append(i)
                size += len(text)
            if group and (last or size >= CHUNK):
                for j, (lang, score) in zip(group, self._group([texts[j] for j in group])):
                    langs[j], scores[j] = lang, score
                group, size = [], 0
        return langs, scores

    def _group(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        own = [_symbols(t) for t in texts]
        ends = np.cumsum([len(o) for o in own])
        total = self.phrases(np.concatenate(own), ends) * np.array(self.bits)[:, None] / np.diff(ends, prepend=0)
        best = total.argmin(0)
        for j, k in enumerate(best):
            rest = np.delete(total[:, j], k)
            yield self.langs[k], float(1 - total[k, j] / rest.min()) if len(rest) and rest.min() > 0 else 1.0


def predictor(spark: SparkSession, learned: dict[str, str]):
    """A function for mapInArrow of batches whose column 1 is the text.

    The automata are made once, on the driver, and broadcast: about 35 bytes
    for each letter of the sample, which the sample's bounds limit.
    """
    parser = spark.sparkContext.broadcast(Parser(tuple(sorted(learned.items()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = parser.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score.

    Learned from the text and lang of rows that aren't held out, in a sample
    of sample_docs documents a language, each whole or, if it has more than
    sample_chars letters, as many in PIECES pieces spread over all of it;
    predicted from the text alone, all of it, however long. A null text or one
    without a letter is `und` with score 0, as is any if nothing could be
    learned. The score is 1 - best / second-best entropy. Ties go to the
    language that sorts first; repeated rows give repeated rows, an empty
    table none; other columns are not read.
    """
    run = predictor(docs.sparkSession, sample(docs, sample_docs, sample_chars))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield b.drop_columns(["text"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return source.mapInArrow(short, "doc_id long, held_out boolean, lang_pred string, score double")


def label(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """documents without those in no language, lang being the predicted one.

    It predicts as identify() does, and what is `und` there goes: a null or
    empty text, one without a letter, all if nothing could be learned. Ties
    and long texts are as there; repeated rows stay repeated, an empty table
    gives no rows, and all other columns, nulls included, stay as they are.
    """
    names = docs.columns
    at = {c: i for i, c in enumerate(names)}
    run = predictor(docs.sparkSession, sample(docs, sample_docs, sample_chars))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = next(run(iter([pa.RecordBatch.from_arrays([b.column(at["doc_id"]), b.column(at["text"])], names=["doc_id", "text"])])))
            lang = said.column(2)
            out = pa.RecordBatch.from_arrays([lang if i == at["lang"] else c for i, c in enumerate(b.columns)], names=b.schema.names)
            yield out.filter(pa.compute.not_equal(lang, UNKNOWN))

    return docs.mapInArrow(keep, docs.withColumn("lang", F.col("lang").cast("string")).schema)
