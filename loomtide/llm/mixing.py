"""Mixing sources to target weights by temperature.

A source with a share p of all tokens gets a weight in proportion to p^a. The
exponent a is bisected: 1 keeps the natural shares, 0 makes all equal. It is
the largest whose weights reach a target entropy, or the smallest at which no
source is repeated too often. The weights then become budgets of tokens, and a
budget is spent in blocks: each block is a permutation of the source of its
own, and the last is cut where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtide.llm.common import materialize

#: Levels of bisection in all, and those that one job evaluates at once.
LEVELS, AT_ONCE = 48, 6
#: Sources up to so many are broadcast; more are joined over SALTS parts each.
BROADCAST_SOURCES, SALTS = 20_000, 64
#: The permutation's hash falls into 16^3 cells, the one in which a source's
#: budget ends into 16^3 again, and so on until a cell has about CELL_ROWS rows
#: of the largest source; only the last such cell is put in order.
CELL_DIGITS, CELL_ROWS = 3, 16_384


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _order(seed: int, block: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _measures(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """{a: (entropy in bits, most passes over fewest)} from one aggregation."""
    each = shares.select("p", F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a")).withColumn("w", F.pow("p", "a"))
    z = F.sum("w")
    rows = each.groupBy("a").agg(
        (F.log2(z) - F.sum(F.col("w") * F.col("a") * F.log2("p")) / z).alias("entropy"),
        (F.max(F.pow("p", F.col("a") - 1)) / F.min(F.pow("p", F.col("a") - 1))).alias("spread"),
    ).collect()
    return {r["a"]: (r["entropy"], r["spread"]) for r in rows}


def exponent(shares: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None) -> float:
    """Bisects the exponent in [0, 1]; shares has a row p > 0 for each source.

    With max_repeat, the smallest exponent at which the most repeated source
    makes at most max_repeat times the passes of the least repeated one;
    otherwise the largest whose entropy is target_entropy bits or more (0 if
    none is). One job measures all points of AT_ONCE levels of the bisection.
    """
    def fits(m: tuple[float, float]) -> bool:
        return m[1] <= max_repeat if max_repeat is not None else m[0] < target_entropy

    # fits() is false up to some exponent and true beyond it.
    ends = _measures(shares, [0.0, 1.0])
    if fits(ends[0.0]):
        return 0.0
    if not fits(ends[1.0]):
        return 1.0
    lo, hi, level = 0.0, 1.0, 0
    while level < LEVELS:
        n = 1 << AT_ONCE
        points = [lo + (hi - lo) * i / n for i in range(1, n)]
        seen = _measures(shares, points)
        a, b = 0, n
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if fits(seen[points[mid - 1]]) else (mid, b)
        lo, hi = (points[a - 1] if a else lo), (points[b - 1] if b < n else hi)
        level += AT_ONCE
    return hi if max_repeat is not None else lo


def budgets(sizes: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None, budget: int | None = None) -> DataFrame:
    """(key, tokens, n) of sources -> (key, tokens, n, weight, budget, full, rest).

    Without a budget, it is the least with which every source makes one whole
    pass. full is the number of whole blocks of a source, rest the tokens that
    its last block has. A source without tokens has weight 0 and one block.
    """
    some = sizes.where("tokens > 0")
    total = some.agg(F.sum("tokens")).first()[0]
    if not total:
        return sizes.select("*", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1).cast("long").alias("full"), F.lit(0).cast("long").alias("rest"))
    shares = some.select((F.col("tokens") / F.lit(float(total))).alias("p"))
    a = exponent(shares, target_entropy, max_repeat)
    z, least = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max(F.pow("p", F.lit(1 - a)))).first()
    spent = float(budget) if budget is not None else total * z * least
    p = F.col("tokens") / F.lit(float(total))
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    out = sizes.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * F.lit(spent)).cast("long"))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(1)).cast("long")
    return out.withColumn("full", full).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(F.lit(0)).cast("long"))


def _edge(rows: DataFrame, level: int) -> DataFrame:
    """(__key, __cell, __left): the first part of a source's cell that doesn't
    fit what is left as a whole, and what is left for it.

    rows have the cell found so far, of level * CELL_DIGITS digits, and its rest.
    """
    inside = rows.where(F.substring("__last", 1, CELL_DIGITS * level) == F.col("__cell"))
    parts = inside.groupBy("__key", F.substring("__last", 1, CELL_DIGITS * (level + 1)).alias("cell")).agg(F.sum("n_tokens").alias("n"), F.first("__left").alias("left"))
    upto = F.sum("n").over(Window.partitionBy("__key").orderBy("cell"))
    return (
        parts.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
        .groupBy("__key").agg(F.min(F.struct("cell", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))).alias("e"))
        .select("__key", F.col("e.cell").alias("__cell"), F.col("e.left").alias("__left"))
    )


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None, budget: int | None = None, seed: int = 0) -> DataFrame:
    """documents -> their rows as often as drawn, with block, n_tokens, order_key.

    block counts a source's permutations from 0, and order_key is the row's
    place in its block: reading by block and key reads the mixture. Give one of
    target_entropy (bits) and max_repeat. A last block holds the rows in order
    while their tokens fit the rest of the budget. A null source is a source
    of its own, a null text has no tokens, a null doc_id counts as ''; repeated
    rows are drawn each for itself, and an empty table gives no rows. Columns
    of docs stay, except block, n_tokens and order_key, which are replaced.
    """
    if (target_entropy is None) == (max_repeat is None):
        raise ValueError("give one of target_entropy and max_repeat")
    slim = materialize(docs.select("doc_id", _key(F.col("source")).alias("__key"), n_tokens(F.col("text")).alias("n_tokens")), "tokens")
    sizes = materialize(slim.groupBy(F.col("__key").alias("key")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "sources", slim=True)
    plan = materialize(budgets(sizes, target_entropy, max_repeat, budget).select(F.col("key").alias("__key"), F.col("full").alias("__full"), F.col("rest").alias("__rest")), "budgets", slim=True)
    few = plan.count() <= BROADCAST_SOURCES

    def joined(rows: DataFrame, side: DataFrame) -> DataFrame:
        if few:
            return rows.join(F.broadcast(side), "__key")
        salted = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["__key", "__salt"]).drop("__salt")

    last_key = _order(seed, F.col("__full"), F.col("doc_id"))
    levels, most = 1, sizes.agg(F.max("n")).first()[0] or 0
    while most > CELL_ROWS << 4 * CELL_DIGITS * levels:
        levels += 1
    edge = plan.where("__rest > 0").select("*", F.lit("").alias("__cell"), F.col("__rest").alias("__left"))
    for level in range(levels):
        found = _edge(joined(slim, edge).withColumn("__last", last_key), level)
        edge = plan.join(materialize(found, "cells", slim=True), "__key")
    sources = materialize(plan.join(edge.select("__key", "__cell", "__left"), "__key", "left"), "edges", slim=True)

    kept = [c for c in docs.columns if c not in ("block", "n_tokens", "order_key")]
    rows = joined(docs.select(*kept, _key(F.col("source")).alias("__key"), n_tokens(F.col("text")).alias("n_tokens")), sources).withColumn("__last", last_key)
    cell = F.substring("__last", 1, CELL_DIGITS * levels)
    on_edge = F.coalesce((cell == F.col("__cell")) & (F.col("__rest") > 0), F.lit(False))
    clear = rows.where(~on_edge).withColumn("__in", (F.col("__rest") > 0) & (F.col("__cell").isNull() | (cell < F.col("__cell"))))
    run = F.sum("n_tokens").over(Window.partitionBy("__key").orderBy("__last", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    tight = rows.where(on_edge).withColumn("__in", run <= F.col("__left"))
    blocks = F.concat(
        F.when(F.col("__full") > 0, F.sequence(F.lit(0).cast("long"), F.col("__full") - 1)).otherwise(F.array().cast("array<long>")),
        F.when(F.col("__in"), F.array("__full")).otherwise(F.array().cast("array<long>")),
    )
    drawn = clear.unionByName(tight).withColumn("block", F.explode(blocks))
    return drawn.withColumn("order_key", _order(seed, F.col("block"), F.col("doc_id"))).select(*kept, "block", "n_tokens", "order_key")
