"""Mixing sources to target weights (operator 4).

Source shares of the tokens are raised to an exponent between 0 (all sources alike) and 1
(as they are) and normalised.  The exponent is bisected until the weights have the wished
entropy, and raised further where a source would be repeated too often.  A source's
budget is realised as passes over a fresh permutation of its documents each: whole passes
first, then the start of one more.  Offsets inside a pass come from sums by slices of the
permutation, so no source is ever sorted in one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.store import settle

STEPS, DRIVER_SIZES, SLICE_ROWS = 50, 100_000, 100_000


def tempered(tokens: np.ndarray, alpha: float, counts=1) -> np.ndarray:
    """Weights of sources with so many tokens (all above 0), each standing for `counts` alike."""
    logs = alpha * np.log(tokens / (tokens * counts).sum())
    w = np.exp(logs - logs.max())
    return w / (w * counts).sum()


def entropy(w: np.ndarray, counts=1) -> float:
    w, counts = w[w > 0], np.broadcast_to(counts, w.shape)[w > 0]
    return float(-(counts * w * np.log(w)).sum())


def bisect_exponent(tokens, budget: float, evenness: float, max_repeats: float, counts=1) -> float:
    """The exponent for entropy H(1) + evenness * (H(0) - H(1)), or the least above it that repeats no source over max_repeats times.

    If even exponent 1 repeats more (a budget over max_repeats times the tokens), it is 1.
    """
    tokens = np.asarray(tokens, float)
    counts = np.broadcast_to(np.asarray(counts, float), tokens.shape)
    return _exponent(lambda a: entropy(tempered(tokens, a, counts), counts), lambda a: (tempered(tokens, a, counts) * budget / tokens).max(), counts.sum(), evenness, max_repeats)


def _exponent(entropy_at, repeats_at, n: float, evenness: float, max_repeats: float) -> float:
    """The same for n sources, from functions of the exponent."""
    flat = entropy_at(1)
    goal = flat + evenness * (np.log(n) - flat)

    def least(fits) -> float:
        lo, hi = 0.0, 1.0
        if fits(lo):
            return lo
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
        return hi

    by_entropy = least(lambda a: entropy_at(a) <= goal + 1e-12)
    by_repeats = least(lambda a: repeats_at(a) <= max_repeats)
    return max(by_entropy, by_repeats)


def _exponent_of_many(sizes: DataFrame, budget: float, evenness: float, max_repeats: float) -> float:
    """bisect_exponent of sizes (size, count), with an aggregate for each exponent tried."""
    n, most = sizes.agg(F.sum("count"), F.max("size")).first()
    logs, known = F.ln(F.col("size") / F.lit(most)), {}

    def at(alpha: float) -> tuple[float, float]:
        if alpha not in known:
            raised = F.exp(F.lit(float(alpha)) * logs)
            norm, mean, least = sizes.agg(F.sum(F.col("count") * raised), F.sum(F.col("count") * raised * logs), F.max(raised / F.col("size"))).first()
            known[alpha] = (float(np.log(norm) - alpha * mean / norm), least * budget / norm)
        return known[alpha]

    return _exponent(lambda a: at(a)[0], lambda a: at(a)[1], float(n), evenness, max_repeats)


def source_weights(sources: DataFrame, budget: int | None, evenness: float, max_repeats: float) -> DataFrame:
    """sources (source, tokens) with weight, quota and alpha, for those with tokens.

    sources is read several times, so it should be a written table.  The driver gets sizes
    and how many sources have each; where there are more than DRIVER_SIZES sizes, they stay
    where they are, and each step of the bisection is an aggregate.
    """
    sources = sources.where("tokens > 0")
    sizes = sources.groupBy(F.col("tokens").cast("double").alias("size")).count()
    rows = sizes.limit(DRIVER_SIZES + 1).collect()
    many = len(rows) > DRIVER_SIZES
    if not rows:
        return sources.withColumn("weight", F.lit(0.0)).withColumn("quota", F.lit(0).cast("long")).withColumn("alpha", F.lit(1.0))
    total = sources.agg(F.sum("tokens")).first()[0]
    budget = total if budget is None else budget
    if many:
        sizes = settle(sizes)
        alpha = _exponent_of_many(sizes, float(budget), evenness, max_repeats)
    else:
        rows.sort()
        alpha = bisect_exponent([r[0] for r in rows], budget, evenness, max_repeats, [r[1] for r in rows])
    raised = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha))
    norm = sources.agg(F.sum(raised)).first()[0]
    weight = raised / F.lit(norm)
    return sources.withColumn("weight", weight).withColumn("quota", F.floor(weight * F.lit(float(budget))).cast("long")).withColumn("alpha", F.lit(alpha))


def count_words(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weighed(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows with their source's weights: the DRIVER_SIZES largest sources are broadcast, so that no hot one meets in one task; smaller ones are joined by shuffle."""
    heads = weights.orderBy(F.desc("tokens"), "source").limit(DRIVER_SIZES)
    if weights.count() <= DRIVER_SIZES:
        return rows.join(F.broadcast(weights), "source")
    heads = settle(heads)
    tail = weights.join(F.broadcast(heads.select("source")), "source", "left_anti")
    return rows.join(F.broadcast(heads), "source").unionByName(rows.join(tail, "source"))


def draw(docs: DataFrame, tokens: Column | None = None, budget: int | None = None, evenness: float = 0.5, max_repeats: float = 4.0, seed: str = "mix") -> DataFrame:
    """row (a struct of the columns of docs), pass_no, from_token, weight and alpha: what mix gives, with docs' columns apart.

    tokens: how many tokens a row has; by default its column n_tokens.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    plain = [docs[f"`{f.name}`"] for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    tie = F.xxhash64(*plain)
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), tie.cast("string")))
    count = F.col("n_tokens") if tokens is None else tokens
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), source.alias("source"), name.alias("name"), tie.alias("tie"), count.cast("long").alias("n"))
    # Tokens are counted once; all that follows reads the written rows.
    rows = settle(own.where("n > 0"))
    totals = settle(rows.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")))
    weights = settle(source_weights(totals, budget, evenness, max_repeats).where("quota > 0").drop("rows"))
    most = totals.agg(F.max("rows")).first()[0] or 0
    # Hexadecimal digits of the key that make a slice: SLICE_ROWS rows of the largest source in each, or fewer.
    digits = max(2, math.ceil(math.log(max(most / SLICE_ROWS, 1), 16)))
    passes = (
        _weighed(rows, weights)
        .withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.floor((F.greatest("quota", F.lit(1)) - 1) / F.col("tokens")).cast("int"))))
        .withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("pass_no").cast("string"), F.col("name"))))
        .withColumn("slice", F.substring("key", 1, digits))
    )
    group = ["source", "pass_no", "slice"]
    sums = passes.groupBy(*group).agg(F.sum("n").alias("own"))
    before = sums.select(*group, (F.sum("own").over(Window.partitionBy("source", "pass_no").orderBy("slice")) - F.col("own")).alias("before"))
    ties = Window.partitionBy(*group).orderBy("key", "n", "tie").rowsBetween(Window.unboundedPreceding, 0)
    return (
        passes.withColumn("within", F.sum("n").over(ties))
        .join(before, group)
        .withColumn("from_token", F.col("pass_no") * F.col("tokens") + F.col("before") + F.col("within") - F.col("n"))
        .where("from_token + n <= quota")
        .select("row", "pass_no", "from_token", "weight", "alpha")
    )


def mix(docs: DataFrame, budget: int | None = None, evenness: float = 0.5, max_repeats: float = 4.0, seed: str = "mix") -> DataFrame:
    """The rows of docs (doc_id, source, n_tokens, others) that the budget takes, once for each pass that takes them.

    Adds pass_no, from_token (where the row starts in its source's stream), weight and
    alpha.  budget: tokens in all; by default as many as there are.  A row is taken in the
    last, partial pass if it ends within the quota; so a source falls short of its quota
    by less than a document.

    A null source is a source of its own.  Rows without tokens (or with null n_tokens) are
    never taken.  doc_id may be of any type that casts to text; a hash of the columns stands
    for a null one.  Rows of one doc_id come next to each other in a pass, by tokens, then by
    a hash of their columns; repeated rows are separate rows.  The length of a text plays no part.  An empty table
    gives no rows.  Columns of docs named like the four added ones are replaced; all others stay.
    """
    added = ["pass_no", "from_token", "weight", "alpha"]
    return draw(docs, None, budget, evenness, max_repeats, seed).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added), *added)
