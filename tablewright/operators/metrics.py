"""Scores and statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import strings, vocab
from tablewright.plans.stages import settle

TIER_WEIGHTS = {"t1": 0.30, "t2": 0.40, "t3": 0.15, "t4": 0.15}


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column, digits: int | None = 1) -> dict[str, Column]:
    """Precision, recall and F1; with digits, rounded percentages."""
    p, r, f = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)
    shown = (lambda c: c) if digits is None else (lambda c: F.round(100 * c, digits))
    return {"precision": shown(p), "recall": shown(r), "f1": shown(f)}


def prf_by(counts: DataFrame, keys: list[str], digits: int | None = 1) -> DataFrame:
    """Counts summed by keys (none: micro average) with precision, recall and F1."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    return (counts.groupBy(*keys) if keys else counts.groupBy()).agg(*sums).withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"), digits))


def prf_rollup(counts: DataFrame, keys: list[str], digits: int | None = 1) -> DataFrame:
    """Every level of keys and the total in one pass."""
    return counts.rollup(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"), digits))


def prf_macro(counts: DataFrame, levels: list[list[str]], digits: int = 4) -> DataFrame:
    """Means of means: scores by row, then averaged over each coarser level of keys in turn."""
    out = counts.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"), None))
    for keys in levels:
        out = (out.groupBy(*keys) if keys else out.groupBy()).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return out.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1")})


def numeric_score(gold: Column, pred: Column, tolerance: float = 0.05) -> Column:
    """G05 (tier 2): score of a value that truth has; null where truth is not measured."""
    mark = F.lit(vocab.BELOW_DETECTION)
    error = F.abs(pred - gold) / F.abs(gold)
    decay = F.when(error <= tolerance, 1.0).when(error >= tolerance * 20, 0.0).otherwise(1 - (error - tolerance) / (tolerance * 19))
    return (
        F.when(gold.isNull(), F.lit(None).cast("double"))
        .when(gold == mark, F.when(pred.isNull(), 0.5).when(pred == mark, 1.0).otherwise(0.3))
        .when(pred.isNull() | (pred == mark), 0.0)
        .when(gold == 0, F.when(F.abs(pred) <= 0.001, 1.0).otherwise(0.0))
        .otherwise(decay)
    )


def null_score(gold: Column, pred: Column) -> Column:
    """G06 (tier 4): score of a value that truth does not have; null where it has one."""
    return F.when(gold.isNull(), F.when(pred.isNull(), 1.0).otherwise(0.0))


def metadata_scores(gold: DataFrame, pred: DataFrame, doc: list[str], fields: list[str] = vocab.METADATA_FIELDS) -> DataFrame:
    """G04 (tier 1): (doc..., field, score) for the fields that truth has, from one row a document each."""
    tall = lambda df, name: df.select(*doc, F.posexplode(F.array(*[strings.clean_value(F.col(f)) for f in fields])).alias("k", name))
    both = tall(gold, "g").where("g is not null").join(tall(pred, "p"), [*doc, "k"], "left")
    pairs = both.select(strings.comparable(F.col("g")).alias("a"), strings.comparable(F.col("p")).alias("b")).distinct().where("a <> b")
    similar = pairs.withColumn("similar", strings.similarity(F.col("a"), F.col("b")))
    rows = both.withColumns({"a": strings.comparable(F.col("g")), "b": strings.comparable(F.col("p"))}).join(similar, ["a", "b"], "left")
    score = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("similar", F.lit(0.0)))
    return rows.select(*doc, F.element_at(F.array(*map(F.lit, fields)), F.col("k") + 1).alias("field"), score.alias("score"))


def tier_report(t1: DataFrame, cells: DataFrame, t3: DataFrame, doc: list[str]) -> DataFrame:
    """t1 to t4 and their weighted sum by document.

    t1: doc..., score (of fields); cells: doc..., sample, gold, pred (of matched samples,
    every element); t3: doc..., tp, fp, fn of sample names (its score is their F1).
    """
    by_sample = cells.groupBy(*doc, "sample").agg(F.avg(numeric_score(F.col("gold"), F.col("pred"))).alias("t2"), F.avg(null_score(F.col("gold"), F.col("pred"))).alias("t4"))
    samples = by_sample.groupBy(*doc).agg(F.avg(F.coalesce("t2", F.lit(1.0))).alias("t2"), F.avg(F.coalesce("t4", F.lit(1.0))).alias("t4"))
    first = t1.groupBy(*doc).agg(F.avg("score").alias("t1"))
    third = t3.select(*doc, prf(F.col("tp"), F.col("fp"), F.col("fn"), None)["f1"].alias("t3"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    rows = third.join(first, doc, "left").join(samples, doc, "left").select(*doc, *map(zero, TIER_WEIGHTS))
    return rows.withColumn("overall", sum((F.col(t) * w for t, w in TIER_WEIGHTS.items()), F.lit(0.0)))


def completeness(cells: DataFrame, doc: list[str], n_expected: int, key: str = "element", value: str = "value") -> DataFrame:
    """Share in percent of the expected columns with any value, and rows with values."""
    return cells.where(F.col(value).isNotNull()).groupBy(*doc).agg(F.count_distinct(key).alias("n_present"), F.round(100 * F.count_distinct(key) / n_expected, 2).alias("completeness"))


def id_quality(rows: DataFrame, doc: list[str], name: str) -> DataFrame:
    """Half the share of different names among names, and half that of rows with a name."""
    n = strings.clean_value(F.col(name))
    return rows.groupBy(*doc).agg(F.round(F.coalesce(0.5 * F.count_distinct(n) / F.nullif(F.count(n), F.lit(0)), F.lit(0.0)) + 0.5 * F.count(n) / F.count("*"), 4).alias("id_quality"))


def plausibility(cells: DataFrame, doc: list[str], element: str, value: str) -> DataFrame:
    """Share of elements whose largest value is possible (majors to 1,000,000 ppm, others to 100,000); limits do not count as values."""
    top = F.max(F.when(F.col(value) >= 0, F.col(value)))
    limit = F.when(F.col(element).isin(*vocab.PLAUSIBLE_MAJORS), 1_000_000).otherwise(100_000)
    by = cells.where(F.col(value).isNotNull()).groupBy(*doc, element).agg(top.alias("top"))
    ok = F.coalesce(F.col("top") <= limit, F.lit(True))
    return by.groupBy(*doc).agg(F.round(F.count_if(ok) / F.count("*"), 4).alias("plausibility"))


def consistency(rows: DataFrame, methods: list[str] | None = None, minerals: list[str] | None = None) -> DataFrame:
    """Share of metadata checks that hold (method, mineral with half credit for unknown ones, country, year 1990 to 2030); a half without any."""
    from tablewright.functions.numbers import first_year, has_mark

    methods = methods or list(vocab.METHODS)
    minerals = minerals or list(vocab.MINERALS)
    method, mineral, country, date = (strings.clean_value(F.col(c)) for c in ("analytical_method", "mineral", "country", "publication_date"))
    checks = F.array(
        F.when(method.isNotNull(), has_mark(method, methods).cast("double")),
        F.when(mineral.isNotNull(), F.when(has_mark(mineral, minerals), 1.0).otherwise(0.5)),
        F.when(country.isNotNull(), ((F.length(country) >= 2) & ~F.replace(country, F.lit(" "), F.lit("")).rlike("^[0-9]+$")).cast("double")),
        F.when(date.isNotNull(), F.coalesce(first_year(date).between(1990, 2030), F.lit(False)).cast("double")),
    )
    held = F.array_compact(checks)
    return rows.withColumn("consistency", F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.size(held)).otherwise(0.5))


def quality(metadata: Column, elements: Column, ids: Column, plausible: Column, consistent: Column) -> Column:
    """The weighted sum of the five parts (each 0 to 1), in percent."""
    return F.round(100 * (0.20 * metadata + 0.15 * elements + 0.20 * ids + 0.25 * plausible + 0.20 * consistent), 2)


def modal_agreement(values: DataFrame, keys: list[str], system: str, value: str) -> DataFrame:
    """Share in percent of all systems that give the most frequent value of each key; n_systems counts all systems there are."""
    total = values.agg(F.count_distinct(system).alias("n_systems"))
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_distinct(system).alias("n"))
    top = values.select(*keys).distinct().join(counts.groupBy(*keys).agg(F.max("n").alias("n")), keys, "left")
    return top.join(F.broadcast(total)).select(*keys, F.round(100 * F.coalesce("n", F.lit(0)) / F.col("n_systems"), 1).alias("agreement"))


def jaccard_pairs(keys: DataFrame, doc: str, system: str, key: str, systems: list[str]) -> DataFrame:
    """For each pair of systems, the mean over documents of both of the Jaccard similarity of their keys, and of the share of the first's keys.

    A row with a null key says that the document has no keys of that system.
    """
    rows = keys.where(F.col(system).isin(*systems)).select(doc, system, key).distinct()
    docs = rows.groupBy(doc, system).agg(F.count(key).alias("n"))
    a, b = docs.select(doc, F.col(system).alias("a"), F.col("n").alias("n_a")), docs.select(doc, F.col(system).alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b, doc).where("a < b")
    x = rows.dropna().select(doc, key, F.col(system).alias("a"))
    y = rows.dropna().select(doc, key, F.col(system).alias("b"))
    both = x.join(y, [doc, key]).where("a < b").groupBy(doc, "a", "b").agg(F.count("*").alias("n_both"))
    rows = pairs.join(both, [doc, "a", "b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    union = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return rows.groupBy("a", "b").agg(
        F.count("*").alias("n_docs"),
        F.round(F.avg(F.when(union == 0, 1.0).otherwise(F.col("n_both") / union)), 6).alias("jaccard"),
        F.round(F.avg(F.when(F.col("n_a") > 0, F.col("n_both") / F.col("n_a"))), 6).alias("overlap"),
    )


def jaccard_all(keys: DataFrame, doc: str, system: str, key: str, systems: list[str]) -> DataFrame:
    """Mean over documents of the keys that all systems share among those that any has, where all have the document."""
    rows = keys.where(F.col(system).isin(*systems)).select(doc, system, key).distinct()
    having = rows.groupBy(doc).agg(F.count_distinct(system).alias("k")).where(F.col("k") == len(systems)).select(doc)
    by = rows.dropna().join(having, doc, "left_semi").groupBy(doc, key).agg(F.count("*").alias("k"))
    per = by.groupBy(doc).agg((F.count_if(F.col("k") == len(systems)) / F.count("*")).alias("j"))
    return per.agg(F.count("*").alias("n_docs"), F.round(F.avg("j"), 6).alias("jaccard"))


def cost_summary(runs: DataFrame, keys: list[str], seconds: str, predictions: str, tokens_in: int, tokens_out: int, price_in: float, price_out: float) -> DataFrame:
    """Seconds (mean, median, total), mean predictions, and the price of a token budget a document (prices per million tokens)."""
    one = (tokens_in * price_in + tokens_out * price_out) / 1e6
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.avg(seconds), 4).alias("mean_s"),
        F.round(F.median(seconds), 4).alias("median_s"),
        F.round(F.sum(seconds), 2).alias("total_s"),
        F.round(F.avg(predictions), 4).alias("mean_predictions"),
        F.round(F.count("*") * F.lit(one), 6).alias("cost"),
    )


def coverage_audit(values: DataFrame, known: DataFrame, field: str, value: str) -> DataFrame:
    """For each field how many values a vocabulary (field, term) knows, of all that are not null."""
    terms = known.select(F.col("field").alias(field), F.lower("term").alias("t")).distinct()
    rows = values.where(F.col(value).isNotNull()).withColumn("t", F.lower(F.trim(value))).groupBy(field, "t").agg(F.count("*").alias("n"))
    hit = rows.join(terms.withColumn("hit", F.lit(1)), [field, "t"], "left")
    return hit.groupBy(field).agg(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("total")).withColumn("percent", F.round(100 * F.col("hits") / F.col("total"), 2))


def violations(rows: Column, columns: Column) -> dict[str, Column]:
    """Counts of label pairs that must not occur together: 1 with 2, 1 with 3, 2 with 3 over an axis and across, 3 with 3 across."""
    n = lambda c, k: F.size(F.filter(c, lambda x: x == k))
    pair = lambda a, b: n(rows, a) * n(rows, b) + n(columns, a) * n(columns, b)
    return {"v12": pair(1, 2), "v13": n(rows, 1) * n(rows, 3) + n(columns, 1) * n(columns, 3), "v23": pair(2, 3), "v33": n(rows, 3) * n(columns, 3)}


def seeded_summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over seeded runs."""
    return runs.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"), F.count(value).alias("n"))


def class_report(labels: DataFrame, gold: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    cells = labels.groupBy(gold, pred).agg(F.count("*").alias("n"))
    side = lambda c, name: cells.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(name))
    hit = cells.where(F.col(gold) == F.col(pred)).select(F.col(gold).alias("class"), F.col("n").alias("tp"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = side(gold, "support").join(side(pred, "n_pred"), "class", "full_outer").join(hit, "class", "left").select("class", zero("support"), zero("n_pred"), zero("tp"))
    return both.withColumns(prf(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("support") - F.col("tp"), 1))


def best_parameter(scores: DataFrame, keys: list[str], parameter: str, score: str) -> DataFrame:
    """The parameter with the highest score by keys, the least of equals."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), parameter)
    return scores.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def number_rows(rows: DataFrame, keys: list[str], name: str, slices: int = 4096) -> DataFrame:
    """rows, numbered from 0 on in an order given by keys (which tell rows apart), without sorting all in one task."""
    rows = rows.withColumn("__slice", F.pmod(F.xxhash64(*keys), F.lit(slices)))
    sizes = rows.groupBy("__slice").agg(F.count("*").alias("__n"))
    before = sizes.select("__slice", (F.sum("__n").over(Window.orderBy("__slice")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__slice").orderBy(*keys))
    return rows.withColumn("__k", within).join(F.broadcast(before), "__slice").withColumn(name, F.col("__before") + F.col("__k") - 1).drop("__slice", "__k", "__before")


def bootstrap(values: DataFrame, value: str, index: str, n: int, replicates: int = 1000, seed: str = "42") -> DataFrame:
    """Means of resamples: (replicate, mean).

    Draw i of replicate b takes the row whose index (0 to n - 1) is the leading 60 bits of
    md5(seed:b:i), modulo n: the same in every dialect.  A draw is an equality join, so no
    data are copied; replicates times n draws are made.
    """
    spark = values.sparkSession
    draws = spark.range(replicates * n).select(F.expr(f"id div {max(n, 1)}").alias("replicate"), (F.col("id") % n).alias("i"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("replicate").cast("string"), F.col("i").cast("string")))
    at = (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n).alias(index)
    return draws.select("replicate", at).join(values.select(index, value), index).groupBy("replicate").agg(F.avg(value).alias("mean"))


def bootstrap_interval(means: DataFrame, level: float = 0.95) -> DataFrame:
    """The means at the ranks that cut off half the rest at either end, and the share of means at or below 0."""
    means = settle(means)  # one row a replicate, of many to make them
    n = means.count()
    ranked = means.withColumn("k", F.row_number().over(Window.orderBy("mean", "replicate")) - 1)
    lo, hi = int((1 - level) / 2 * n), min(n - 1, int((1 + level) / 2 * n))
    return ranked.agg(F.max(F.when(F.col("k") == lo, F.col("mean"))).alias("low"), F.max(F.when(F.col("k") == hi, F.col("mean"))).alias("high"), F.avg((F.col("mean") <= 0).cast("double")).alias("p"))


_PRIME = 2147483647
#: The chances of 0, 1, 2, ... draws of a row in a resample, added up: e^-1 / k!.
_POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def _draws(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each replicate draws each row: the same for a row wherever it lies.

    A linear mix of row, replicate and seed modulo the prime 2^31 - 1 is squared and shifted four times, all in
    64-bit integers, and compared with the Poisson distribution; SQL can do the same.
    """
    # By such a prime, 31 bits and those above them leave what their sum leaves; after two sums x is at most the prime and 1.
    fold = lambda x: (x & _PRIME) + (x >> 31)
    x = fold(fold(((ids % _PRIME) * 48271)[:, None] + (np.arange(replicates) * 69621 + seed)[None, :]))
    for step in range(4):
        x = fold(fold(x * x + (x + 16807 * (step + 1))))
    x = np.where(x >= _PRIME, x - _PRIME, x).astype(np.int32)
    out = np.zeros(x.shape, np.int8)
    for p in _POISSON:
        out += x >= int(_PRIME * p)
    return out


def poisson_bootstrap(values: DataFrame, unit: str, columns: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(replicate, n, columns...): means of each column over Poisson resamples, and how many draws there are.

    A row's number of draws depends on its unit (a whole number that tells rows apart) and the replicate only, so
    partial sums of all replicates are made in one scan; `replicates` rows a task are shuffled, whatever the number of rows.
    Rows that lack the unit or a value are left out; a replicate without draws has null means; an empty table gives no rows.
    """
    names = [f"__{k}" for k in range(len(columns))]

    def summed(batches):
        total = np.zeros((replicates, len(columns) + 1))
        some = False
        for batch in batches:
            for a in range(0, batch.num_rows, 64):  # as many as a core's cache holds the draws of
                part = batch.slice(a, 64)
                w = _draws(part.column(0).to_numpy(), replicates, seed)
                v = np.column_stack([np.ones(part.num_rows), *(part.column(k + 1).to_numpy() for k in range(len(columns)))])
                total += w.T.astype(float) @ v
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), *(pa.array(total[:, k]) for k in range(len(columns) + 1))], ["replicate", "n", *names])

    rows = values.select(F.col(unit).cast("long").alias("unit"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True))).dropna()
    parts = rows.mapInArrow(summed, "replicate long, n double" + "".join(f", {n} double" for n in names))
    out = parts.groupBy("replicate").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names))
    return out.select("replicate", F.col("n").cast("long").alias("n"), *((F.col(n) / F.nullif(F.col("n"), F.lit(0.0))).alias(c) for n, c in zip(names, columns, strict=True)))


def paired_bootstrap(values: DataFrame, unit: str, a: str, b: str, replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Difference of the means of two systems over the same units, its interval, and p, the share of resamples in which a is not better than b.

    One row: n, mean_a, mean_b, difference, low, high, p.  Units that lack either value are left out.
    """
    both = values.select(unit, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    means = poisson_bootstrap(both.withColumn("d", F.col("a") - F.col("b")), unit, ["d"], replicates, seed).where("d is not null").select("replicate", F.round("d", 9).alias("mean"))
    whole = both.agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("a") - F.col("b")).alias("difference"))
    return whole.join(F.broadcast(bootstrap_interval(means, level)))
