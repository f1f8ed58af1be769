"""Order-dependent operators: filling, labelling, merging of intervals, budgets, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import strings, vocab


def forward_fill(rows: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """The last value that is not null, in order."""
    over = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(over))


def fill_sparse_ids(rows: DataFrame, table: list[str], order: str, name: str, has_data: Column) -> DataFrame:
    """Forward fill of sample ids, only in tables where they are sparse: 2 or more but under half, and 10 or more of the first 20 rows have data."""
    over = Window.partitionBy(*table)
    first = F.row_number().over(over.orderBy(order)) <= 20
    n = F.count(name).over(over)
    rows = rows.withColumns({"__first": first, "__data": has_data, "__n": n, "__all": F.count("*").over(over)})
    sparse = (F.col("__n") >= 2) & (2 * F.col("__n") < F.col("__all")) & (F.count_if(F.col("__first") & F.col("__data")).over(over) >= 10)
    filled = F.last(name, ignorenulls=True).over(over.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.when(sparse, filled).otherwise(F.col(name))).drop("__first", "__data", "__n", "__all")


def heading(line: Column) -> Column:
    """The section that a heading line (numbered or not) names, or null."""
    s = F.lower(F.trim(F.regexp_replace(line, r"^\s*(\d+(\.\d+)*\.?|[IVX]+\.)?\s*", "")))
    return F.when(F.length(s) <= 60, F.try_element_at(strings.table(vocab.HEADINGS), F.regexp_replace(s, r"[.:]$", "")))


def label_sections(lines: DataFrame, doc: list[str], order: str, starts: Column, default: str = "preamble") -> DataFrame:
    """Lines with their section; a line that starts another section than the current one is left out, one that repeats it stays."""
    over = Window.partitionBy(*doc).orderBy(order)
    rows = lines.withColumn("__s", starts)
    rows = rows.withColumn("__before", F.coalesce(F.last("__s", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(default)))
    return rows.withColumn("section", F.coalesce("__s", "__before")).where("__s is null or __s = __before").drop("__s", "__before")


def sections(labelled: DataFrame, doc: list[str], order: str, line: str) -> DataFrame:
    """Text of each section, its lines joined in order."""
    return labelled.groupBy(*doc, "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n").alias("text"))


def merge_intervals(spans: DataFrame, group: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Unions of intervals that overlap or are at most `gap` apart: (group..., start, end, n)."""
    over = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(over.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("__new", (reach.isNull() | (F.col(start) > reach + gap)).cast("int")).withColumn("__k", F.sum("__new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*group, "__k").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__k")


def keyword_spans(docs: DataFrame, text: str, pattern: str, before: int = 200, after: int = 400) -> DataFrame:
    """Intervals (start, end) around each hit of a pattern, within the text."""
    parts = F.split(text, pattern)
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    at = F.aggregate(F.slice(parts, F.lit(1), F.col("k") + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(hits, F.lit(1), F.col("k")), F.lit(0), lambda s, x: s + F.length(x))
    rows = docs.where(F.size(hits) > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.size(hits) - 1)))
    return rows.withColumn("at", at).select(*[c for c in docs.columns if c != text], F.greatest(F.lit(0), F.col("at") - before).alias("start"), F.least(F.length(text), F.col("at") + after).alias("end"))


def keyword_digest(docs: DataFrame, keys: list[str], text: str, pattern: str, most: int = 6000, before: int = 200, after: int = 400, gap: int = 200) -> DataFrame:
    """(keys..., chunk_no from 0, start, end, chunk): stretches around the hits of a pattern, merged and trimmed, as long as all of them together have at most `most` characters.

    The first stretch that does not fit ends a document's digest, even if a later one would fit.  Texts are looked at whole; documents without
    a hit, or without a text, have none.  Keys tell documents apart.
    """
    spans = merge_intervals(keyword_spans(docs.select(*keys, text), text, pattern, before, after), keys, "start", "end", gap)
    chunks = spans.join(docs.select(*keys, text), keys).withColumn("chunk", F.trim(F.substr(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")))).drop(text)
    so_far = F.sum(F.length("chunk")).over(Window.partitionBy(*keys).orderBy("start"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1
    # What is held so far only grows, so all after the first that does not fit are over as well.
    return chunks.withColumns({"__n": so_far, "chunk_no": number}).where(F.col("__n") <= most).select(*keys, "chunk_no", "start", "end", "chunk")


def budget_pack(parts: DataFrame, group: list[str], order: list[str], length: str, budget: int, critical: Column | None = None, least: int = 200) -> DataFrame:
    """Parts with taken: the characters of each within a budget; critical ones whole and first, a cut one only if over `least` is left."""
    first = F.lit(False) if critical is None else F.coalesce(critical, F.lit(False))
    rows = parts.withColumn("__c", first)
    over = Window.partitionBy(*group).orderBy(F.desc("__c"), *order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(length).over(over), F.lit(0))
    taken = F.when(F.col("__c") | (F.col(length) <= F.col("__left")), F.col(length)).when(F.col("__left") > least, F.col("__left")).otherwise(0)
    return rows.withColumn("__left", left).withColumn("taken", taken.cast("long")).drop("__c", "__left")


def leaderboard(scores: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Ranks from 1 in a total order."""
    over = Window.partitionBy(*(group or [])).orderBy(*order)
    return scores.withColumn(name, F.row_number().over(over))


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group (limited before the shuffle as well)."""
    over = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(over)).where(F.col("__k") <= k).drop("__k")


#: Deposit types that are sent to every task at once.
TYPES_AT_ONCE = 2000


def score_types(docs: DataFrame, types: DataFrame, k: int = 10) -> DataFrame:
    """Deposit types (type_id, name, grp, environment, description) scored for each row (id, deposit, deposit_group, environment, keywords, commodity): the best k above 0.05.

    Six signals add up: name in the deposit's (0.4), group (0.2), environment (0.1),
    share of shared key words (up to 0.2), commodity in the description (0.1), shared
    words of names (0.1); 1 at most.
    """
    low = lambda c: F.lower(F.coalesce(F.trim(c), F.lit("")))
    has = lambda a, b: (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    bag = lambda c: F.array_distinct(F.filter(F.split(low(c), r"[^a-z0-9]+"), lambda w: F.length(w) > 2))
    shared = F.size(F.array_intersect(bag("keywords"), bag("description")))
    score = (
        F.when(has(low("deposit"), low("name")), 0.4).otherwise(0.0)
        + F.when(has(low("deposit_group"), low("grp")), 0.2).otherwise(0.0)
        + F.when((low("environment") != "") & (low("environment") == low("type_environment")), 0.1).otherwise(0.0)
        + F.least(F.lit(0.2), 0.2 * shared / F.greatest(F.size(bag("keywords")), F.lit(1)))
        + F.when((low("commodity") != "") & low("description").contains(low("commodity")), 0.1).otherwise(0.0)
        + F.when(F.size(F.array_intersect(bag("deposit"), bag("name"))) > 0, 0.1).otherwise(0.0)
    )
    # Types are a vocabulary; a longer one goes in parts of a size that every task can hold, each with the best of its part.
    parts = max(1, -(-types.count() // TYPES_AT_ONCE))
    named = types.withColumnRenamed("environment", "type_environment").withColumn("__part", F.pmod(F.xxhash64("type_id"), F.lit(parts)))
    best = []
    for part in range(parts):
        pairs = docs.join(F.broadcast(named.where(F.col("__part") == part).drop("__part")))
        rows = pairs.withColumn("score", F.round(F.least(F.lit(1.0), score), 4)).where("score > 0.05").select(*docs.columns, "type_id", "name", "score")
        best.append(top_k(rows, docs.columns, [F.desc("score"), F.col("type_id")], k))
    return top_k(reduce(DataFrame.unionByName, best), docs.columns, [F.desc("score"), F.col("type_id")], k) if parts > 1 else best[0]


def ordered_distinct(c: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(c)


def valid_prefix(rows: DataFrame, group: list[str], index: str, expected: str, got: str) -> DataFrame:
    """The rows of a model's answer before the first that is not the expected next cell."""
    bad = F.min(F.when(~F.col(expected).eqNullSafe(F.col(got)), F.col(index))).over(Window.partitionBy(*group))
    return rows.withColumn("__bad", bad).where(f"__bad is null or {index} < __bad").drop("__bad")
