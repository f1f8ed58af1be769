"""Deduplication, merging and consensus of several versions of the same records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import strings
from tablewright.operators.components import connected


def fingerprint(c: Column, fold: bool = False, head: int = 1200, length: int = 400) -> Column:
    """Canonical start of a table's text: lower case, no white space or ruling, word characters and . , only."""
    c = F.left(c, F.lit(head))
    if fold:
        c = strings.nfkc(c)
    c = F.regexp_replace(F.lower(c), r"[\s|+\-_=*]+", "")
    return F.left(F.regexp_replace(c, r"[^\p{L}\p{N}.,]", ""), F.lit(length))


def dedup_by_fingerprint(tables: DataFrame, doc: list[str], text: str, order: str, fold: bool = False) -> DataFrame:
    """Of tables of one fingerprint the longest, the first of equals, with the number merged."""
    rows = tables.withColumn("fingerprint", fingerprint(F.col(text), fold))
    best = F.max_by(F.struct(F.col(order), F.col(text)), F.struct(F.length(text), (-F.col(order)).alias("o")))
    return rows.groupBy(*doc, "fingerprint").agg(best.alias("b"), F.count("*").alias("n_merged")).select(*doc, "fingerprint", F.col(f"b.{order}").alias(order), F.col(f"b.{text}").alias(text), "n_merged")


def first_non_null(rows: DataFrame, keys: list[str], order: str, columns: list[str] | None = None) -> DataFrame:
    """One row a key; every column has its first value in order that is not null."""
    columns = columns or [c for c in rows.columns if c not in [*keys, order]]
    # min_by gives null for a null value at the least ordinal, hence the guard on the ordinal.
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns], F.min(order).alias(order))


def merge_key(name: Column, *place: str) -> Column:
    """The name, or for rows without one a key of their own from file, sheet and row."""
    return F.coalesce(strings.clean_value(name), F.concat_ws("\x01", F.lit("row"), *[F.col(p).cast("string") for p in place]))


def consensus(versions: DataFrame, doc: list[str], key: list[str], backend: str, order: str, values: list[str]) -> DataFrame:
    """The version of each record with most values, the earliest of equals, with confidence and agreement.

    confidence: the share of the document's active backends that have the record.  Records
    with null in a part of the key after the first (a method) join the only other record of
    that name, if there is exactly one.
    """
    n_values = sum((F.col(v).isNotNull().cast("int") for v in values), F.lit(0))
    rows = versions.withColumn("n_values", n_values)
    if len(key) > 1:
        names = rows.dropna(subset=key).select(*doc, *key).distinct().groupBy(*doc, key[0]).agg(F.count("*").alias("k"), *[F.min(c).alias(f"__{c}") for c in key[1:]]).where("k = 1").drop("k")
        rows = rows.join(names, [*doc, key[0]], "left").withColumns({c: F.coalesce(c, f"__{c}") for c in key[1:]}).drop(*[f"__{c}" for c in key[1:]])
    active = versions.groupBy(*doc).agg(F.count_distinct(backend).alias("n_active"))
    best = F.max_by(F.struct(backend, order, *values), F.struct("n_values", (-F.col(order)).alias("o")))
    out = rows.groupBy(*doc, *key).agg(best.alias("b"), F.max("n_values").alias("n_values"), F.count_distinct(backend).alias("n_backends"))
    out = out.join(active, doc)
    return out.select(*doc, *key, "b.*", "n_values", "n_backends", "n_active", F.round(F.col("n_backends") / F.col("n_active"), 2).alias("confidence"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def text_chunks(docs: DataFrame, text: str, size: int = 6000, overlap: int = 400, most: int | None = 12) -> DataFrame:
    """Overlapping chunks (chunk_no from 0, chunk) of each text; most: how many at most, as the operator has it."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))
    if most is not None:
        last = F.least(last, F.lit(most - 1))
    rows = docs.where(F.length(text) > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("chunk", F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size)))


def judge_groups(tables: DataFrame, groups: DataFrame, doc: list[str], order: str, text: str) -> DataFrame:
    """Of tables that a judge put together the longest, the first of equals; tables it does not mention stay.

    groups: doc..., group_id, order: a judge's answers, of several calls or judges if need be.  Groups that share a table are one,
    however many steps it takes (connected components over groups), so no table is kept twice.  Tables that are in no group, and
    numbers that are no table's, change nothing.
    """
    node = lambda c: F.struct(*doc, F.col(c).alias("name"))
    named = groups.dropna(subset=["group_id", order]).select(*doc, F.col(order).cast("string").alias("__name"), F.col("group_id").cast("string").alias("__group"))
    # A table is of its first group; only groups that share a table are linked, so tables of one group are not in the graph.
    named = named.withColumn("__first", F.min("__group").over(Window.partitionBy(*doc, "__name")))
    parts = connected(named.where("__group <> __first").select(node("__group").alias("a"), node("__first").alias("b")))
    parts = parts.select(*(F.col(f"node.{c}").alias(c) for c in doc), F.col("node.name").alias("__first"), F.col("component.name").alias("__part"))
    own = named.where("__group = __first").select(*doc, "__name", "__first").distinct().join(parts, [*doc, "__first"], "left").select(*doc, "__name", F.coalesce("__part", "__first").alias("__g"))
    g = tables.withColumn("__name", F.col(order).cast("string")).join(own, [*doc, "__name"], "left").withColumn("__t", F.when(F.col("__g").isNull(), F.col("__name")))
    best = F.max_by(F.struct(order, text), F.struct(F.length(text), (-F.col(order)).alias("o")))
    return g.groupBy(*doc, "__g", "__t").agg(best.alias("b")).select(*doc, f"b.{order}", f"b.{text}")


def upsert_nodes(nodes: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """One node an id (id, type, props map); properties from the first row that has each.

    keys: columns that properties are in, instead of a map, where an id has one type only.  Nodes are then merged in one aggregate, of which only the types and columns that are asked for are made.
    """
    if keys is not None:
        return nodes.groupBy("id", "type").agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.col(order))).alias(k) for k in keys])
    props = nodes.select("id", order, F.explode("props").alias("k", "v")).where("v is not null")
    merged = props.groupBy("id", "k").agg(F.min_by("v", order).alias("v")).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("props"))
    return nodes.groupBy("id").agg(F.min_by("type", order).alias("type")).join(merged, "id", "left")
