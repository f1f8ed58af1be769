"""Rows of many sources merged by keys that are written differently.

Keys are reconciled first: equal ones, those equal after normalising, and one that goes on where another
ends, are links, and connected keys are one entity.  Then all sources are one union, and one aggregate takes every
column's first value, however many sources there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import strings
from tablewright.operators.components import connected
from tablewright.plans.stages import settle

SEPARATORS = "-.@_ #"


def key_form(c: Column) -> Column:
    """A key in lower case, with no white space around dashes and single blanks elsewhere; null for a missing one."""
    return F.lower(strings.sample_name(strings.clean_value(c)))


def stems(form: Column) -> Column:
    """The parts of a form that end before a separator, longest first."""
    ends = F.filter(F.sequence(F.length(form) - 1, F.lit(1), F.lit(-1)), lambda k: F.contains(F.lit(SEPARATORS), F.substr(form, k + 1, F.lit(1))))
    return F.when(F.length(form) > 1, F.transform(ends, lambda k: F.left(form, k))).otherwise(F.array().cast("array<string>"))


def entities(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by..., form, entity) of all key forms of rows: the least form that a form is linked with.

    A form is linked with its longest stem that is a form itself, unless that stem has other such forms too: with A, A-1 and
    A-2 nothing says which of the two A is, and all three stay apart.  Missing keys have no entity.
    """
    forms = settle(rows.select(*by, key_form(F.col(key)).alias("form")).dropna(subset=["form"]).distinct())
    tall = forms.select(*by, F.col("form").alias("longer"), F.explode(stems(F.col("form"))).alias("form"))
    nearest = tall.join(forms, [*by, "form"]).groupBy(*by, "longer").agg(F.max_by("form", F.length("form")).alias("form"))
    only = nearest.groupBy(*by, "form").agg(F.count("*").alias("n"), F.min("longer").alias("longer")).where("n = 1")
    node = lambda c: F.struct(*by, F.col(c).alias("form"))
    found = connected(only.select(node("form").alias("a"), node("longer").alias("b")))
    found = found.select(*(F.col(f"node.{c}").alias(c) for c in by), F.col("node.form").alias("form"), F.col("component.form").alias("entity"))
    return forms.join(found, [*by, "form"], "left").withColumn("entity", F.coalesce("entity", "form"))


def merge_sources(sources: list[DataFrame], key: str, order: str, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row for each entity: by..., entity, n_rows, n_sources, and every column's first value that is not null.

    First by the sources' places in the list, then by `order`, then by the key as it is written.  A source may lack columns that others have; columns of one name have
    one type.  Rows without a key are entities of their own (entity null), since nothing says what they belong to.  Equal rows are merged like any
    others; sources without rows add nothing.  Null columns of `by` meet none.
    """
    by = by or []
    columns = columns or list(dict.fromkeys(c for s in sources for c in s.columns if c not in {key, order, *by}))
    place = lambda k, s: s.select(*by, F.col(key).cast("string").alias("__key"), F.col(order).alias("__order"), F.lit(k).alias("__source"), *(c for c in columns if c in s.columns))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [place(k, s) for k, s in enumerate(sources)])
    rows = rows.withColumn("form", key_form(F.col("__key")))
    named = entities(rows, by, "__key")
    # A row without a key is told apart by where it lies.
    alone = F.when(F.col("form").isNull(), F.struct(F.col("__source"), F.col("__order")))
    placed = rows.join(named, [*by, "form"], "left").withColumn("__alone", alone)
    at = F.struct("__source", "__order", "__key")
    return placed.groupBy(*by, "entity", "__alone").agg(
        F.count("*").alias("n_rows"), F.count_distinct("__source").alias("n_sources"), *(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns)
    ).drop("__alone")
