"""Ids of any type as whole numbers, for operators that sort, hash or pack ids with numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tablewright.llm.store import settle
from tablewright.operators.ranks import global_ranks


def is_whole(docs: DataFrame, column: str = "doc_id") -> bool:
    """Whether the ids are whole numbers as they are."""
    return isinstance(docs.schema[column].dataType, IntegralType)


def numbers(docs: DataFrame, column: str = "doc_id") -> DataFrame:
    """(id, number) of all different ids: from 1 on, in the order of their type; null has none.

    The ids are shuffled twice, alone; the table is settled, so that all that reads it has the same numbers.
    """
    ids = docs.select(docs[f"`{column}`"].alias("id")).dropna().distinct()
    return settle(global_ranks(ids, "id", "id").select("id", F.col("row_number").alias("number")))
