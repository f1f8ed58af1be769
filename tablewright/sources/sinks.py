"""Exports: wide tables, JSON-LD, graphs, reports, per-document results with resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import vocab


def wide_columns(elements: list[str] = vocab.ELEMENTS) -> list[str]:
    """The fixed order of columns of the wide form: metadata, then four for each element, then provenance."""
    return [*vocab.WIDE_BEFORE, *(f"{e}_{x}" for e in elements for x in ("ppm", "detection_limit", "original_value", "original_unit")), *vocab.WIDE_AFTER]


def to_wide(long: DataFrame, keys: list[str], elements: list[str] = vocab.ELEMENTS) -> DataFrame:
    """A row a sample; the list of elements is given, so no pass to find it is needed."""
    kinds = {"ppm": "value_ppm", "detection_limit": "detection_limit", "original_value": "original_value", "original_unit": "original_unit"}
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("element") == e, F.col(c))).alias(f"{e}_{k}") for e in elements for k, c in kinds.items() if c in long.columns])


def to_long(wide: DataFrame, keys: list[str], elements: list[str] = vocab.ELEMENTS, ending: str = "_ppm") -> DataFrame:
    """A row for each sample and element, nulls (not measured) too."""
    have = [e for e in elements if f"{e}{ending}" in wide.columns]
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(e).alias("element"), F.col(f"{e}{ending}").alias("value")) for e in have])).alias("x")).select(*keys, "x.*")


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order, null for those that are missing."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def to_jsonld(long: DataFrame, sample: str, context: str = "https://schema.org/") -> DataFrame:
    """A JSON-LD node for each sample with its measurements."""
    node = F.struct(
        F.lit(context).alias("@context"),
        F.lit("Sample").alias("@type"),
        F.col(sample).cast("string").alias("@id"),
        F.sort_array(F.collect_list(F.struct(F.col("element"), F.col("value_ppm"), F.col("state")))).alias("measurement"),
    )
    return long.groupBy(sample).agg(F.to_json(node).alias("node"))


def graph_csv(nodes: DataFrame, edges: DataFrame, properties: list[str]) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables with the headers of property-graph imports."""
    n = nodes.select(F.col("id").alias("id:ID"), F.col("type").alias(":LABEL"), *[F.try_element_at("props", F.lit(p)).alias(p) for p in properties])
    return n, edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("type").alias(":TYPE"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML elements, a row each, nodes before edges."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(0).alias("part"), F.format_string('<node id="%s"><data key="type">%s</data></node>', safe(F.col("id")), safe(F.col("type"))).alias("xml"))
    return n.union(edges.select(F.lit(1), F.format_string('<edge source="%s" target="%s"><data key="type">%s</data></edge>', safe(F.col("src")), safe(F.col("dst")), safe(F.col("type")))))


def report_sheets(scores: DataFrame, fields: DataFrame, cells: DataFrame, names: DataFrame, doc: list[str], most: int = 10) -> dict[str, DataFrame]:
    """The four parts of a report; lists of names show the first few."""
    listed = names.groupBy(*doc, "status").agg(F.slice(F.sort_array(F.collect_set("name")), 1, most).alias("names"), F.count("*").alias("n"))
    return {"summary": scores, "metadata": fields, "elements": cells.groupBy(*doc, "element").agg(F.avg("score").alias("score"), F.count("*").alias("n")), "samples": listed}


def write_results(rows: DataFrame, path: str, doc: str) -> None:
    """Records by document, added to what is there."""
    rows.write.mode("append").partitionBy(doc).json(path)


def unfinished(docs: DataFrame, done: DataFrame | None, doc: str) -> DataFrame:
    """Documents without a result yet."""
    return docs if done is None else docs.join(done.select(doc).distinct(), doc, "left_anti")
