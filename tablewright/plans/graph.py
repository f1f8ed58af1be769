"""Flat records to a property graph and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.consensus import upsert_nodes

NODE_TYPES = ["paper", "deposit", "method", "laboratory", "sample", "analysis", "mineral", "measurement", "element"]
EDGE_TYPES = ["contains", "analyzed_by", "used_method", "target_mineral", "measured", "measures_element"]
PROPERTIES = ["doc_id", "element", "method", "name", "state", "symbol", "value_ppm"]


def _id(kind: str, *parts):
    return F.concat_ws(":", F.lit(kind), *[F.coalesce(F.lower(F.trim(p)), F.lit("")) for p in parts])


def base_sample(name):
    """A sample's name before an @ or a spot's mark."""
    return F.trim(F.regexp_replace(F.split_part(name, F.lit("@"), F.lit(1)), r"(?i)-spot.*$", ""))


def build(records: DataFrame, element_edges: bool = False, properties: bool | str = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, props) and edges (src, dst, type).

    properties off: nodes are id and type only.  An id starts with its type, so these are the distinct ones, and nothing is merged.
    properties "columns": a column for each of PROPERTIES instead of the map props, so that those that nothing reads need not be merged.

    records: doc_id, deposit, laboratory, method, mineral, sample_name, sample_local_id,
    element, value_ppm, state.  Ids are names, so they are the same in every run; those of
    measurements hold the method.  element_edges: also link measurements to elements.
    """
    r = records.withColumns({"base": base_sample(F.col("sample_name")), "local": F.coalesce("sample_local_id", "sample_name")})
    paper, deposit, lab, method = _id("paper", F.col("doc_id")), _id("deposit", F.col("deposit")), _id("laboratory", F.col("laboratory")), _id("method", F.col("method"))
    sample, analysis = _id("sample", F.col("doc_id"), F.col("base")), _id("analysis", F.col("doc_id"), F.col("local"))
    mineral, measure = _id("mineral", F.col("mineral")), _id("measurement", F.col("doc_id"), F.col("local"), F.col("method"), F.col("element"))
    element = _id("element", F.col("element"))
    kinds = [
        (paper, "paper", F.lit(True), dict(doc_id=F.col("doc_id"))),
        (deposit, "deposit", F.col("deposit").isNotNull(), dict(name=F.col("deposit"))),
        (lab, "laboratory", F.col("laboratory").isNotNull(), dict(name=F.col("laboratory"))),
        (method, "method", F.col("method").isNotNull(), dict(name=F.col("method"))),
        (sample, "sample", F.col("base").isNotNull(), dict(name=F.col("base"))),
        (analysis, "analysis", F.col("local").isNotNull(), dict(name=F.col("local"))),
        (mineral, "mineral", F.col("mineral").isNotNull(), dict(name=F.col("mineral"))),
        (measure, "measurement", F.col("element").isNotNull(), dict(element=F.col("element"), value_ppm=F.col("value_ppm"), state=F.col("state"), method=F.col("method"))),
        (element, "element", F.col("element").isNotNull(), dict(symbol=F.col("element"))),
    ]
    # One pass over the records, a row for each type; what a type has is made of that row alone, so of types that are not asked for nothing is made.
    by = lambda values: F.coalesce(*[F.when(F.col("type") == t, v) for t, v in values])
    each = lambda types: r.select("*", F.explode(F.array(*map(F.lit, types))).alias("type"))
    nodes = each([t for _, t, _, _ in kinds]).where(by((t, c) for _, t, c, _ in kinds))
    own = [by((t, p[k].cast("string")) for _, t, _, p in kinds if k in p).alias(k) for k in PROPERTIES]
    nodes = nodes.select(by((t, i) for i, t, _, _ in kinds).alias("id"), "type", *(own if properties else []))
    if properties:
        nodes = upsert_nodes(nodes.withColumn("ord", F.xxhash64("id", *[F.coalesce(k, F.lit("\x00")) for k in PROPERTIES])), "ord", PROPERTIES)
    else:
        nodes = nodes.distinct()
    if properties is True:
        held = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in PROPERTIES]), lambda e: e["value"].isNotNull())
        nodes = nodes.select("id", "type", F.when(F.size(held) > 0, F.map_from_entries(held)).alias("props"))
    links = [
        (paper, sample, "contains", F.col("base").isNotNull()),
        (sample, analysis, "analyzed_by", F.col("base").isNotNull() & F.col("local").isNotNull()),
        (analysis, method, "used_method", F.col("local").isNotNull() & F.col("method").isNotNull()),
        (analysis, mineral, "target_mineral", F.col("local").isNotNull() & F.col("mineral").isNotNull()),
        (analysis, measure, "measured", F.col("local").isNotNull() & F.col("element").isNotNull()),
    ]
    if element_edges:
        links.append((measure, element, "measures_element", F.col("element").isNotNull()))
    edges = each([t for _, _, t, _ in links]).where(by((t, c) for _, _, t, c in links))
    edges = edges.select(by((t, x) for x, _, t, _ in links).alias("src"), by((t, x) for _, x, t, _ in links).alias("dst"), "type").distinct()
    return nodes, edges


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of nodes and edges of each type."""
    n = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    return n.union(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge"), "type", "n"))


def from_answers(entities: DataFrame, structure: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of a model's three answers, each already parsed: entities (doc_id, deposit, laboratory, method), structure (doc_id, sample_name, sample_local_id, method, mineral), values (doc_id, sample_local_id, element, value_ppm, state)."""
    rows = structure.join(entities.groupBy("doc_id").agg(F.first("deposit", True).alias("deposit"), F.first("laboratory", True).alias("laboratory")), "doc_id", "left")
    return build(rows.join(values, ["doc_id", "sample_local_id"], "left"))


def flatten(nodes: DataFrame, edges: DataFrame, elements: list[str]) -> DataFrame:
    """A row an analysis: sample, method, mineral and a column for each element.  Nodes may have props or a column for each property."""
    to = lambda kind: edges.where(F.col("type") == kind)
    # Nodes of the type that an edge leads to: of methods and minerals a few, which are sent to the edges, however many these are.
    of = lambda kind, own, *columns: nodes.where(F.col("type") == kind).select(F.col("id").alias(own), *columns)
    prop = lambda k: F.try_element_at("props", F.lit(k)) if "props" in nodes.columns else F.col(k)
    measured = to("measured").join(of("measurement", "dst", prop("element").alias("element"), prop("value_ppm").try_cast("double").alias("value")), "dst").select(F.col("src").alias("analysis"), "element", "value")
    wide = measured.groupBy("analysis").agg(*[F.max(F.when(F.col("element") == e, F.col("value"))).alias(f"{e}_ppm") for e in elements])
    one = lambda edge, kind: to(edge).join(of(kind, "dst", prop("name").alias("name")), "dst").groupBy(F.col("src").alias("analysis")).agg(F.min("name").alias(kind))
    sample = to("analyzed_by").join(of("sample", "src", prop("name").alias("sample_name")), "src").select(F.col("dst").alias("analysis"), "sample_name")
    return sample.join(one("used_method", "method"), "analysis", "left").join(one("target_mineral", "mineral"), "analysis", "left").join(wide, "analysis", "left")
