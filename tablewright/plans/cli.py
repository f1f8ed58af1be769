"""Command line (P04): spark-submit --py-files tablewright.zip -m tablewright.plans.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tablewright.operators import metrics, windows
from tablewright.plans import graph, pipelines
from tablewright.plans.stages import settle
from tablewright.sources import files, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tablewright")
    sub = out.add_subparsers(dest="command", required=True)
    for name, text in (
        ("extract", "measurements of the tables in files"),
        ("batch", "the same, written by document; finished documents are skipped"),
        ("graph", "nodes and edges of extracted measurements"),
        ("quality", "completeness and plausibility without truth"),
        ("batch-quality", "batch, and the quality of all documents beside it"),
        ("paper", "measurements of one document"),
        ("benchmark", "precision, recall and F1 of each variant without a step, against true records (Parquet: doc_id, ord, value, type)"),
    ):
        p = sub.add_parser(name, help=text)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--least-elements", type=int, default=3)
        if name == "paper":
            p.add_argument("--doc", required=True, help="its path below the input")
        if name == "benchmark":
            p.add_argument("--gold", required=True)
    p = sub.add_parser("list", help="documents in a folder, and whether a batch has finished them")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--done", help="the batch's output")
    p = sub.add_parser("eval", help="precision, recall and F1 of predicted against true records (Parquet: doc_id, ord, value, type)")
    p.add_argument("pred")
    p.add_argument("gold")
    p.add_argument("output")
    p = sub.add_parser("leaderboard", help="rank of systems by a score (Parquet: system, score)")
    p.add_argument("input")
    p.add_argument("output")
    p = sub.add_parser("discover", help="papers and their supplements in a folder")
    p.add_argument("input")
    p.add_argument("output")
    return out


def _cells(spark: SparkSession, path: str):
    """Cells of the files below a path; a document is a file, named by its place there, so files of one name in two folders are two."""
    cells = files.data_sheets(files.read_grids(spark, path))
    root = path.rstrip("/").split("://")[-1].removeprefix("file:")
    below = F.ltrim(F.substring_index("source_file", root, -1), F.lit("/"))
    name = F.when((below != "") & F.contains(F.col("source_file"), F.lit(root)), below).otherwise(F.regexp_extract("source_file", r"([^/]*)$", 1))
    table = F.pmod(F.xxhash64("source_file", "sheet"), F.lit(1 << 31)).cast("int")
    return cells.select(name.alias("doc_id"), F.lit("file").alias("backend"), table.alias("table_no"), "row", "col", "raw")


def _finished(spark: SparkSession, path: str | None):
    """The documents that a batch has written, None if there is nothing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.json(path) if path else None
    except AnalysisException:
        return None


def _quality(rows):
    whole = metrics.completeness(rows, ["doc_id"], 73, value="value_ppm")
    return whole.join(metrics.plausibility(rows, ["doc_id"], "element", "value_ppm"), "doc_id", "left")


def _scored(rows, gold):
    """Counts and scores of measurements as records of value and element, by document and in total."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("sample_name", "element", "value_ppm")).cast("long")
    pred = rows.where("value_ppm is not null").select("doc_id", order.alias("ord"), F.col("value_ppm").cast("double").alias("value"), F.col("element").alias("type"))
    truth = gold.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("value").cast("double").alias("value"), "type")
    return pipelines.evaluate(pred, truth, F.col("p_type").eqNullSafe(F.col("g_type")), ["doc_id"], [["value", "type"], ["value"]], ["type"])


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "list":
        docs = _cells(spark, a.input).select("doc_id").distinct()
        done = _finished(spark, a.done)
        flag = F.lit(False) if done is None else F.coalesce("finished", F.lit(False))
        docs = docs if done is None else docs.join(done.select("doc_id", F.lit(True).alias("finished")).distinct(), "doc_id", "left")
        docs.select("doc_id", flag.alias("finished")).write.parquet(a.output)
    elif a.command == "benchmark":
        base = pipelines.Config(backends=("file",), least_elements=a.least_elements)
        cells, gold = _cells(spark, a.input), spark.read.parquet(a.gold)
        for name, config in ({"full": base} | pipelines.grid_ablations(base)).items():
            _scored(pipelines.extract(cells, config), gold).write.parquet(f"{a.output}/variant={name}")
    elif a.command in ("extract", "batch", "graph", "quality", "batch-quality", "paper"):
        cells = _cells(spark, a.input)
        if a.command == "paper":
            cells = cells.where(F.col("doc_id") == a.doc)
        rows = pipelines.extract(cells, pipelines.Config(backends=("file",), least_elements=a.least_elements))
        if a.command in ("extract", "paper"):
            rows.write.parquet(a.output)
        elif a.command == "batch":
            sinks.write_results(sinks.unfinished(rows, _finished(spark, a.output), "doc_id"), a.output, "doc_id")
        elif a.command == "batch-quality":
            rows = settle(rows)
            results = f"{a.output}/results"
            sinks.write_results(sinks.unfinished(rows, _finished(spark, results), "doc_id"), results, "doc_id")
            _quality(rows).write.mode("overwrite").parquet(f"{a.output}/quality")
        elif a.command == "graph":
            more = {c: F.lit(None).cast("string") for c in ("deposit", "laboratory", "method")}
            nodes, edges = graph.build(rows.withColumns(more))
            nodes.write.parquet(f"{a.output}/nodes")
            edges.write.parquet(f"{a.output}/edges")
        else:
            _quality(rows).write.parquet(a.output)
    elif a.command == "eval":
        pred, gold = spark.read.parquet(a.pred), spark.read.parquet(a.gold)
        pipelines.evaluate(pred, gold, F.col("p_type").eqNullSafe(F.col("g_type")), ["doc_id"], [["value", "type"], ["value"]], ["type"]).write.parquet(a.output)
    elif a.command == "leaderboard":
        windows.leaderboard(spark.read.parquet(a.input), [F.desc("score"), F.col("system")]).write.parquet(a.output)
    else:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.input).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "path")
        files.discover(listing).write.parquet(a.output)


if __name__ == "__main__":
    main()
