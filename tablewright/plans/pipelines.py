"""Whole pipelines as one plan over all documents."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import numbers, strings, vocab
from tablewright.operators import consensus, filters, grid, merging, metrics
from tablewright.plans.stages import settle, spread


@dataclass(frozen=True)
class Config:
    """Which stages run; variants for ablation differ in one field."""

    backends: tuple[str, ...] = ("docling", "marker", "mineru", "camelot", "pdfplumber")
    least_elements: int = 3
    validate: bool = True
    explode_minerals: bool = True
    vote: bool = True
    promote: bool = True
    fill_ids: bool = True
    filter_rows: bool = True
    only_data_tables: bool = False
    text_backends: tuple[str, ...] = ("pdftext",)

    def variant(self, **changes) -> Config:
        return replace(self, **changes)


def ablations(base: Config) -> dict[str, Config]:
    """The base, one variant without each stage, one for each single backend and one without each."""
    out = {"full": base, "no_validation": base.variant(validate=False), "no_consensus": base.variant(vote=False), "no_mineral_split": base.variant(explode_minerals=False)}
    out |= {f"only_{b}": base.variant(backends=(b,)) for b in base.backends}
    return out | {f"without_{b}": base.variant(backends=tuple(x for x in base.backends if x != b)) for b in base.backends}


def grid_ablations(base: Config) -> dict[str, Config]:
    """Variants of the steps on grids: without each, and with only tables of data."""
    return {"no_promotion": base.variant(promote=False), "no_id_fill": base.variant(fill_ids=False), "no_row_filter": base.variant(filter_rows=False), "only_data_tables": base.variant(only_data_tables=True)}


def split_minerals(rows: DataFrame) -> DataFrame:
    """A row for each mineral of a list; a mineral that is not given is inferred from the analysis id."""
    named = F.filter(F.transform(F.split("mineral", ","), lambda x: F.trim(x)), lambda x: x != "")
    names = sorted(vocab.MINERALS, key=len, reverse=True)

    def inferred(text):
        # The names are gone through one by one only where one of them is there.
        name = F.when(F.lower(text).rlike(strings.one_of(names)), strings.first_pattern(text, [(m, m) for m in names]))
        code = F.regexp_extract(text, r"(?i)(?:^|[^a-z])(" + "|".join(sorted(vocab.MINERAL_CODES, key=len, reverse=True)) + r")(?:[^a-z]|$)", 1)
        coded = strings.bound(F.lower(code), lambda x: F.when(x != "", F.try_element_at(strings.table(vocab.MINERAL_CODES), x)))
        return F.coalesce(name, coded)

    out = rows.withColumn("mineral", F.explode_outer(F.when(F.size(named) > 0, named)))
    return out.withColumn("mineral", F.coalesce("mineral", strings.bound(F.coalesce("sample_local_id", "sample_name"), inferred)))


def named_columns(body: DataFrame, headers: DataFrame, table: list[str]) -> tuple[DataFrame, DataFrame]:
    """Headers that are all numbers, or lack names, take those of the first row of data: headers, and (table..., start) where data begin.

    A row with numbers is data, and gives no names to columns without one.
    """
    body, headers = grid.promote_header(body, headers, table)
    # Cells without text are not in the grid, so a column without a name is one that only the body has.
    every = body.select(*table, "col").distinct().join(headers, [*table, "col"], "left").select(*table, "col", F.coalesce("header", F.lit("")).alias("header"))
    first = body.groupBy(*table).agg(F.min("row").alias("row"))
    second = settle(body.join(first, [*table, "row"], "left_semi"))  # else what is asked of its texts would be asked of all cells before the join
    labels = second.join(second.where(numbers.plain_float(F.col("raw")).isNotNull()), table, "left_anti")
    merged = settle(grid.merge_header_rows(every, labels, table).join(every.withColumnRenamed("header", "was"), [*table, "col"]))
    gained = merged.groupBy(*table).agg(F.bool_or((F.col("was") == "") & (F.col("header") != "")).alias("gained"))
    starts = first.join(gained, table).select(*table, (F.col("row") + F.col("gained").cast("int")).alias("start"))
    return merged.where("header <> ''").drop("was"), starts


def without_flagged(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """long records without the samples whose names tell that they are none, a fifth of a document's samples at most."""
    samples = rows.groupBy("doc_id", key).agg(F.max(name).alias(name), F.min(order).alias(order))
    return rows.join(filters.capped_removal(samples, ["doc_id"], filters.is_unsafe_name(F.col(name)), order), ["doc_id", key], "left_semi")


HINT_COLUMNS = {"header_row": "int", "transpose": "boolean", "sample_id_col": "string", "unit_override": "string"}


def _hinted_turns(turned: DataFrame, cells: DataFrame, hints: DataFrame, table: list[str]) -> DataFrame:
    """Tables to be turned, where hints say yes or no."""
    keys = ["doc_id", "table_no"]
    kept = turned.join(hints.where("transpose is not null").select(*keys), keys, "left_anti")
    wanted = cells.join(hints.where("transpose").select(*keys), keys, "left_semi").groupBy(*table).agg(F.min("col").alias("first"))
    return kept.unionByName(wanted.join(turned, table, "left").select(*table, F.coalesce("label_col", "first").alias("label_col")))


def _hinted_units(rows: DataFrame, hints: DataFrame) -> DataFrame:
    """Records whose table's unit a hint gives, scaled by it."""
    unit = F.col("unit_override")
    said = rows.join(hints.select("doc_id", "table_no", "unit_override"), ["doc_id", "table_no"], "left")
    scaled = lambda state, c: F.when(unit.isNull(), F.col(c)).when(F.col("state") == state, F.round(numbers.to_ppm(F.col("original_value"), unit), 6))
    return said.withColumns({"value_ppm": scaled("measured", "value_ppm"), "detection_limit": scaled("bdl_known", "detection_limit"), "original_unit": F.coalesce(unit, "original_unit")}).drop("unit_override")


def corrected(cells: DataFrame, hints: DataFrame, config: Config = Config()) -> DataFrame:
    """Measurements of all documents, and of those with hints what they lead to, if that has strictly more measured values than before."""
    first = settle(extract(cells, config))
    some = cells.join(hints.select("doc_id").distinct(), "doc_id", "left_semi")
    second = settle(extract(some, config, hints))
    count = lambda df, n: df.groupBy("doc_id").agg(F.count_if(F.col("state") == "measured").alias(n))
    better = count(second, "n").join(count(first, "was"), "doc_id", "left").where(F.col("n") > F.coalesce("was", F.lit(0))).select("doc_id")
    return first.join(better, "doc_id", "left_anti").unionByName(second.join(better, "doc_id", "left_semi"))


def extract(cells: DataFrame, config: Config = Config(), hints: DataFrame | None = None) -> DataFrame:
    """Measurements of cell grids (doc_id, backend, table_no, row, col, raw), all documents at once.

    Tables of statistics found in plain text are left out (B17), and, if asked for, grids too
    small for data (B16); header rows are found, transposed tables turned, number headers and
    second header rows promoted (B02, A02), columns given roles and units, sparse sample ids
    filled downwards (W01), cells parsed, rows that are no samples left out, local ids made
    (B19), versions of several backends reconciled, flagged samples removed under a cap (F03),
    and a row given for each mineral (N13).  Each stage has its switch (P05).

    hints (L07, N12): doc_id, table_no and any of header_row, transpose, sample_id_col and unit_override, one row a table; what is not null
    takes the place of what would be found.
    """
    if hints is not None:
        hints = settle(hints.select("doc_id", "table_no", *((F.col(c) if c in hints.columns else F.lit(None)).cast(t).alias(c) for c, t in HINT_COLUMNS.items())))
    table = ["doc_id", "backend", "table_no"]
    cells = settle(grid.clean_cells(cells.where(F.col("backend").isin(*config.backends))))  # files are read and parsed once
    first = cells.groupBy(*table).agg(F.min("row").alias("first"))
    heads = first.join(grid.header_row(cells, table), table, "left").select(*table, F.coalesce("header_row", "first").alias("h"))
    if hints is not None:
        heads = heads.join(hints.select("doc_id", "table_no", "header_row"), ["doc_id", "table_no"], "left").select(*table, F.coalesce("header_row", "h").alias("h"))
    heads = settle(heads)  # read for the headers, for tables to be turned and for the body
    raw_headers = cells.join(heads, table).where("row = h").select(*table, "col", F.col("raw").alias("header"))
    turned = grid.transposed(cells, raw_headers, table)
    if hints is not None:
        turned = settle(_hinted_turns(turned, cells, hints, table))
    cells = grid.transpose(cells, turned, table)
    heads = heads.join(turned, table, "left").select(*table, F.coalesce("label_col", "h").alias("h"))
    placed = settle(cells.join(heads, table))
    headers, body = placed.where("row = h").select(*table, "col", F.col("raw").alias("header")), placed.where("row > h").drop("h")
    if config.only_data_tables:
        body = body.join(grid.is_data_table(body, table).where("is_data"), table, "left_semi")
    if set(config.text_backends) & set(config.backends):
        texts = body.where(F.col("backend").isin(*config.text_backends))
        body = body.join(grid.is_summary_table(texts, table).where("is_summary"), table, "left_anti")
    if config.promote:
        headers, starts = named_columns(body, headers, table)
        body = body.join(settle(starts), table).where("row >= start").drop("start")
    headers = grid.unique_headers(headers, table)
    ids = grid.sample_id_column(headers, grid.column_profile(body, table), table)
    if hints is not None:
        low = lambda c: F.lower(F.trim(c))
        named = headers.join(hints.select("doc_id", "table_no", "sample_id_col"), ["doc_id", "table_no"]).where(low("header") == low("sample_id_col")).groupBy(*table).agg(F.min("col").alias("col"))
        ids = named.unionByName(ids.join(named, table, "left_anti"))
    ids = settle(ids)
    rows = grid.measurements(body, headers, table, ids, config.least_elements, config.fill_ids, config.filter_rows)
    rows = rows.withColumns({"ord": F.col("table_no").cast("long") * 1_000_000 + F.col("row"), "__key": F.coalesce("sample_local_id", "sample_name")})
    if hints is not None:
        rows = _hinted_units(rows, hints)
    rows = settle(rows)  # what follows reads them several times
    if config.validate:
        rows = without_flagged(rows, "__key", "sample_name", "ord")
    values = ["value_ppm", "state", "detection_limit", "original_value", "original_unit"]
    if config.vote:
        rows = consensus.consensus(rows, ["doc_id"], ["__key", "element"], "backend", "ord", ["sample_name", "sample_local_id", "mineral", *values]).drop("__key")
    else:
        rows = rows.select("doc_id", "backend", "sample_name", "sample_local_id", "mineral", "element", *values)
    return split_minerals(rows) if config.explode_minerals else rows


def domain_records(cells: DataFrame, headers: DataFrame, domain: str, config: Config = Config()) -> DataFrame:
    """Records of pre-parsed tables (doc_id, table_no, row, col, raw) of a domain (assay, composition or result), validated and deduplicated.

    Headers are read by rules, each text once, and what validation makes of names is made of the headers' names, not record by record; records of results have the model of their row's label, and the metric, dataset, task, statistic or
    parameter that header or label name.
    """
    table = ["doc_id", "table_no"]

    def meaning(texts, text):
        known = grid.interpret_headers(texts.withColumn("header", F.col(text)), [], domain).drop("header").where("is_data")
        if config.validate and domain != "result":
            known = filters.assay_names(known) if domain == "assay" else filters.component_names(known)
        return known

    cells = spread(cells, *table)
    data = grid.assemble(grid.numeric_cells(cells, headers, table), grid.by_text(headers, F.col("header"), meaning), table, domain)
    if domain == "result":
        return result_records(data, ["table_no", "row", "col"], config)
    if config.validate:
        data = filters.tested(data, [t for _, t in vocab.ASSAY_TYPES]) if domain == "assay" else filters.with_value(data.withColumn("value", F.col("value").cast("string")))
    keys = ["doc_id", "value", "treatment", "target", "type"] if domain == "assay" else ["doc_id", "sample_id", "component", "value"]
    return consensus.keep_first(data, keys, ["table_no", "row", "col"])


def result_records(records: DataFrame, order: list[str], config: Config = Config()) -> DataFrame:
    """Records of experimental results (doc_id, value, type, model, dataset, and metric, task or others), validated against the vocabularies and deduplicated.

    They come from a model's answers (N11); the first in order of each value, type, model
    and dataset stays, a missing part being like an empty one.
    """
    data = filters.valid_results(records) if config.validate else records
    parts = ["value", "type", "model", "dataset"]
    keyed = data.withColumns({f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts})
    return consensus.keep_first(keyed, ["doc_id", *(f"__{c}" for c in parts)], order).drop(*(f"__{c}" for c in parts))


def merged_samples(rows: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Long records (doc_id, sample_name, sample_local_id, element, values...) of a document's sheets and files, one row for each sample and element.

    A sample's key is its local id, or its name; keys that are written differently are reconciled (merging.entities).  Each value is
    the first that is not null in the order given (file, sheet, row).  Samples without a key are left out.
    """
    keyed = rows.withColumn("__key", F.coalesce("sample_local_id", "sample_name")).withColumn("form", merging.key_form(F.col("__key")))
    placed = keyed.join(merging.entities(keyed, ["doc_id"], "__key"), ["doc_id", "form"])
    at = F.struct(*order, "__key")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return placed.groupBy("doc_id", "entity", "element").agg(first("sample_name"), *map(first, values), F.count("*").alias("n_records"))


def job_matrix(spark, models: list[str], domains: list[str], shots: list[int], done: DataFrame | None = None) -> DataFrame:
    """All combinations (model, domain, shots) that are not done."""
    jobs = spark.createDataFrame(list(product(models, domains, shots)), "model string, domain string, shots int")
    return jobs if done is None else jobs.join(done, ["model", "domain", "shots"], "left_anti")


def batch_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Documents, failures (an error column) and means of scores over evaluated ones."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("error").isNotNull()).alias("n_failed"),
        F.count("score").alias("n_evaluated"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.sum("n_records").alias("n_records"),
    )


def evaluate(pred: DataFrame, gold: DataFrame, correct, doc: list[str], passes: list[list[str]], columns: list[str]) -> DataFrame:
    """P, R and F1 by document and in total (null keys), in one plan."""
    from tablewright.operators.matching import bag_counts

    return metrics.prf_rollup(bag_counts(pred, gold, doc, passes, correct, columns), doc)
