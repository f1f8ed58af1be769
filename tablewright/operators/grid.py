"""Structure of cell grids: headers, roles, units, orientation, records.

A grid has a row a cell: table..., row, col, raw.  Every operator works on all tables at
once; what is known of a table is one row of a small table of profiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import numbers, strings, vocab
from tablewright.operators.filters import component_of, is_sample
from tablewright.operators.windows import fill_sparse_ids
from tablewright.plans.stages import settle

#: Names of columns by role, in order of preference.
ROLES = {
    "sample_id": ["sample", "sample id", "sample_id", "sample name", "sample no.", "sample no", "sample number", "analysis", "analysis id", "spot", "point", "id"],
    "deposit": ["deposit", "deposit name", "mine", "locality"],
    "reference": ["reference", "references", "source", "data source"],
    "mineral": ["mineral", "phase", "mineral phase"],
    "method": ["method", "analytical method", "technique"],
    "zone": ["zone", "zoning", "generation", "stage"],
    "spot": ["spot", "spot no.", "spot number", "point", "point no."],
}


def header_row(cells: DataFrame, table: list[str], first: int = 20) -> DataFrame:
    """(table..., header_row): of the first rows that with most element headers (two or more, the earliest of equals); short rows of wide tables do not count."""
    width = F.max("col").over(Window.partitionBy(*table)) + 1
    rows = cells.where(F.col("row") < first).withColumn("__w", width).where("trim(raw) <> ''")
    by = rows.groupBy(*table, "row").agg(F.count("*").alias("n"), F.max("__w").alias("w"), F.count_if(strings.element_header(F.col("raw")).isNotNull()).alias("hits"))
    return by.where("hits >= 2 and not (w > 5 and n <= 3)").groupBy(*table).agg((-F.max(F.struct("hits", (-F.col("row")).alias("r")))["r"]).alias("header_row"))


def promote_header(cells: DataFrame, headers: DataFrame, table: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tables whose headers are all numbers take their first row as headers: (cells, headers)."""
    plain = headers.groupBy(*table).agg(F.bool_and(F.col("header").rlike(r"^\d+$")).alias("digits"))
    high = cells.groupBy(*table).agg(F.count_distinct("row").alias("n"), F.min("row").alias("first"))
    todo = plain.join(high, table).where("digits and n >= 2").select(*table, "first")
    moved = cells.join(todo, table)
    new = moved.where("row = first").select(*table, "col", F.trim("raw").alias("header"))
    return cells.join(todo.withColumnRenamed("first", "row"), [*table, "row"], "left_anti"), headers.join(todo, table, "left_anti").select(*table, "col", "header").unionByName(new)


def merge_header_rows(headers: DataFrame, second: DataFrame, table: list[str], share: float = 0.4) -> DataFrame:
    """Headers (table..., col, header) take the labels of the next row for columns without names, where it labels a share of those (one at least); elements are no labels."""
    label = second.where(strings.element_header(F.col("raw")).isNull() & ~F.coalesce(numbers.plain_float(F.col("raw")).isNotNull(), F.lit(False))).select(*table, "col", F.trim("raw").alias("label"))
    rows = headers.join(label, [*table, "col"], "left").withColumn("__open", F.col("header").rlike(r"(?i)^(unnamed.*)?$"))
    over = Window.partitionBy(*table)
    enough = F.count_if(F.col("__open") & F.col("label").isNotNull()).over(over) >= F.greatest(F.lit(1.0), share * F.count_if("__open").over(over))
    return rows.withColumn("__e", enough).select(*table, "col", F.when(F.col("__e") & F.col("__open"), F.coalesce("label", "header")).otherwise(F.col("header")).alias("header"))


def clean_cells(cells: DataFrame) -> DataFrame:
    """Trimmed cells; empty ones go, and with them empty rows and columns."""
    return cells.withColumn("raw", F.trim("raw")).where("raw <> ''")


def unique_headers(headers: DataFrame, table: list[str]) -> DataFrame:
    """The second Total becomes Total_1, and so on."""
    k = F.row_number().over(Window.partitionBy(*table, "header").orderBy("col")) - 1
    return headers.withColumn("__k", k).withColumn("header", F.when(F.col("__k") > 0, F.concat_ws("_", "header", "__k")).otherwise(F.col("header"))).drop("__k")


def column_profile(cells: DataFrame, table: list[str], value: str = "raw") -> DataFrame:
    """For each column the share of rows with a value, of numbers and of different ones among them."""
    v = F.when(F.trim(value) != "", F.trim(value))
    n_rows = cells.groupBy(*table).agg(F.count_distinct("row").alias("n_rows"))
    by = cells.groupBy(*table, "col").agg(F.count(v).alias("n"), F.count(numbers.plain_float(v)).alias("n_numeric"), F.count_distinct(v).alias("n_distinct"))
    share = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 6)
    return by.join(n_rows, table).select(*table, "col", "n", "n_distinct", share("n", "n_rows").alias("coverage"), share("n_numeric", "n").alias("numeric"), share("n_distinct", "n").alias("uniqueness"))


def role_columns(headers: DataFrame, table: list[str], roles: dict[str, list[str]] | None = None) -> DataFrame:
    """(table..., role, col): for each role the first column whose lower-cased name is one of the role's."""
    name = F.lower(F.trim("header"))
    named = F.array_compact(F.array(*[F.when(name.isin(*names), F.lit(role)) for role, names in (roles or ROLES).items()]))
    return headers.withColumn("role", F.explode(named)).groupBy(*table, "role").agg(F.min("col").alias("col"))


def sample_id_column(headers: DataFrame, profile: DataFrame, table: list[str]) -> DataFrame:
    """(table..., col) of the sample id.

    The first candidate by name if 30 percent of its rows have values; else the first
    later candidate that half of the rows have, not numeric and mostly different; else the
    first of five columns that is mostly different and neither an element nor a unit; else
    the first column.
    """
    named = F.lower(F.trim("header")).isin(*ROLES["sample_id"])
    rows = headers.join(profile, [*table, "col"], "left").withColumns({"__named": named, "__first": F.min(F.when(named, F.col("col"))).over(Window.partitionBy(*table))})
    good = (F.col("coverage") >= 0.5) & (F.col("numeric") < 0.5) & (F.col("uniqueness") > 0.5)
    other = (F.col("col") < 5) & (F.col("uniqueness") > 0.7) & strings.element_header(F.col("header")).isNull() & numbers.header_unit(F.col("header")).isNull()
    choice = F.when(F.col("__named") & (F.col("col") == F.col("__first")) & (F.col("coverage") >= 0.3), 0).when(F.col("__named") & (F.col("col") > F.col("__first")) & good, 1).when(other, 2).otherwise(3)
    return rows.groupBy(*table).agg(F.min(F.struct(choice.alias("c"), "col"))["col"].alias("col"))


def element_columns(headers: DataFrame, table: list[str]) -> DataFrame:
    """(table..., col, header, element, unit) of element columns; unit as the header says."""
    rows = headers.withColumns({"element": strings.element_header(F.col("header")), "unit": numbers.header_unit(F.col("header"))})
    return rows.where("element is not null").select(*table, "col", "header", "element", "unit")


def unit_rows(cells: DataFrame, table: list[str], first: int = 3) -> DataFrame:
    """(table..., row): rows of units among a table's first data rows: two unit marks or more, and 30 percent of the cells."""
    start = F.min("row").over(Window.partitionBy(*table))
    rows = cells.withColumn("__s", start).where(F.col("row") < F.col("__s") + first).where("trim(raw) <> ''")
    unit = numbers.header_unit(F.col("raw")).isNotNull()
    return rows.groupBy(*table, "row").agg(F.count("*").alias("n"), F.count_if(unit).alias("u")).where("u >= 2 and u >= 0.3 * n").groupBy(*table).agg(F.min("row").alias("row"))


def transposed(cells: DataFrame, headers: DataFrame, table: list[str]) -> DataFrame:
    """(table..., label_col): tables with under 3 element headers where one of the first 3 columns has 5 element labels or more, 30 percent of its cells."""
    few = settle(headers.groupBy(*table).agg(F.count_if(strings.element_header(F.col("header")).isNotNull()).alias("k")).where("k < 3").select(*table))
    # The cells of other tables are not read for elements.
    by = cells.where("col < 3 and trim(raw) <> ''").join(few, table, "left_semi").groupBy(*table, "col").agg(F.count("*").alias("n"), F.count_if(strings.element_header(F.col("raw")).isNotNull()).alias("e"))
    return by.where("e >= 5 and e >= 0.3 * n").groupBy(*table).agg(F.min("col").alias("label_col"))


def transpose(cells: DataFrame, which: DataFrame, table: list[str]) -> DataFrame:
    """Cells of the given tables with rows and columns swapped, of all others as they are."""
    flip = cells.join(which.select(*table, F.lit(True).alias("__t")), table, "left")
    swap = F.coalesce("__t", F.lit(False))
    return flip.select(*table, F.when(swap, F.col("col")).otherwise(F.col("row")).alias("row"), F.when(swap, F.col("row")).otherwise(F.col("col")).alias("col"), "raw")


def numeric_cells(cells: DataFrame, headers: DataFrame, table: list[str]) -> DataFrame:
    """(table..., row, col, raw, value, row_label, header, cell_index) of numeric cells; a row's label is its first cell."""
    core = F.trim(F.regexp_replace(F.split_part("raw", F.lit("±"), F.lit(1)), r"\(.*?\)", ""))
    marked = F.when(F.col("raw").rlike("[0-9]"), numbers.plain_float(F.replace(F.regexp_replace(core, r"^[<>~]\s*|\s*%$", ""), F.lit(","), F.lit(""))))
    value = F.coalesce(numbers.plain_float(F.col("raw")), marked)
    label = F.max(F.when(F.col("col") == 0, F.col("raw"))).over(Window.partitionBy(*table, "row"))
    rows = cells.withColumn("value", value).withColumn("row_label", label).where("value is not null").join(headers.select(*table, "col", "header"), [*table, "col"], "left")
    return rows.withColumn("cell_index", F.format_string("CA(%d,%d)", F.col("row") + 1, F.col("col")))


def by_text(rows: DataFrame, text: Column, read) -> DataFrame:
    """rows with the columns that read (of a table with a column of texts, and its name) makes of each distinct text, null too; it leaves texts out with their rows."""
    # What is read of a grouping column, the optimizer would read of every row before the grouping.
    rows = rows.withColumn("__text", text)
    once = rows.groupBy("__text").agg(F.first("__text").alias("__said")).select("__said")
    return rows.join(read(once, "__said"), F.col("__text").eqNullSafe(F.col("__said"))).drop("__text", "__said")


def interpret_headers(headers: DataFrame, table: list[str], domain: str, caption: Column | None = None) -> DataFrame:
    """Type, unit and target of assay headers; component and unit of composition headers (mol if neither header nor caption names it)."""
    h, low = F.col("header"), F.lower("header")
    if domain == "assay":
        kind = strings.first_pattern(h, vocab.ASSAY_TYPES, "xx")
        pattern = "|".join(p.replace(" ", r"\s") for p, _ in vocab.ASSAY_TYPES)
        target = F.trim(F.regexp_replace(F.regexp_extract(low, rf"^(.*?)(?:{pattern})", 1), r"[\s,;:(\[_-]+$", ""))
        unit = strings.canonical(F.regexp_extract(h, r"[(\[]\s*([^)\]]+?)\s*[)\]]", 1), vocab.ASSAY_UNITS, keep=False, blanks=True)
        return headers.withColumns({"type": kind, "unit": F.coalesce(unit, F.lit("xx")), "target": F.when(target != "", F.substring(h, F.lit(1), F.length(target))).otherwise("xx"), "is_data": kind != "xx"})
    if domain == "result":
        return headers.withColumns(_named_parts(low) | {"is_data": F.lit(True)})
    name = F.regexp_replace(low, r"\s*[(\[].*$|\s+(mol|wt|mass|at)[^a-z].*$|\s+(mol|wt|mass|at)$", "")
    component = F.coalesce(component_of(h), component_of(name))
    unit = F.coalesce(numbers.glass_unit(h), numbers.glass_unit(caption) if caption is not None else F.lit(None).cast("string"), F.lit("mol"))
    return headers.withColumns({"component": component, "unit": unit, "is_data": component.isNotNull()})


def _named_parts(low: Column) -> dict[str, Column]:
    """What a lower-cased header or row label names: metric, dataset, task, statistic and parameter, each the first part that the vocabulary knows."""
    parts = F.transform(F.split(low, r"[/|(),:;\[\]]| - | on "), lambda x: F.trim(x))

    def first(known):
        # A whole name counts before a word of it.
        found = F.array_compact(F.transform(F.concat(F.array(low), parts, F.flatten(F.transform(parts, lambda p: F.split(p, " ")))), lambda x: F.try_element_at(strings.table(known), x)))
        return F.get(found, 0)

    names = {"metric": vocab.METRICS, "dataset": vocab.DATASETS, "task": vocab.TASKS, "statistic": vocab.STATISTICS, "parameter": vocab.PARAMETERS}
    return {name: first(known) for name, known in names.items()}


def assemble(cells: DataFrame, headers: DataFrame, table: list[str], domain: str) -> DataFrame:
    """Records of numeric cells in data columns."""
    data = headers.where("is_data").drop("header", "is_data")
    rows = cells.join(data, [*table, "col"])
    if domain == "result":
        # What the header does not say, the row's label may; a row that names no measure is a model.
        names = ["metric", "dataset", "task", "statistic", "parameter"]
        said = [f"__{k}" for k in names]
        rows = by_text(rows, F.lower(F.trim("row_label")), lambda df, c: df.select(c, *(v.alias(f"__{k}") for k, v in _named_parts(F.col(c)).items())))
        part = lambda k: F.coalesce(F.col(k), F.col(f"__{k}"))
        kind = F.when(part("parameter").isNotNull(), "Hyper-parameter/Architecture").when(part("statistic").isNotNull(), "Data Stat.").when(part("metric").isNotNull(), "Result").otherwise("Other")
        model = F.when(F.coalesce(*said).isNull(), F.trim("row_label"))
        out = rows.select(*table, "row", "col", F.trim("raw").alias("value"), kind.alias("type"), model.alias("model"), part("dataset").alias("dataset"), part("metric").alias("metric"), part("task").alias("task"), part("statistic").alias("attribute_name"), part("parameter").alias("parameter_name"), "cell_index")
        return out.where("type <> 'Other'")
    if domain == "assay":
        return rows.where("type not in ('xx', 'Other')").select(*table, "row", "col", F.col("raw").alias("value"), "type", "target", F.coalesce("row_label", F.lit("xx")).alias("treatment"), "unit", "cell_index")
    sample = F.concat_ws("_", *table, F.col("row").cast("string"), F.col("row_label"))
    return rows.where("value <> 0").select(*table, "row", "col", sample.alias("sample_id"), "component", F.round("value", 5).alias("value"), "unit")


def is_data_table(cells: DataFrame, table: list[str]) -> DataFrame:
    """(table..., n_rows, n_cols, n_numeric, is_data): 3 rows, 3 columns and 5 numeric cells in the first 10 rows, or more."""
    plain = F.regexp_replace("raw", "[,<>]", "")
    numeric = F.count_if((F.col("row") < 10) & numbers.plain_float(plain).isNotNull())
    by = cells.groupBy(*table).agg(F.count_distinct("row").alias("n_rows"), F.count_distinct("col").alias("n_cols"), numeric.alias("n_numeric"))
    return by.withColumn("is_data", F.expr("n_rows >= 3 and n_cols >= 3 and n_numeric >= 5"))


def is_summary_table(cells: DataFrame, table: list[str], caption: str | None = None) -> DataFrame:
    """(table..., is_summary): a caption with summary, or a word of statistics among the first 5 cells of the first column."""
    words = F.col("raw").rlike(r"(?i)\b(mean|average|median|std|min|max|minimum|maximum)\b")
    said = F.bool_or(F.coalesce(F.lower(caption).contains("summary"), F.lit(False))) if caption else F.lit(False)
    start = F.min("row").over(Window.partitionBy(*table))
    hit = F.bool_or((F.col("col") == 0) & (F.col("row") < F.col("__s") + 5) & words)
    return cells.withColumn("__s", start).groupBy(*table).agg((said | hit).alias("is_summary"))


def render(cells: DataFrame, table: list[str], rows: int = 120, chars: int = 12_000, mark: str = " | ") -> DataFrame:
    """A table as text, a line a row, its first rows and characters."""
    line = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["raw"]), mark)
    lines = cells.where(F.col("row") < rows).groupBy(*table, "row").agg(line(F.struct("col", "raw")).alias("line"))
    return lines.groupBy(*table).agg(F.left(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n"), F.lit(chars)).alias("text"))


def local_ids(rows: DataFrame, table: list[str], name: str, order: str, spot: str | None = None, given: str | None = None) -> DataFrame:
    """sample_local_id: the given one, else name-spot, else name-k in order; no made ids in tables whose names are all different."""
    k = F.row_number().over(Window.partitionBy(*table, name).orderBy(order))
    over = Window.partitionBy(*table)
    out = rows.withColumns({"__k": k, "__n": F.count("*").over(Window.partitionBy(*table, name))}).withColumn("__m", F.max("__n").over(over))
    made = F.when(F.col("__m") > 1, F.concat_ws("-", name, F.col("__k").cast("string")))
    if spot:
        made = F.when(F.col(spot).isNotNull(), F.concat_ws("-", name, F.concat(F.lit("spot"), F.col(spot).cast("string")))).otherwise(made)
    return out.withColumn("sample_local_id", F.coalesce(F.col(given), made) if given else made).drop("__k", "__n", "__m")


def sample_names(cells: DataFrame, headers: DataFrame, table: list[str], ids: DataFrame, fill: bool = True, only_samples: bool = True) -> DataFrame:
    """(table..., row, sample_name, mineral, sample_local_id) of data rows, in one pass over the cells.

    Sparse ids are filled downwards; rows that name no sample are left out; repeated names
    get local ids, by the column of spots where a table has one.
    """
    elements = element_columns(headers, table).groupBy(*table).agg(F.collect_set("col").alias("__e"))
    roles = role_columns(headers, table).where("role in ('mineral', 'spot')").groupBy(*table)
    roles = roles.agg(*[F.max(F.when(F.col("role") == r, F.col("col"))).alias(f"__{r}") for r in ("mineral", "spot")])
    places = ids.select(*table, F.col("col").alias("__id")).join(elements, table, "left").join(roles, table, "left")
    at = lambda c: F.max(F.when(F.col("col") == F.col(c), F.nullif(F.trim("raw"), F.lit(""))))
    data = F.bool_or(F.array_contains("__e", F.col("col")) & numbers.plain_float(F.col("raw")).isNotNull())
    # A column of spots that is the id itself gives no second part.
    spot = F.max(F.when((F.col("col") == F.col("__spot")) & (F.col("__spot") != F.col("__id")), F.nullif(F.trim("raw"), F.lit(""))))
    rows = cells.join(places, table).groupBy(*table, "row").agg(at("__id").alias("sample_name"), at("__mineral").alias("mineral"), spot.alias("__at"), data.alias("__has"))
    if fill:
        rows = fill_sparse_ids(rows, table, "row", "sample_name", F.coalesce("__has", F.lit(False)))
    rows = rows.where(is_sample(F.col("sample_name")) if only_samples else F.col("sample_name").isNotNull())
    return local_ids(rows, table, "sample_name", "row", "__at").drop("__at", "__has")


def measurements(cells: DataFrame, headers: DataFrame, table: list[str], ids: DataFrame, least: int = 3, fill: bool = True, only_samples: bool = True) -> DataFrame:
    """Long records of tables with enough element columns.

    cells without header; headers: table..., col, header; ids: table..., col of the sample
    id.  Columns (table..., row, sample_name, sample_local_id, mineral, element, value_ppm,
    state, detection_limit, original_value, original_unit).  A column's unit is its header's,
    else that of the unit row, else wt% by the range of a major element's values in a table
    that is not ppm throughout, else ppm.  `fill` and `only_samples`: see sample_names.
    """
    elements = element_columns(headers, table)
    enough = elements.groupBy(*table).agg(F.count_distinct("element").alias("k")).where(F.col("k") >= least).select(*table)
    units = unit_rows(cells, table)
    stated = cells.join(units, [*table, "row"], "left_semi").select(*table, "col", numbers.header_unit(F.col("raw")).alias("row_unit"))
    body = cells.join(units, [*table, "row"], "left_anti").join(enough, table, "left_semi")
    names = sample_names(body, headers, table, ids, fill, only_samples)
    parsed = body.join(elements.join(stated, [*table, "col"], "left"), [*table, "col"]).withColumn("cell", numbers.parse_cell(F.col("raw")))
    totals = cells.join(headers.where("lower(trim(header)) = 'total'").select(*table, "col"), [*table, "col"], "left_semi")
    near = totals.groupBy(*table).agg(F.avg(numbers.plain_float(F.col("raw"))).between(85, 110).alias("percent_total"))
    ranged = numbers.percent_by_range(parsed.select(*table, "element", F.col("cell.value").alias("v")), table, "element", "v").select(*table, "element", "is_percent")
    rows = parsed.join(near, table, "left").join(ranged, [*table, "element"], "left")
    guess = F.when(F.coalesce("percent_total", F.lit(False)) & F.coalesce("is_percent", F.lit(False)), "wt%").otherwise("ppm")
    rows = rows.withColumn("unit", F.coalesce("unit", "row_unit", guess))
    return rows.join(names, [*table, "row"]).select(
        *table, "row", "sample_name", "sample_local_id", "mineral", "element",
        F.round(numbers.to_ppm(F.col("cell.value"), F.col("unit")), 6).alias("value_ppm"),
        F.col("cell.state").alias("state"),
        F.round(numbers.to_ppm(F.col("cell.detection_limit"), F.col("unit")), 6).alias("detection_limit"),
        F.coalesce(F.col("cell.value"), F.col("cell.detection_limit")).alias("original_value"),
        F.col("unit").alias("original_unit"),
    )
