"""Row filters, plausibility checks and validation against vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import numbers, strings, vocab
from tablewright.operators.dictionary import found_names

NOTE_MARKS = r"^(Note:|note:|\*|†|‡|§)"
#: How a text that is no sample name starts.
NOT_A_SAMPLE = ["note", "source", "remark", "abbreviation", "detection limit", "mean", "average", "median", "std", "standard deviation", "min", "max", "total"]


def _starts(low: Column, names: list[str]) -> Column:
    """Whether a lower-cased text starts with one of some names, as a whole word."""
    return low.rlike("^" + strings.one_of(names) + "(?![0-9a-z_])")


def _words(low: Column) -> Column:
    """Runs of letters and digits of a lower-cased text."""
    return F.filter(F.split(low, "[^0-9a-z]+"), lambda w: w != "")


def is_statistic(name: Column) -> Column:
    """a row of statistics: it starts with one's name, has one among its words, or says how many spots it is of (n = 24)."""

    def counted(low, tight):
        # n = at the start, in brackets, or after a mineral's short name.
        count = F.split_part(tight, F.lit("n="), F.lit(1))
        return tight.contains("n=") & ((count == "") | (count.endswith("(") & tight.rlike(r"n=[0-9]+[)]")) | (F.length(count).between(2, 4) & F.contains(low, F.lit(" n"))))

    def told(low):
        word = low.rlike("(?<![0-9a-z])" + strings.one_of(vocab.STATISTIC_WORDS) + "(?![0-9a-z])")
        return _starts(low, vocab.STATISTIC_ROWS) | word | strings.bound(F.replace(low, F.lit(" "), F.lit("")), lambda tight: counted(low, tight))

    return strings.bound(strings.collapse(F.lower(name)), told)


def is_heading(name: Column) -> Column:
    """a row of units or of remarks on the table, or a header row that came with the data."""
    return strings.bound(strings.collapse(F.lower(name)), lambda low: _starts(low, vocab.UNIT_ROWS + vocab.NOTE_ROWS) | (low == "sample"))


def is_reference_material(name: Column) -> Column:
    """the letters of a reference material and its number (MASS-1, G_NIST610, BHVO-2G), with s_ or g_ of sulfide and glass standards before them."""
    low = F.replace(strings.collapse(F.lower(name)), F.lit("nist srm"), F.lit("nistsrm"))

    def told(low, letters):
        number = F.ltrim(F.substr(low, F.length(letters) + 1), F.lit(" _-"))
        known = F.array(*map(F.lit, vocab.ROW_STANDARDS))
        shorter = F.substr(letters, F.lit(2))
        series = F.when(F.array_contains(known, letters), letters).when(F.left(letters, F.lit(1)).isin("s", "g") & F.array_contains(known, shorter), shorter)
        # A few stand alone, or with a word in place of the number.
        bare = ((series == "nist") & (number == "")) | ((series == "usgs") & (F.size(_words(low)) == 2)) | low.startswith("stdgl") | (low == "reference standard")
        return F.coalesce(bare, F.lit(False)) | F.coalesce(number.rlike("^[0-9]+[a-z]?$") & series.isNotNull(), F.lit(False))

    own = lambda low: F.when(F.left(low, F.lit(2)).isin("s_", "g_"), F.substr(low, F.lit(3))).otherwise(low)
    # Most names start like none of them.
    like = "^[sg]?" + strings.one_of(vocab.ROW_STANDARDS) + "|^stdgl|^reference standard"
    read = lambda x: F.when(x.rlike(like), strings.bound(F.regexp_replace(x, "[^a-z].*$", ""), lambda letters: told(x, letters)))
    return F.coalesce(strings.bound(strings.bound(low, own), read), F.lit(False))


def is_note(c: Column) -> Column:
    """a blank, a text of over 80 characters, a sentence of over 30, or one with a note's mark."""
    s = F.trim(c)
    return (s == "") | (F.length(s) > 80) | (s.endswith(".") & s.contains(" ") & (F.length(s) > 30)) | s.rlike(NOTE_MARKS)


def is_citation(c: Column) -> Column:
    """a source line, authors with a year, or a year before a name."""
    low = F.lower(c)
    authors = F.regexp_extract(low, r"\bet\s+al[.]?(.*)", 1)
    return low.contains("source:") | F.ltrim(authors).rlike(r"^(,\s*|\()\d{4}") | low.rlike(r"^\d{4}[a-z]?\s+[a-z]{2}")


def is_sample(name: Column) -> Column:
    """whether a row's sample id names a sample: no statistics, reference material, note, citation or blank."""
    bad = is_statistic(name) | is_heading(name) | is_reference_material(name) | is_note(name) | is_citation(name)
    return name.isNotNull() & ~F.trim(name).isin("", "nan", "None", "NaN") & ~bad


def data_source(c: Column) -> Column:
    """this_study, or cited_study with the citation's first 50 characters."""
    s = F.lower(F.trim(c))
    cited = s.startswith("source:") | s.rlike(r"\bet\s+al\.?\s*[,(]\s*\d{4}")
    return F.when(cited, F.concat(F.lit("cited_study:"), F.left(F.trim(c), F.lit(50)))).otherwise("this_study")


def sample_rows(rows: DataFrame, table: list[str], name: str, deposit: str | None = None, wanted: str | None = None) -> DataFrame:
    """sample rows; with a wanted deposit, only those whose deposit equals, contains or is contained in it, where that keeps some but not all rows of a table."""
    out = rows.where(is_sample(F.col(name)))
    if not deposit or not wanted:
        return out
    d, w = F.lower(F.trim(deposit)), F.lit(wanted.strip().lower())
    fits = (F.coalesce(d, F.lit("")) == "") | d.contains(w) | F.contains(w, d)
    over = Window.partitionBy(*table)
    some = F.count_if(fits).over(over).between(F.lit(1), F.count("*").over(over) - 1)
    return out.withColumns({"__fits": fits, "__some": some}).where(~F.col("__some") | F.col("__fits")).drop("__fits", "__some")


def is_non_sample(name: Column) -> Column:
    """a name of over 100 characters, or one that starts like a note or a statistic."""
    return (F.length(name) > 100) | _starts(F.lower(F.ltrim(name)), NOT_A_SAMPLE)


def capped_removal(rows: DataFrame, table: list[str], flag: Column, order: str, share: float = 0.2) -> DataFrame:
    """flagged rows leave, the first in order first, at most a share of a table's rows (and one at least)."""
    over = Window.partitionBy(*table)
    most = F.greatest(F.lit(1), F.floor(F.lit(share) * F.count("*").over(over)))
    flagged = F.coalesce(flag, F.lit(False))
    place = F.sum(flagged.cast("int")).over(over.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"__f": flagged, "__k": place, "__m": most}).where(~F.col("__f") | (F.col("__k") > F.col("__m"))).drop("__f", "__k", "__m")


def is_unsafe_name(name: Column) -> Column:
    """a name that is a statistic and nothing else, has a count of analyses in brackets, or starts a source line."""
    # As the other filters, it names the text once.
    return strings.bound(strings.collapse(F.lower(name)), lambda low: _unsafe(low, F.replace(low, F.lit(" "), F.lit(""))))


def _unsafe(low: Column, tight: Column) -> Column:
    return low.isin(*vocab.SAFE_REMOVALS) | (tight == "n=") | tight.rlike(r"[(]n=[0-9]+[)]") | low.startswith("source: ")


def may_be_relevant(text: Column) -> Column:
    """a table's text of 30 characters or more with a digit among the first 500."""
    return F.coalesce((F.length(text) >= 30) & F.left(text, F.lit(500)).rlike("[0-9]"), F.lit(False))


def valid_assays(rows: DataFrame, types: list[str]) -> DataFrame:
    """assay records of a known type, other than those not tested, with canonical units and targets."""
    return assay_names(tested(rows, types))


def tested(rows: DataFrame, types: list[str]) -> DataFrame:
    """assay records of a known type, other than those not tested."""
    return rows.where(F.col("type").isin(*types) & ~F.coalesce(F.lower(F.trim("value")).isin(*vocab.NOT_TESTED), F.lit(False)))


def assay_names(rows: DataFrame) -> DataFrame:
    """canonical units and targets."""
    return rows.withColumns({"unit": strings.canonical(F.col("unit"), vocab.ASSAY_UNITS, blanks=True), "target": strings.canonical(F.col("target"), vocab.TARGETS)})


def component_of(c: Column) -> Column:
    """The formula of a component by its formula (any case, blanks and a closing bracket such as (mol%) aside) or its name; null for others."""
    low = strings.collapse(F.lower(c))
    formulas = {f.lower().replace(" ", ""): f for f in [*vocab.COMPOUNDS, *vocab.COMPONENT_ELEMENTS]}
    bare = F.regexp_replace(low, r"\s*[(][^()]*[)]$", "")
    tries = [F.try_element_at(strings.table(known), F.replace(x, F.lit(" "), F.lit("")) if known is formulas else x) for x in (low, bare) for known in (formulas, vocab.COMPONENT_NAMES)]
    return F.coalesce(*tries)


def valid_compositions(rows: DataFrame) -> DataFrame:
    """composition records of a known component with a value; unknown units are mol."""
    return with_value(component_names(rows))


def component_names(rows: DataFrame) -> DataFrame:
    """known components by their formulas, others left out; unknown units are mol."""
    unit = F.coalesce(numbers.glass_unit(F.col("unit")), F.lit("mol"))
    return rows.withColumns({"component": component_of(F.col("component")), "unit": unit}).where("component is not null")


def with_value(rows: DataFrame) -> DataFrame:
    """composition records whose value is one."""
    return rows.where(null_kind(F.col("value"), "composition") == "none")


def valid_results(rows: DataFrame) -> DataFrame:
    """result records of a known type (canonical), with canonical metrics, tasks, attributes, parameters, datasets and models, where there are such columns."""
    kind = F.coalesce(strings.canonical(F.col("type"), vocab.RESULT_TYPE_NAMES, keep=False), F.col("type"))
    out = rows.withColumn("type", kind).where(F.col("type").isin(*vocab.RESULT_TYPES))
    names = {"metric": vocab.METRICS, "task": vocab.TASKS, "attribute_name": vocab.STATISTICS, "parameter_name": vocab.PARAMETERS, "dataset": vocab.DATASETS, "model": vocab.MODELS}
    return out.withColumns({c: strings.canonical(F.col(c), v) for c, v in names.items() if c in rows.columns})


def null_kind(value: Column, domain: str) -> Column:
    """what a value's words say instead of a value, none if it is one."""
    s = F.lower(F.trim(value))
    if domain == "assay":
        return F.when(s.isin(*vocab.NOT_TESTED), "not_tested").when(s.startswith(">"), "inactive").when(s.startswith("<"), "below_detection").otherwise("none")
    if domain == "composition":
        return F.when(s.isNull() | s.isin(*vocab.NOT_REPORTED_WORDS), "not_reported").when(s.isin(*vocab.ZERO_WORDS), "zero_component").otherwise("none")
    return F.when(s.isNull() | s.isin(*vocab.NOT_REPORTED_WORDS, *vocab.ZERO_WORDS[:4]), "not_reported").otherwise("none")


def check_picklist(values: DataFrame, picklist: DataFrame, field: str, value: str, least: float = 0.5) -> DataFrame:
    """(field, value, status, canonical): exact (any case), suggestion (one contains the other; best ratio of lengths above the least), unknown, or unlisted.

    picklist: field, term.  Which of the distinct values holds which term, or lies in it, is found by two scans with automata
    (found_names), not by comparing a field's values with all its terms.
    """
    v = values.select(field, value).distinct().where(F.col(value).isNotNull()).withColumn("__low", F.lower(F.trim(value)))
    terms = picklist.select(F.col("field").alias(field), "term").where("term is not null").distinct().withColumn("__t", F.lower("term"))
    lows, wanted = v.select("__low").distinct(), terms.select("__t").distinct()
    inside = found_names(lows, ["__low"], "__low", wanted, "__t").withColumnRenamed("name", "__t")
    around = found_names(wanted, ["__t"], "__t", lows, "__low").withColumnRenamed("name", "__low")
    ratio = F.least(F.length("__low"), F.length("__t")) / F.greatest(F.length("__low"), F.length("__t"))
    pairs = inside.unionByName(around).distinct().withColumn("score", F.when(F.col("__low") == F.col("__t"), 2.0).when(ratio > least, ratio)).where("score is not null")
    best = v.join(pairs, "__low").join(terms, [field, "__t"]).groupBy(field, value).agg(F.max_by("term", F.struct("score", "term")).alias("canonical"), F.max("score").alias("score"))
    listed = terms.select(field).distinct().withColumn("__listed", F.lit(True))
    got = v.join(best, [field, value], "left").join(listed, field, "left")
    status = F.when(F.col("__listed").isNull(), "unlisted").when(F.col("score") == 2, "exact").when(F.col("score").isNotNull(), "suggestion").otherwise("unknown")
    return got.select(field, value, status.alias("status"), "canonical")


def check_metadata(rows: DataFrame) -> DataFrame:
    """implausible metadata become null (doi, url, title, journal, country, latitude, longitude), where there are such columns."""
    ok = {
        "doi": lambda c: c.rlike(r"^10\.\d{4,9}/\S+$"),
        "url": lambda c: c.rlike(r"^https?://\S+$"),
        "title": lambda c: F.length(c).between(8, 400),
        "journal": lambda c: (F.length(c) <= 200) & ~c.rlike(r"^(https?://|10\.\d{4,9}/)"),
        "country": lambda c: (F.length(c) >= 3) & c.rlike("[A-Za-z]"),
    }
    out = rows
    for name, test in ok.items():
        if name in rows.columns:
            c = F.trim(name)
            out = out.withColumn(name, F.when(test(c), c))
    if "journal" in rows.columns and "title" in rows.columns:
        out = out.withColumn("journal", F.when(~F.lower("journal").eqNullSafe(F.lower("title")), F.col("journal")))
    for name, limit in (("latitude", 90), ("longitude", 180)):
        if name in rows.columns:
            out = out.withColumn(name, numbers.coordinate(F.col(name), limit))
    return out


def quick_quality(cells: DataFrame, table: list[str], named: DataFrame, expected: int = 15) -> DataFrame:
    """score of 0 to 100 (40 rows, 30 elements against `expected`, 20 ids, 10 no uniform column), and whether it passes.

    cells: table..., row, element, value; named: table..., has_id.
    """
    by_element = cells.groupBy(*table, "element").agg(F.count("value").alias("n"), F.count_distinct("value").alias("d"))
    uniform = by_element.groupBy(*table).agg(F.count_if(F.col("n") > 0).alias("n_elements"), F.count_if((F.col("n") > 3) & (F.col("d") == 1)).alias("n_uniform"))
    rows = cells.groupBy(*table).agg(F.count_distinct("row").alias("n_rows"))
    all_ = rows.join(uniform, table).join(named, table, "left")
    points = F.when(F.col("n_rows") > 0, 40).otherwise(0) + F.least(F.lit(30.0), 30.0 * F.col("n_elements") / expected) + F.when(F.coalesce("has_id", F.lit(False)), 20).otherwise(0) + F.when(F.col("n_uniform") == 0, 10).otherwise(0)
    return all_.select(*table, "n_rows", "n_elements", "n_uniform", F.round(points, 2).alias("score"), ((F.col("n_rows") >= 1) & (F.col("n_elements") >= 3)).alias("passed"))


def page_score(text: Column, strong: list[str], weak: list[str], references: list[str]) -> Column:
    """how likely a page holds data: 0.3 of its marks and 0.7 of its numeric lines, halved when evidence is weak; null for a page of references."""
    low = F.lower(text)
    times = lambda m: ((F.length(low) - F.length(F.replace(low, F.lit(m), F.lit("")))) / len(m)).cast("int")
    total = lambda ms: sum((times(m) for m in ms), F.lit(0))
    digits = lambda x: F.length(F.regexp_replace(x, r"[^0-9.]", ""))
    numeric = F.size(F.filter(F.split(text, "\n"), lambda x: (digits(x) > 10) & (digits(x) > 0.15 * F.length(x)) & ~F.lower(x).rlike("doi|http")))
    marks = total(strong) + total(weak)
    score = 0.3 * marks + 0.7 * numeric
    return F.when(total(references) >= 3, F.lit(None).cast("double")).when((marks >= 2) & (numeric >= 2), score).when((marks >= 1) & (numeric >= 1), score / 2).otherwise(0.0)


def sum_check(rows: DataFrame, keys: list[str], value: str, target: float = 100.0, tolerance: float = 5.0) -> DataFrame:
    """sums by sample, and whether each is near enough to the target."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("total")).withColumn("valid", F.abs(F.col("total") - target) <= tolerance)


def grounded(attributes: Column, text: Column, most: int = 5) -> Column:
    """entries of a map with a word (other than of and number) of key or value in the text, the first few; an unknown marker if none."""
    low = F.lower(text)
    entry_words = lambda e: F.filter(F.split(F.lower(F.concat_ws(" ", e["key"], e["value"])), r"\s+"), lambda w: ~w.isin("", "of", "number"))
    kept = F.slice(F.filter(F.map_entries(attributes), lambda e: F.exists(entry_words(e), lambda w: low.contains(w))), 1, most)
    return F.when(F.size(kept) > 0, F.map_from_entries(kept)).otherwise(F.create_map(F.lit("xx"), F.lit("yy")))
