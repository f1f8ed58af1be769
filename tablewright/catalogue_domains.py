"""Queries for the text helpers, table forms and domain pipelines, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.catalogue import _graph, _read, query
from tablewright.functions import answers, numbers, strings, vocab
from tablewright.operators import filters, grid
from tablewright.plans import graph, models, pipelines
from tablewright.sources import sinks, tables


def _pick(texts: list[str], k):
    return F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))


def _list(texts) -> str:
    return "[" + ", ".join("'" + str(t).replace("'", "''") + "'" for t in texts) + "]"


def _first(text: str, pairs, field: str = "r") -> str:
    """What belongs to the first of the pairs whose pattern a lower-cased text holds."""
    rows = ", ".join(f"{{'p': '{p}', 'r': '{r}'}}" for p, r in pairs)
    return f"list_filter([{rows}], lambda x: contains(lower({text}), x.p))[1].{field}"


_MARKED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"


@query(rf"""SELECT doc_id, md5(regexp_replace(translate(text, '{_MARKED}', '{_PLAIN}'), '[^\x00-\x7f]', '', 'g')) AS folded,
md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))) AS page,
CASE WHEN trim(text) NOT IN ('', 'nan', 'None', 'NaN') THEN md5(trim(text)) END AS clean FROM documents""")
def text_cleaners(spark, sf_dir):
    """Whole texts without accents, as page text, and as values."""
    text = F.col("text")
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(strings.ascii_fold(text)).alias("folded"), F.md5(strings.page_text(text)).alias("page"), F.md5(strings.clean_value(text)).alias("clean"))


_METHODS, _DEPOSITS = list(vocab.METHODS.items()), [(d[0], d[1]) for d in vocab.DEPOSITS]
_GROUPS = [(d[0], d[2]) for d in vocab.DEPOSITS]
_COUNTRY = [(f" {n} ", c) for n, c in vocab.COUNTRIES.items()]


@query(f"""WITH p AS (
  SELECT p_partkey, p_name || ' by ' || upper({_list(vocab.METHODS)}[p_partkey % {len(vocab.METHODS)} + 1]) || ' of a ' || {_list(d[0] for d in vocab.DEPOSITS)}[p_partkey % {len(vocab.DEPOSITS)} + 1] || ' in ' ||
    {_list(vocab.COUNTRIES)}[p_partkey % {len(vocab.COUNTRIES)} + 1] || '.' AS t FROM part
)
SELECT p_partkey, {_first("t", _METHODS)} AS method, {_first("t", _DEPOSITS)} AS environment, {_first("t", _GROUPS)} AS grp, {_first("' ' || regexp_replace(lower(t), '[^\\p{L}\\p{N}_]+', ' ', 'g') || ' '", _COUNTRY)} AS country FROM p""")
def domain_terms(spark, sf_dir):
    """Methods, deposit environments and groups, and countries that sentences name, over every key of the vocabularies."""
    k = F.col("p_partkey")
    text = F.concat("p_name", F.lit(" by "), F.upper(_pick(list(vocab.METHODS), k)), F.lit(" of a "), _pick([d[0] for d in vocab.DEPOSITS], k), F.lit(" in "), _pick(list(vocab.COUNTRIES), k), F.lit("."))
    p = _read(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    environment, group = strings.deposit_kind(F.col("t"))
    return p.select("p_partkey", strings.first_pattern(F.col("t"), _METHODS).alias("method"), environment.alias("environment"), group.alias("grp"), strings.country_code(F.col("t")).alias("country"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(props->>'$.k' AS DOUBLE) WHEN 1 THEN round(value, 2) ELSE CAST(event_id % 100 AS DOUBLE) END AS v, props || ' ' || CAST(round(value, 2) AS VARCHAR) AS t FROM events)
SELECT event_id, contains(t, CAST(v AS VARCHAR)) OR (v = floor(v) AND contains(t, CAST(CAST(v AS BIGINT) AS VARCHAR))) OR contains(t, printf('%.1f', v)) OR contains(t, printf('%.2f', v)) AS verified FROM e""")
def verified_values(spark, sf_dir):
    """Whether a text has a value in one of four ways of writing it."""
    k = F.col("event_id")
    e = _read(spark, sf_dir, "events")
    value = F.when(k % 3 == 0, F.get_json_object("props", "$.k").cast("double")).when(k % 3 == 1, F.round("value", 2)).otherwise((k % 100).cast("double"))
    return e.select("event_id", numbers.verified(value, F.concat_ws(" ", "props", F.round("value", 2).cast("string"))).alias("verified"))


@query("""WITH r AS (
  SELECT l_orderkey // 8 AS doc_id, l_orderkey AS t, k AS row, unnest([1, 2, 3]) AS col, unnest([CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), '>' || CAST(l_partkey % 9 AS VARCHAR), 'nt']) AS value, 'c' || l_suppkey % 4 AS treatment
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
)
SELECT doc_id, value, CASE col WHEN 1 THEN 'IC50' ELSE 'GI50' END AS type, CASE col WHEN 1 THEN 'EGFR' ELSE 'HeLa' END AS target, treatment, CASE col WHEN 1 THEN 'nM' ELSE 'µM' END AS unit
FROM r WHERE col < 3 QUALIFY row_number() OVER (PARTITION BY doc_id, value, treatment, col ORDER BY t, row, col) = 1""")
def assay_tables(spark, sf_dir):
    """Records of assay tables by their headers, validated and deduplicated; documents are eight orders."""
    l = _read(spark, sf_dir, "lineitem")  # noqa: E741
    cells = F.array(F.concat(F.lit("c"), (F.col("l_suppkey") % 4).cast("string")), F.col("l_quantity").cast("int").cast("string"), F.concat(F.lit(">"), (F.col("l_partkey") % 9).cast("string")), F.lit("nt"))
    doc, table = F.floor(F.col("l_orderkey") / 8).alias("doc_id"), F.col("l_orderkey").alias("table_no")
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("row")
    # A window beside a generator would number the cells.
    body = l.select(doc, table, row, cells.alias("cells")).select("doc_id", "table_no", "row", F.posexplode("cells").alias("col", "raw"))
    headers = l.select(doc, table).distinct().select("doc_id", "table_no", F.posexplode(F.array(*map(F.lit, ["Compound", "EGFR IC50 (nM)", "HeLa GI50 [uM]", "MIC"]))).alias("col", "header"))
    return pipelines.domain_records(body, headers, "assay").select("doc_id", "value", "type", "target", "treatment", "unit")


@query("""WITH r AS (
  SELECT p_partkey // 6 AS doc_id, p_partkey % 6 AS row, p_name, unnest(['SiO2', 'Na2O', 'CaO']) AS component, unnest([CAST(p_size AS DOUBLE), CAST(p_partkey % 5 AS DOUBLE), 12.5]) AS value FROM part
)
SELECT doc_id, doc_id || '_1_' || row || '_' || p_name AS sample_id, component, CAST(value AS VARCHAR) AS value, CASE component WHEN 'CaO' THEN 'mol' ELSE 'wt' END AS unit FROM r WHERE value <> 0""")
def composition_tables(spark, sf_dir):
    """Records of composition tables, whose headers give components by formula or name, and units."""
    p = _read(spark, sf_dir, "part")
    cells = F.array("p_name", F.col("p_size").cast("string"), (F.col("p_partkey") % 5).cast("string"), F.lit("12.5 ± 0.1"), F.lit("8"))
    body = p.select(F.floor(F.col("p_partkey") / 6).cast("long").alias("doc_id"), F.lit(1).alias("table_no"), (F.col("p_partkey") % 6).cast("int").alias("row"), F.posexplode(cells).alias("col", "raw"))
    headers = body.select("doc_id", "table_no").distinct().select("doc_id", "table_no", F.posexplode(F.array(*map(F.lit, ["Glass", "silica (wt%)", "Na2O wt%", "Lime", "density"]))).alias("col", "header"))
    return pipelines.domain_records(body, headers, "composition").select("doc_id", "sample_id", "component", "value", "unit")


@query("""WITH l AS (SELECT o_custkey AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row, o_orderstatus || ' | ' || o_orderpriority || ' | ' || o_orderkey AS line FROM orders)
SELECT t, md5(left(string_agg(line, chr(10) ORDER BY row), 300)) AS text FROM l WHERE row < 8 GROUP BY t""")
def table_texts(spark, sf_dir):
    """Tables of customers' orders as text, eight rows and 300 characters."""
    o = _read(spark, sf_dir, "orders")
    row = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("row")
    rows = o.select(F.col("o_custkey").alias("t"), row, F.array("o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("cells"))
    cells = rows.select("t", "row", F.posexplode("cells").alias("col", "raw"))
    return grid.render(cells, ["t"], 8, 300).withColumn("text", F.md5("text"))


@query("""WITH r AS (SELECT c_nationkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN 'lost' END AS error, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 THEN c_acctbal END AS score, c_custkey % 11 AS n_records FROM customer)
SELECT c_nationkey, c_mktsegment, count(*) AS n_total, count(error) AS n_failed, count(score) AS n_evaluated, round(avg(score), 6) AS mean_score, CAST(sum(n_records) AS BIGINT) AS n_records FROM r GROUP BY ALL""")
def batch_aggregates(spark, sf_dir):
    """Runs by nation and segment: failures, evaluated ones and their mean score."""
    k = F.col("c_custkey")
    rows = _read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.when(k % 7 == 0, "lost").alias("error"), F.when((k % 7 != 0) & (k % 3 != 0), F.col("c_acctbal")).alias("score"), (k % 11).alias("n_records"))
    return pipelines.batch_summary(rows, ["c_nationkey", "c_mktsegment"])


_UNIT_TEXTS = ["mol%", "Mole %", "wt. %", "mass percent", "weight", "%", "at. %", "atomic", "molar", "g/L", ""]


@query(f"""WITH u AS (SELECT p_partkey, {_list(_UNIT_TEXTS)}[p_partkey % {len(_UNIT_TEXTS)} + 1] AS t FROM part)
SELECT p_partkey, CASE WHEN t IN ('mol%', 'Mole %', 'at. %', 'molar') THEN 'mol' WHEN t IN ('wt. %', 'mass percent', 'weight') THEN 'wt' END AS unit FROM u""")
def glass_units(spark, sf_dir):
    """Mol or wt as units of compositions say it."""
    return _read(spark, sf_dir, "part").select("p_partkey", numbers.glass_unit(_pick(_UNIT_TEXTS, F.col("p_partkey"))).alias("unit"))


@query("""SELECT 'analysis:' || l_orderkey || ':s' || l_linenumber AS analysis, any_value('S' || l_linenumber) AS sample_name, min(l_returnflag) AS method, min(l_linestatus) AS mineral,
max(CASE WHEN l_partkey % 2 = 0 THEN l_quantity END) AS cu_ppm, max(CASE WHEN l_partkey % 2 <> 0 THEN l_quantity END) AS zn_ppm
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1 GROUP BY l_orderkey, l_linenumber""")
def flat_graph(spark, sf_dir):
    """Analyses of a graph as rows again, those of one record."""
    flat = graph.flatten(*_graph(spark, sf_dir, properties="columns"), ["cu", "zn"])
    l = _read(spark, sf_dir, "lineitem")  # noqa: E741
    once = l.groupBy("l_orderkey", "l_linenumber").count().where("count = 1").select(F.concat(F.lit("analysis:"), F.col("l_orderkey").cast("string"), F.lit(":s"), F.col("l_linenumber").cast("string")).alias("analysis"))
    return flat.join(once, "analysis", "left_semi")


@query("""WITH c AS (SELECT conv_id, turn, role, lower(text) AS t FROM conversations)
SELECT conv_id, turn, contains(t, 'tion') AS has_first, contains(t, role) OR contains(t, 'sche') AS has_second, NOT (contains(t, 'tion') OR contains(t, role) OR contains(t, 'sche')) AS none FROM c""")
def grounded_attributes(spark, sf_dir):
    """attributes that a turn's text speaks of."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", filters.grounded(F.create_map(F.lit("number of"), F.lit("tion"), F.col("role"), F.lit("sche")), F.col("text")).alias("m"), "role")
    has = lambda k: F.map_contains_key("m", k)
    return c.select("conv_id", "turn", has(F.lit("number of")).alias("has_first"), has(F.col("role")).alias("has_second"), has(F.lit("xx")).alias("none"))


@query("""WITH p AS (SELECT p_partkey, unnest([0, 1, 2]) AS col, unnest(['Name', 'Size', 'Price']) AS h, unnest([p_name, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)]) AS v FROM part),
c AS (SELECT p_partkey, CAST(0 AS INTEGER) AS row, col, h AS raw FROM p UNION ALL SELECT p_partkey, 1, col, v FROM p UNION ALL SELECT p_partkey, 2, col, v FROM p)
SELECT p_partkey, count(*) AS n_cells, string_agg(raw, '|' ORDER BY row, col) AS cells FROM c GROUP BY p_partkey""")
def markdown_tables(spark, sf_dir):
    """Cells of tables in Markdown between other lines."""
    body = F.concat(F.lit("| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" | "), F.col("p_retailprice").cast("string"), F.lit(" |\n"))
    text = F.concat(F.lit("Parts of this table\n\n| Name | Size | Price |\n|---|:---:|--:|\n"), body, body, F.lit("\nend | of it\n"))
    cells = tables.parse_tables(_read(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text", tables.markdown_cells)
    return cells.groupBy("p_partkey").agg(F.count("*").alias("n_cells"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "col", "raw"))), lambda x: x["raw"]), "|").alias("cells"))


_WIDE = sinks.wide_columns(["cu", "zn"])
_HAVE = {
    "sample_name": "'S' || l_orderkey", "cu_ppm": "max(CASE WHEN e = 'cu' THEN v END)", "zn_ppm": "max(CASE WHEN e = 'zn' THEN v END)", "cu_original_unit": "max(CASE WHEN e = 'cu' THEN 'ppm' END)",
    "zn_original_unit": "max(CASE WHEN e = 'zn' THEN 'ppm' END)", "cu_original_value": "max(CASE WHEN e = 'cu' THEN v END)", "zn_original_value": "max(CASE WHEN e = 'zn' THEN v END)",
}


@query(
    "WITH l AS (SELECT l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN 'cu' ELSE 'zn' END AS e, max(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT "
    + ", ".join(f'{_HAVE.get(c, "CAST(NULL AS VARCHAR)")} AS "{c}"' for c in _WIDE)
    + " FROM l GROUP BY l_orderkey"
)
def wide_export(spark, sf_dir):
    """A row a sample in the fixed order of columns, null for those that are not there."""
    l = _read(spark, sf_dir, "lineitem")  # noqa: E741
    long = l.groupBy("l_orderkey", F.when(F.col("l_partkey") % 2 == 0, "cu").otherwise("zn").alias("element")).agg(F.max("l_quantity").alias("value_ppm"))
    long = long.select(F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("sample_name"), "element", "value_ppm", F.col("value_ppm").alias("original_value"), F.lit("ppm").alias("original_unit"))
    return sinks.project(sinks.to_wide(long, ["sample_name"], ["cu", "zn"]), _WIDE)


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS a, CASE WHEN s_suppkey % 3 = 0 THEN 'old' WHEN s_suppkey % 3 = 1 THEN 'type ' || s_nationkey END AS had, s_nationkey, s_suppkey % 90 / 100.0 AS c FROM supplier),
x AS (SELECT *, a < 2 AND c >= 0.3 AS sure FROM s)
SELECT k, CASE WHEN sure THEN 'type ' || s_nationkey ELSE had END AS deposit_type, CASE WHEN sure THEN n_name END AS deposit_environment, CASE WHEN sure THEN round(c, 6) END AS confidence,
CASE WHEN sure AND a = 0 THEN 'second (0.20) | third (0.10)' END AS alternatives, CASE WHEN sure AND had <> 'type ' || s_nationkey THEN had END AS original
FROM x LEFT JOIN nation ON n_nationkey = s_nationkey""")
def applied_classification(spark, sf_dir):
    """Deposit types of ranked answers, applied where the model is sure; what was there is kept beside them."""
    k, c = F.col("s_suppkey"), F.col("s_suppkey") % 90 / 100.0
    name = F.concat(F.lit("type "), F.col("s_nationkey").cast("string"))
    more = F.when(k % 4 == 0, ', {"deposit_type": "second", "confidence": 0.2}, {"deposit_type": "third", "confidence": 0.1}').otherwise("")
    answer = F.when(k % 4 < 2, F.concat(F.lit('As JSON:\n```json\n{"classifications": [{"deposit_type": "'), name, F.lit('", "confidence": '), c.cast("string"), F.lit("}"), more, F.lit("]}\n```"))).otherwise("no idea")
    rows = _read(spark, sf_dir, "supplier").select(k.alias("k"), F.when(k % 3 == 0, "old").when(k % 3 == 1, name).alias("deposit_type"), answer.alias("answer"))
    types = _read(spark, sf_dir, "nation").select(F.concat(F.lit("type "), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("environment"), F.lit("g").alias("grp"))
    out = models.apply_classification(rows, "answer", types)
    return out.select("k", "deposit_type", "deposit_environment", F.round("deposit_type_confidence", 6).alias("confidence"), F.col("deposit_type_alternatives").alias("alternatives"), F.col("deposit_type_original").alias("original"))


@query("""WITH e AS (SELECT event_id, 'd' || (event_id // 40) AS doc_id, event_id // 40 % 2 = 0 AS even, unnest(['fe', 'cu', 'zn']) AS element, unnest([round(abs(value), 2), CAST(event_id AS DOUBLE), event_id % 7 + 1.0]) AS v FROM events)
SELECT doc_id, 'P' || event_id AS sample_name, element, round(CASE WHEN even THEN v * 10000 ELSE v END, 6) AS value_ppm, v AS original_value, CASE WHEN even THEN 'wt%' ELSE 'ppm' END AS original_unit FROM e""")
def hinted_extraction(spark, sf_dir):
    """Measurements of tables whose header, sample column and unit only a model's hints tell: a row of elements stands before the header."""
    e = _read(spark, sf_dir, "events")
    k = F.col("event_id")
    cells = F.array(F.lit("b"), F.concat(F.lit("P"), k.cast("string")), F.round(F.abs("value"), 2).cast("string"), k.cast("string"), (k % 7 + 1).cast("string"))
    doc = F.concat(F.lit("d"), F.floor(k / 40).cast("string")).alias("doc_id")
    rows = e.select(doc, F.struct((k % 40 + 2).cast("int").alias("row"), cells.alias("cells")).alias("r"))
    head = lambda n, *c: F.struct(F.lit(n).cast("int").alias("row"), F.array(*map(F.lit, c)).alias("cells"))
    heads = rows.select("doc_id").distinct().select("doc_id", F.explode(F.array(head(0, "Ag", "Au", "Pb", "Sb", "As"), head(1, "Batch", "Probe", "Fe", "Cu", "Zn"))).alias("r"))
    grid_cells = rows.unionByName(heads).select("doc_id", F.lit("docling").alias("backend"), F.lit(0).alias("table_no"), F.col("r.row").alias("row"), F.posexplode("r.cells").alias("col", "raw"))
    even = F.substr(F.col("doc_id"), F.lit(2)).cast("long") % 2 == 0
    answer = F.concat(F.lit('Hints: {"header_row": 1, "transpose": false, "sample_id_col": "probe"'), F.when(even, ', "unit_override": "wt%"').otherwise(""), F.lit("}"))
    hints = heads.select("doc_id").distinct().select("doc_id", F.lit(0).alias("table_no"), answers.hints(answer).alias("h")).select("doc_id", "table_no", "h.*")
    return pipelines.extract(grid_cells, hints=hints).select("doc_id", "sample_name", "element", "value_ppm", "original_value", "original_unit")


@query("""WITH t AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row, o_orderkey, o_orderstatus, o_totalprice FROM orders),
c AS (
  SELECT o_custkey, row, unnest([0, 1, 2]) AS col, false AS is_header, unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus || ' & co', CAST(o_totalprice AS VARCHAR)]) AS raw FROM t
  UNION ALL SELECT o_custkey, 0, unnest([0, 1, 2]), true, unnest(['Key', 'Status', 'Price']) FROM (SELECT DISTINCT o_custkey FROM orders)
)
SELECT o_custkey, count(*) AS n_cells, count(*) FILTER (is_header) AS n_headers, md5(string_agg(row || ':' || col || ':' || raw, '|' ORDER BY row, col)) AS cells FROM c GROUP BY o_custkey""")
def html_tables(spark, sf_dir):
    """Cells of tables in web pages, with a head, markup inside cells, entities and other text around; a page is a customer's orders."""
    o = _read(spark, sf_dir, "orders")
    j = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    line = j("<tr><td>", F.col("o_orderkey").cast("string"), "</td><td> <b>", F.col("o_orderstatus"), "</b> &amp; co</td><td>", F.col("o_totalprice").cast("string"), "</td></tr>")
    body = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    page = j("<html><body><p>Orders</p><table><thead><tr><th>Key</th><th>Status</th><th>Price</th></tr></thead><tbody>", F.col("body"), "</tbody></table><p>end</p></body></html>")
    cells = tables.parse_tables(body.select("o_custkey", page.alias("html")), "html", tables.html_cells)
    text = F.transform(F.sort_array(F.collect_list(F.struct("row", "col", "raw"))), lambda x: F.concat_ws(":", x["row"].cast("string"), x["col"].cast("string"), x["raw"]))
    return cells.groupBy("o_custkey").agg(F.count("*").alias("n_cells"), F.count_if("is_header").alias("n_headers"), F.md5(F.array_join(text, "|")).alias("cells"))
