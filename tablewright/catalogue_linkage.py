"""Queries for linkage, search, merging, ranks and resampling, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.catalogue import _BAG, _GP, _NORM, ORACLE, _bag, _read, query
from tablewright.functions import formula, numbers, strings, vocab
from tablewright.operators import assignment, consensus, dictionary, filters, matching, merging, metrics, ranks, similarity, windows
from tablewright.plans import pipelines
from tablewright.plans.stages import settle, spread
from tablewright.sources import files

# J06, S03


@query()
def max_weight_matching(spark, sf_dir):
    """Benchmark items matched with turns of conversations one to one, by word F1 above 0.15: most pairs, and of those the most similar."""
    edges = similarity.word_f1_pairs(_read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "conversations"), [], "text", 0.15)
    pairs = assignment.max_weight_matching(edges.select(F.md5("a").alias("a"), F.md5("b").alias("b"), F.col("score").alias("weight")))
    return pairs.select(F.col("a").alias("item"), F.col("b").alias("turn"), F.round("weight", 6).alias("f1"))


# A04, A05, C02


def _sources(spark, sf_dir):
    """Four sources of events that write their users' names in their own ways and lack some columns."""
    e = _read(spark, sf_dir, "events")
    user, k = F.col("user_id").cast("string"), F.col("user_id")
    short = F.concat(F.lit("U-"), user)
    names = [
        short,
        F.concat(F.lit(" u  -  "), user, F.lit(" ")),
        F.when(k % 5 == 0, F.concat(short, F.lit(".b"))).otherwise(short),
        F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.concat(short, F.lit(".b x"))).when(k % 3 == 0, F.concat(F.lower(short), F.lit("_1"))).when(k % 3 == 1, F.concat(F.lower(short), F.lit("_"), (F.col("event_id") % 2).cast("string"))).otherwise(short),
    ]
    values = [{"value": F.col("value")}, {"kind": F.col("event_type")}, {"value": F.col("value"), "kind": F.col("event_type")}, {"value": -F.col("value"), "props": F.col("props")}]
    return [
        e.where(F.col("event_id") % 4 == s).select(name.alias("name"), "event_id", *(F.when(F.col("event_id") % 3 != 0, c).alias(n) for n, c in value.items()))
        for s, (name, value) in enumerate(zip(names, values, strict=True))
    ]


@query(r"""WITH RECURSIVE r AS (
  SELECT event_id % 4 AS s, event_id,
    CASE event_id % 4 WHEN 0 THEN 'U-' || user_id WHEN 1 THEN ' u  -  ' || user_id || ' ' WHEN 2 THEN CASE WHEN user_id % 5 = 0 THEN 'U-' || user_id || '.b' ELSE 'U-' || user_id END
    ELSE CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 'U-' || user_id || '.b x' WHEN user_id % 3 = 0 THEN 'u-' || user_id || '_1' WHEN user_id % 3 = 1 THEN 'u-' || user_id || '_' || (event_id % 2) ELSE 'U-' || user_id END END AS name,
    CASE WHEN event_id % 3 <> 0 AND event_id % 4 IN (0, 2) THEN value WHEN event_id % 3 <> 0 AND event_id % 4 = 3 THEN -value END AS value, CASE WHEN event_id % 3 <> 0 AND event_id % 4 IN (1, 2) THEN event_type END AS kind,
    CASE WHEN event_id % 3 <> 0 AND event_id % 4 = 3 THEN props END AS props
  FROM events
),
f AS (SELECT *, lower(trim(regexp_replace(regexp_replace(name, '\s*-\s*', '-', 'g'), '\s+', ' ', 'g'))) AS form FROM r),
d AS MATERIALIZED (SELECT DISTINCT form FROM f WHERE form IS NOT NULL),
n AS (SELECT x.form AS longer, arg_max(y.form, length(y.form)) AS form FROM d x JOIN d y ON starts_with(x.form, y.form) AND length(x.form) > length(y.form) AND contains('-.@_ #', substr(x.form, length(y.form) + 1, 1)) GROUP BY x.form),
o AS MATERIALIZED (SELECT form, min(longer) AS longer FROM n GROUP BY form HAVING count(*) = 1),
c AS (SELECT form, form AS entity FROM d UNION SELECT x.b, c.entity FROM c JOIN (SELECT form AS a, longer AS b FROM o UNION SELECT longer, form FROM o) x ON x.a = c.form),
e AS (SELECT form, min(entity) AS entity FROM c GROUP BY form)
SELECT e.entity, count(*) AS n_rows, count(DISTINCT s) AS n_sources, arg_min(value, (s, event_id)) FILTER (value IS NOT NULL) AS value, arg_min(kind, (s, event_id)) FILTER (kind IS NOT NULL) AS kind,
       arg_min(props, (s, event_id)) FILTER (props IS NOT NULL) AS props
FROM f LEFT JOIN e ON e.form = f.form GROUP BY e.entity, CASE WHEN f.form IS NULL THEN event_id END""")
def merge_sources(spark, sf_dir):
    """Events of four sources merged by users whose names are written differently."""
    return merging.merge_sources(_sources(spark, sf_dir), "name", "event_id", columns=["value", "kind", "props"])


# F08, H12


_GRAMS = "list_transform(range(1, length(x.t) + 2), lambda i: substr(chr(1) || x.t || chr(1), i, 2))"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS id FROM part UNION SELECT DISTINCT url FROM pages WHERE url IS NOT NULL),
g AS (SELECT x.id, list_sort({_GRAMS}) AS g FROM (SELECT id, lower(trim(id)) AS t FROM n) x WHERE length(x.t) > 0),
m AS MATERIALIZED (SELECT id, list_transform(g, lambda v, i: v || '#' || (i - list_position(g, v))) AS g FROM g)
SELECT a.id AS a, b.id AS b, round(2 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) AS score
FROM m a JOIN m b ON a.id < b.id AND least(len(a.g), len(b.g)) * 2 >= 0.8 * (len(a.g) + len(b.g)) WHERE 2 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) >= 0.8 - 1e-12""")
def similar_names(spark, sf_dir):
    """All pairs of part names and page addresses whose character pairs have a Dice similarity of 0.8 or more."""
    names = _read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(_read(spark, sf_dir, "pages").select("url"))
    return similarity.similar_names(names, "name").withColumn("score", F.round("score", 6))


# J13


def _nodes(spark, sf_dir):
    """Texts of paragraphs and list items of pages in order, and titles and headings that are looked for among them."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "html")
    inner = lambda pattern: F.regexp_extract_all(F.col("html"), F.lit(pattern), F.lit(1))
    bare = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    nodes = pages.select("page_id", F.posexplode(F.concat(inner("(?s)<p>(.*?)</p>"), inner("(?s)<li>(.*?)</li>"))).alias("node_ord", "t")).select("page_id", "node_ord", bare(F.col("t")).alias("node_text")).where("node_text <> ''")
    wanted = pages.select("page_id", F.explode(F.create_map(F.lit("title"), inner("(?s)<title>(.*?)</title>"), F.lit("heading"), inner("(?s)<h1>(.*?)</h1>"))).alias("attribute", "v")).select("page_id", "attribute", bare(F.get("v", F.lit(0))).alias("value")).where("value <> ''")
    return nodes, wanted


_WORDS = f"list_filter(string_split({_NORM}, ' '), lambda x: x <> '')"


@query(rf"""WITH n AS (
  SELECT page_id, i - 1 AS node_ord, trim(regexp_replace(l[i], '<[^>]*>', '', 'g')) AS text
  FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, list_concat(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS l FROM pages))
),
w AS (
  SELECT page_id, attribute, trim(regexp_replace(v, '<[^>]*>', '', 'g')) AS text
  FROM (SELECT page_id, 'title' AS attribute, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)[1] AS v FROM pages UNION ALL SELECT page_id, 'heading', regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)[1] FROM pages)
),
x AS MATERIALIZED (SELECT page_id, text, min(node_ord) AS node_ord, any_value({_WORDS}) AS l FROM n WHERE text <> '' GROUP BY page_id, text),
y AS MATERIALIZED (SELECT page_id, attribute, text, {_WORDS} AS l FROM w WHERE text <> ''),
s AS (
  SELECT y.page_id, attribute, y.text AS value, x.text AS node_text, node_ord,
    2 * list_sum(list_transform(list_distinct(y.l), lambda v: least(len(list_filter(y.l, lambda z: z = v)), len(list_filter(x.l, lambda z: z = v))))) / (len(x.l) + len(y.l)) AS f1
  FROM y JOIN x ON x.page_id = y.page_id
),
b AS (SELECT page_id, attribute, max(f1) AS f1, arg_min(node_text, (-f1, node_ord)) AS node_text FROM s GROUP BY page_id, attribute)
SELECT y.page_id, y.attribute, md5(y.text) AS value, md5(CASE WHEN f1 >= 0.25 THEN node_text ELSE '<NULL>' END) AS node_text, round(CASE WHEN f1 >= 0.25 THEN f1 END, 6) AS f1
FROM y LEFT JOIN b ON b.page_id = y.page_id AND b.attribute = y.attribute""")
def closest_page_text(spark, sf_dir):
    """The paragraph or list item of a page that is closest to its title, and to its heading."""
    found = matching.closest_text(*_nodes(spark, sf_dir), ["page_id"])
    return found.select("page_id", "attribute", F.md5("value").alias("value"), F.md5("node_text").alias("node_text"), F.round("f1", 6).alias("f1"))


# J14, N06


@query("""WITH n AS (SELECT DISTINCT left(text, 24) AS name FROM benchmark UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT s_name FROM supplier)
SELECT doc_id, name FROM documents JOIN n ON contains(text, name) WHERE name <> ''""")
def names_in_documents(spark, sf_dir):
    """Names of parts and suppliers and openings of benchmark items, wherever documents have them."""
    names = _read(spark, sf_dir, "benchmark").select(F.left("text", F.lit(24)).alias("name")).union(_read(spark, sf_dir, "part").select("p_name")).union(_read(spark, sf_dir, "supplier").select("s_name"))
    return dictionary.found_names(_read(spark, sf_dir, "documents"), ["doc_id"], "text", names, "name")


@query("""WITH c AS (
  SELECT l_orderkey AS t, k AS row, 0 AS col, 'glass ' || chr(97 + CAST(l_partkey % 5 AS INTEGER)) || l_linenumber AS raw, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
),
v AS (SELECT t, row, unnest([1, 2]) AS col FROM c),
k AS (
  SELECT c.t, c.row, c.col, lower(c.raw) AS label, 'glass ' || chr(97 + m) AS material
  FROM c JOIN (SELECT l_orderkey AS t, min(CAST(l_partkey % 5 AS INTEGER)) AS m FROM lineitem GROUP BY l_orderkey) n ON n.t = c.t WHERE contains(lower(c.raw), 'glass ' || chr(97 + m))
)
SELECT v.t, CAST(v.row AS INTEGER) AS row, CAST(v.col AS INTEGER) AS col, arg_max(material, (length(material) / length(label), -k.col, -k.row)) AS material FROM v JOIN k ON k.t = v.t AND k.row = v.row AND k.col < v.col GROUP BY ALL""")
def material_labels(spark, sf_dir):
    """The material that each value cell of a table belongs to: a label left of it that holds a known name."""
    l = _read(spark, sf_dir, "lineitem")  # noqa: E741
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    letter = lambda k: F.concat(F.lit("glass "), F.char(F.lit(97) + k))
    rows = l.select(F.col("l_orderkey").alias("t"), row.alias("row"), F.array(F.concat(letter(F.col("l_partkey") % 5), F.col("l_linenumber").cast("string")), F.col("l_quantity").cast("string"), F.lit("1.5")).alias("r"))
    names = l.groupBy(F.col("l_orderkey").alias("t")).agg(letter(F.min(F.col("l_partkey") % 5)).alias("material"))
    return matching.material_of(rows.select("t", "row", F.posexplode("r").alias("col", "raw")), names, ["t"])


# J04, J12


def _greedy(keys: str, near: str, by: str) -> str:
    """CTEs a, b and t: one prediction of a group after the other takes the first free truth near it; t has p_ord and g_ord (null: none)."""
    same = lambda x, y: " AND ".join(f"{x}.{k.strip()} = {y}.{k.strip()}" for k in keys.split(","))
    return f"""
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ord) AS k FROM {by}_pred),
b AS MATERIALIZED (SELECT {keys}, list({{'o': ord, 'v': v}} ORDER BY ord) AS free FROM {by}_gold GROUP BY {keys}),
t AS (
  SELECT {keys}, CAST(0 AS BIGINT) AS k, free, CAST(NULL AS BIGINT) AS p_ord, CAST(NULL AS BIGINT) AS g_ord FROM b
  UNION ALL
  SELECT {keys}, k, list_filter(free, lambda x: x.o IS DISTINCT FROM g_ord), p_ord, g_ord
  FROM (SELECT {", ".join(f"t.{k.strip()}" for k in keys.split(","))}, a.k, t.free, a.ord AS p_ord, list_filter(t.free, lambda x: {near})[1].o AS g_ord FROM t JOIN a ON {same("a", "t")} AND a.k = t.k + 1)
)"""


ORACLE["tolerance_match"] = f"""WITH RECURSIVE {_GP},
x_pred AS (SELECT doc_id, type, unit, ord, CAST(value AS DOUBLE) AS v FROM pred), x_gold AS (SELECT doc_id, type, unit, ord, CAST(value AS DOUBLE) AS v FROM gold),
{_greedy("doc_id, type, unit", "abs(x.v - a.v) < 1.01", "x")}
SELECT doc_id, type, unit, p_ord, g_ord FROM t WHERE g_ord IS NOT NULL"""

ORACLE["error_taxonomy_near"] = f"""WITH RECURSIVE {_GP},
m AS MATERIALIZED (
  SELECT p.doc_id, p.ord AS p_ord, g.ord AS g_ord, p.type = g.type AND p.unit = g.unit AS ok
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY ord) AS r FROM pred) p JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY ord) AS r FROM gold) g USING (doc_id, value, r)
),
x_pred AS MATERIALIZED (SELECT doc_id, ord, CAST(value AS DOUBLE) AS v FROM pred WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = pred.doc_id AND m.p_ord = pred.ord)),
x_gold AS MATERIALIZED (SELECT doc_id, ord, CAST(value AS DOUBLE) AS v FROM gold WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = gold.doc_id AND m.g_ord = gold.ord)),
{_greedy("doc_id", "abs(x.v - a.v) / greatest(abs(x.v), 1e-9) < 0.05", "x")},
n AS (SELECT count(*) AS n FROM t WHERE g_ord IS NOT NULL)
SELECT * FROM (
  SELECT 'VAL_MATCH_ATTR_WRONG' AS class, count(*) AS n FROM m WHERE NOT ok UNION ALL SELECT 'NEAR_MISS', n FROM n
  UNION ALL SELECT 'OVER_EXTRACT', (SELECT count(*) FROM x_pred) - n FROM n UNION ALL SELECT 'MISSED', (SELECT count(*) FROM x_gold) - n FROM n) WHERE n > 0"""


# H14


ORACLE["formula_components"] = """SELECT p_partkey, x.c AS component, round(x.v / (p_size + 1 + p_partkey % 9 + 1), 5) AS share
FROM (SELECT *, unnest([{'c': 'SiO2', 'v': p_size + 1.0}, {'c': 'Na2O', 'v': p_partkey % 9 + 1.0}]) AS x FROM part)"""


@query("""WITH p AS (SELECT p_partkey, 1 + p_size % 49 AS q, 100 - (1 + p_size % 49) AS r, p_partkey % 8 AS f FROM part),
c AS (
  SELECT p_partkey, f, unnest(CASE
    WHEN f = 2 THEN [{'c': 'Ge', 'v': q / 100}, {'c': 'Se', 'v': r / 100}]
    WHEN f = 3 THEN [{'c': 'SiO2', 'v': r * 0.6 / 100}, {'c': 'Na2O', 'v': r * 0.4 / 100}, {'c': 'Er2O3', 'v': q / 100}]
    WHEN f = 4 THEN [{'c': 'Ge', 'v': r / 100 / 3}, {'c': 'S', 'v': r / 100 * 2 / 3 + q / 100 * 0.6}, {'c': 'Sb', 'v': q / 100 * 0.4}]
    WHEN f = 7 THEN [{'c': 'SiO2', 'v': r / 2 / 100}, {'c': 'CaO', 'v': r / 2 / 100}, {'c': 'Na2O', 'v': q / 100}]
    ELSE [{'c': 'SiO2', 'v': q / 100}, {'c': 'Na2O', 'v': r / 100}] END) AS x FROM p
)
SELECT p_partkey, CAST(1 AS BIGINT) AS formula_no, x.c AS component, round(x.v, 4) AS share FROM c""")
def composition_forms(spark, sf_dir):
    """Compositions in eight ways of writing: plain, bracketed, of elements, of groups, with variables, with a remainder and nested."""
    q = 1 + F.col("p_size") % 49
    a, r = q.cast("string"), (100 - q).cast("string")
    j = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    texts = [
        j("glass ", a, "SiO2-", r, "Na2O was melted"), j("the (SiO2)", a, "(Na2O)", r, " glass"), j("Ge", a, "Se", r), j(r, "(60SiO2-40Na2O)-", a, "Er2O3"),
        j(r, "(GeS2)", a, "(Sb2S3)"), j("xSiO2·(100-x)Na2O, where x = ", a), j(a, "SiO2-bal. Na2O"), j("[(50SiO2:50CaO)", r, " (Na2O)", a, "]90 [SiO2]0"),
    ]
    part = spread(_read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")  # a small file, of whose rows much is made
    rows = part.select("p_partkey", F.element_at(F.array(*texts), (F.col("p_partkey") % 8 + 1).cast("int")).alias("text"))
    return formula.formula_components(rows, ["p_partkey"], "text").select("p_partkey", "formula_no", "component", F.round("share", 4).alias("share"))


# G17


_CDF = ", ".join(str(int(metrics._PRIME * p)) for p in metrics._POISSON)


def _resampled(rows: str, replicates: int) -> str:
    """CTEs means (replicate, n, mean) and interval (low, high, p) of the table `rows` (unit, v), drawn as poisson_bootstrap does."""
    return f"""
w0 AS (SELECT rep, v, (unit % 2147483647 * 48271 + rep * 69621 + 42) % 2147483647 AS x FROM {rows}, range(0, {replicates}) z(rep)),
w1 AS (SELECT rep, v, (x * x + 16807 + x) % 2147483647 AS x FROM w0), w2 AS (SELECT rep, v, (x * x + 33614 + x) % 2147483647 AS x FROM w1),
w3 AS (SELECT rep, v, (x * x + 50421 + x) % 2147483647 AS x FROM w2), w4 AS (SELECT rep, v, (x * x + 67228 + x) % 2147483647 AS x FROM w3),
means AS MATERIALIZED (SELECT rep AS replicate, sum(k) AS n, round(sum(k * v) / sum(k), 9) AS mean FROM (SELECT rep, v, len(list_filter([{_CDF}], lambda y: y <= x)) AS k FROM w4) GROUP BY rep),
ordered AS (SELECT *, row_number() OVER (ORDER BY mean, replicate) - 1 AS k, count(*) OVER () AS z FROM means WHERE mean IS NOT NULL),
interval_ AS (SELECT max(mean) FILTER (k = CAST(floor(0.025 * z) AS BIGINT)) AS low, max(mean) FILTER (k = least(z - 1, CAST(floor(0.975 * z) AS BIGINT))) AS high, avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END) AS p FROM ordered)"""


@query(f"""{_BAG}, f AS MATERIALIZED (SELECT doc_id AS unit, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS v FROM t),{_resampled("f", 1000)}
SELECT count(*) AS n, round(avg(v), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, round(any_value(p), 6) AS p FROM f, interval_""")
def bootstrap_interval(spark, sf_dir):
    """Mean F1 over all orders with its interval of 95 percent, from 1000 resamples of all of them in one scan."""
    f1 = settle(metrics.prf_by(_bag(spark, sf_dir), ["doc_id"], None).select("doc_id", "f1"))
    means = metrics.poisson_bootstrap(f1, "doc_id", ["f1"]).select("replicate", F.round("f1", 9).alias("mean"))
    whole = f1.agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("mean"))
    return whole.join(metrics.bootstrap_interval(means).select(*(F.round(c, 6).alias(c) for c in ("low", "high", "p"))))


@query(f"""WITH c AS MATERIALIZED (
  SELECT o_custkey AS unit, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey
),
d AS MATERIALIZED (SELECT unit, a, b, a - b AS v FROM c WHERE a IS NOT NULL AND b IS NOT NULL),{_resampled("d", 1000)}
SELECT count(*) AS n, round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b, round(avg(v), 4) AS difference, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high, round(any_value(p), 6) AS p FROM d, interval_""")
def paired_bootstrap(spark, sf_dir):
    """Whether customers' finished orders are larger than their open ones: paired difference, interval and p value."""
    mean = lambda status: F.avg(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice")))
    c = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(mean("F").alias("a"), mean("O").alias("b"))
    out = metrics.paired_bootstrap(c, "o_custkey", "a", "b")
    return out.select("n", *(F.round(c, 6 if c == "p" else 4).alias(c) for c in ("mean_a", "mean_b", "difference", "low", "high", "p")))


# W05, W01


@query("""SELECT o_orderkey, CAST(o_totalprice / 1000 AS BIGINT) AS price, row_number() OVER (ORDER BY CAST(o_totalprice / 1000 AS BIGINT) DESC, o_orderkey DESC) AS row_number,
rank() OVER (ORDER BY CAST(o_totalprice / 1000 AS BIGINT) DESC) AS rank, dense_rank() OVER (ORDER BY CAST(o_totalprice / 1000 AS BIGINT) DESC) AS dense_rank FROM orders""")
def global_ranks(spark, sf_dir):
    """Ranks of all orders by price in thousands (halves go to the even one), with ties, by ranges of the price."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.rint(F.col("o_totalprice") / 1000).cast("long").alias("price"))
    return ranks.global_ranks(o, "price", "o_orderkey", descending=True)


@query("""SELECT event_id, last_value(CASE WHEN event_id % 4 = 0 THEN value END IGNORE NULLS) OVER (ORDER BY ts, event_id) AS last_value FROM events""")
def fill_down(spark, sf_dir):
    """Each event with the last value of every fourth one up to it, in order of time over the whole table."""
    e = _read(spark, sf_dir, "events").select("ts", "event_id", F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("v"))
    return ranks.fill_down(e, ["ts", "event_id"], "v", "last_value").select("event_id", "last_value")


# C07


@query("""WITH RECURSIVE g AS (SELECT user_id, 'g' || (event_id // 3 % 50) AS grp, event_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT user_id, 'h' || (event_id // 9 % 20), event_id FROM events WHERE event_id % 9 = 0),
e AS MATERIALIZED (SELECT DISTINCT a.user_id, a.event_id AS a, b.event_id AS b FROM g a JOIN g b ON a.user_id = b.user_id AND a.grp = b.grp),
c AS (SELECT user_id, a, a AS c FROM e UNION SELECT e.user_id, e.b, c.c FROM c JOIN e ON e.user_id = c.user_id AND e.a = c.a),
p AS (SELECT user_id, a AS event_id, min(c) AS c FROM c GROUP BY user_id, a)
SELECT user_id, arg_max(event_id, (length(props), -event_id)) AS event_id FROM (SELECT v.user_id, v.event_id, v.props, coalesce(p.c, v.event_id) AS c FROM events v LEFT JOIN p ON p.event_id = v.event_id) GROUP BY user_id, c""")
def judged_duplicates(spark, sf_dir):
    """Of events that two judges put into groups the longest; groups that share an event are one."""
    e = _read(spark, sf_dir, "events")
    by = lambda every, name, n: e.where(F.col("event_id") % every == 0).select("user_id", F.concat(F.lit(name), F.expr(f"event_id div {every} % {n}").cast("string")).alias("group_id"), "event_id")
    return consensus.judge_groups(e, by(3, "g", 50).union(by(9, "h", 20)), ["user_id"], "event_id", "props").select("user_id", "event_id")


# G03, G04


_FIELDS = ["title", "country", "journal"]


@query(f"""WITH o AS (SELECT o_orderkey AS doc, o_orderpriority, o_orderstatus, CAST(o_custkey % 10 AS VARCHAR) AS c FROM orders),
t1 AS (
  SELECT doc, avg(s) AS t1 FROM (
    SELECT doc, CASE WHEN doc % 4 = 0 THEN 0.0 ELSE 1.0 END AS s FROM o UNION ALL SELECT doc, CASE WHEN doc % 3 = 0 THEN 0.0 ELSE 1.0 END FROM o WHERE doc % 5 <> 0 UNION ALL SELECT doc, 1.0 FROM o WHERE doc % 2 = 0) GROUP BY doc
),
cells AS (
  SELECT l_orderkey AS doc, l_linenumber AS sample, CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN -99999.0 ELSE l_quantity END AS g,
    CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN -99999.0 WHEN 2 THEN l_quantity * 1.3 ELSE l_quantity END AS p FROM lineitem
),
by_sample AS (
  SELECT doc, sample, avg(CASE WHEN g IS NULL THEN NULL WHEN g = -99999.0 THEN CASE WHEN p IS NULL THEN 0.5 WHEN p = -99999.0 THEN 1.0 ELSE 0.3 END WHEN p IS NULL OR p = -99999.0 THEN 0.0
    WHEN abs(p - g) / abs(g) <= 0.05 THEN 1.0 ELSE 1 - (abs(p - g) / abs(g) - 0.05) / 0.95 END) AS t2, avg(CASE WHEN g IS NULL THEN CASE WHEN p IS NULL THEN 1.0 ELSE 0.0 END END) AS t4
  FROM cells GROUP BY doc, sample
),
by_doc AS (SELECT doc, avg(coalesce(t2, 1.0)) AS t2, avg(coalesce(t4, 1.0)) AS t4 FROM by_sample GROUP BY doc),
{_BAG.removeprefix("WITH ")},
r AS (
  SELECT t.doc_id, coalesce(t1.t1, 0) AS t1, coalesce(by_doc.t2, 0) AS t2, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS t3, coalesce(by_doc.t4, 0) AS t4 FROM t LEFT JOIN t1 ON t1.doc = t.doc_id LEFT JOIN by_doc ON by_doc.doc = t.doc_id
)
SELECT doc_id, round(t1, 6) AS t1, round(t2, 6) AS t2, round(t3, 6) AS t3, round(t4, 6) AS t4, round(0.30 * t1 + 0.40 * t2 + 0.15 * t3 + 0.15 * t4, 6) AS overall FROM r""")
def tier_report(spark, sf_dir):
    """Four tiers and their weighted sum by order: metadata, numbers, names and nulls."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("country"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("j")).alias("journal"))
    guess = o.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("title")).alias("title"), F.when(F.col("doc_id") % 3 != 0, F.col("country")).alias("country"), "journal")
    l = _read(spark, sf_dir, "lineitem")  # noqa: E741
    below = F.lit(vocab.BELOW_DETECTION)
    gold = F.when(F.col("l_partkey") % 6 == 0, None).when(F.col("l_partkey") % 6 == 1, below).otherwise(F.col("l_quantity"))
    pred = F.when(F.col("l_suppkey") % 5 == 0, None).when(F.col("l_suppkey") % 5 == 1, below).when(F.col("l_suppkey") % 5 == 2, F.col("l_quantity") * 1.3).otherwise(F.col("l_quantity"))
    cells = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sample"), gold.alias("gold"), pred.alias("pred"))
    report = metrics.tier_report(metrics.metadata_scores(o, guess, ["doc_id"], _FIELDS), cells, _bag(spark, sf_dir), ["doc_id"])
    return report.select("doc_id", *(F.round(c, 6).alias(c) for c in ("t1", "t2", "t3", "t4", "overall")))


# H10, N03, H03, G08


_COMPONENTS = [*((c, c) for c in vocab.COMPOUNDS), *((e, e) for e in vocab.COMPONENT_ELEMENTS), *vocab.COMPONENT_NAMES.items()]


@query(f"""WITH k AS (SELECT unnest([{", ".join(f"'{c}'" for _, c in _COMPONENTS)}]) AS c, unnest(range(0, {len(_COMPONENTS)})) AS i)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (l_partkey + l_orderkey) % 11 = 0 THEN NULL ELSE c END AS component FROM lineitem JOIN k ON i = (l_partkey + l_orderkey) % {len(_COMPONENTS)}""")
def component_names(spark, sf_dir):
    """Components by every formula and name that is known, in any case, with units behind, and by names that are none."""
    l = _read(spark, sf_dir, "lineitem")  # noqa: E741
    k = F.col("l_partkey") + F.col("l_orderkey")
    name = F.element_at(F.array(*(F.lit(n) for n, _ in _COMPONENTS)), (k % len(_COMPONENTS) + 1).cast("int"))
    written = F.when(k % 11 == 0, F.concat(name, F.lit("q9"))).when(k % 3 == 0, F.concat(F.upper(name), F.lit(" (mol%)"))).when(k % 3 == 1, F.concat(F.lit(" "), F.lower(name))).otherwise(name)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", filters.component_of(written).alias("component"))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 80 AS d, c_custkey // 7 % 60 AS m, c_custkey // 11 % 60 AS s FROM customer)
SELECT k, round(CASE k % 8 WHEN 0 THEN -(d + m / 60 + s / 3600) WHEN 1 THEN -(d + m / 60 + s / 3600) WHEN 2 THEN d + m / 60 + s / 3600 WHEN 3 THEN d + 0.25 WHEN 4 THEN -(d + m / 60) WHEN 5 THEN d + m / 60 + s / 3600 WHEN 6 THEN -(d + 0.5) END, 6) AS latitude FROM c""")
def coordinates(spark, sf_dir):
    """Coordinates with the quarter behind or in front, with marks or blanks, with a comma as point, signed, and what is none."""
    k = F.col("k")
    d, m, s = ((x).cast("string") for x in (k % 80, F.expr("k div 7 % 60"), F.expr("k div 11 % 60")))
    j = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    texts = [
        j(d, " ", m, " ", s, " S"), j("S ", d, " ", m, " ", s), j(d, "°", m, "′", s, "″ N"), j(d, ",25"), j(d, "°", m, "'W"), j(d, "d", m, "m", s, "s"), j("-", d, ".5"), j(d, " to ", m),
    ]
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("t", F.element_at(F.array(*texts), (k % 8 + 1).cast("int")))
    return rows.select("k", F.round(numbers.coordinate(F.col("t"), 90), 6).alias("latitude"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, l_partkey % 8 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE k WHEN 1 THEN '>' || q WHEN 4 THEN q || '-' || q || ' nM' WHEN 5 THEN q || 'e-3' WHEN 6 THEN 'about ' || q WHEN 7 THEN q || ',000.5' ELSE q END AS core FROM l""")
def value_cores(spark, sf_dir):
    """Cores of quantities written with units, comparators, uncertainties, brackets and powers, and of ranges and words that stay."""
    q = F.col("l_quantity").cast("int").cast("string")
    j = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    texts = [j(q, " nM"), j("> ", q, " µM"), j(q, " ± 3"), j(q, " (1-9)"), j(q, "-", q, " nM"), j(q, "e-3 mg/L"), j("about ", q), j(q, ",000.5%")]
    rows = _read(spark, sf_dir, "lineitem").withColumn("t", F.element_at(F.array(*texts), (F.col("l_partkey") % 8 + 1).cast("int")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", strings.value_core(F.col("t")).alias("core"))


@query("""WITH d AS (SELECT o_orderkey AS k, o_orderkey % 5 AS a, o_orderkey % 4 AS b, o_orderkey % 3 AS c, year(o_orderdate) AS y FROM orders),
x AS (SELECT k, list_filter([CASE WHEN a = 0 THEN 1.0 WHEN a = 1 THEN 0.0 END, CASE WHEN b = 0 THEN 1.0 WHEN b = 1 THEN 0.5 END, CASE WHEN c = 0 THEN 1.0 WHEN c = 1 THEN 0.0 END, CASE WHEN a + b > 3 THEN NULL WHEN y BETWEEN 1990 AND 2030 THEN 1.0 ELSE 0.0 END], lambda v: v IS NOT NULL) AS l FROM d)
SELECT k, round(CASE WHEN len(l) > 0 THEN list_sum(l) / len(l) ELSE 0.5 END, 6) AS consistency FROM x""")
def metadata_consistency(spark, sf_dir):
    """The share of metadata checks that hold: method, mineral, country and year."""
    k = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select(
        k.alias("k"),
        F.when(k % 5 == 0, "EPMA at 20 kV").when(k % 5 == 1, "by eye").alias("analytical_method"),
        F.when(k % 4 == 0, "Pyrite").when(k % 4 == 1, "kryptonite").alias("mineral"),
        F.when(k % 3 == 0, "Peru").when(k % 3 == 1, "12").alias("country"),
        F.when(k % 5 + k % 4 <= 3, F.date_format("o_orderdate", "MM/yyyy")).alias("publication_date"),
    )
    return metrics.consistency(rows).select("k", F.round("consistency", 6).alias("consistency"))



# W03, P02, B15, A04, A21


@query(r"""WITH s AS (SELECT doc_id, text, generate_subscripts(regexp_extract_all(text, 'tion'), 1) AS k FROM documents),
p AS (SELECT doc_id, length(array_to_string(string_split(text, 'tion')[1 : k], 'tion')) AS x, length(text) AS n FROM s),
i AS (SELECT doc_id, greatest(0, x - 200) AS start, least(n, x + 400) AS "end" FROM p),
r AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i),
k AS (SELECT *, sum(CASE WHEN r IS NULL OR start > r + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM r),
m AS (SELECT doc_id, min(start) AS start, max("end") AS "end" FROM k GROUP BY doc_id, k),
c AS (SELECT m.*, trim(substr(text, start + 1, "end" - start)) AS chunk FROM m JOIN documents USING (doc_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_no, sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY start) AS n FROM c)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", md5(chunk) AS chunk FROM t WHERE n <= 6000""")
def keyword_digest(spark, sf_dir):
    """Stretches around hits of a key word, 6000 characters a document at most."""
    found = windows.keyword_digest(_read(spark, sf_dir, "documents"), ["doc_id"], "text", "tion")
    return found.withColumn("chunk", F.md5("chunk"))


@query("""WITH c AS (
  SELECT p_partkey // 4 AS doc_id, p_partkey % 4 AS row, unnest([1, 2, 3]) AS col, p_name, unnest([CAST(p_size AS VARCHAR), CAST(p_partkey % 7 AS VARCHAR), CAST(p_partkey % 3 AS VARCHAR)]) AS value FROM part WHERE p_partkey % 4 <> 3
),
r AS (SELECT doc_id, row, col, value, p_name AS model, CASE col WHEN 1 THEN 'accuracy' WHEN 2 THEN 'F1' ELSE 'BLEU' END AS metric FROM c)
SELECT doc_id, value, 'Result' AS type, model, lower(metric) AS metric FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, value, model ORDER BY row, col) = 1""")
def result_tables(spark, sf_dir):
    """Records of results from tables of four parts: the row names the model, the header the metric; the last row has words only."""
    p = _read(spark, sf_dir, "part")
    words = F.col("p_partkey") % 4 == 3
    cell = lambda c: F.when(words, "none").otherwise(c.cast("string"))
    cells = p.select(F.floor(F.col("p_partkey") / 4).alias("doc_id"), F.lit(1).alias("table_no"), (F.col("p_partkey") % 4).cast("int").alias("row"), F.posexplode(F.array("p_name", cell(F.col("p_size")), cell(F.col("p_partkey") % 7), cell(F.col("p_partkey") % 3))).alias("col", "raw"))
    names = F.array(F.lit("Model"), F.lit("Acc."), F.lit("F1 score"), F.lit("BLEU (test)"))
    headers = cells.select("doc_id", "table_no").distinct().select("doc_id", "table_no", F.posexplode(names).alias("col", "header"))
    return pipelines.domain_records(cells, headers, "result").select("doc_id", "value", "type", "model", F.lower("metric").alias("metric"))


@query("""WITH r AS (
  SELECT user_id % 20 AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'S-' || user_id ELSE ' s - ' || user_id END AS name, 's-' || user_id AS entity, event_type AS element, event_id % 3 AS sheet, event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events
)
SELECT doc_id, entity, element, arg_min(name, (sheet, event_id)) AS sample_name, arg_min(value, (sheet, event_id)) FILTER (value IS NOT NULL) AS value, count(*) AS n_records FROM r GROUP BY ALL""")
def merged_samples(spark, sf_dir):
    """Measurements of a document's three sheets merged by samples whose names are written differently."""
    e = _read(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    rows = e.select(
        (F.col("user_id") % 20).alias("doc_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("S-"), user)).otherwise(F.concat(F.lit(" s - "), user)).alias("sample_name"), F.lit(None).cast("string").alias("sample_local_id"),
        F.col("event_type").alias("element"), (F.col("event_id") % 3).alias("sheet"), "event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"),
    )
    return pipelines.merged_samples(rows, ["sheet", "event_id"], ["value"])


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k >= 100 AND k < 5000""")
def benchmark_slice(spark, sf_dir):
    """Orders from the 100th to the 5000th by key, numbered by ranges of the key."""
    return files.benchmark_slice(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", None, 100, 5000)
