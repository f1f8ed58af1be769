"""Cases that reviews found, each small enough to have failed before."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import rows
from pyspark.sql import functions as F

from tablewright import catalogue, catalogue_linkage  # noqa: F401  the other adds its queries to the first
from tablewright.functions import formula, numbers, strings
from tablewright.operators import assignment, consensus, filters, grid, matching, metrics, similarity, windows
from tablewright.plans import graph, pipelines, stages


def test_global_ranks_rounds_halves_as_its_sql(spark, tmp_path):
    prices = [197500.0, 198500.0, 198500.0, 500.0, 1500.0, 2500.0, 2499.99]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    got = catalogue.QUERIES["global_ranks"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(catalogue.ORACLE["global_ranks"]).df())


def test_hits_of_equal_stretches_are_one_stretch(spark):
    # All hits of a short text have the same stretch, so any order of them must merge to one.
    docs = spark.createDataFrame([(k, "tion and " * n) for k, n in enumerate([5, 4, 9, 1])], "doc_id long, text string").repartition(3)
    spans = windows.merge_intervals(windows.keyword_spans(docs, "text", "tion"), ["doc_id"], "start", "end", 200)
    assert sorted(map(tuple, spans.collect())) == [(0, 0, 45, 5), (1, 0, 36, 4), (2, 0, 81, 9), (3, 0, 9, 1)]


def _dice(x, y):
    return 2 * len(x & y) / (len(x) + len(y))


def test_blocks_of_sets_give_all_pairs(spark, monkeypatch):
    """Blocks and parts of members that are smaller than the sets; more blocks than sets, so some are empty."""
    for name, value in (("BLOCK", 7), ("MEMBERS", 5), ("PAIRS", 3)):
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(31)
    words = [f"w{k}" for k in range(30)]
    sets = [sorted(set(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randint(1, 12)))) for _ in range(60)]
    rows_ = lambda of: spark.createDataFrame([(0, f"{k}", set_) for k, set_ in of], "by int, id string, members array<string>")
    numbered = list(enumerate(sets))
    for least, strict in ((0.3, False), (0.5, True), (1.0, False)):
        good = lambda x, y: _dice(set(x), set(y)) > least if strict else _dice(set(x), set(y)) >= least - 1e-12  # noqa: B023, E731
        score = lambda i, j: round(_dice(set(sets[i]), set(sets[j])), 9)
        got = {(r.by, r.a, r.b): round(r.score, 9) for r in similarity.similar_sets(rows_(numbered), None, least, strict=strict).collect()}
        assert got == {(0, *sorted((str(i), str(j)))): score(i, j) for i in range(60) for j in range(i) if good(sets[i], sets[j])}
        got = [(r.a, r.b, round(r.score, 9)) for r in similarity.similar_sets(rows_(numbered[:20]), rows_(numbered[20:]), least, strict=strict).collect()]
        assert sorted(got) == sorted((str(i), str(j), score(i, j)) for i in range(20) for j in range(20, 60) if good(sets[i], sets[j]))


def test_parts_of_members_and_cells(monkeypatch):
    for name, value in (("MEMBERS", 3), ("PAIRS", 2)):
        monkeypatch.setattr(similarity, name, value)
    x, y = [["a", "b", "c", "d", "e"], ["b"], ["q", "r"]], [["e", "d", "z"], ["a", "b", "c", "d", "e"], ["q"]]
    got = similarity._overlaps(pa.array(x), pa.array(y))
    assert got.tolist() == [[len(set(s) & set(t)) for t in y] for s in x]
    table = pa.table({"first": [True] * 3 + [False] * 3, "id": [0, 1, 2, 3, 4, 5], "members": [*x, *y]})
    found = [tuple(r.values()) for b in similarity._cell(table, 0.5, "dice", False, False) for r in b.to_pylist()]
    assert sorted(found) == [(0, 3, 0.5), (0, 4, 1.0), (2, 5, 2 / 3)]
    # A cell of a block with itself, and one whose other block is empty.
    first = table.slice(0, 3)
    assert [b.to_pylist() for b in similarity._cell(first, 0.3, "dice", False, True)] == [[{"a": 0, "b": 1, "score": 1 / 3}]]
    assert not list(similarity._cell(first, 0.3, "dice", False, False))


def test_matching_with_one_large_side_is_solved_in_a_task(spark, monkeypatch):
    """Few nodes with very many edges each: 40 * 300 of them are cut to 40 * 40 before components are looked for, and none is auctioned."""
    monkeypatch.setattr(assignment, "auction", lambda *a: pytest.fail("auctioned"))
    rng = np.random.default_rng(32)
    weights = rng.random((40, 300)) + 0.01
    edges = [(i, j, float(weights[i, j])) for i in range(40) for j in range(300)]
    # Old bound: the smaller side times both sides; 1,600 edges are left.
    chosen = assignment.max_weight_matching(spark.createDataFrame(edges, "a long, b long, weight double"), cells=2000).collect()
    assert len({r.a for r in chosen}) == len({r.b for r in chosen}) == 40
    dense = matching.max_weight_pairs(weights.tolist())
    assert abs(sum(r.weight for r in chosen) - sum(weights[i, j] for i, j in dense)) < 1e-6


@pytest.mark.parametrize("few", [0, 3, 256])
def test_closest_of_few_and_of_many_wanted_texts(spark, monkeypatch, few):
    """By index, both, and all pairs, with no step settled for the last but which pages have many."""
    settled = []
    monkeypatch.setattr(similarity, "settle", lambda df, f=similarity.settle: settled.append(df.columns) or f(df))
    monkeypatch.setattr(similarity, "A_SET", few)
    rng = random.Random(33)
    text = lambda: " ".join(rng.choices([f"w{k}" for k in range(25)], k=rng.randint(1, 8)))
    nodes = [(p, k, text()) for p in range(4) for k in range(20)] + [(0, 30, None), (0, 31, ""), (2, 32, " ")]
    wanted = [(p, f"a{k}", text()) for p in range(5) for k in range(2 + p)] + [(0, "copy", nodes[3][2]), (0, "null", None), (1, "none", "unseen words"), (1, "blank", "")]
    found = matching.closest_text(spark.createDataFrame(nodes, "page int, node_ord int, node_text string"), spark.createDataFrame(wanted, "page int, attribute string, value string"), ["page"])
    got = {(r.page, r.attribute): (r.node_text, None if r.f1 is None else round(r.f1, 9)) for r in found.collect()}
    bag = lambda t: {(w, k) for w in set(t.split()) for k in range(t.split().count(w))}
    for page, attribute, value in wanted:
        scored = [(round(_dice(bag(value), bag(t)), 9), -k, t) for p, k, t in nodes if p == page and value and t and t.strip()]
        best = max(scored, default=(0, 0, None))
        assert got[page, attribute] == ((best[2], best[0]) if best[0] >= 0.25 else ("<NULL>", None))
    assert len(got) == len(wanted) and (few < 256 or settled == [["by"]])


def test_graph_without_properties_has_the_same_nodes(spark):
    rows = [("1", "D", None, "m", "py", "S1", None, "cu", 1.0, "measured"), ("1", None, "L", "n", "py", "s1 ", "a", "cu", 2.0, "measured"), ("2", None, None, None, None, None, None, None, None, None)]
    records = spark.createDataFrame(rows, "doc_id string, deposit string, laboratory string, method string, mineral string, sample_name string, sample_local_id string, element string, value_ppm double, state string")
    (nodes, edges), (bare, same_edges) = graph.build(records), graph.build(records, properties=False)
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, nodes.select("id", "type").collect()))
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, same_edges.collect()))
    # One shuffle, without joins or values merged.
    plan = bare._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "min_by" not in plan


def _calls_before_grouping(df, name):
    """Whether the optimized plan calls a function below its lowest aggregate, or more than once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    lowest = max(k for k, line in enumerate(plan) if "Aggregate" in line)
    return any(name in line for line in plan[lowest + 1 :]) or (name[0] == "_" and sum(line.count(name + "(") for line in plan) > 1)


def test_formulas_are_parsed_once_a_text(spark):
    texts = spark.createDataFrame([(k, "20Na2O-80SiO2") for k in range(5)] + [(5, "no formula"), (6, None)], "id long, text string")
    out = formula.formula_components(texts.repartition(2), ["id"], "text")
    assert not _calls_before_grouping(out, "_compositions")
    assert sorted((r.id, r.component, r.share) for r in out.collect()) == sorted((k, c, v) for k in range(5) for c, v in (("Na2O", 0.2), ("SiO2", 0.8)))


@pytest.mark.parametrize("domain", ["assay", "composition", "result"])
def test_headers_are_read_once_a_text(spark, domain):
    """As many partitions as the session has, however small the table; a header that is null and cells without header or label among them."""
    names = {"assay": ["Compound", "EGFR IC50 (nM)", "what"], "composition": ["Glass", "silica (wt%)", "lime"], "result": ["Model", "Acc.", None]}[domain]
    cells = [(d, 1, r, c, f"{r + c}" if c else "m1") for d in range(3) for r in range(2) for c in range(3)] + [(3, 1, 0, 1, "7"), (0, 1, 5, 9, "8"), (0, 1, 0, 4, ">1,000 (x) %")]
    heads = [(d, 1, c, n) for d in range(4) for c, n in enumerate(names)]
    out = pipelines.domain_records(spark.createDataFrame(cells, "doc_id long, table_no int, row int, col int, raw string").coalesce(1), spark.createDataFrame(heads, "doc_id long, table_no int, col int, header string"), domain)
    assert not _calls_before_grouping(out, "element_at") and not _calls_before_grouping(out, "Contains(lower(header")
    assert "repartition" in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = sorted((r.doc_id, r.value, r.type if domain != "composition" else r.component) for r in out.collect())
    first = [(d, str(r + 1), r) for d in range(3) for r in range(2)]
    if domain == "assay":
        assert got == sorted([(d, v, "IC50") for d, v, _ in first] + [(3, "7", "IC50")])
    elif domain == "composition":
        assert got == sorted([(d, f"{r + c}.0", n) for d in range(3) for r in range(2) for c, n in ((1, "SiO2"), (2, "CaO"))] + [(3, "7.0", "SiO2")])
    else:
        assert got == sorted([(d, v, "Result") for d, v, _ in first] + [(3, "7", "Result")])


def test_bootstrap_makes_its_resamples_once(spark):
    """The interval needs their number and their ranks; rows are read by one scan for both."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(k, float(k % 7)) for k in range(300)], "unit long, v double").repartition(3).mapInArrow(seen, "unit long, v double")
    means = metrics.poisson_bootstrap(rows, "unit", ["v"], replicates=50).select("replicate", F.col("v").alias("mean"))
    low, high, p = metrics.bootstrap_interval(means).first()
    assert read.value == 300 and 2 < low < high < 4 and p == 0


def test_draws_are_those_of_the_remainders():
    prime, below = 2147483647, metrics._POISSON
    ids = [0, 1, -1, 5, prime - 1, prime, prime + 1, 2**62, -(2**62)]
    for seed in (0, 42, -7):
        want = []
        for i in ids:
            for b in range(200):
                x = ((i % prime) * 48271 + b * 69621 + seed) % prime
                for step in range(4):
                    x = (x * x + 16807 * (step + 1) + x) % prime
                want.append(sum(x >= int(prime * p) for p in below))
        assert metrics._draws(np.array(ids), 200, seed).ravel().tolist() == want


def test_names_are_matched_once(spark):
    """What is left of the first two phases is read four times, but matched once."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    names = lambda n: spark.createDataFrame([(1, x) for x in n], "doc long, name string").coalesce(1).mapInArrow(seen, "doc long, name string")
    out = matching.name_match(names(["a", "b - 1", "c@1", "d"]), names(["a", "b-1", "c", "d_2"]), ["doc"])
    assert sorted(map(tuple, out.collect())) == [(1, "a", "a", 1), (1, "b-1", "b - 1", 2), (1, "c", "c@1", 3), (1, "d_2", "d", 3)]
    assert read.value == 8


def test_matching_deals_records_to_all_partitions(spark):
    """Two a core at least, whatever few bytes there are: what a task sorts is its part of the rows."""
    rows = spark.createDataFrame([(d, k, k % 3) for d in range(20) for k in range(5)], "doc long, ord long, value long")
    out = matching.match_passes(rows, rows, ["doc"], [["value"]])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any("RepartitionByExpression" in line and line.rstrip().endswith(f", {2 * spark.sparkContext.defaultParallelism}") for line in plan.splitlines())
    assert out.count() == 100


def test_functions_of_a_text_name_it_once(spark):
    """each time that a text is named, what is made of it is made again."""
    plan = lambda c: spark.createDataFrame([("S1",)], "texxt string").select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    named = lambda f: plan(f(F.col("texxt"))).split("LogicalRDD")[0].count("texxt#")
    counts = {f.__name__: named(f) for f in (filters.is_statistic, filters.is_heading, filters.is_unsafe_name, strings.element_header, strings.value_core, numbers.parse_cell)}
    assert set(counts.values()) == {1}, counts


def test_cells_of_tables_with_elements_in_their_header_are_not_turned(spark):
    """only tables with few element headers are looked at for labels, and those with labels are turned."""
    heads = spark.createDataFrame([("a", c, h) for c, h in enumerate(["Sample", "Fe", "Cu", "Zn"])] + [("b", 0, "Element"), ("b", 1, "S1")], "t string, col int, header string")
    labels = ["Fe", "Cu", "Zn", "Pb", "Ag"]
    cells = spark.createDataFrame([(t, r, c, x if c == 0 else "1") for t in "ab" for r, x in enumerate(labels) for c in (0, 1)], "t string, row int, col int, raw string")
    assert [tuple(r) for r in grid.transposed(cells, heads, ["t"]).collect()] == [("b", 0)]


def test_records_are_matched_once_for_all_error_classes(spark):
    """without near misses the classes are told in one scan of the records."""
    schema = "doc_id long, ord long, value string, type string, unit string"
    pred = spark.createDataFrame([(1, 1, "5 nM", "a", "u"), (1, 2, "7", "a", "u"), (1, 3, "9", "b", "u"), (1, 4, "", "a", "u")], schema)
    gold = spark.createDataFrame([(1, 1, "5", "a", "u"), (1, 2, "9", "a", "u"), (1, 3, "8", "a", "u"), (2, 1, "1", "a", "u")], schema)
    counts = matching.error_classes(pred, gold, ["doc_id"], near=False)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2
    assert dict(map(tuple, counts.collect())) == {"VAL_MATCH_ATTR_WRONG": 1, "OVER_EXTRACT": 2, "MISSED": 2, "SCHEMA_ERR": 1}


def test_rows_by_position_meet_in_one_shuffle_that_grows_with_them(spark, monkeypatch):
    """no join of rows repeated for each shift, and partitions of a bounded number of rows."""
    monkeypatch.setattr(stages, "ROWS", 100)
    rows = spark.createDataFrame([(d, k, "v", float(k + 1)) for d in range(20) for k in range(50)], "doc long, i long, element string, v double")
    out = matching.position_pairs(rows.withColumn("i", F.col("i") + 3), rows, ["doc"], "i", "element", "v")
    aligned = out._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[0]
    assert "Join" not in aligned and any("RepartitionByExpression" in line and line.rstrip().endswith(", 20") for line in aligned.splitlines())
    assert {(r.p_index - r.g_index, r.score) for r in out.collect()} == {(3, 1.0)} and out.count() == 1000


def test_cells_and_names_meet_in_one_shuffle(spark):
    """cells were shuffled by their texts, by table and text twice, by row and by column."""
    cells = spark.createDataFrame([(t, r, c, x) for t in range(5) for r in range(3) for c, x in enumerate(["glass a1", "5.0"])] + [(None, 0, 0, "glass a1"), (None, 0, 1, "5")], "t long, row int, col int, raw string")
    names = spark.createDataFrame([(t, "Glass A") for t in range(4)] + [(4, "Glass B"), (None, "Glass A")], "t long, material string")
    out = matching.material_of(cells, names, ["t"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert sorted(map(tuple, out.collect())) == [(t, r, 1, "glass a") for t in range(4) for r in range(3)]


def test_only_groups_that_share_a_table_are_linked(spark, monkeypatch):
    """the rounds of the components went over all tables and groups."""
    seen = []
    monkeypatch.setattr(consensus, "connected", lambda links, real=consensus.connected: seen.append(links.count()) or real(links))
    tables = spark.createDataFrame([(1, k, "x" * k) for k in range(9)], "doc long, ord long, t string")
    groups = spark.createDataFrame([(1, f"g{k // 3}", k) for k in range(9)] + [(1, "h", 2), (1, "h", 3)], "doc long, group_id string, ord long")
    assert sorted(r.ord for r in consensus.judge_groups(tables, groups, ["doc"], "ord", "t").collect()) == [5, 8] and seen == [2]


def test_large_components_are_matched_exactly(spark):
    """Components that are too large for a task, here all; one more edge may cost the weight of many."""
    path = [e for k in range(4) for e in [(k, k, 0.1)] + [(k + 1, k, 1.0)] * (k < 3)]
    chosen = assignment.max_weight_matching(spark.createDataFrame(path, "a long, b long, weight double"), cells=0).collect()
    assert sorted((r.a, r.b) for r in chosen) == [(k, k) for k in range(4)]
    rng = np.random.default_rng(41)
    for n, m, cardinality in ((14, 9, True), (9, 14, False)):
        weights = np.where(rng.random((n, m)) < 0.4, rng.choice([0.2, 0.5, 0.5, 0.9, 0.37], (n, m)), 0.0)
        a, b = np.nonzero(weights)
        edges = [(int(i), f"b{j}", float(weights[i, j])) for i, j in zip(a, b, strict=True)]
        chosen = assignment.max_weight_matching(spark.createDataFrame(edges, "a long, b string, weight double"), cardinality, cells=0).collect()
        best = assignment.solve(a, b, weights[a, b], cardinality)
        assert len({r.a for r in chosen}) == len({r.b for r in chosen}) == len(chosen) and {(r.a, r.b, r.weight) for r in chosen} <= set(edges)
        assert not cardinality or len(chosen) == best.sum()
        assert abs(sum(r.weight for r in chosen) - weights[a, b][best].sum()) < 1e-6


def test_graph_with_properties_as_columns_is_flattened_alike(spark):
    rows = [("1", "D", None, "m", "py", "S1", None, "cu", 1.0, "measured"), ("1", "D", None, "M", "py", "s1", None, "zn", 3.0, None), ("1", None, "L", "n", "py", "s1 ", "a", "cu", 2.0, "measured"), ("2", None, None, None, None, None, None, None, None, None), ("3", None, None, None, None, "S-spot2", None, None, None, None)]
    records = spark.createDataFrame(rows, "doc_id string, deposit string, laboratory string, method string, mineral string, sample_name string, sample_local_id string, element string, value_ppm double, state string")
    flat = graph.flatten(*graph.build(records, properties="columns"), ["cu", "zn"])
    # Nodes are merged in one shuffle, of the types that edges lead to only, before which no map or JSON is made.
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 20 and "to_json" not in plan and "map_from_entries" not in plan
    assert sorted(map(str, flat.collect())) == sorted(map(str, graph.flatten(*graph.build(records), ["cu", "zn"]).collect()))
    assert {(r.analysis, r.cu_ppm, r.zn_ppm) for r in flat.collect()} == {("analysis:1:s1", 1.0, 3.0), ("analysis:1:a", 2.0, None), ("analysis:3:s-spot2", None, None)}


def test_sets_are_shuffled_few_times_to_be_compared(spark, monkeypatch):
    # Once for each part of the other side: 32 blocks of 64,159 names were as many, and ten times the names ten times that.
    assert similarity._parts((64_159,) * 2, (1_500_000,) * 2, 48, True) == [10, 10]
    assert similarity._parts((641_590,) * 2, (15_000_000,) * 2, 48, True) == [10, 10]
    # Never fewer than a cell can hold, by sets or by members; never more than blocks of sets; cells enough for all tasks.
    assert similarity._parts((3_000_000, 100), (9_000_000, 5_000), 48, False) == [48, 1]
    assert similarity._parts((70_000, 70_000), (70_000 * 300, 70_000), 4, False) == [6, 2]
    assert similarity._parts((100, 0), (10, 0), 48, False) == [1, 1]
    monkeypatch.setattr(similarity, "BLOCK", 3)
    table = pa.table({"first": [True] * 8, "id": list(range(8)), "members": [[str(k % 3), str(k % 2)] for k in range(8)]})
    found = [tuple(r.values()) for b in similarity._cell(table, 0.5, "dice", False, True) for r in b.to_pylist()]
    overlap = similarity._overlaps(*[table.column("members").combine_chunks()] * 2)
    assert sorted(found) == [(i, j, overlap[i, j] / 2) for i in range(8) for j in range(i + 1, 8) if overlap[i, j] >= 1]
