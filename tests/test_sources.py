import io
import json
import zipfile
from xml.sax.saxutils import escape

from tablewright.plans import cli, graph, models, pipelines
from tablewright.sources import files, sinks, tables


def workbook(sheets):
    """Bytes of a workbook with shared strings and numbers."""
    strings, parts = [], {}
    for k, (_, rows) in enumerate(sheets.items(), 1):
        xml = ""
        for r, row in enumerate(rows, 1):
            for c, v in enumerate(row):
                ref = f"{chr(65 + c)}{r}"
                if isinstance(v, str):
                    strings.append(v)
                    xml += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
                else:
                    xml += f'<c r="{ref}"><v>{v}</v></c>'
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{xml}</sheetData></worksheet>'
    names = "".join(f'<sheet name="{n}" sheetId="{k}"/>' for k, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets>{names}</sheets></workbook>'
    parts["xl/sharedStrings.xml"] = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def folder(tmp_path):
    book = workbook({"Data": [["Sample", "Fe (wt%)", "Cu ppm", "Zn ppb"], ["S1", 1.5, "<5", 2000], ["S2", "bdl", 7, 3000], ["Mean", 1, 1, 1]], "LOD": [["x", "y"]]})
    (tmp_path / "2020_Smith_etal.xlsx").write_bytes(book)
    (tmp_path / "a.csv").write_bytes("Sample,Fe,Ag,Au\nP1,1,n/a,3\nP2,\xb5,5,6\n".encode("latin-1"))
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.csv", "Sample,Pb,Zn,Cu\nQ1,1,2,3\n")
        z.writestr("__MACOSX/in.csv", "x")
    return tmp_path


def test_grids(spark, tmp_path):
    grids = files.data_sheets(files.read_grids(spark, str(folder(tmp_path))))
    got = {(r.source_file.rsplit("/", 1)[1], r.sheet) for r in grids.collect()}
    assert got == {("2020_Smith_etal.xlsx", "Data"), ("a.csv", ""), ("z.zip!in.csv", "")}


def test_cli_extract_and_graph(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    folder(source)
    cli.main(["extract", str(source), str(out)], spark)
    rows = {(r.sample_name, r.element): (r.value_ppm, r.state) for r in spark.read.parquet(str(out)).collect()}
    assert rows["S1", "fe"] == (15000.0, "measured") and rows["S1", "cu"] == (None, "bdl_known") and rows["S1", "zn"] == (2.0, "measured")
    assert rows["S2", "fe"] == (None, "bdl_unknown") and rows["P1", "ag"] == (None, "not_measured") and not any(k[0] == "Mean" for k in rows)
    cli.main(["graph", str(source), str(tmp_path / "graph")], spark)
    assert spark.read.parquet(str(tmp_path / "graph/edges")).count() > 0
    cli.main(["batch", str(source), str(tmp_path / "batch")], spark)
    n = spark.read.json(str(tmp_path / "batch")).count()
    cli.main(["batch", str(source), str(tmp_path / "batch")], spark)
    assert spark.read.json(str(tmp_path / "batch")).count() == n


def test_html():
    cells = tables.html_cells("<table><tr><th>A</th><th>B</th></tr><tr><td>1<td>2&lt;3</table><table><tr><td>1</td><td>2</td></tr></table>")
    assert cells == [(0, 0, 0, True, "A"), (0, 0, 1, True, "B"), (0, 1, 0, False, "1"), (0, 1, 1, False, "2<3"), (1, 0, 0, False, "1"), (1, 0, 1, False, "2")]


def test_markdown():
    cells = tables.markdown_cells("x\n| a | b |\n|---|---|\n| 1 | 2 | 3 |\n| 4 |\n\n| no |\n")
    assert [(c[1], c[2], c[3], c[4]) for c in cells] == [(0, 0, True, "a"), (0, 1, True, "b"), (1, 0, False, "1"), (1, 1, False, "2"), (2, 0, False, "4"), (2, 1, False, "")]


def test_whitespace_tables():
    cells = tables.whitespace_cells("Some text\nSample Fe Cu Zn Pb\nS1 1 2 3 4\nnote\nS2 1 bdl - 4\n\n\nend")
    assert {c[1] for c in cells} == {0, 1, 2} and (0, 2, 2, False, "bdl") in cells


def test_gold_and_predictions(spark, tmp_path):
    (tmp_path / "gold").mkdir()
    (tmp_path / "pred").mkdir()
    (tmp_path / "gold/g.json").write_text(json.dumps({"P1::t1": {"cell_list_gold": [{"value": "1", "type": "a"}]}, "P2::t1": {"cell_list_gold": []}}))
    for name, text in (("P1", '[{"value": "1", "type": "a"}]'), ("P3", '{"predictions": [], "tuples": [{"value": "2"}]}'), ("P4", "no json"), ("summary", "{}")):
        (tmp_path / f"pred/{name}.json").write_text(text)
    gold = files.read_gold(spark, str(tmp_path / "gold"), "value: string, type: string")
    assert [(r.doc_id, r.ord, r.value) for r in gold.collect()] == [("P1", 0, "1")]
    docs = spark.createDataFrame([("P1",), ("P4",), ("P9",)], "doc_id string")
    pred = files.read_predictions(spark, str(tmp_path / "pred"), "value: string, type: string", docs)
    assert sorted((r.doc_id, r.value) for r in pred.collect()) == [("P1", "1"), ("P4", None), ("P9", None)]
    assert [r[0] for r in spark.createDataFrame([("a_b_table3",), ("a",)], "t string").select(files.doc_of("t", "_table")).collect()] == ["a_b", "a"]


def test_discovery(spark):
    listing = spark.createDataFrame([(n, f"/x/{n}") for n in ("2020_Smith_etal.pdf", "2020_Smith_etal_supp.xlsx", "2021_Müller.pdf", "2021_Muller_S1.csv")], "name string, path string")
    got = {r.stem: r.supplement_path for r in files.discover(listing).collect()}
    assert got["2020_Smith_etal"] == "/x/2020_Smith_etal_supp.xlsx"
    assert [r.name for r in files.find_by_author(listing, "2021", "Müller", "S1").collect()] == ["2021_Müller.pdf"]


def test_pipeline_votes_and_turns(spark):
    def grid(backend, rows):
        return [("d", backend, 0, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]

    plain = [["Sample", "Fe ppm", "Cu ppm", "Zn ppm"], ["A", "1", "2", ""], ["B", "4", "5", "6"]]
    other = [["Sample", "Fe ppm", "Cu ppm", "Zn ppm"], ["A", "1", "2", "3"]]
    turned = [["Element", "T1", "T2"], ["Fe", "1", "2"], ["Cu", "3", "4"], ["Zn", "5", "6"], ["Pb", "7", "8"], ["Ag", "9", "10"]]
    cells = spark.createDataFrame([*grid("docling", plain), *grid("marker", other), *[("e", "docling", 0, r, c, v) for r, row in enumerate(turned) for c, v in enumerate(row)]], "doc_id string, backend string, table_no int, row int, col int, raw string")
    got = {(r.doc_id, r.sample_name, r.element): (r.value_ppm, r.confidence) for r in pipelines.extract(cells).collect()}
    assert got["d", "A", "zn"] == (3.0, 0.5) and got["d", "A", "fe"] == (1.0, 1.0) and got["e", "T2", "ag"] == (10.0, 1.0)
    assert len(pipelines.ablations(pipelines.Config())) == 14


def test_extract_stages(spark):
    """B02, A02, B16, B17, W01, B19, N13 and F03 as stages of the pipeline, each with its switch."""
    grids = {
        ("numbers", "docling"): [["0", "1", "2", "3"], ["Sample", "Fe ppm", "Cu ppm", "Zn ppm"], ["A", "1", "2", "3"]],
        ("second", "docling"): [["Sample", "Fe ppm", "Cu ppm", "Zn ppm"], ["", "", "", "", "Mineral"], ["A", "1", "2", "3", "py, sph"]],
        ("sparse", "docling"): [["Sample", "Fe ppm", "Cu ppm", "Zn ppm"]] + [[f"S{k // 5}" if k % 5 == 0 else "", str(k + 1), "2", "3"] for k in range(15)],
        ("spots", "docling"): [["Sample", "Spot", "Fe ppm", "Cu ppm", "Zn ppm"], ["A", "1", "1", "2", "3"], ["A", "2", "4", "5", "6"], ["B", "1", "7", "8", "9"]],
        ("statistics", "pdftext"): [["Sample", "Fe ppm", "Cu ppm", "Zn ppm"], ["A", "1", "2", "3"], ["Median", "1", "2", "3"]],
        ("flags", "docling"): [["Sample", "Fe ppm", "Cu ppm", "Zn ppm"], ["A", "1", "2", "3"], ["Mean", "1", "2", "3"], ["Total", "4", "5", "6"]],
    }
    cells = [(d, b, 0, r, c, v) for (d, b), rows in grids.items() for r, row in enumerate(rows) for c, v in enumerate(row) if v]
    cells = spark.createDataFrame(cells, "doc_id string, backend string, table_no int, row int, col int, raw string")
    base = pipelines.Config(backends=("docling", "pdftext"))

    def run(**changes):
        got = {}
        for r in pipelines.extract(cells, base.variant(**changes)).where("element = 'fe'").collect():
            got.setdefault(r.doc_id, []).append((r.sample_name, r.sample_local_id, r.mineral, r.value_ppm))
        return {k: sorted(v, key=str) for k, v in got.items()}

    got = run()
    assert got["numbers"] == [("A", None, None, 1.0)] and "statistics" not in got and got["flags"] == [("A", None, None, 1.0)]
    assert got["second"] == [("A", None, "py", 1.0), ("A", None, "sph", 1.0)]
    assert got["spots"] == [("A", "A-spot1", None, 1.0), ("A", "A-spot2", None, 4.0), ("B", "B-spot1", None, 7.0)]
    assert len(got["sparse"]) == 15 and ("S1", "S1-5", None, 10.0) in got["sparse"]
    other = run(fill_ids=False, filter_rows=False, explode_minerals=False, promote=False, text_backends=())
    assert len(other["sparse"]) == 3 and len(other["statistics"]) == 1
    assert other["second"] == [("A", None, None, 1.0)]  # without the second header row the column of minerals has no name
    assert [r[0] for r in other["flags"]] == ["A", "Total"]  # a fifth of the samples at most, one at least: the first flagged
    assert [r[0] for r in run(filter_rows=False, validate=False)["flags"]] == ["A", "Mean", "Total"]
    assert set(run(only_data_tables=True)) == {"sparse", "spots", "flags"}
    assert set(pipelines.grid_ablations(base)) == {"no_promotion", "no_id_fill", "no_row_filter", "only_data_tables"}


def test_graph_round_trip(spark):
    rows = spark.createDataFrame([("p", "D", None, "EPMA", "pyrite", "S1@1", "S1-1", "cu", 5.0, "measured"), ("p", "D", None, "SIMS", "pyrite", "S1@1", "S1-1", "cu", 6.0, "measured")], "doc_id string, deposit string, laboratory string, method string, mineral string, sample_name string, sample_local_id string, element string, value_ppm double, state string")
    nodes, edges = graph.build(rows, element_edges=True)
    kinds = {(r.kind, r.type): r.n for r in graph.statistics(nodes, edges).collect()}
    assert kinds["node", "measurement"] == 2 and kinds["edge", "measures_element"] == 2 and kinds["node", "sample"] == 1
    flat = graph.flatten(nodes, edges, ["cu"]).collect()
    assert [(r.sample_name, r.mineral, r.cu_ppm) for r in flat] == [("S1", "pyrite", 6.0)]
    assert sinks.graphml(nodes, edges).count() == nodes.count() + edges.count()


def test_models(spark):
    docs = spark.createDataFrame([(1, "Cu 5 and more than thirty characters of text"), (2, "none")], "doc_id int, text string")
    client = models.retrying(lambda ps: ['{"records": [{"value": "5"}]}' if "Cu" in p else "no" for p in ps], 2, 0)
    assert [(r.doc_id, json.loads(r.record)) for r in models.extract_records(docs, client).collect()] == [(1, {"value": "5"})]
    assert [r.doc_id for r in models.relevant_tables(docs, client).collect()] == [1]
    known = models.complete(docs.selectExpr("'x' as prompt"), models.stub({models.prompt_hash("x"): "y"}))
    assert known.collect()[0].answer == "y"
    first = spark.createDataFrame([(1, 1, False), (2, 5, True)], "d int, score int, passed boolean")
    tries = models.Correction(lambda failing, k: failing.selectExpr("d", f"score + {k} as score", f"score + {k} > 2 as passed"))
    assert sorted(tuple(r) for r in tries.run(first, ["d"], "score", "passed").select("d", "score", "passed").collect()) == [(1, 4, True), (2, 5, True)]
    assert models.fill_cells(["a", "b"], lambda cs: cs[:1] + ["?"] * (len(cs) - 1), lambda a: a if a != "?" else None) == {"a": "a", "b": "b"}


def test_streaming_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from tablewright.streaming import incremental

    rows = spark.createDataFrame([(k, "ab"[k % 2], float(k)) for k in range(20)], "s int, k string, value double").selectExpr("timestamp_seconds(s * 30) as ts", "k", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_counts(stream, "ts", "k", "2 minutes").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    want = rows.groupBy(F.window("ts", "2 minutes").alias("w"), "k").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "k", "n", "total")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))
    for _ in range(2):
        incremental.append_scores(stream.selectExpr("k as doc_id", "value"), lambda b: b.groupBy("doc_id").count(), str(tmp_path / "out"), str(tmp_path / f"ck{_}")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 10), ("b", 10)]
