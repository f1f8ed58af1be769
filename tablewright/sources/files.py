"""Files to cell grids and records, and back.

Delimited files, workbooks and archives are read from the bytes that Spark's binaryFile
source gives, so any store that Spark reads will do.  Workbooks need no library: they are
archives of XML.  PDF extraction is a plug-in (see plans.models.Backend).
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import numbers, strings, vocab
from tablewright.operators import ranks

GRID = "source_file string, sheet string, row int, col int, raw string"
#: Words in the names of sheets that hold no samples.
SKIPPED_SHEETS = ["lod", "detection limit", "reference material", "ref material", "standard", "certified", "blank"]


def decode(content: bytes) -> str:
    """UTF-8 with or without a mark, else Latin-1."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def csv_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, raw) of a delimited file; empty cells are left out."""
    for r, row in enumerate(csv.reader(io.StringIO(decode(content), newline=""))):
        for c, x in enumerate(row):
            if x.strip():
                yield "", r, c, x


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, raw) of a workbook's sheets: shared and inline strings, numbers and results of formulas; styles and dates stay as stored."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {}
        if "xl/_rels/workbook.xml.rels" in names:
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for k, sheet in enumerate(book.find("m:sheets", _NS), 1):
            target = (links.get(sheet.get(_REL)) or f"worksheets/sheet{k}.xml").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            if path not in names:
                continue
            for cell in ElementTree.fromstring(z.read(path)).iter(f"{{{_NS['m']}}}c"):
                m = re.match(r"([A-Z]+)(\d+)", cell.get("r", ""))
                if not m:
                    continue
                col = 0
                for ch in m[1]:
                    col = col * 26 + ord(ch) - 64
                if cell.get("t") == "inlineStr":
                    raw = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                else:
                    value = cell.find("m:v", _NS)
                    raw = (value.text or "") if value is not None else ""
                    if cell.get("t") == "s" and raw:
                        raw = shared[int(raw)]
                if raw.strip():
                    yield sheet.get("name", f"Sheet{k}"), int(m[2]) - 1, col - 1, raw


def expand(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """The file itself, or the tables inside an archive of files (system folders aside)."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for member in z.namelist():
                if member.lower().endswith((".xlsx", ".csv")) and not member.startswith("__MACOSX"):
                    yield f"{name}!{member}", z.read(member)
    else:
        yield name, content


def cells_of(name: str, content: bytes) -> Iterator[tuple]:
    """(file, sheet, row, col, raw, error) by the file's ending: its cells, or one row that says why there are none."""
    try:
        members = list(expand(name, content))
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
        yield (name, None, None, None, None, f"{type(e).__name__}: {e}")
        return
    for path, data in members:
        kind = path.lower().rsplit(".", 1)[-1]
        try:
            if kind not in ("xlsx", "csv", "txt"):
                raise ValueError(f"no reader for .{kind}")
            for row in list(xlsx_cells(data) if kind == "xlsx" else csv_cells(data)):
                yield (path, *row, None)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, csv.Error) as e:
            yield (path, None, None, None, None, f"{type(e).__name__}: {e}")


def _read(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            cells = [c for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in cells_of(p, data)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate(kinds)], ["source_file", "sheet", "row", "col", "raw", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, f"{GRID}, error string")


def read_grids(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Cell grids of all tables in files: source_file, sheet, row, col, raw.  Files that cannot be read have none; unreadable() names them."""
    return _read(spark, path, pattern).where("error is null").drop("error")


def unreadable(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(source_file, error) of files, and members of archives, that are of no known kind or cannot be read."""
    return _read(spark, path, pattern).where("error is not null").select("source_file", "error")


def data_sheets(grids: DataFrame) -> DataFrame:
    """Cells of sheets whose name has no word of skipped sheets."""
    return grids.where(~numbers.has_mark(F.col("sheet"), SKIPPED_SHEETS))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows, with null for columns that a frame lacks."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_pages(spark: SparkSession, path: str, most: int = 5000) -> DataFrame:
    """Extracted page text (doc_id, page_no, text) from text files with form feeds between pages, each page cut to `most` characters."""
    docs = spark.read.format("text").option("wholetext", "true").load(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("doc_id"), "value")
    return docs.select("doc_id", F.posexplode(F.split("value", "\f")).alias("page", "text")).select("doc_id", (F.col("page") + 1).alias("page_no"), F.left(strings.page_text(F.col("text")), F.lit(most)).alias("text"))


def doc_of(table_id, style: str = "::"):
    """The document's part of a table id: before ::, or before the last _table."""
    return F.substring_index(table_id, "::", 1) if style == "::" else F.regexp_replace(table_id, r"_table(?!.*_table).*$", "")


def read_gold(spark: SparkSession, path: str, fields: str, style: str = "::") -> DataFrame:
    """Gold records (doc_id, table_id, ord, fields...) of a JSON object by table id; tables without records are left out."""
    kind = f"map<string, struct<cell_list_gold: array<struct<{fields}>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("table_id", "entry"))
    rows = raw.select("table_id", F.posexplode("entry.cell_list_gold").alias("ord", "cell"))
    return rows.select(doc_of(F.col("table_id"), style).alias("doc_id"), "table_id", "ord", "cell.*")


def read_predictions(spark: SparkSession, path: str, fields: str, documents: DataFrame | None = None) -> DataFrame:
    """Predicted records (doc_id, ord, fields...) of one JSON file a document: a list, or the first of predictions, extracted, tuples that is not empty.

    Summaries are skipped; files that are no JSON have no records.  documents: doc_id; all
    of them stay, those without records with null ord.
    """
    lists = f"array<struct<{fields}>>"
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1).alias("doc_id"), F.col("value"))
    raw = raw.where(~F.col("doc_id").isin("summary", "evidence"))
    record = F.from_json("value", f"struct<predictions: {lists}, extracted: {lists}, tuples: {lists}>")
    pick = lambda c: F.when(F.size(c) > 0, c)
    found = F.when(F.ltrim("value").startswith("["), F.from_json("value", lists)).otherwise(F.coalesce(*[pick(record[k]) for k in ("predictions", "extracted", "tuples")]))
    rows = raw.select("doc_id", F.posexplode(found).alias("ord", "cell")).select("doc_id", "ord", "cell.*")
    return rows if documents is None else documents.select("doc_id").join(rows, "doc_id", "left")


def registry(papers: DataFrame, files: DataFrame) -> DataFrame:
    """Papers (paper_id, pdf, supplement) with the paths of their files (name, path), and processable or the reason why not."""
    pdf = files.select(F.col("name").alias("pdf"), F.col("path").alias("pdf_path"))
    extra = files.select(F.col("name").alias("supplement"), F.col("path").alias("supplement_path"))
    rows = papers.join(pdf, "pdf", "left").join(extra, "supplement", "left")
    reason = F.when(F.col("pdf_path").isNull() & F.col("supplement_path").isNull(), "no files").when(F.col("pdf_path").isNull(), "no pdf")
    return rows.withColumns({"skip_reason": reason, "processable": F.col("pdf_path").isNotNull() | F.col("supplement_path").isNotNull()})


def discover(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Supplements (name, path) found for each PDF by the prefix year_author_etal, else by year and author."""
    stem = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1)
    rows = files.withColumn("stem", stem).withColumn("prefix", F.regexp_extract("stem", r"^(\d{4}[A-Z]?_\w+?_etal)", 1))
    rows = rows.withColumn("short", F.regexp_extract("stem", r"^(\d{4}[A-Z]?_[A-Za-z]+)", 1))
    pdfs = rows.where(F.lower("name").endswith(".pdf")).select("stem", "prefix", "short", F.col("path").alias("pdf_path"))
    if known is not None:
        pdfs = pdfs.join(known.select("stem"), "stem", "left_anti")
    extra = rows.where(F.lower("name").rlike(r"\.(xlsx|xls|csv|zip)$")).select(F.col("path").alias("supplement_path"), F.col("prefix").alias("s_prefix"), F.col("short").alias("s_short"))
    first = pdfs.where("prefix <> ''").join(extra, F.col("prefix") == F.col("s_prefix")).select("stem", "pdf_path", "supplement_path")
    left = pdfs.join(first.select("stem"), "stem", "left_anti")
    second = left.join(extra, (F.col("short") == F.col("s_short")) & (F.col("short") != ""), "left").select("stem", "pdf_path", "supplement_path")
    return first.unionByName(second)


def find_by_author(files: DataFrame, year: str, author: str, excluded: str = r"(?i)supp|guide|appendix") -> DataFrame:
    """Files whose ASCII-folded name starts with the year and has the author as a whole word; supplements aside."""
    from unicodedata import normalize

    plain = normalize("NFKD", author).encode("ascii", "ignore").decode()
    name = strings.ascii_fold(F.col("name"))
    return files.where(name.startswith(year) & name.rlike(rf"(?i)(^|[^A-Za-z]){re.escape(plain)}([^A-Za-z]|$)") & ~F.col("name").rlike(excluded))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary (field, term) from a CSV with these headers; a missing file is an empty one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.csv(path, header=True).select("field", "term")
    except AnalysisException:
        return spark.createDataFrame([], "field string, term string")


def benchmark_slice(tables: DataFrame, table_id: str, gold: str | None, start: int = 0, end: int | None = None) -> DataFrame:
    """Tables in order of id, from start to end; with gold, only those that have some.  The order is made by ranges of the id."""
    rows = tables if gold is None else tables.where(F.size(gold) > 0)
    numbered = ranks.global_ranks(rows, table_id, table_id)
    k = F.col("row_number") - 1
    return numbered.where((k >= start) & (F.lit(True) if end is None else k < end)).select(*rows.columns)


def file_facts(files: DataFrame, path: str) -> DataFrame:
    """Files with what their names tell: publication_year (four digits that start the name) and analytical_method (the first that the name holds)."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    method = strings.first_pattern(F.translate(name, "_", " "), list(vocab.METHODS.items()))
    return files.withColumns({"publication_year": numbers.leading_year(F.col(path)), "analytical_method": method})


def first_backend(tables: DataFrame, doc: list[str], order: list[str], forced: str | None = None) -> DataFrame:
    """Raw tables (doc..., backend, ...) of the first backend in order that has any; forced: of that one or none."""
    if forced:
        return tables.where(F.col("backend") == forced)
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("backend"))
    rows = tables.where(rank > 0).withColumn("__rank", rank)
    best = rows.groupBy(*doc).agg(F.min("__rank").alias("__rank"))
    return rows.join(best, [*doc, "__rank"], "left_semi").drop("__rank")


