"""Table text to cell grids: (table_no, row, col, is_header, raw).

Parsers are plain functions over one text, run as Arrow map functions over a column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.functions import vocab

Cell = tuple[int, int, int, bool, str]
CELLS = "table_no int, row int, col int, is_header boolean, raw string"
_NUMERIC = re.compile(r"^[<>~]?\s*[-+]?(\d[\d,]*\.?\d*|\.\d+)([eE][-+]?\d+)?\s*%?$")


def is_numeric(text: str) -> bool:
    """A number, after a comparator, before an uncertainty or a bracket; dashes are none."""
    s = re.sub(r"\(.*?\)", "", text.split("±")[0]).strip()
    return bool(_NUMERIC.match(s))


class _Tables(HTMLParser):
    def __init__(self, tags: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.tags, self.cells, self.table, self.row, self.col = tags, [], -1, -1, -1
        self.head, self.text = False, None

    def _close(self):
        if self.text is not None:
            self.cells.append((max(self.table, 0), max(self.row, 0), self.col, self.head_cell, re.sub(r"\s+", " ", "".join(self.text)).strip()))
            self.text = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._close()
            self.table, self.row = self.table + 1, -1
        elif tag == "thead":
            self.head = True
        elif tag == "tr":
            self._close()
            self.row, self.col = self.row + 1, -1
        elif tag in self.tags:
            self._close()
            self.col += 1
            self.head_cell, self.text = self.head, []

    def handle_endtag(self, tag):
        if tag in self.tags or tag in ("tr", "table"):
            self._close()
        elif tag == "thead":
            self.head = False

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def html_cells(html: str, tags: tuple[str, ...] = ("td", "th")) -> list[Cell]:
    """Cells of all tables, spans not spread. Rows of a head are headers; without one the first row is, if under half of it is numeric."""
    parser = _Tables(tags)
    parser.feed(html)
    parser._close()
    cells = parser.cells
    out = []
    for t in sorted({c[0] for c in cells}):
        own = [c for c in cells if c[0] == t]
        if not any(c[3] for c in own):
            first = [c[4] for c in own if c[1] == min(x[1] for x in own)]
            head = min(x[1] for x in own) if sum(map(is_numeric, first)) < 0.5 * len(first) else -1
            own = [(a, r, c, r == head, s) for a, r, c, _, s in own]
        out += own
    return out


_RULE = re.compile(r"^\|?[\s:|-]+\|?$")


def _split_row(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def markdown_cells(text: str) -> list[Cell]:
    """Cells of blocks of three or more lines that start and end with a bar; rulings go, rows are cut or filled to the header's width, further leading rows that are hardly numeric are headers too."""
    blocks, block = [], []
    for line in [*text.split("\n"), ""]:
        s = line.strip()
        if len(s) > 1 and s.startswith("|") and s.endswith("|"):
            block.append(s)
        else:
            if len(block) >= 3:
                blocks.append(block)
            block = []
    out = []
    for t, lines in enumerate(blocks):
        rows = [_split_row(x) for x in lines if not (_RULE.match(x) and "-" in x)]
        width, leading = len(rows[0]) if rows else 0, True
        for r, row in enumerate(rows):
            filled = [c for c in row if c]
            leading = leading and (r == 0 or bool(filled) and sum(map(is_numeric, filled)) <= 0.5 * len(filled) and r < len(rows) - 1)
            out += [(t, r, c, leading, x) for c, x in enumerate((row + [""] * width)[:width])]
    return out


_DASHES = {"-", "--", "–", "—", *vocab.BELOW_DETECTION_WORDS}


def _element(token: str) -> bool:
    return re.sub(r"[^a-z]", "", token.lower()) in set(vocab.ELEMENTS) | set(vocab.ELEMENT_NAMES)


def whitespace_cells(text: str) -> list[Cell]:
    """Tables of aligned words in a page's text.

    A header line has 10 characters, 4 words and 3 elements or more; words that are none
    are joined.  Its rows have about as many words (2 more or fewer), three in ten of them
    numbers or marks of missing values; up to 7 lines before the first row and single
    lines between rows are passed over.  Tables of one row are none.
    """
    lines, out, table, i = text.split("\n"), [], 0, 0
    while i < len(lines):
        tokens = lines[i].split()
        if len(lines[i].strip()) < 10 or len(tokens) < 4 or sum(map(_element, tokens)) < 3:
            i += 1
            continue
        header: list[str] = []
        for w in tokens:
            if header and not _element(w) and not _element(header[-1]):
                header[-1] += " " + w
            else:
                header.append(w)
        rows, missed, j = [], 0, i + 1
        while j < len(lines) and missed <= (1 if rows else 7):
            own = lines[j].split()
            values = sum(is_numeric(w) or w.lower() in _DASHES for w in own)
            if own and abs(len(own) - len(header)) <= 2 and values >= 0.3 * len(own):
                rows.append(own)
                missed = 0
            else:
                missed += 1
            j += 1
        if len(rows) >= 2:
            for r, row in enumerate([header, *rows]):
                if r and len(row) > len(header):
                    extra = len(row) - len(header)
                    row = [" ".join(row[: extra + 1]), *row[extra + 1 :]]
                out += [(table, r, c, r == 0, x) for c, x in enumerate(row)]
            table += 1
            i = j
        else:
            i += 1
    return out


def parse_tables(docs: DataFrame, text: str, parser: Callable[[str], list[Cell]]) -> DataFrame:
    """The other columns of docs with one row for each cell that the parser finds in a text."""
    keep = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []
            for k, t in enumerate(batch.column(text).to_pylist()):
                found = parser(t) if t else []
                at += [k] * len(found)
                cells += found
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            columns = [pa.array([c[j] for c in cells], kind) for j, kind in enumerate(kinds)]
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, *columns], [*keep, "table_no", "row", "col", "is_header", "raw"])

    return docs.select(*keep, text).mapInArrow(run, f"{schema}, {CELLS}" if schema else CELLS)
