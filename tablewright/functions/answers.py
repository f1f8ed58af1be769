"""JSON in model answers, tolerantly."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```[a-zA-Z]*\s*(.*?)```", re.S)


def _balanced(text: str) -> list[str]:
    """Spans of outermost braces that close, strings respected."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for k, ch in enumerate(text):
        if quoted:
            escaped, quoted = (not escaped and ch == "\\"), not (ch == '"' and not escaped)
        elif ch == '"' and depth:
            quoted, escaped = True, False
        elif ch == "{":
            if not depth:
                start = k
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : k + 1])
    return out


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def parse_json(text: str | None):
    """The value of an answer: as it is, inside a fence, from the first bracket, or the complete parts of a list that was cut off; None if there is none."""
    if not text:
        return None
    body = m[1] if (m := _FENCE.search(text)) else text
    for part in (body.strip(), text.strip()):
        if (value := _loads(part)) is not None:
            return value
    for a, b in (("{", "}"), ("[", "]")):
        i, j = body.find(a), body.rfind(b)
        if 0 <= i < j and (value := _loads(body[i : j + 1])) is not None:
            return value
    if m := re.search(r'"(\w+)"\s*:\s*\[', body):
        items = [v for s in _balanced(body[m.end() :]) if (v := _loads(s)) is not None]
        if items:
            return {m[1]: items}
    items = [v for s in _balanced(body) if (v := _loads(s)) is not None]
    return items or None


def parse_records(text: str | None, required: tuple[str, ...] = ()) -> list[dict]:
    """The records of an answer: a list, an object or one under a list's name, lines of JSON, or objects in prose; those with all required keys."""
    value = parse_json(text)
    if isinstance(value, dict):
        inner = next((v for v in value.values() if isinstance(v, list) and any(isinstance(x, dict) for x in v)), None)
        value = inner if inner is not None else [value]
    rows = [v for v in value or [] if isinstance(v, dict)] if isinstance(value, list) else []
    if text:
        lines = [v for line in text.splitlines() if line.strip().startswith("{") and isinstance(v := _loads(line.strip().rstrip(",")), dict)]
        spans = [v for s in _balanced(text) if isinstance(v := _loads(s), dict)] if not rows else []
        rows = max(rows, lines, spans, key=len)
    return [r for r in rows if all(r.get(k) not in (None, "") for k in required)]


@F.pandas_udf(T.StringType())
def answer_json(s: pd.Series) -> pd.Series:
    """N10 over a column: the value as canonical JSON."""
    return s.map(lambda t: None if (v := parse_json(t)) is None else json.dumps(v, sort_keys=True))


def records(c: Column, required: tuple[str, ...] = ()) -> Column:
    """N11 over a column: an array of JSON objects."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [json.dumps(r, sort_keys=True) for r in parse_records(t, required)])

    return run(c)


def tolerant(c: Column, schema: str) -> Column:
    """from_json, with the tolerant parser only where that finds nothing."""
    valid = F.get_json_object(c, "$").isNotNull()  # the others alone reach Python
    return F.coalesce(F.when(valid, F.from_json(c, schema)), F.from_json(answer_json(F.when(~valid, c)), schema))


HINTS = "header_row int, skip_rows int, transpose boolean, min_element_cols int, sample_id_col string, unit_override string, sheet_name string"


def hints(c: Column) -> Column:
    """Parsing hints of the right types; others are null."""
    return tolerant(c, HINTS)
