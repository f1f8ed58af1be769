"""Composition formulas of glasses (H14): a small grammar over tokens, with amounts that are linear in variables.

    composition := term (separator? term)*        two terms at least, or a bracket, and an amount somewhere
    term        := amount? unit  or  unit amount?  one of the two ways all along; elements take amounts behind only
    unit        := compound | element | bracket of a composition
    amount      := scalar (sign scalar)* | bracket of that | number %      a scalar is 60, x, 2x or x/2
    remainder   := bal., balance, rest             in place of one amount: what is left of 100 (of 1, if the others are shares)

A group's amount goes to its parts by their shares.  Variables have values by the caller, or by what the text says of them
(x = 0.5; x + y = 40), which is solved as far as one unknown at a time goes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import vocab
from tablewright.plans.stages import spread

_ELEMENTS = {e.capitalize() for e in [*vocab.ELEMENTS, *map(str.lower, vocab.COMPONENT_ELEMENTS)]}
_COMPOUNDS = sorted((c for c in vocab.COMPOUNDS if any(x.isdigit() or x.islower() or x == "O" for x in c) and c != "Amorphous"), key=len, reverse=True)
_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<rest>(?:bal(?:ance|\.)?|rest)(?![a-z]))"
    + rf"|(?P<compound>(?:{'|'.join(map(re.escape, _COMPOUNDS))})(?![a-z]|\d*\.\d))"
    + r"|(?P<element>[A-Z][a-z]?)|(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<variable>[xyzX](?![a-z]))|(?P<open>[(\[])|(?P<close>[)\]])|(?P<percent>%)|(?P<sign>[-+/])|(?P<separator>[*:,])"
)
_PAIR = {"(": ")", "[": "]"}
#: Marks of other scripts that stand for the grammar's own.
_PLAIN = str.maketrans({"·": "*", "∙": "*", "×": "*", "–": "-", "—": "-", "−": "-", **{chr(0x2080 + d): str(d) for d in range(10)}})

Linear = dict[str, float]


def _plus(a: Linear, b: Linear, factor: float = 1.0) -> Linear:
    return {k: a.get(k, 0.0) + factor * b.get(k, 0.0) for k in a.keys() | b.keys()}


def _value(a: Linear, known: dict[str, float]) -> float | None:
    """The number that an amount is, if its variables are known."""
    if any(k not in known for k, c in a.items() if k and c):
        return None
    return sum(c * known.get(k, 1.0) for k, c in a.items() if c)


class _Parser:
    """Reads compositions out of the tokens of a text; a token is (kind, text, start, end)."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            kind = m.lastgroup if m else "other"
            end = m.end() if m else at + 1
            if kind == "element" and m[0] not in _ELEMENTS:
                kind, end = ("element", at + 1) if m[0][0] in _ELEMENTS and not m[0][1:].islower() else ("other", end)
            if kind != "space":
                self.tokens.append((kind, text[at:end], at, end))
            at = end

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if i < len(self.tokens) else "end"

    def scalar(self, i: int):
        """(amount, next): a number, a variable, one times the other, or that by a number."""
        if self.kind(i) == "number":
            value: Linear = {"": float(self.tokens[i][1])}
            i += 1
            if self.kind(i) == "variable":
                value, i = {self.tokens[i][1]: value[""]}, i + 1
        elif self.kind(i) == "variable":
            value, i = {self.tokens[i][1]: 1.0}, i + 1
        else:
            return None
        while self.kind(i) == "sign" and self.tokens[i][1] == "/" and self.kind(i + 1) == "number" and float(self.tokens[i + 1][1]):
            value, i = {k: v / float(self.tokens[i + 1][1]) for k, v in value.items()}, i + 2
        return value, i

    def amount(self, i: int):
        """(amount, next), None if there is none."""
        if self.kind(i) == "rest":
            return None, i + 1
        if self.kind(i) == "open":
            inside = self.amount(i + 1)
            if inside is None or inside[0] is None or self.kind(inside[1]) != "close" or self.tokens[inside[1]][1] != _PAIR[self.tokens[i][1]]:
                return None
            return inside[0], inside[1] + 1
        first = self.scalar(i)
        if first is None:
            return None
        total, i = first
        if self.kind(i) == "percent":
            return total, i + 1
        while self.kind(i) == "sign" and self.tokens[i][1] != "/" and (more := self.scalar(i + 1)):
            total, i = _plus(total, more[0], 1.0 if self.tokens[i][1] == "+" else -1.0), more[1]
        return total, i

    def unit(self, i: int, after: bool):
        """(parts, next, whether it is a bracket): a part is (name, share of the unit as (above, below))."""
        kind = self.kind(i)
        if kind == "compound" or kind == "element":
            return ([(self.tokens[i][1], {"": 1.0}, {"": 1.0})], i + 1, False) if after or kind == "compound" else None
        if kind == "open":
            for way in (True, False):
                inside = self.terms(i + 1, way)
                if inside and self.kind(inside[1]) == "close" and self.tokens[inside[1]][1] == _PAIR[self.tokens[i][1]] and not any(a is None for _, a, _ in inside[0]):
                    total: Linear = {}
                    for _, a, _ in inside[0]:
                        total = _plus(total, a)
                    # Shares of shares have no linear form: an inner group must have numbers only.
                    parts = []
                    for unit, a, _ in inside[0]:
                        for name, above, below in unit:
                            if below == {"": 1.0} and above == {"": 1.0}:
                                parts.append((name, a, total))
                            elif set(a) <= {""} and set(total) <= {""}:
                                f = a.get("", 0.0) / total[""] if total.get("") else 0.0
                                parts.append((name, {k: v * f for k, v in above.items()}, below))
                            else:
                                return None
                    return parts, inside[1] + 1, True
        return None

    def term(self, i: int, after: bool):
        """(unit, amount or None for a remainder, whether an amount was there), next, bracket."""
        if after:
            unit = self.unit(i, True)
            if not unit:
                return None
            found = self.amount(unit[1])
            return ((unit[0], found[0], True), found[1], unit[2]) if found else ((unit[0], {"": 1.0}, False), unit[1], unit[2])
        found = self.amount(i)
        if found and (unit := self.unit(found[1], False) or (self.kind(found[1]) == "open" and self.unit(found[1], True))):
            return (unit[0], found[0], True), unit[1], unit[2]
        unit = self.unit(i, False)
        if unit and unit[2] and (behind := self.amount(unit[1])):
            return (unit[0], behind[0], True), behind[1], True
        if unit and self.kind(unit[1]) == "rest":
            return (unit[0], None, True), unit[1] + 1, unit[2]
        return ((unit[0], {"": 1.0}, False), unit[1], unit[2]) if unit else None

    def terms(self, i: int, after: bool):
        """(terms, next) of as many terms as follow each other in one way; None if there is none."""
        out, end = [], i
        while got := self.term(i, after):
            out.append(got[0])
            i = end = got[1]
            if self.kind(i) == "separator" or (self.kind(i) == "sign" and self.tokens[i][1] != "/"):
                i += 1
        return (out, end) if out else None


def _known(text: str, given: dict[str, float]) -> dict[str, float]:
    """Values of variables: those given, and those that equations in the text lead to, one unknown at a time."""
    known = dict(given)
    sides = [(m[1], m[2]) for m in re.finditer(r"(?<![\w.])((?:\d*\.?\d*\s*[xyzX]\s*[-+]\s*)*\d*\.?\d*\s*[xyzX])\s*=\s*(\d+(?:\.\d+)?)(?!\s*[-–,]\s*\d)", text)]
    equations = [(found[0], float(value)) for left, value in sides if (found := _Parser(left).amount(0)) and found[0]]
    progress = True
    while progress:
        progress = False
        for left, value in equations:
            unknown = [k for k, c in left.items() if k and c and k not in known]
            if len(unknown) == 1:
                rest = sum(c * known.get(k, 1.0) for k, c in left.items() if k != unknown[0])
                known[unknown[0]] = (value - rest) / left[unknown[0]]
                progress = True
    return known


def _shares(terms, known: dict[str, float]) -> list[tuple[str, float]]:
    """Components and shares of a composition; none if an amount is not known or below 0."""
    amounts = [None if a is None else _value(a, known) for _, a, _ in terms]
    open_ = [k for k, (_, a, _) in enumerate(terms) if a is None]
    if len(open_) > 1 or any(v is None or v < 0 for k, v in enumerate(amounts) if k not in open_):
        return []
    if open_:
        rest = sum(v for v in amounts if v is not None)
        amounts[open_[0]] = (1.0 if rest < 1 else 100.0) - rest
        if amounts[open_[0]] < 0:
            return []
    total = sum(amounts)
    out: dict[str, float] = {}
    for (unit, _, _), amount in zip(terms, amounts, strict=True):
        for name, above, below in unit:
            a, b = _value(above, known), _value(below, known)
            if a is None or not b or a < 0 or not total:
                return []
            out[name] = out.get(name, 0.0) + amount / total * a / b
    return [(c, round(v, 5)) for c, v in out.items() if v > 0]


def compositions(text: str | None, variables: dict[str, float] | None = None) -> list[tuple[str, list[tuple[str, float]]]]:
    """All compositions of a text, in order and without overlap: (how it is written, components with shares summing to 1).

    At each place the longest reading counts.  A composition with amounts that are not known is left out; so is one that a letter, digit or dash touches.
    """
    text = (text or "").translate(_PLAIN)
    parser, known, out, i = _Parser(text), _known(text, variables or {}), [], 0
    while i < len(parser.tokens):
        start = parser.tokens[i][2]
        free = start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "-_")
        best = None
        for after in (False, True):
            got = parser.terms(i, after) if free else None
            if got and (len(got[0]) > 1 or len(got[0][0][0]) > 1) and any(t[2] for t in got[0]) and (best is None or got[1] > best[1]):
                best = got
        if best:
            end = parser.tokens[best[1] - 1][3]
            found = _shares(best[0], known) if end == len(text) or not (text[end].isalnum() or text[end] in "-_") else []
            if found:
                out.append((text[start:end], found))
                i = best[1]
                continue
        i += 1
    return out


def parse_formula(text: str | None, variables: dict[str, float] | None = None) -> list[tuple[str, float]]:
    """Components and shares of the longest composition in a text, the first of equals."""
    return max(compositions(text, variables), key=lambda c: len(c[0]), default=("", []))[1]


_COMPONENT = T.StructType([T.StructField("component", T.StringType()), T.StructField("share", T.DoubleType())])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("formula", T.StringType()), T.StructField("components", T.ArrayType(_COMPONENT))])))
def _compositions(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"formula": f, "components": [{"component": c, "share": v} for c, v in parts]} for f, parts in compositions(t)])


def formula_components(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., formula_no, formula, component, share) of all compositions of a text column.

    Only texts that can hold one (a capital letter and a digit or variable) go to the parser, and of equal texts one.  Null and empty texts have none; keys
    should tell rows apart.
    """
    able = rows.select(*keys, F.col(text).alias("__t")).where(F.col("__t").rlike("[A-Z]") & F.col("__t").rlike(r"[0-9xyzX]"))
    # Filters on what is parsed would be moved before the grouping, and to the other side of the join, if it were taken for a function: every row would be parsed.
    parsed = spread(able.select("__t").distinct(), "__t").withColumn("f", _compositions.asNondeterministic()("__t")).where(F.size("f") > 0)
    tall = able.join(parsed, "__t").select(*keys, F.posexplode("f").alias("__k", "f"))
    return tall.select(*keys, (F.col("__k") + 1).cast("long").alias("formula_no"), F.col("f.formula").alias("formula"), F.explode("f.components").alias("c")).select(*keys, "formula_no", "formula", "c.component", "c.share")


@F.pandas_udf(T.ArrayType(_COMPONENT))
def formulas(s: pd.Series) -> pd.Series:
    """H14 over a column of texts: the components of the longest composition of each."""
    return s.map(lambda t: [{"component": c, "share": v} for c, v in parse_formula(t)])
