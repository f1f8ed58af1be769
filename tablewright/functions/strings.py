"""String functions as Catalyst expressions.

Everything here is a column expression, but for the two that have no built-in
counterpart (Unicode compatibility folding and the matching-blocks similarity), which are
Arrow UDFs meant for distinct values only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import vocab

UNKNOWN = "xx"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition (part of H02, C01)."""
    return s.str.normalize("NFKC")


def table(mapping: dict[str, str]) -> Column:
    """A constant map as one literal, which is folded when the query is planned."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in mapping.items())), F.lit("\x01"), F.lit("\x02"))


def bound(c: Column, make: Callable[[Column], Column]) -> Column:
    """make(c), c being evaluated once however often make names it: as the element of an array."""
    return F.get(F.transform(F.array(c), make), 0)


def one_of(texts: list[str]) -> str:
    """A pattern of alternatives, taken as they are."""
    return "(?:" + "|".join(map(re.escape, texts)) + ")"


def collapse(c: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column, fold: bool = False) -> Column:
    """Lower case, dashes unified, marks to blanks, white space collapsed; fold: with nfkc."""
    c = F.lower(F.trim(c.cast("string")))
    if fold:
        c = nfkc(c)
    c = F.translate(c, "".join(vocab.DASHES), "-" * len(vocab.DASHES))
    c = F.translate(c, "".join(vocab.MARKUP), " " * len(vocab.MARKUP))
    return collapse(c)


def value_core(c: Column) -> Column:
    """The value before an uncertainty or a bracket, without a unit of up to 15 letters; comparators stay.

    What starts the text and is of signs, digits, points, commas and a power of ten is read as a number.  If it is one, and what
    follows is short and has letters, blanks and unit marks only, that is a unit; else the text stays as it is.
    """
    plain = F.trim(F.split_part(F.split_part(F.translate(c.cast("string"), "\u00a0\u2009", ""), F.lit("\u00b1"), F.lit(1)), F.lit("("), F.lit(1)))
    return bound(plain, lambda x: bound(F.ltrim(x, F.lit("<>+-0123456789., ")), lambda tail: F.when(tail == "", x).otherwise(_without_unit(x, tail))))


def _without_unit(plain: Column, tail: Column) -> Column:
    """A value before its bracket, without a unit; tail: what follows its signs and digits."""
    power = F.ltrim(F.substr(tail, F.lit(2)), F.lit("+-0123456789"))
    # The letter e is a power of ten only if digits follow it.
    raised = F.lower(F.left(tail, F.lit(1))).eqNullSafe("e") & (F.length(power) < F.length(tail) - 1)
    rest = F.when(raised, power).otherwise(tail)
    number = F.trim(F.left(plain, F.length(plain) - F.length(rest)))
    compared = F.left(number, F.lit(1)).isin("<", ">")
    bare = F.when(compared, F.ltrim(F.substr(number, F.lit(2)))).otherwise(number)
    counts = F.replace(bare, F.lit(","), F.lit("")).try_cast("double").isNotNull() & ~F.left(bare, F.lit(1)).isin(".", ",") & ~F.substring(bare, 1, 2).isin("+.", "-.")
    unit = F.trim(rest)
    named = counts & F.length(unit).between(1, 15) & (F.translate(F.lower(unit), "abcdefghijklmnopqrstuvwxyz\u03bc\u00b5%/\u00b7 ", "") == "")
    return F.when(named, F.when(compared, F.concat(F.left(number, F.lit(1)), bare)).otherwise(bare)).otherwise(plain)


def words(c: Column) -> Column:
    """Words of an already collapsed text; none for an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def common_words(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two word arrays."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))


def word_f1(gold: Column, pred: Column) -> Column:
    """Word-level F1 of two texts after H02, 0 where nothing is shared."""
    g, p = words(normalize_text(gold)), words(normalize_text(pred))
    both = F.size(g) + F.size(p)
    return F.when(both > 0, 2 * common_words(g, p) / both).otherwise(F.lit(0.0))


def attr_match(gold: Column, pred: Column, threshold: float = 0.25) -> Column:
    """An unknown first argument matches all; else equality, equality without hyphens and blanks, or word F1.

    Columns with other than ASCII text are folded before (a column of nfkc), as no UDF may stand inside.
    """
    g, p = normalize_text(gold), normalize_text(pred)
    plain = lambda c: F.regexp_replace(c, "[- ]", "")
    return (g == UNKNOWN) | (g == p) | (plain(g) == plain(p)) | (word_f1(gold, pred) >= threshold)


def clean_value(c: Column) -> Column:
    """Trimmed; placeholders for missing values are null."""
    c = F.trim(c.cast("string"))
    return F.when(~c.isin("", "nan", "None", "NaN"), c)


def comparable(c: Column) -> Column:
    """Lower case, letters, digits and underscores only, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s]", " "))


def page_text(c: Column) -> Column:
    """Hyphenation at line ends undone, glued words (aB) parted, blanks collapsed, line breaks kept."""
    c = F.regexp_replace(c, r"(\w)-\n(\w)", "$1$2")
    c = F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def latex_free(c: Column) -> Column:
    """Without citations, references and markup commands."""
    c = F.regexp_replace(c, r"\\(?:cite[a-z]*|ref|label)\{[^}]*\}", "")
    return collapse(F.regexp_replace(F.regexp_replace(c, r"\\[a-zA-Z]+", ""), r"[{}$]", ""))


def ascii_fold(c: Column) -> Column:
    """Latin letters without their marks; other non-ASCII characters dropped."""
    marked = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
    plain = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"
    return F.regexp_replace(F.translate(c, marked, plain), r"[^\x00-\x7f]", "")


def sample_name(c: Column) -> Column:
    """White space around dashes removed, runs collapsed."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\s*-\s*", "-"), r"\s+", " ")


def element_header(c: Column) -> Column:
    """A column header as an element symbol, or null.

    Unit and statistic endings go one after the other in the order of the list; then a
    symbol, a name, or a symbol with an isotope number of two digits or more after or
    before it (six characters at most).
    """
    # Every symbol and name has a letter, so numbers are done with at once.
    return bound(F.lower(F.trim(c)), lambda raw: F.when(raw.rlike("[a-z]"), _element(raw)))


def _element(raw: Column) -> Column:
    """The element of a lower-cased header."""
    s = F.regexp_replace(raw, r"_pp[mb]_(content|conc)$", "")
    s = F.regexp_replace(s, r"_pp[mb]_m\d+", "")
    s = F.regexp_replace(s, r"[_\s]+(mean|2se|2sd|sd|se|median|avg|rsd|1sd|1se)$", "")
    cut = lambda acc, e: F.when(F.endswith(acc, e), F.left(acc, F.length(acc) - F.length(e))).otherwise(acc)
    endings = F.split(F.lit("\x01".join(vocab.UNIT_ENDINGS)), "\x01")
    s = bound(s, lambda x: F.when(x.rlike(one_of(vocab.UNIT_ENDINGS) + r"\z"), F.aggregate(endings, x, cut)).otherwise(x))
    s = F.trim(F.regexp_replace(F.trim(s), "_+$", ""))
    names = table({e: e for e in vocab.ELEMENTS} | vocab.ELEMENT_NAMES)

    def symbol(x):
        after, before = F.regexp_extract(x, r"^(.*?[^0-9])[0-9]{2,}$", 1), F.regexp_extract(x, r"^[0-9]{2,}([^0-9].*)$", 1)
        tries = F.array(x, F.when(F.length(x) <= 6, after), F.when(F.length(x) <= 6, before))
        return F.get(F.filter(F.transform(tries, lambda t: F.try_element_at(names, t)), lambda e: e.isNotNull()), 0)

    found = bound(s, symbol)  # looked up in its three readings
    return F.when(~raw.rlike(r"_pp[mb]_(lod|dl|det_lim)$"), found)


def first_pattern(c: Column, patterns: list[tuple[str, str]], default: str | None = None) -> Column:
    """What belongs to the first pattern, in the given order, that lower-cased text contains."""
    text, out = F.lower(c), F.lit(default)
    for pattern, result in reversed(patterns):
        out = F.when(text.contains(pattern), F.lit(result)).otherwise(out)
    return out


def canonical(c: Column, mapping: dict[str, str], keep: bool = True, blanks: bool = False) -> Column:
    """Lookup of the lower-cased text (blanks: without its blanks); unknown ones stay, or are null."""
    key = F.lower(F.trim(c))
    if blanks:
        key = F.replace(key, F.lit(" "), F.lit(""))
    if not mapping:
        return c if keep else F.lit(None).cast("string")
    found = F.try_element_at(table(mapping), key)
    return F.coalesce(found, c) if keep else found


def short_deposit(c: Column) -> Column:
    """Without a closing bracket and without closing commodity and deposit words."""
    c = F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))
    metals = "Pb|Zn|Cu|Au|Ag|Fe|Sn|W|Mo|Ni|Co|Sb|U|REE"
    return F.trim(F.regexp_replace(c, rf"(?i)(\s+(?:{metals})(?:\s*[-\u2013/]\s*(?:{metals}))*)?\s+(deposits?|mines?|ore\s*fields?|districts?)$", ""))


def reference_materials(c: Column) -> Column:
    """Codes of reference materials in the order of mention, each once (any case), joined by commas; a text without any stays.

    A code is a word of letters, a dash and a number (MASS-1, BHVO-2g); a series with its number in the same word or the next one
    (SRM610, NBS 612, USGS MASS-1), together with NIST before SRM; or a sulfide by its formula.
    """
    marks = " ,;:()[]\n\t"
    tokens = F.filter(F.split(F.translate(c, marks, " " * len(marks)), " +"), lambda w: w != "")
    series = F.array(*map(F.lit, vocab.STANDARD_SERIES))
    sulfides = F.array(*(F.lit(s.lower()) for s in vocab.STANDARD_SULFIDES))
    letters = lambda w: F.upper(F.regexp_replace(w, "[^A-Za-z].*$", ""))
    after = lambda w: F.substr(w, F.length(letters(w)) + 1)
    numbered = lambda x: x.rlike("^[0-9]+[A-Za-z]?$")

    def code(w, i):
        name, tail = letters(w), after(w)
        following, before = F.coalesce(F.get(tokens, i + 1), F.lit("")), F.upper(F.coalesce(F.get(tokens, i - 1), F.lit("")))
        dashed = (name != "") & (F.left(tail, F.lit(1)) == "-") & (numbered(F.substr(tail, F.lit(2))) | ((name == "S") & tail.rlike("^-[A-Za-z]+[0-9]+[A-Za-z]?$")))
        joined = F.array_contains(series, name) & ((tail != "") & F.left(tail, F.lit(1)).rlike("[0-9]"))
        apart = F.array_contains(series, F.upper(w)) & numbered(following)
        prefix = F.when(before.isin("NIST", "USGS") & (F.upper(w) != before), F.concat(F.get(tokens, i - 1), F.lit(" "))).otherwise("")
        return F.when(dashed | joined, F.concat(prefix, w)).when(apart, F.concat(prefix, w, F.lit(" "), following)).when(F.array_contains(sulfides, F.lower(w)), w)

    found = F.filter(F.transform(tokens, code), lambda x: x.isNotNull())
    once = F.aggregate(found, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))
    return F.when(F.size(once) > 0, F.array_join(once, ", ")).otherwise(c)


def deposit_kind(c: Column) -> tuple[Column, Column]:
    """Environment and group of a deposit type, by the first name that it contains."""
    return tuple(first_pattern(F.trim(c), [(d[0], d[k]) for d in vocab.DEPOSITS]) for k in (1, 2))


def country_code(c: Column) -> Column:
    """The country that a text names first in the list, as three letters."""
    names = F.array(*(F.struct(F.lit(f" {n} ").alias("n"), F.lit(code).alias("c")) for n, code in vocab.COUNTRIES.items()))
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "), F.lit(" "))
    return bound(padded, lambda text: F.get(F.filter(names, lambda x: F.contains(text, x["n"])), 0)["c"])


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks (Ratcliff-Obershelp), for distinct pairs."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two collapsed texts."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """The larger of word Jaccard and block ratio; 1 for two empty texts, 0 for one."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(empty(a) & empty(b), 1.0).when(empty(a) | empty(b), 0.0).otherwise(F.greatest(token_jaccard(a, b), block_ratio(a, b)))


def rename_keys(c: Column, names: dict[str, str]) -> Column:
    """A map with some of its keys renamed."""
    return F.transform_keys(c, lambda k, _: F.coalesce(F.try_element_at(table(names), k), k))


def section_or_text(sections: Column, names: list[str], text: Column) -> Column:
    """The first named section there is, else the whole text."""
    return F.coalesce(*[F.try_element_at(sections, F.lit(n)) for n in names], text)
