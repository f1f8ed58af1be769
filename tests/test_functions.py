import pytest
from pyspark.sql import functions as F

from tablewright.functions import answers, formula, numbers, strings


def column(spark, values, f):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), "k int, s string").select("k", f(F.col("s"))).orderBy("k").collect()]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("bdl", (None, "bdl_unknown", None)), ("<0.5", (None, "bdl_known", 0.5)), ("< 5 ppm", (None, "bdl_known", 5.0)), ("<", (None, "bdl_unknown", None)), ("n/a", (None, "not_measured", None)),
        ("", (None, "not_measured", None)), (None, (None, "not_measured", None)), ("1,234", (1234.0, "measured", None)), (">10", (10.0, "measured", None)), ("-", (None, "bdl_unknown", None)),
        ("5d", (None, "not_measured", None)), ("nan", (None, "not_measured", None)), ("1e3", (1000.0, "measured", None)), ("-99999", (None, "bdl_unknown", None)), ("<0", (None, "bdl_unknown", None)),
    ],
)
def test_parse_cell(spark, raw, expected):
    assert tuple(column(spark, [raw], numbers.parse_cell)[0]) == expected


def test_element_headers(spark):
    cases = {"Fe (wt%)": "fe", "Ag (ppb)": "ag", "V51_ppm_mean": "v", "57Fe": "fe", "Mn55_ppm_LOD": None, "B6": None, "Silver": "ag", "Fe2O3": None, "Sulphur ppm": "s", "B291152": None, "Pb208": "pb", "": None, None: None}
    assert column(spark, list(cases), strings.element_header) == list(cases.values())


def test_value_core(spark):
    cases = {"127 nM": "127", ">100": ">100", "12 ± 3": "12", "5 (1-9)": "5", "1.2e-3 µM": "1.2e-3", "abc": "abc", "> 100 nM": ">100"}
    assert column(spark, list(cases), strings.value_core) == list(cases.values())


def test_normalize_and_match(spark):
    rows = spark.createDataFrame([("xx", "a"), ("HL-60", "hl60"), ("a b", "b c"), ("a", "b"), ("µM", "μM")], "g string, p string")
    folded = rows.withColumns({"g": strings.nfkc("g"), "p": strings.nfkc("p")})
    got = [r[0] for r in folded.select(strings.attr_match(F.col("g"), F.col("p"))).collect()]
    assert got == [True, True, True, False, True]


def test_similarity(spark):
    rows = spark.createDataFrame([("", ""), ("a", ""), ("epma", "empa"), ("a b c", "c b a")], "a string, b string")
    got = [r[0] for r in rows.select(strings.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 0.75, 1.0]


def test_coordinates(spark):
    cases = {"12.5": 12.5, "45°30'S": -45.5, "91": None, "10 d 30 m N": 10.5, "x": None}
    assert column(spark, list(cases), lambda c: numbers.coordinate(c, 90)) == list(cases.values())


def test_units(spark):
    rows = spark.createDataFrame([(1.5, "wt%"), (2000.0, "ppb"), (-99999.0, "wt%"), (-0.5, "wt%"), (None, "ppb"), (3.0, "ppm")], "v double, u string")
    assert [r[0] for r in rows.select(numbers.to_ppm(F.col("v"), F.col("u"))).collect()] == [15000.0, 2.0, -99999.0, -5000.0, None, 3.0]


def test_evaluate():
    assert [numbers.evaluate(x) for x in ("1+2*3", "(1-x)", "2/0", "-(3)", "__import__('os')", "", None)] == [7.0, None, None, -3.0, None, None, None]


def test_formula():
    assert formula.parse_formula("glass 60SiO2-40Na2O here") == [("SiO2", 0.6), ("Na2O", 0.4)]
    assert formula.parse_formula("(SiO2)70(CaO)30") == [("SiO2", 0.7), ("CaO", 0.3)]
    assert formula.parse_formula("(100-x)SiO2-xNa2O", {"x": 25}) == [("SiO2", 0.75), ("Na2O", 0.25)]
    assert formula.parse_formula("no glass") == formula.parse_formula(None) == []


@pytest.mark.parametrize(
    "text, n",
    [
        ('[{"value": 1}, {"value": 2}]', 2), ('```json\n{"samples": [{"value": 1}]}\n```', 1), ('{"value": 1}\n{"value": 2}', 2), ('x {"value": 1} y {"value": 2} z', 2),
        ('{"samples": [{"value": 1}, {"value": "}"}, {"va', 2), ("nothing", 0), (None, 0), ('{"other": 1}', 0),
    ],
)
def test_records(text, n):
    assert len(answers.parse_records(text, ("value",))) == n


def test_tolerant_json(spark):
    got = column(spark, ['{"a": 1}', 'so: {"a": 2} ok', "no"], lambda c: answers.tolerant(c, "a int")["a"])
    assert got == [1, 2, None]
