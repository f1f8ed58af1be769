import random
import re
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators import matching


def greedy(pred, gold, passes):
    """First unmatched wins, a pass after the other."""
    out, p_done, g_done = [], set(), set()
    for key in passes:
        for i, p in enumerate(pred):
            for j, g in enumerate(gold):
                if i not in p_done and j not in g_done and key(p) == key(g):
                    out.append((i, j))
                    p_done.add(i)
                    g_done.add(j)
    return sorted(out)


def test_rank_join_is_greedy_matching(spark):
    rng = random.Random(5)
    docs = [([(rng.randrange(4), rng.choice("ab")) for _ in range(rng.randrange(9))], [(rng.randrange(4), rng.choice("ab")) for _ in range(rng.randrange(9))]) for _ in range(150)]
    rows = lambda k: [(d, i, v, t) for d, doc in enumerate(docs) for i, (v, t) in enumerate(doc[k])]
    schema = "doc int, ord int, value int, type string"
    pairs = matching.match_passes(spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema), ["doc"], [["value", "type"], ["value"]])
    got = sorted((r.doc, r.p_ord, r.g_ord) for r in pairs.collect())
    assert got == sorted((d, *x) for d, (p, g) in enumerate(docs) for x in greedy(p, g, [lambda x: x, lambda x: x[0]]))


def test_tolerance_match_is_ordered_greedy(spark):
    rng = random.Random(6)
    p = [(d, i, rng.randrange(6) / 2) for d in range(40) for i in range(6)]
    g = [(d, i, rng.randrange(6) / 2) for d in range(40) for i in range(6)]
    schema = "doc int, ord long, value double"
    got = sorted(tuple(r) for r in matching.tolerance_match(spark.createDataFrame(p, schema), spark.createDataFrame(g, schema), ["doc"], tolerance=0.6).collect())
    want = []
    for d in range(40):
        free = [x for x in g if x[0] == d]
        for x in (x for x in p if x[0] == d):
            hit = next((y for y in free if abs(x[2] - y[2]) < 0.6), None)
            if hit:
                free.remove(hit)
                want.append((d, x[1], hit[1]))
    assert got == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0.0, 0.2, 0.3, 0.5, 0.75, 1.0]), min_size=3, max_size=3), min_size=1, max_size=4))
def test_matching_of_most_edges_and_weight(weights):
    got = matching.max_weight_pairs(weights)
    n, m = len(weights), 3
    best = max((sum(1 for i, j in zip(range(n), p, strict=False) if j < m and weights[i][j] > 0.25), sum(weights[i][j] for i, j in zip(range(n), p, strict=False) if j < m and weights[i][j] > 0.25)) for p in permutations(range(max(n, m) + n), n))
    assert (len(got), round(sum(weights[i][j] for i, j in got), 9)) == (best[0], round(best[1], 9))


def test_names(spark):
    gold = spark.createDataFrame([(1, x) for x in ("A", "B - 1", "C", "D-1", "Z")], "doc int, name string")
    pred = spark.createDataFrame([(1, x) for x in ("A", "B-1", "C@2", "D", "Q")], "doc int, name string")
    got = {r.g_name: (r.p_name, r.phase) for r in matching.name_match(pred, gold, ["doc"]).collect()}
    assert got == {"A": ("A", 1), "B - 1": ("B-1", 2), "C": ("C@2", 3), "D-1": ("D", 3)}


def test_counts_add_up(spark):
    pred = spark.createDataFrame([(1, 0, "1", "a"), (1, 1, "1", "b"), (2, 0, None, "a")], "doc int, ord int, value string, type string")
    gold = spark.createDataFrame([(1, 0, "1", "a"), (3, 0, "2", "a")], "doc int, ord int, value string, type string")
    rows = {r.doc: (r.tp, r.fp, r.fn) for r in matching.bag_counts(pred, gold, ["doc"], [["value", "type"], ["value"]]).collect()}
    assert rows == {1: (1, 1, 0), 2: (0, 1, 0), 3: (0, 0, 1)}


def test_other_and_membership(spark):
    pred = spark.createDataFrame([(1, 0, "5", "Result"), (1, 1, "6", "Result"), (1, 2, "7", "Other")], "doc int, ord int, value string, type string")
    gold = spark.createDataFrame([(1, 0, "5", "Other"), (1, 1, "6", "Result")], "doc int, ord int, value string, type string")
    p, g = matching.without_other(pred, gold, ["doc"])
    assert ([r.value for r in p.collect()], [r.value for r in g.collect()]) == (["6"], ["6"])


def test_material_and_text(spark):
    cells = spark.createDataFrame([("t", 0, 0, "Glass A1"), ("t", 1, 0, "x"), ("t", 0, 1, "5.0"), ("t", 1, 1, "6.0")], "t string, row int, col int, raw string")
    names = spark.createDataFrame([("t", "glass a1")], "t string, material string")
    assert [(r.row, r.material) for r in matching.material_of(cells, names, ["t"]).orderBy("row").collect()] == [(0, "glass a1")]
    nodes = spark.createDataFrame([(1, 0, "the red house"), (1, 1, "blue")], "page int, node_ord int, node_text string")
    wanted = spark.createDataFrame([(1, "a", "red house"), (1, "b", "none")], "page int, attribute string, value string")
    assert {r.attribute: r.node_text for r in matching.closest_text(nodes, wanted, ["page"]).collect()} == {"a": "the red house", "b": "<NULL>"}


def test_near_misses(spark):
    schema = "doc int, ord int, value string, type string, unit string"
    pred = spark.createDataFrame([(1, 0, "100", "a", "u"), (1, 1, "104", "a", "u"), (1, 2, "9", "b", "u"), (1, 3, "77", "", "u")], schema)
    gold = spark.createDataFrame([(1, 0, "100", "b", "u"), (1, 1, "100", "a", "u"), (1, 2, "5", "a", "u")], schema)
    got = {r["class"]: r.n for r in matching.error_classes(pred, gold, ["doc"]).select(F.col("class"), "n").collect()}
    assert got == {"VAL_MATCH_ATTR_WRONG": 1, "NEAR_MISS": 1, "OVER_EXTRACT": 2, "MISSED": 1, "SCHEMA_ERR": 1}


def by_position(pred, gold):
    """Pairs of rows (dicts of values) as the survey's J09 describes them."""

    def score(a, b):
        both = [k for k in a if k in b]
        return sum(abs(b[k] - a[k]) / a[k] < 0.1 for k in both) / max(1, len(both))

    if len(pred) <= 3 * len(gold):
        at = lambda s: [(i, i + s, score(g, pred[i + s])) for i, g in enumerate(gold) if i + s < len(pred)]
        shift = max(range(min(len(pred), 10)), key=lambda s: (round(sum(x[2] for x in at(s)), 9), -s))
        return [x for x in at(shift) if x[2] >= 0.3]
    out, used = [], set()
    for i, g in enumerate(gold):
        n, j = max((score(g, p), -j) for j, p in enumerate(pred) if j not in used)
        if n > 0.3:
            out.append((i, -j, n))
            used.add(-j)
    return out


def test_pairs_by_position_and_greedy_ones_of_many_predictions(spark):
    rng = random.Random(13)
    row = lambda: {e: float(rng.randrange(1, 40)) for e in rng.sample(["fe", "cu", "zn", "pb"], 3)}
    docs = []
    for d in range(40):
        gold = [row() for _ in range(rng.randrange(1, 6))]
        copies = [{e: v * rng.choice([1, 1.05, 0.95, 2]) for e, v in g.items()} for g in gold]
        extra = [row() for _ in range(rng.randrange(3) if d % 2 else 3 * len(gold))]
        if d % 2 == 0:
            copies += [dict(copies[0])]
            rng.shuffle(copies)
        docs.append((extra + copies, gold))
    schema = "doc int, ord int, element string, value double"
    rows = lambda k: [(d, i, e, v) for d, doc in enumerate(docs) for i, r in enumerate(doc[k]) for e, v in r.items()]
    got = matching.position_pairs(spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema), ["doc"], "ord", "element", "value").collect()
    want = [(d, *x) for d, (p, g) in enumerate(docs) for x in by_position(p, g)]
    assert sorted((r.doc, r.g_index, r.p_index, round(r.score, 9)) for r in got) == sorted((*x[:3], round(x[3], 9)) for x in want)
    assert {d % 2 for d, *_ in want} == {0, 1}


def test_names_match_as_by_hand(spark):
    """Against the three phases over lists, one document at a time."""
    rng = random.Random(4)
    names = ["A-1", "A - 1", "A-1@2", "A-1 x", "A", "A-11", "B 2", "B  2", "B 2.1", "B", "b", "C#1", "C"]
    clean = lambda n: re.sub(r"\s+", " ", re.sub(r"\s*-\s*", "-", n.strip()))
    rows = {(s, d): sorted(set(rng.sample(names, rng.randrange(9)))) for s in "pg" for d in range(30)}
    side = lambda s: spark.createDataFrame([(d, n) for (t, d), ns in rows.items() if t == s for n in ns], "doc long, name string").repartition(3)
    got = {(r.doc, r.g_name, r.p_name, r.phase) for r in matching.name_match(side("p"), side("g"), ["doc"]).collect()}
    want = set()
    for d in range(30):
        p, g = list(rows["p", d]), list(rows["g", d])
        for phase, same in ((1, lambda a, b: a == b), (2, lambda a, b: clean(a) == clean(b))):
            for a in sorted(g, key=lambda n: (clean(n), n)):
                b = next((x for x in sorted(p, key=lambda n: (clean(n), n)) if same(a, x)), None)
                if b is not None:
                    want.add((d, a, b, phase))
                    p.remove(b)
                    g.remove(a)
        longer = lambda x, y: len(clean(x)) > len(clean(y)) and clean(x).startswith(clean(y)) and clean(x)[len(clean(y))] in "-.@_ #"
        for a in sorted(g, key=lambda n: (clean(n), n)):
            free = sorted(p, key=lambda n: (clean(n), n))
            b = next((x for x in free if longer(x, a)), None) or next((x for x in free if longer(a, x)), None)
            if b is not None:
                want.add((d, a, b, 3))
                p.remove(b)
    assert got == want and {x[3] for x in got} == {1, 2, 3}
