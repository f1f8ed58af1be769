"""Linkage, search, merging, ranks and resampling against brute force, and on awkward and empty tables."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import formula, numbers, strings, vocab
from tablewright.operators import assignment, components, consensus, dictionary, filters, matching, merging, metrics, ranks, similarity, windows
from tablewright.plans import pipelines
from tablewright.sources import files, sinks


def frame(spark, rows, schema, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def column(spark, values, f):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), "k int, s string").select("k", f(F.col("s"))).orderBy("k").collect()]


def by_hand(links):
    label = {v: v for link in links for v in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(300, k) for k in range(301, 340)] + [(7, 7), (500, 500)]
    got = components.connected(frame(spark, [*links, (None, 1), (2, None)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == by_hand(links) and len(got) == len(by_hand(links))
    assert components.connected(frame(spark, [], "a long, b long")).count() == 0


def heaviest(edges, cardinality):
    """The most edges and weight, over all subsets."""
    best = (0, 0.0)

    def grow(k, a, b, n, w):
        nonlocal best
        best = max(best, (n, round(w, 9)) if cardinality else (0, round(w, 9)))
        for i in range(k, len(edges)):
            x, y, v = edges[i]
            if x not in a and y not in b:
                grow(i + 1, a | {x}, b | {y}, n + 1, w + v)

    grow(0, frozenset(), frozenset(), 0, 0.0)
    return best


def test_solver_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        edges = [(i, j, rng.choice([0.3, 0.5, 0.7, rng.random() + 0.01])) for i in range(rng.randint(1, 5)) for j in range(rng.randint(1, 5)) if rng.random() < 0.6]
        if edges:
            a, b, w = map(np.array, zip(*edges, strict=True))
            for cardinality in (True, False):
                chosen = assignment.solve(a, b, w, cardinality)
                assert len(set(a[chosen])) == len(set(b[chosen])) == chosen.sum()
                got = (int(chosen.sum()) if cardinality else 0, round(float(w[chosen].sum()), 9))
                assert got[0] == heaviest(edges, cardinality)[0] and abs(got[1] - heaviest(edges, cardinality)[1]) < 1e-6


def test_solver_equals_dense_matching():
    rng = np.random.default_rng(3)
    for n, m in ((30, 50), (45, 20)):
        weights = np.where(rng.random((n, m)) < 0.5, rng.random((n, m)), 0.0)
        a, b = np.nonzero(weights > 0.25)
        chosen = assignment.solve(a, b, weights[a, b])
        pairs = matching.max_weight_pairs(weights.tolist())
        assert chosen.sum() == len(pairs) and abs(weights[a, b][chosen].sum() - sum(weights[i, j] for i, j in pairs)) < 1e-6


def test_matching_of_components(spark):
    rng = random.Random(4)
    groups = [[(f"{g}-{i}", f"{g}-{j}", rng.randint(1, 9) / 10) for i in range(3) for j in range(4) if rng.random() < 0.5] for g in range(12)]
    edges = [e for g in groups for e in g]
    awkward = [(None, "x", 1.0), ("x", None, 1.0), ("x", "y", 0.0), ("x", "y", None), ("x", "y", float("nan")), *edges[:5]]
    chosen = assignment.max_weight_matching(frame(spark, [*edges, *awkward], "a string, b string, weight double")).collect()
    want = [heaviest(g, True) for g in groups]
    assert len({r.a for r in chosen}) == len({r.b for r in chosen}) == len(chosen) == sum(n for n, _ in want)
    assert abs(sum(r.weight for r in chosen) - sum(w for _, w in want)) < 1e-6
    assert assignment.max_weight_matching(frame(spark, [], "a string, b string, weight double")).count() == 0


def test_auction_is_near_the_best(spark):
    """Components that are too large for a task, here all."""
    rng = random.Random(5)
    edges = [(i, j, float(rng.randint(1, 6))) for i in range(5) for j in range(4) if rng.random() < 0.7]
    chosen = assignment.max_weight_matching(frame(spark, edges, "a long, b long, weight double"), cardinality=False, cells=0, epsilon=0.15).collect()
    assert len({r.a for r in chosen}) == len({r.b for r in chosen}) == len(chosen)
    assert sum(r.weight for r in chosen) >= heaviest(edges, False)[1] - 5 * 0.15


def test_merge_of_sources(spark):
    a = frame(spark, [("A - 1", 1, 1.0, None), ("B", 2, None, None), (None, 3, 9.0, None)], "name string, ord int, x double, y string")
    b = frame(spark, [("a-1", 1, 5.0, "p"), ("B.2", 2, 7.0, "q"), ("C-1", 3, 1.0, "r"), ("C-2", 4, 2.0, "s"), ("C", 5, 3.0, "t"), ("", 6, 4.0, "u")], "name string, ord int, x double, y string")
    c = frame(spark, [("B.2 c", 1, "late", 3)], "name string, ord int, y string, z int")
    got = sorted(((r.entity, r.n_rows, r.n_sources, r.x, r.y, r.z) for r in merging.merge_sources([a, b, c], "name", "ord").collect()), key=str)
    assert got == sorted([("a-1", 2, 2, 1.0, "p", None), ("b", 3, 3, 7.0, "q", 3), ("c-1", 1, 1, 1.0, "r", None), ("c-2", 1, 1, 2.0, "s", None), ("c", 1, 1, 3.0, "t", None), (None, 1, 1, 9.0, None, None), (None, 1, 1, 4.0, "u", None)], key=str)
    assert merging.merge_sources([a.limit(0), b.limit(0)], "name", "ord").count() == 0
    scoped = merging.merge_sources([a.withColumn("doc", F.lit(1)), b.withColumn("doc", F.lit(2))], "name", "ord", ["doc"])
    assert {(r.doc, r.entity) for r in scoped.collect()} >= {(1, "a-1"), (2, "a-1")}


def dice(a, b):
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


@pytest.mark.parametrize("measure", ["dice", "jaccard"])
def test_similar_sets_equal_all_pairs(spark, measure):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    sets = [sorted(set(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randint(1, 12)))) for _ in range(120)]
    rows = frame(spark, [(k % 2, k, s) for k, s in enumerate(sets)] + [(0, 500, []), (0, 501, None)], "by int, id long, members array<string>")
    score = (lambda x, y: 2 * len(x & y) / (len(x) + len(y))) if measure == "dice" else (lambda x, y: len(x & y) / len(x | y))
    for least in (0.3, 0.5, 0.8, 1.0):
        got = {(r.a, r.b): round(r.score, 9) for r in similarity.similar_sets(rows, None, least, measure).collect()}
        want = {(i, j): round(score(set(sets[i]), set(sets[j])), 9) for i, j in itertools.combinations(range(120), 2) if i % 2 == j % 2 and score(set(sets[i]), set(sets[j])) >= least - 1e-12}
        assert got == want


def test_index_leaves_few_candidates(spark):
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxy") for _ in range(10)) for _ in range(300)})
    names += [n[:-1] + "z" for n in names[:30]]
    rows = spark.createDataFrame([(n,) for n in names], "id string").select(F.lit("a").alias("side"), F.lit(0).alias("by"), "id", similarity.numbered(similarity.qgrams(F.col("id"))).alias("members"))
    assert similarity.candidates(rows, 0.8, itself=True).count() < 0.01 * len(names) ** 2 / 2
    grams = {n: [("\x01" + n + "\x01")[k : k + 2] for k in range(len(n) + 1)] for n in names}
    want = {tuple(sorted(p)) for p in itertools.combinations(names, 2) if dice(grams[p[0]], grams[p[1]]) >= 0.8 - 1e-12}
    got = {(r.a, r.b) for r in similarity.similar_names(frame(spark, [(n,) for n in [*names, None, "", " "]], "n string"), "n").collect()}
    assert got == want and len(want) >= 30


def test_closest_text_equals_exhaustive_search(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(25)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 8)))
    nodes = [(p, k, text()) for p in range(5) for k in range(20)] + [(0, 30, None), (0, 31, "")]
    wanted = [(p, f"a{k}", text()) for p in range(6) for k in range(6)] + [(0, "copy", nodes[3][2]), (0, "null", None), (1, "none", "unseen words")]
    got = {(r.page, r.attribute): (r.node_text, None if r.f1 is None else round(r.f1, 9)) for r in matching.closest_text(frame(spark, nodes, "page int, node_ord int, node_text string"), frame(spark, wanted, "page int, attribute string, value string"), ["page"]).collect()}
    for page, attribute, value in wanted:
        scored = [(round(dice(value.split(), t.split()), 9), -k, t) for p, k, t in nodes if p == page and value and t]
        best = max(scored, default=(0, 0, None))
        assert got[page, attribute] == ((best[2], best[0]) if best[0] >= 0.25 else ("<NULL>", None))


def test_found_names_equal_contains(spark):
    rng = random.Random(9)
    texts = [(k, "".join(rng.choice("abc é") for _ in range(rng.choice([0, 5, 200])))) for k in range(60)] + [(60, None), (61, "ab" * 50_000)]
    names = ["a", "ab", "abc", "bca", "é", "c é", "ab", "", None, "absent name", "b" * 9]
    for size in (1 << 20, 4):
        got = {tuple(r) for r in dictionary.found_names(frame(spark, texts, "k long, t string"), ["k"], "t", frame(spark, [(n,) for n in names], "n string"), "n", size).collect()}
        assert got == {(k, n) for k, t in texts if t for n in names if n and n in t}
    assert dictionary.found_names(frame(spark, texts, "k long, t string"), ["k"], "t", frame(spark, [], "n string"), "n").count() == 0


def materials_by_hand(cells, names):
    out = {}
    for t, row, col, raw in cells:
        if not raw.strip()[:1].isdigit():
            continue
        best = None
        for u, r, c, label in cells:
            label = label.strip().lower()
            if u == t and ((c == col and r < row) or (r == row and c < col)):
                for v, m in names:
                    m = m.strip().lower()
                    if v == t and label and m and (m in label or label in m):
                        rank = (min(len(label), len(m)) / max(len(label), len(m)), -c, -r, m)
                        best = max(best or rank, rank)
        if best:
            out[t, row, col] = best[3]
    return out


def test_materials_equal_brute_force(spark):
    rng = random.Random(10)
    labels = ["Glass A", "glass", "A1", "glass a1 x", "x", "", "5.0", "6", "1.5"]
    cells = [(t, r, c, rng.choice(labels)) for t in "pqr" for r in range(6) for c in range(5)]
    names = [("p", "glass a1"), ("p", "a1"), ("q", "Glass A"), ("q", "x y"), ("s", "glass")]
    got = {(r.t, r.row, r.col): r.material for r in matching.material_of(frame(spark, cells, "t string, row int, col int, raw string"), frame(spark, names, "t string, material string"), ["t"]).collect()}
    assert got == materials_by_hand(cells, names)


def greedy(pred, gold, near):
    out = set()
    for d in {p[0] for p in pred}:
        free = sorted((o, v) for k, o, v in gold if k == d and v is not None)
        for _, o, v in sorted((p for p in pred if p[0] == d and p[2] is not None), key=lambda p: p[1]):
            hit = next(((g, w) for g, w in free if near(v, w)), None)
            if hit:
                out.add((d, o, hit[0]))
                free.remove(hit)
    return out


@pytest.mark.parametrize("hot", [1 << 16, 10])
@pytest.mark.parametrize("relative", [False, True])
def test_tolerance_match_equals_brute_force(spark, hot, relative):
    rng = random.Random(11)
    value = lambda: rng.choice([0.0, 1e-10, -1e-9, None, float("nan"), float("inf"), rng.uniform(-3, 3), rng.randrange(50) / 10, 100 * rng.random()])
    schema = "doc string, ord long, value double"
    pred, gold = ([(d, k, value()) for d in "abc" for k in range(n)] for n in (60, 50))
    got = {tuple(r) for r in matching.tolerance_match(frame(spark, [*pred, (None, 1, 1.0)], schema), frame(spark, [*gold, (None, 1, 1.0)], schema), ["doc"], tolerance=0.3, relative=relative, hot=hot).collect()}
    real = lambda rows: [r for r in rows if r[2] is not None and math.isfinite(r[2])]
    near = (lambda v, g: abs(v - g) / max(abs(g), 1e-9) < 0.3) if relative else (lambda v, g: abs(v - g) < 0.3)
    assert got == greedy(real(pred), real(gold), near) and len(got) > 50
    assert matching.tolerance_match(frame(spark, [], schema), frame(spark, gold, schema), ["doc"]).count() == 0


@pytest.mark.parametrize("intervals", [1, 3, 50])
@pytest.mark.parametrize("descending", [False, True])
def test_global_ranks(spark, intervals, descending):
    rng = random.Random(12)
    rows = [(k, rng.choice([None, 1, 1, 1, 1, 5, *range(20)])) for k in range(300)]
    got = {r.id: (r.row_number, r["rank"], r.dense_rank) for r in ranks.global_ranks(frame(spark, rows, "id long, v int"), "v", "id", descending, intervals).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0)
    ordered = sorted(rows, key=lambda r: (key(r), r[0]), reverse=descending)
    kinds = list(dict.fromkeys(map(key, ordered)))
    assert got == {r[0]: (k, 1 + next(i for i, x in enumerate(ordered) if key(x) == key(r)), 1 + kinds.index(key(r))) for k, r in enumerate(ordered, 1)}
    assert ranks.global_ranks(frame(spark, [], "id long, v int"), "v", "id").count() == 0


@pytest.mark.parametrize("intervals", [1, 40])
def test_fill_down(spark, intervals):
    rng = random.Random(13)
    rows = [(k, rng.choice([None, None, None, k])) for k in range(200)]
    got = {r.k: r.f for r in ranks.fill_down(frame(spark, rows, "k long, v long"), ["k"], "v", "f", intervals).collect()}
    last, want = None, {}
    for k, v in rows:
        last = v if v is not None else last
        want[k] = last
    assert got == want


def test_judge_groups(spark):
    tables = [("d", k, "x" * (k % 5 + 1)) for k in range(10)] + [("e", 1, "only"), ("e", 2, None)]
    groups = [("d", "a", 1), ("d", "a", 2), ("d", "b", 2), ("d", "b", 3), ("d", "c", 7), ("d", "c", 99), ("d", None, 8), ("e", "a", 2)]
    got = sorted((r.doc, r.ord) for r in consensus.judge_groups(frame(spark, tables, "doc string, ord int, t string"), frame(spark, groups, "doc string, group_id string, ord int"), ["doc"], "ord", "t").collect())
    assert got == [("d", 0), ("d", 3), ("d", 4), ("d", 5), ("d", 6), ("d", 7), ("d", 8), ("d", 9), ("e", 1), ("e", 2)]
    assert consensus.judge_groups(frame(spark, tables, "doc string, ord int, t string"), frame(spark, [], "doc string, group_id string, ord int"), ["doc"], "ord", "t").count() == 12


def test_resamples(spark):
    draws = metrics._draws(np.arange(4000), 300, 42)
    # Draws are like those of a Poisson distribution of mean 1, by row, by replicate and over pairs.
    assert abs(draws.mean() - 1) < 0.01 and abs(draws.var() - 1) < 0.02
    assert abs(draws.mean(0).std() - 1 / math.sqrt(4000)) < 0.003 and abs(draws.mean(1).std() - 1 / math.sqrt(300)) < 0.006
    assert abs(np.corrcoef(draws[:-1].ravel(), draws[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(draws[:, :-1].ravel(), draws[:, 1:].ravel())[0, 1]) < 0.01
    rng = random.Random(14)
    rows = [(k, rng.gauss(5, 2), rng.gauss(4, 2)) for k in range(400)] + [(900, None, 1.0), (None, 2.0, 1.0)]
    got = {r.replicate: (r.n, r.v) for r in metrics.poisson_bootstrap(frame(spark, rows, "id long, v double, w double"), "id", ["v"], 50).collect()}
    values = np.array([v for k, v, _ in rows if k is not None and v is not None])
    w = metrics._draws(np.array([k for k, v, _ in rows if k is not None and v is not None]), 50, 42)
    assert all(got[b][0] == w[:, b].sum() and abs(got[b][1] - (w[:, b] @ values) / w[:, b].sum()) < 1e-9 for b in range(50))
    r = metrics.paired_bootstrap(frame(spark, rows, "id long, a double, b double"), "id", "a", "b").first()
    assert r.n == 400 and r.low < r.difference < r.high and r.p < 0.01
    same = metrics.paired_bootstrap(frame(spark, [(k, 1.0, 1.0) for k in range(50)], "id long, a double, b double"), "id", "a", "b").first()
    assert (same.difference, same.p) == (0.0, 1.0)


FORMULAS = [
    ("glass 60SiO2-40Na2O here", "SiO2 60 Na2O 40"), ("60 SiO2 - 40 Na2O", "SiO2 60 Na2O 40"), ("60%SiO2, 40% Na2O", "SiO2 60 Na2O 40"), ("60SiO2·40Na2O", "SiO2 60 Na2O 40"), ("60SiO2 40Na2O", "SiO2 60 Na2O 40"),
    ("60SiO2–40Na2O", "SiO2 60 Na2O 40"), ("60SiO2:40Na2O", "SiO2 60 Na2O 40"), ("60SiO2+40Na2O", "SiO2 60 Na2O 40"), ("0.6SiO2*0.4Na2O", "SiO2 60 Na2O 40"), (".6SiO2-.4Na2O", "SiO2 60 Na2O 40"),
    ("3SiO2-Na2O", "SiO2 75 Na2O 25"), ("Na2O-3SiO2", "Na2O 25 SiO2 75"), ("SiO2-Na2O", ""), ("60SiO2", ""), ("SiO2 60, Na2O 40", "SiO2 60 Na2O 40"), ("60SiO₂-40Na₂O", "SiO2 60 Na2O 40"),
    ("Ge20Se80", "Ge 20 Se 80"), ("Ge 20 Se 80", "Ge 20 Se 80"), ("Ge20-Se80", "Ge 20 Se 80"), ("GeSe4", "Ge 20 Se 80"), ("Ge20As20Se60 fibres", "Ge 20 As 20 Se 60"), ("GeSe", ""),
    ("(SiO2)70(CaO)30", "SiO2 70 CaO 30"), ("(SiO2)70-(CaO)30", "SiO2 70 CaO 30"), ("[SiO2]70 [CaO]30", "SiO2 70 CaO 30"), ("(60SiO2-40Na2O)95(Er2O3)5", "SiO2 57 Na2O 38 Er2O3 5"), ("(SiO2-Na2O)90(CaO)10", "SiO2 45 Na2O 45 CaO 10"),
    ("80(GeS2)20(Sb2S3)", "Ge 26.667 S 65.333 Sb 8"), ("(Ge20Se80)90Te10", "Ge 18 Se 72 Te 10"), ("(GeSe4)90(GaTe)10", "Ge 18 Se 72 Ga 5 Te 5"),
    ("95(60SiO2-40Na2O)-5Er2O3", "SiO2 57 Na2O 38 Er2O3 5"), ("95[60SiO2 40Na2O] 5Er2O3", "SiO2 57 Na2O 38 Er2O3 5"), ("((60SiO2-40B2O3)50(CaO)50)90(Er2O3)10", "SiO2 27 B2O3 18 CaO 45 Er2O3 10"),
    ("xNa2O-(100-x)SiO2, x = 30", "Na2O 30 SiO2 70"), ("xNa2O-(1-x)SiO2 (x=0.3)", "Na2O 30 SiO2 70"), ("2xNa2O-(1-2x)SiO2, x = 0.2", "Na2O 40 SiO2 60"), ("xNa2O-yCaO-(100-x-y)SiO2, x + y = 40 and x = 10", "Na2O 10 CaO 30 SiO2 60"),
    ("xNa2O-(100-x)SiO2", ""), ("xNa2O-(100-x)SiO2, x = 120", ""), ("x/2Na2O-(100-x/2)SiO2, x = 40", "Na2O 20 SiO2 80"), ("60SiO2-balance Na2O", "SiO2 60 Na2O 40"), ("60SiO2-bal. Na2O", "SiO2 60 Na2O 40"), ("0.6SiO2-Na2O bal.", "SiO2 60 Na2O 40"),
    ("20Sr(PO3)2-80AlF3", "Sr(PO3)2 20 AlF3 80"), ("20AlO1.5-80SiO2", "AlO1.5 20 SiO2 80"), ("a60SiO2-40Na2O", ""), ("60SiO2-40Na2Ox", ""), ("60SiO2-0Na2O-40CaO", "SiO2 60 CaO 40"), ("30SiO2-40Na2O-30SiO2", "SiO2 60 Na2O 40"), ("", ""), (None, ""), ("In 2005 we", ""), ("(60SiO2-40Na2O", "SiO2 60 Na2O 40"),
]


@pytest.mark.parametrize("text, want", FORMULAS)
def test_formulas(text, want):
    parts = want.split()
    expected = {c: float(v) / 100 for c, v in zip(parts[::2], parts[1::2], strict=True)}
    got = dict(formula.parse_formula(text))
    assert got.keys() == expected.keys() and all(abs(got[c] - v) < 2e-5 for c, v in expected.items())


def test_several_formulas(spark):
    rows = [(1, "from 60SiO2-40Na2O to (Ge20Se80)90Te10"), (2, "none"), (3, None), (4, "from 60SiO2-40Na2O to (Ge20Se80)90Te10"), (5, "Ge 1 " + "long " * 30_000)]
    got = formula.formula_components(frame(spark, rows, "k int, t string"), ["k"], "t").collect()
    assert {(r.k, r.formula_no, r.formula) for r in got} == {(k, n, f) for k in (1, 4) for n, f in ((1, "60SiO2-40Na2O"), (2, "(Ge20Se80)90Te10"))} and len(got) == 10


def test_every_key_of_vocabularies_is_found(spark):
    assays = frame(spark, [(k, "nM", "IC50", "5") for t in vocab.TARGETS for k in (t, t.upper(), f" {t} ")], "target string, unit string, type string, value string")
    assert {r.target for r in filters.valid_assays(assays, ["IC50"]).collect()} == set(vocab.TARGETS.values())
    keys = [*vocab.COMPOUNDS, *vocab.COMPONENT_ELEMENTS, *vocab.COMPONENT_NAMES]
    want = [*vocab.COMPOUNDS, *vocab.COMPONENT_ELEMENTS, *vocab.COMPONENT_NAMES.values()]
    assert column(spark, keys, filters.component_of) == want and column(spark, [f" {k.upper()} (wt%)" for k in keys], filters.component_of) == want
    assert column(spark, ["unobtainium", "", None, "(mol%)"], filters.component_of) == [None] * 4
    elements = [*vocab.ELEMENTS, *vocab.ELEMENT_NAMES]
    assert column(spark, elements, strings.element_header) == [vocab.ELEMENT_NAMES.get(e, e) for e in elements]


def test_scanners(spark):
    places = {"24 35 42 S": -24.595, "S 24 35 42": -24.595, "24,5": 24.5, "24°35'42\"N": 24.595, "24d35m42s": 24.595, "24°35'42s": -24.595, "-24.5": -24.5, "12.5 W": -12.5, "24 -3": None, "N": None, "24 70 x": None, "1 2 3 4": None, "": None, None: None}
    assert column(spark, list(places), lambda c: F.round(numbers.coordinate(c, 90), 6)) == list(places.values())
    cores = {"12-15 nM": "12-15 nM", "5 3 nM": "5 3 nM", "1,000µM": "1,000", "-5.5 %": "-5.5", "3e": "3", "1.5eV": "1.5", "2E+3 s": "2E+3", "about 5 nM": "about 5 nM", "7 a very long unit name": "7 a very long unit name", "": "", None: None}
    assert column(spark, list(cores), strings.value_core) == list(cores.values())
    names = ["Py-1", "Samples A", "Minas-3", "Rangeland 2", "Summit-1", "massive-3", "Totalisator 4", "Notes-1b"]
    others = ["Mean", "mean (n = 4)", "NIST 610", "NIST SRM 612", "Py2(n=24)", "G_NIST610", "S_MASS_1", "MASS-1", "GE8", "SpA  n=34", "n = 4", "Sample", "(ppm)", "(wt%)", "concentrations in ppm", "Gsd-1", "USGS xyz", "reference standard", "stdgl2b2", "Average Py", "s.d.", "detection limit", "note: x", "A range here", "", None]
    got = column(spark, names + others, filters.is_sample)
    assert [n for n, ok in zip(names + others, got, strict=True) if ok] == [n for n in names if n != "Notes-1b"] + ["Notes-1b"] * got[names.index("Notes-1b")]
    codes = {"USGS reference material MASS-1 (W et al., 2002), NIST SRM610": "MASS-1, NIST SRM610", "NIST SRM 612 and BHVO-2g; nist srm 612": "NIST SRM 612, BHVO-2g", "FeS2 and S-JP1": "FeS2, S-JP1", "none": "none", "": "", None: None}
    assert column(spark, list(codes), strings.reference_materials) == list(codes.values())


def test_digest_ends_at_its_budget(spark):
    text = "x" * 300 + "KEY" + "y" * 900 + "KEY" + "z" * 900 + "KEY"
    docs = frame(spark, [(1, text), (2, "none"), (3, None), (4, "KEY"), (5, "")], "id int, text string")
    for most, n in ((10_000, 3), (1300, 2), (700, 1), (100, 0)):
        got = windows.keyword_digest(docs, ["id"], "text", "KEY", most).collect()
        own = sorted((r.chunk_no, r.start, r.chunk) for r in got if r.id == 1)
        assert [k for k, _, _ in own] == list(range(n)) and all(text[s:].startswith(c) for _, s, c in own) and sum(len(c) for _, _, c in own) <= most
        assert sum(r.id == 4 for r in got) == 1 and {r.id for r in got} <= {1, 4}


def test_result_records_of_tables(spark):
    rows = [["Model", "SQuAD (F1)", "Acc. on MNLI", "Notes"], ["BERT", "90.1", "84.0", "old"], ["Ours", "91.2", "85.5", "7"], ["learning rate", "0.1", "0.2", ""]]
    cells = [("d", 1, r, c, x) for r, row in enumerate(rows[1:]) for c, x in enumerate(row) if x]
    headers = frame(spark, [("d", 1, c, x) for c, x in enumerate(rows[0])], "doc_id string, table_no int, col int, header string")
    got = pipelines.domain_records(frame(spark, cells, "doc_id string, table_no int, row int, col int, raw string"), headers, "result").collect()
    found = {(r.value, r.type, r.model, r.metric) for r in got}
    assert {("90.1", "Result", "BERT", "F1"), ("84.0", "Result", "BERT", "accuracy"), ("91.2", "Result", "Ours", "F1"), ("85.5", "Result", "Ours", "accuracy")} <= found
    assert all(r.type == "Hyper-parameter/Architecture" and r.model is None for r in got if r.value in ("0.1", "0.2")) and not [r for r in got if r.value == "7"]


def test_wide_columns_and_file_facts(spark):
    columns = sinks.wide_columns(["fe", "cu"])
    assert len(columns) == 51 + 8 + 22 and columns[0] == "Uploaded" and columns[51:53] == ["fe_ppm", "fe_detection_limit"] and columns[-1] == "data_source_tag" and len(set(columns)) == len(columns)
    row = sinks.project(frame(spark, [("S1", 5.0)], "sample_name string, fe_ppm double"), columns).first()
    assert (row.sample_name, row.fe_ppm, row.country) == ("S1", 5.0, None)
    facts = files.file_facts(frame(spark, [("/a/2019_Smith_LA-ICP-MS.csv",), ("b.csv",)], "path string"), "path").collect()
    assert {(r.publication_year, r.analytical_method) for r in facts} == {(2019, "LA-ICPMS"), (None, None)}


def test_files_of_one_name_are_two_documents(spark, tmp_path):
    from tablewright.plans import cli

    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.csv").write_text(f"Sample,Fe,Cu,Zn\n{folder},1,2,3\n")
    assert {r.doc_id for r in cli._cells(spark, str(tmp_path)).select("doc_id").distinct().collect()} == {"a/t.csv", "b/t.csv"}


def test_hints_are_kept_where_they_help(spark):
    """One document is misread without its hint, and one hint makes things worse."""
    good = [["Fe", "Cu", "Zn", "Pb"], ["Sample", "Fe", "Cu", "Zn"], ["S1", "1", "2", "3"], ["S2", "4", "5", "6"]]
    plain = [["Sample", "Fe", "Cu", "Zn"], ["T1", "1", "2", "3"], ["T2", "4", "5", "6"]]
    cells = [(d, "docling", 0, r, c, x) for d, rows in (("a", good), ("b", plain)) for r, row in enumerate(rows) for c, x in enumerate(row)]
    hints = frame(spark, [("a", 0, 1, "wt%"), ("b", 0, 2, None)], "doc_id string, table_no int, header_row int, unit_override string")
    got = {(r.doc_id, r.sample_name, r.element): (r.value_ppm, r.original_unit) for r in pipelines.corrected(frame(spark, cells, "doc_id string, backend string, table_no int, row int, col int, raw string"), hints).collect()}
    assert {k: v for k, v in got.items() if k[0] == "b"} == {("b", f"T{n}", e): (v, "ppm") for n, vs in ((1, (1.0, 2.0, 3.0)), (2, (4.0, 5.0, 6.0))) for e, v in zip(("fe", "cu", "zn"), vs, strict=True)}
    hinted = {(r.doc_id, r.sample_name, r.element): (r.value_ppm, r.original_unit) for r in pipelines.extract(frame(spark, cells, "doc_id string, backend string, table_no int, row int, col int, raw string").where("doc_id = 'a'"), hints=hints).collect()}
    assert hinted == {("a", f"S{n}", e): (v * 10_000, "wt%") for n, vs in ((1, (1.0, 2.0, 3.0)), (2, (4.0, 5.0, 6.0))) for e, v in zip(("fe", "cu", "zn"), vs, strict=True)}


def test_more_commands(spark, tmp_path):
    from tablewright.plans import cli

    source = tmp_path / "in"
    source.mkdir()
    for d, n in (("a.csv", 1), ("b.csv", 5)):
        (source / d).write_text("Sample,Fe ppm,Cu ppm,Zn ppm\n" + "".join(f"S{k},{k + n},2,3\n" for k in range(2)))
    spark.createDataFrame([("a.csv", 1, 1.0, "fe"), ("a.csv", 2, 2.0, "cu"), ("a.csv", 3, 99.0, "zn")], "doc_id string, ord int, value double, type string").write.parquet(str(tmp_path / "gold"))
    cli.main(["list", str(source), str(tmp_path / "before")], spark)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "before")).collect())) == [("a.csv", False), ("b.csv", False)]
    cli.main(["paper", str(source), str(tmp_path / "one"), "--doc", "b.csv"], spark)
    assert {(r.doc_id, r.value_ppm) for r in spark.read.parquet(str(tmp_path / "one")).where("element = 'fe'").collect()} == {("b.csv", 5.0), ("b.csv", 6.0)}
    cli.main(["batch-quality", str(source), str(tmp_path / "batch")], spark)
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "batch" / "quality")).collect()} == {"a.csv", "b.csv"}
    cli.main(["list", str(source), str(tmp_path / "after"), "--done", str(tmp_path / "batch" / "results")], spark)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "after")).collect())) == [("a.csv", True), ("b.csv", True)]
    cli.main(["benchmark", str(source), str(tmp_path / "scores"), "--gold", str(tmp_path / "gold")], spark)
    scores = spark.read.parquet(str(tmp_path / "scores")).where("doc_id = 'a.csv'").collect()
    assert {r.variant for r in scores} == {"full", "no_promotion", "no_id_fill", "no_row_filter", "only_data_tables"}
    assert {(r.tp, r.fp, r.fn) for r in scores if r.variant == "full"} == {(2, 4, 1)}
