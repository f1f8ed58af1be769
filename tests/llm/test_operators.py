"""Every operator against brute force on small fixtures, and on empty and awkward tables."""

import hashlib
import math
import pickle
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tablewright.llm import brown_lm, decontam, graph, jaccard_join, langid, license_scan, mixing, packing, substring_dedup, token_counts, topk_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


AWKWARD = [(1, None), (2, ""), (3, "   \n"), (4, "one two"), (4, "one two"), (5, "word " * 30_000), (None, "null id text of some words here now"), (6, "ünïcode 漢字 \x00 text"), (7, "a b c d e f g h i j k l m n o p q r s t u v")]
SF = "/root/testdata/sf0.001"


# 1


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (60, 8), dtype=np.uint8)
    rows = [(i, (base[i % 60] ^ (rng.random(8) < 0.3).astype(np.uint8) * (1 << rng.integers(0, 8, 8)).astype(np.uint8)).tobytes()) for i in range(900)]
    rows += [(1000 + i, base[0].tobytes()) for i in range(400)]
    codes = frame(spark, rows, "id long, code binary")
    for blocks, chunk in ((1 << 18, 1 << 18), (100, 7)):
        got = topk_codes.search(codes, codes.where("id % 20 = 0"), 10, blocks, chunk).collect()
        every = np.array([np.frombuffer(c, np.uint8) for _, c in rows])
        ids = np.array([i for i, _ in rows])
        want = set()
        for i, c in rows:
            if i % 20 == 0:
                d = np.bitwise_count(every ^ np.frombuffer(c, np.uint8)).sum(1)
                want |= {(i, r, int(ids[k]), int(d[k])) for r, k in enumerate(np.lexsort((ids, d))[:10], 1)}
        assert {tuple(r) for r in got} == want


def test_topk_awkward(spark):
    rows = [(1, [0.5, -1.0] * 4), (1, [0.5, -1.0] * 4), (2, None), (3, [1.0]), (None, [1.0] * 8), (4, [float("nan")] * 8), (20, [None, 1.0] * 4)]
    codes = topk_codes.sign_codes(frame(spark, rows, "id long, v array<double>"), 8)
    assert sorted(r.id for r in codes.collect()) == [1, 1, 4, 20]
    got = [(r.query_id, r.neighbor_id, r.distance) for r in topk_codes.search(codes, codes.where("id = 20")).orderBy("rank").collect()]
    assert got == [(20, 20, 0), (20, 4, 4), (20, 1, 8)]
    assert topk_codes.search(codes.limit(0), codes).count() == 0


# 2


def test_alignment():
    assert license_scan.align(list("abcd"), list("abcd")) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert license_scan.align(list("xaybzc"), list("abc")) == [(1, 0), (3, 1), (5, 2)]
    assert license_scan.align(list("aa"), list("ba")) == [(1, 1)]
    assert license_scan.align([], list("a")) == license_scan.align(list("q"), list("a")) == []
    rng = random.Random(3)
    for _ in range(200):
        a, b = [rng.choice("abcdef") for _ in range(12)], [rng.choice("abcdef") for _ in range(9)]
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_longest_rising_run():
    rng = random.Random(4)
    for _ in range(100):
        ys = rng.sample(range(20), 9)
        best = [1] * 9
        for i in range(9):
            best[i] = 1 + max((best[j] for j in range(i) if ys[j] < ys[i]), default=0)
        assert len(license_scan._rising(list(enumerate(ys)))) == max(best)


def test_licenses_found(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join("".join(rng.choice("aeioul") for _ in range(5)) for _ in range(n))
    names = list(license_scan.LICENSES)
    rows = [(k, f"{noise(rng.randrange(300))}\n{license_scan.LICENSES[n]}\n{noise(rng.randrange(300))}") for k, n in enumerate(names)]
    rows += [(50, "Released under the MIT License.\n" * 400), (51, noise(50)), (52, "the license of the work under a"), *[(i if i is None else i + 100, t) for i, t in AWKWARD]]
    got = license_scan.scan_licenses(frame(spark, [(*r, 7) for r in rows], DOCS + ", licenses int")).collect()
    by = {r.doc_id: [x.license for x in r.licenses] for r in got}
    assert all(by[k][0] == n for k, n in enumerate(names)), {k: by[k] for k, n in enumerate(names) if not by[k] or by[k][0] != n}
    assert by[50] == ["MIT"] and by[51] == by[52] == [] and len(got) == len(rows)
    wording = {n: license_scan.words(t) for n, t in license_scan.LICENSES.items()}
    for r in got:  # without the look at distinct words first
        assert [x.license for x in r.licenses] == [x[0] for x in license_scan.scan(license_scan.words(r.text), wording, 0.8)]
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


def test_insertions_at_every_offset():
    rng = random.Random(8)
    every = {n: license_scan.words(t) for n, t in license_scan.LICENSES.items()}
    for name in ("All rights reserved", "MIT", "GPL-3.0", "BSD"):
        w = every[name]
        size = len(w)
        for inserted in sorted({0, 1, size // 2, size}):
            at = sorted(rng.choices(range(1, size), k=inserted))
            notice = [x for k, word in enumerate(w) for x in [b"new"] * at.count(k) + [word]]
            for offset in range(size):
                for own in ([b"x"] * offset + notice + [b"x"] * (2 * size), [b"x"] * offset + notice * 3):
                    assert license_scan.scan(own, {name: w}, 0.8) == [(name, 1.0, offset, offset + len(notice))], (name, inserted, offset)
    own = "x x x copyright 2020 acme all rights reserved x x copyright of all works".encode().split()
    assert license_scan.scan(own, {"c": every["All rights reserved"]}, 0.8) == [("c", 1.0, 3, 9)]


def test_stretched_notices_and_hostile_words():
    """Up to five wordings of other words put into a notice, anywhere in a text; and many words of a license in no order."""
    rng = random.Random(10)
    every = {n: license_scan.words(t) for n, t in license_scan.LICENSES.items()}
    for name in ("MIT-text", "Apache-2.0-header", "GPL-3.0-header", "BSD", "MPL-2.0"):
        w = every[name]
        for share in (1.1, 1.3, 2, 5):
            at = sorted(rng.choices(range(1, len(w)), k=int(share * len(w))))
            notice = [x for k, word in enumerate(w) for x in [b"new"] * at.count(k) + [word]]
            for offset in (0, 1, rng.randrange(500)):
                assert license_scan.scan([b"x"] * offset + notice + [b"y"] * 50, {name: w}, 0.8) == [(name, 1.0, offset, offset + len(notice))]
        spaced = [x for word in w for x in (word, b"two", b"more")]
        assert license_scan.scan(spaced, {name: w}, 0.8)[0][1] == 1.0
    far = [x for word in every["MIT"] for x in [word, *[b"x"] * 200]]
    assert license_scan.scan(far, {"MIT": every["MIT"]}, 0.8) == []
    start = time.process_time()
    license_scan.scan(rng.choices(every["MIT-text"], k=20_000), {"MIT-text": every["MIT-text"]}, 0.8)
    assert time.process_time() - start < 3


def test_common_subsequences():
    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        places = {w: sum(1 << k for k, x in enumerate(b) if x == w) for w in "abcd"}
        assert license_scan.common(a, places, len(b)) == table[-1][-1]


def test_license_scan_as_a_scan_of_all_starts():
    rng = random.Random(9)
    for _ in range(300):
        wording = [rng.choice("abcde") for _ in range(rng.randrange(3, 7))]
        own = [rng.choice("abcdexyz") for _ in range(24)]
        size = len(wording)
        most = max(len(license_scan.align(own[a : a + 2 * size], wording)) for a in range(len(own)))
        got = license_scan.scan(own, {"l": wording}, 0.6)
        assert (got[0][1] if got else 0) >= (most / size if most / size >= 0.6 else 0)
        assert all(sum((Counter(own[a:b]) & Counter(wording)).values()) >= round(c * size) for _, c, a, b in got)


# 3


def components(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = split((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    base = [[word() for _ in range(rng.choice([3, 5, 8, 30, 60, 90]))] for _ in range(12)]
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(260):
        w = list(base[rng.randrange(12) if i % 3 else 0])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        if i % 7 == 0:
            w = passage + [word() for _ in range(rng.randrange(30))]
        rows.append((i * 3 % 260 + 1000 * (i % 2), " ".join(w)))
    rows = list({i: (i, t) for i, t in rows}.values()) + [(5000, None), (5001, ""), (5002, " "), (5003, "AB"), (5004, "ab")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.shingle_components(frame(spark, rows)).collect()}
    assert got == components(rows)


def test_jaccard_awkward(spark):
    rows = [(*r, "x") for r in AWKWARD] + [(8, "one two", "x")]
    got = jaccard_join.shingle_components(frame(spark, rows, DOCS + ", n string")).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id in (4, 8)} == {4}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.shingle_components(frame(spark, [])).count() == 0
    kept = jaccard_join.keep_one(frame(spark, rows, DOCS + ", n string"))
    assert kept.columns == ["doc_id", "text", "n"] and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 5, 6, 7]


def test_components_of_paths(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 999), (999, 998)]
    got = {r.v: r.c for r in graph.components(frame(spark, links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 998 for i in (998, 999, 1000)}


# 4


def test_exponent():
    tokens = [700.0, 200.0, 90.0, 10.0]
    alpha = mixing.bisect_exponent(tokens, 1000, 0.5, 100)
    h = [mixing.entropy(mixing.tempered(np.array(tokens), a)) for a in (0, alpha, 1)]
    assert abs(h[1] - (h[0] + h[2]) / 2) < 1e-9
    alpha = mixing.bisect_exponent(tokens, 1000, 1.0, 3.0)
    assert abs(max(mixing.tempered(np.array(tokens), alpha) * 1000 / tokens) - 3.0) < 1e-9
    assert mixing.bisect_exponent([5.0, 5.0], 10, 0.5, 4) == 0.0
    assert mixing.bisect_exponent([5.0, 7.0], 1000, 0.5, 4) == 1.0
    assert mixing.bisect_exponent([3.0, 9.0], 20, 0.3, 9, [2, 1]) == pytest.approx(mixing.bisect_exponent([3.0, 3.0, 9.0], 20, 0.3, 9))


def test_mixing_takes_passes(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["big", "big", "big", "big", "big", "mid", "mid", "tiny", None]), rng.randrange(1, 60)) for i in range(300)] + [(900, "big", 0), (901, "big", None), (3, "big", 5)]
    got = mixing.mix(frame(spark, rows, "doc_id long, source string, n_tokens long"), evenness=0.9).collect()
    total = {}
    for _, s, n in rows:
        total[s] = total.get(s, 0) + (n or 0)
    alpha = mixing.bisect_exponent(list(total.values()), sum(total.values()), 0.9, 4.0)
    weights = dict(zip(total, mixing.tempered(np.array(list(total.values()), float), alpha), strict=True))
    for s in total:
        own = sorted((r for r in got if r.source == s), key=lambda r: r.from_token)
        quota = math.floor(weights[s] * sum(total.values()))
        taken = sum(r.n_tokens for r in own)
        assert quota - 60 < taken <= quota and own[0].from_token == 0
        assert all(a.from_token + a.n_tokens == b.from_token for a, b in zip(own, own[1:], strict=False))
        full = Counter((r.doc_id, r.n_tokens) for r in own)
        assert max(full.values()) - min(full.values(), default=0) <= max(1, quota // total[s]) + 1
    assert mixing.mix(frame(spark, [], "doc_id long, source string, n_tokens long")).count() == 0


def test_many_sizes_give_the_same_weights(spark, monkeypatch):
    rows = [(f"s{k}", 17 * k * k + 3) for k in range(1, 13)] + [("again", 20)]
    sources = spark.createDataFrame(rows, "source string, tokens long")
    for evenness, repeats in ((0.5, 100.0), (1.0, 3.0)):
        got = []
        for most in (100, 3):
            monkeypatch.setattr(mixing, "DRIVER_SIZES", most)
            got.append({r.source: (r.alpha, r.weight) for r in mixing.source_weights(sources, None, evenness, repeats).collect()})
        assert all(got[1][k] == pytest.approx(got[0][k], rel=1e-9) for k in got[0]) and len(got[1]) == 13


# 5


def lm(spark, rows, **kw):
    docs = frame(spark, rows).withColumn("training", F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    return {r.doc_id: r for r in brown_lm.score_texts(docs, **kw).collect()}


def test_lm_base_and_counts(spark):
    rng = random.Random(8)
    sides = [[f"{p}{k}" for k in range(30)] for p in "ab"]
    rows = [(i, " ".join(rng.choice(sides[j % 2] if rng.random() < 0.95 else sides[1 - j % 2]) for j in range(i % 2, i % 2 + rng.randrange(60)))) for i in range(300)]
    rows += [(400 + i, f"Rare{i} rare{i % 5} A1") for i in range(40)] + [(500, None), (501, "")]
    got = lm(spark, rows, classes=4, common=50, endings=6)
    tokens = {i: [*split((t or "").translate(LOWER)), None] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    held = [r for i, r in got.items() if i < 300 and not r.training]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.97
    assert all(r.score < 0 and r.perplexity > 1 for r in got.values())


def test_lm_is_a_distribution(spark):
    """The probabilities of all one-word texts, an unknown word of each ending, and longer texts (the rest) sum to at most 1."""
    rows = [(i, t) for i, t in enumerate(["a b", "b a", "a a b", "c", "xxa", "yya", "zzb"] * 3)]
    docs = frame(spark, [*rows, (100, "")]).withColumn("training", F.col("doc_id") < 100)
    one = frame(spark, [(200 + k, w) for k, w in enumerate(["a", "b", "c", "xxa", "yya", "zzb", "qqa", "qqb", "q"])]).withColumn("training", F.lit(False))
    got = {r.doc_id: 10**r.score for r in brown_lm.score_texts(docs.union(one), classes=2, common=2, endings=2).collect()}
    assert 0.05 < sum(p for i, p in got.items() if i >= 100) < 1


def test_lm_score_equals_a_dense_model(spark, monkeypatch):
    """Transitions, masses and types counted anew in Python from the words' classes; small segments and turns."""
    rng = random.Random(31)
    rows = [(i, " ".join(f"{rng.choice('ab')}{rng.randrange(40)}" for _ in range(rng.randrange(80)))) for i in range(120)] + [(500, None), (501, "new words here")]
    docs = frame(spark, rows).withColumn("training", F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    whole = {r.doc_id: r.score for r in brown_lm.score_texts(docs, classes=3, common=20, endings=4).collect()}
    monkeypatch.setattr(brown_lm, "SEGMENT_BYTES", 40)
    monkeypatch.setattr(brown_lm, "HELD", 5)
    model, _ = brown_lm.build(docs, classes=3, common=20, endings=4)
    got = {r.doc_id: (r.score, r.n_tokens) for r in brown_lm.score_texts(docs, classes=3, common=20, endings=4).collect()}
    tail = {bytes(r.word): (r["class"], r.c) for r in model.tail.collect()}
    v = model.vocabulary
    tokens = {i: [w.encode() for w in split((t or "").translate(LOWER))] + [None] for i, t in rows}
    train = [ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for ws in train for w in ws)
    assert all(c == count[w] for w, (_, c) in tail.items()) and set(tail) | set(v.words) == set(count) - {None}

    def of(w):
        return 1 if w is None else int(model.of[v.words[w]]) if w in v.words else tail[w][0] if w in tail else int(model.of[v.endings.get(w[-3:], 0)])

    n, table, mass, types = 5, Counter(), Counter(), Counter(of(w) for w in count)
    for ws in train:
        for a, b in zip([None, *ws], ws, strict=False):
            table[of(a), of(b)] += 1
            mass[of(b)] += 1
    for i, ws in tokens.items():
        score = 0.0
        for a, b in zip([None, *ws], ws, strict=False):
            row = [table[of(a), k] for k in range(n)]
            kinds, single = sum(x > 0 for x in row), (mass[of(b)] + 1) / (sum(mass.values()) + n)
            score += math.log10((row[of(b)] + kinds * single) / (sum(row) + kinds) if kinds else single)
            score += math.log10((count[b] + 1) / (mass[of(b)] + types[of(b)] + 1))
        assert got[i] == (pytest.approx(score), len(ws)) and whole[i] == pytest.approx(score)


def test_lm_awkward(spark):
    assert len(lm(spark, AWKWARD)) == 8
    none = frame(spark, AWKWARD).withColumn("training", F.lit(None).cast("boolean"))
    assert {r.train_tokens for r in brown_lm.score_texts(none).collect()} == {0}
    assert brown_lm.score_texts(none.limit(0)).count() == 0


# 6


def hits(text, items, width=13):
    own = decontam._WORD.findall((text or "").encode().lower())
    covered, names = set(), set()
    for name, t in items:
        w = decontam._WORD.findall((t or "").encode().lower())
        size = min(width, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            for k in range(len(own) - size + 1):
                if own[k : k + size] == w[a : a + size]:
                    covered |= set(range(k, k + size))
                    names.add(str(name))
    return len(own), len(covered), sorted(names)


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["ab", "Cd", "é1", "x"])
    items = [(k, " ".join(word() for _ in range(rng.choice([4, 7, 13, 15, 20])))) for k in range(25)] + [(90, None), (91, ""), (92, "--")]
    rows = [(i, (", " if i % 2 else " ").join([*(word() for _ in range(rng.randrange(25))), *(split(rng.choice(items[:25])[1])[: rng.randrange(25)])])) for i in range(120)] + AWKWARD
    bench = frame(spark, items, "item_id long, text string")
    docs = frame(spark, [(*r, 5) for r in rows], DOCS + ", n_words int")
    for limit in (1 << 20, 300):
        got = decontam.contamination(decontam.find_benchmark(docs, bench, broadcast_bytes=limit)).collect()
        assert len(got) == len(rows)
        for r in got:
            n, k, names = hits(r.text, items)
            assert (r.n_words, r.n_hit, r.hit_items) == (n, k, names) and r.contaminated == (k > 0 and 20 * k >= n)
    assert decontam.find_benchmark(docs, bench.limit(0)).where("size(hit_items) > 0").count() == 0
    assert decontam.remove_documents(docs.limit(0), bench).count() == 0
    left = {r.doc_id: r.text for r in decontam.remove_spans(frame(spark, [(1, "keep, " + items[3][1].upper() + "! end"), (2, None)]), frame(spark, [items[3]], "item_id long, text string")).collect()}
    assert left == {1: "keep, ! end", 2: None}


def test_index_of_benchmark_is_bounded():
    rng = random.Random(13)
    items = [(f"item{k}", " ".join(rng.choice(["a", "bc", "def"]) for _ in range(rng.choice([3, 40, 4000])))) for k in range(40)]
    for most in (20_000, 200_000):
        parts = list(decontam.index_parts(items, 13, most))
        assert len(parts) > 1 and all(0 < w.nbytes <= most and len(pickle.dumps(w)) <= most + 2000 for w in parts)
        windows = {(n, w.data[w.starts[k] : w.starts[k + n] - 1]) for w in parts for n, (_, places) in w.tables.items() for k in places.tolist()}
        own = [decontam.words(t) for _, t in items]
        assert windows >= {(min(13, len(x)), b" ".join(x[k : k + 13])) for x in own for k in range(max(1, len(x) - 12))}


# 7


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.remainder() != 2))
    got = langid.predict(docs.where(langid.remainder() == 2), model)
    right, n = got.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert right / n > 0.98


def test_language_awkward(spark):
    docs = frame(spark, [(*r, "xx" if (r[0] or 0) % 2 else "yy", "s") for r in AWKWARD], DOCS + ", lang string, score string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.reject(docs, langid.fit(docs)).columns == docs.columns
    assert {r.doc_id for r in langid.reject(docs, langid.fit(docs), 0.0).collect()} == {4, 5, None, 6, 7}
    assert langid.reject(docs, langid.fit(docs), 0.0, ["yy"]).count() < 6 and langid.reject(docs, langid.fit(docs), 1.1).count() == 0
    assert langid.predict(frame(spark, [(1, "漢字だけ"), (2, "12 34")]), langid.fit(docs)).where("lang_pred = 'und'").count() == 1


@pytest.mark.parametrize("bounds", [{}, {"folded": 0}])
def test_every_language_is_learnt(spark, bounds):
    """90 labels, more than the samples' sizes are meant for."""
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x561, 0x587)]
    stems = ["".join(rng.sample(letters, 6)) for _ in range(90)]
    text = lambda k: " ".join("".join(rng.choice(stems[k]) for _ in range(5)) for _ in range(40))
    docs = frame(spark, [(n * 90 + k, text(k), f"l{k}") for k in range(90) for n in range(8)], DOCS + ", lang string")
    model = langid.fit(docs.where("doc_id < 540"))
    got = langid.predict(docs.where("doc_id >= 540"), model, **bounds).collect()
    assert len(model.languages) == 90 and len(got) == 180 and {r.lang_pred for r in got} == {f"l{k}" for k in range(90)}
    assert sum(r.lang == r.lang_pred for r in got) >= 175


def test_regression_equals_a_dense_one(spark):
    """With all texts as landmarks and fitting rows: kernel ridge regression over a dense kernel matrix."""
    rng = random.Random(21)
    stems = {"a": "abcde", "b": "cdefg", "c": "fghij"}
    rows = [(k, " ".join("".join(rng.choice(stems[lang]) for _ in range(4)) for _ in range(rng.randrange(1, 9))), lang) for k, lang in enumerate("abcab" * 8)]
    docs = frame(spark, [*rows, *rows[:9]], DOCS + ", lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs, 300, 300)).collect()}
    sets = [{t.encode()[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)} for _, t, _ in rows]
    kernel = np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in sets] for x in sets])
    names = [n for n, _ in Counter(x for *_, x in rows).most_common()]
    truth = np.array([[1.0 if lang == n else -1.0 for n in names] for *_, lang in rows])
    centred = kernel - kernel.mean(0)
    alpha = np.linalg.solve(1e-3 * len(rows) * kernel + 1e-6 * np.eye(len(rows)) + centred.T @ centred, centred.T @ (truth - truth.mean(0)))
    value = centred @ alpha + truth.mean(0)
    for (k, _, _), own in zip(rows, value, strict=True):
        assert got[k][0] == names[own.argmax()] and got[k][1] == pytest.approx(min(1, max(0, (1 + own.max()) / 2)), abs=2e-4)


def test_sample_is_whole_for_short_labels(spark):
    """A label with repeated rows only, beside large ones, is sampled all the same."""
    rows = [(k, f"aa bb {k}", "big") for k in range(3000)] + [(1, "zz yy", "same")] * 3000 + [(9, "qq", "one")]
    docs = frame(spark, rows, DOCS + ", lang string")
    got = Counter(r.lang for r in langid._sample(docs, 20).collect())
    assert got == {"big": 20, "same": 1, "one": 1}


# 8


def test_token_counts(spark):
    rows = [*AWKWARD, (9, "a<|endoftext|>b's  \n\n x"), (10, "It's 123 tests  　 here")] + [(100 + i, f"word{i} the the") for i in range(60)]
    path = P.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for head in (100_000, 3, 0):
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(frame(spark, [(*r, 1) for r in rows], DOCS + ", n long"), path, head=head).collect())
        want = sorted((i or 0, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in rows)
        assert got == want
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


# 9


def removed(rows, window):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: math.inf if r[0] is None else r[0])
    for i, t in order:
        w = split(t)
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), (i, k))
    for i, t in order:
        w = split(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] != (i, k):
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window", [1, 4, 5, 20, 50])
def test_repeats_removed(spark, window):
    rng = random.Random(window)
    rows = []
    for i in range(150):
        w = [rng.choice("abcdefghijkl") + rng.choice("xyz" * 3 + "q") for _ in range(rng.randrange(40))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = [f"p{k}" for k in range(rng.choice([window - 1, window, window + 9]))]
        if i % 10 == 0:
            w += ["same", "words"] * 15
        rows.append((i * 7 % 150, " ".join(w)))
    rows += [(200 + k, rows[k][1]) for k in range(0, 150, 9)] + [(300, None), (301, ""), (None, rows[4][1] + " end"), (302, "w " * 3000)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(frame(spark, [(*r, 1) for r in rows], DOCS + ", whole int"), window).collect()}
    assert got == removed(rows, window)


def test_repeats_awkward(spark):
    got = substring_dedup.remove_repeats(frame(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and [r.n_removed for r in got if r.doc_id == 4] == [0, 0]
    twice = substring_dedup.remove_repeats(frame(spark, [(1, AWKWARD[-1][1])] * 3)).collect()
    assert {r.n_removed for r in twice} == {0}
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


# 10


def test_best_fit_decreasing():
    rng = random.Random(11)
    for length in (1, 7, 64, 2048):
        sizes = [rng.randrange(1, length + 1) for _ in range(300)]
        rooms, want = [], 0
        for s in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= s]
            rooms.append((rooms.pop(rooms.index(min(fits))) if fits else length) - s)
        want = sorted(rooms)
        rows = packing.best_fit_decreasing(sizes, length)
        assert sorted(length - sum(sizes[k] for k in r) for r in rows) == want
        assert sorted(k for r in rows for k in r) == list(range(300))


def test_packing_round_trip(spark, tmp_path):
    from tablewright.llm.pieces import ranks

    path = P.path("byte_bpe_50k.tiktoken")
    rows = [*AWKWARD, (70, "x" * (5 << 20)), *[(100 + i, "some words " * (i % 50)) for i in range(80)]]
    for length, block in ((64, 500), (2048, 1 << 21)):
        packed = packing.pack_tokens(frame(spark, rows, parts=2), path, length, block)
        parts = Counter()
        whole: dict = {}
        for r in packed.collect():
            assert len(r.ids) == 2 * length and r.cu_seqlens[0] == 0 and r.position_resets == r.cu_seqlens[:-1] and r.cu_seqlens[-1] == r.n_tokens <= length
            for (d, p), ids in packing.unpack(r, length).items():
                parts[d, p] += 1
                whole.setdefault(d, {})[p] = ids
        for i, t in rows:
            want = [*ranks(path).encode_ordinary(t or ""), 50256] if len(t or "") < 1 << 20 else None
            got = [x for p in sorted(whole[i]) for x in whole[i][p]]
            assert got == want or (want is None and ranks(path).decode(got[:-1]) == t)
        assert parts[4, 0] == 2
    packing.write_packed(packed, str(tmp_path / "out"), 2048)
    for r in spark.read.parquet(str(tmp_path / "out")).limit(20).collect():
        at = np.frombuffer(r.positions, "<u4")
        assert len(at) == 2048 and all(at[k] == 0 for k in r.position_resets) and at[1] == (1 if r.cu_seqlens[1] > 1 else 0)
    assert packing.pack_tokens(frame(spark, []), path).count() == 0


CLASHING = "doc_id long, text string, source string, n_tokens long, key string, slice long, tokens long, quota long, row string, id long, n long, keep_id long, doc long, t1 long, t2 long, whole long, starts long, licenses long, struct struct<`a b`:int>"


def clashing(spark):
    rows = [(i, t, "s", 999, "k", 1, 2, 3, "r", 4, 5, 6, 7, 8, 9, 10, 11, 12, (13,)) for i, t in AWKWARD]
    return frame(spark, rows, CLASHING)


def test_columns_of_any_name_stay(spark):
    docs = clashing(spark)
    rest = lambda df: sorted(map(str, df.drop("licenses").distinct().collect()))
    own = rest(docs)
    assert rest(jaccard_join.keep_one(docs)) == own
    assert rest(substring_dedup.remove_repeats(docs).select(*docs.columns)) == own
    bench = frame(spark, [(1, "zz")], "item_id long, text string")
    assert rest(decontam.remove_documents(docs, bench)) == own and rest(decontam.remove_spans(docs, bench)) == own
    assert rest(license_scan.scan_licenses(docs)) == own
    assert set(rest(mixing.draw(docs, mixing.count_words()).select("row.*"))) <= set(own)
    assert rest(mixing.mix(docs).drop("pass_no", "from_token", "weight", "alpha")) == own


def test_ids_that_are_no_numbers(spark):
    docs = frame(spark, [("x", "a b c d e f"), ("7", "a b c d e f"), ("9", "a b c d e f"), (None, "q")], "doc_id string, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.shingle_components(docs).collect()} == {(None, 1, None), ("7", 2, "7"), ("9", 2, "7"), ("x", 2, "7")}
    assert {r.doc_id for r in jaccard_join.keep_one(docs).collect()} == {"7", None}
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs, 4).collect()} == {"x": 6, "7": 0, "9": 6, None: 0}
    assert sorted(str(d) for r in packing.pack_tokens(docs, P.path("byte_bpe_50k.tiktoken"), 64).collect() for d in r.doc_ids) == ["7", "9", "None", "x"]
    assert token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).count() == 4 and len(lm(spark, [(1, "a")])) == 1


def test_ladder():
    assert substring_dedup.ladder(20) == [5, 10] and substring_dedup.ladder(50) == [6, 12, 25] and substring_dedup.ladder(5) == [2] and substring_dedup.ladder(1) == [1]


def test_no_candidates_survive(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(20)]
    assert {r.n_removed for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()} == {0}


def test_digests():
    assert decontam.digest(["1", "2"]) == hashlib.sha256(b"1,2").hexdigest()


def test_texts_that_cannot_be_linked_are_not_shuffled(spark):
    """Operator 3: the filter of ids lets all wanted ids through, and few others."""
    docs = spark.range(-5000, 5000).select(F.when(F.col("id") != 7, F.col("id")).alias("doc"), F.lit("x").alias("text")).repartition(3)
    wanted = docs.where("doc % 5 = 0")
    kept = {r.doc for r in jaccard_join._maybe_in(docs, wanted).collect()}
    assert kept >= {r.doc for r in wanted.collect()} and len(kept) < 2050
    assert jaccard_join._maybe_in(docs, wanted.where("doc > 9999")).count() == 0
