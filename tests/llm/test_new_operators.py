"""Operators 11 to 13 against brute force on small fixtures, and on empty and awkward tables."""

import datetime
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_operators import AWKWARD, DOCS, LOWER, frame

from tablewright.llm import conversation_repair, impact_search, jaccard_join, order_minhash, packing, substring_dedup

# 11


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, c in Counter(terms(text)).items() if t in b)
            if s > 0:
                scores.append((-s, i is not None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [7, 8192])
def test_impact_search_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(impact_search, "BLOCK_ROWS", rows)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Éa", "漢字", "B9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.choice([1, 5, 30, 200])))) for i in range(300)]
    docs += [(300 + i, docs[0][1]) for i in range(60)]
    items = [(i, ", ".join(rnd.choices([*words, "unseen"], k=rnd.choice([1, 4, 12])))) for i in range(25)] + [(99, docs[0][1])]
    got = impact_search.search(frame(spark, docs), frame(spark, items, "item_id long, text string", 2), 5).collect()
    assert sorted(map(tuple, got), key=str) == ranked(docs, items, 5)


def test_impact_search_stops_early():
    """Documents that only a common term holds are not completed, and the first k are right."""
    n, rnd = 5000, np.random.default_rng(0)
    doc = np.concatenate([np.arange(40), np.arange(n)])
    term = np.concatenate([np.zeros(40, np.int64), np.ones(n, np.int64)])
    impact = np.concatenate([rnd.integers(900, 1000, 40), rnd.integers(1, 10, n)])
    block = impact_search.Block(n, doc, term, impact, 2)
    docs, scores = block.best(np.array([0, 1]), np.array([1, 1]), np.array([1, 1]), 20, 0)
    whole = np.bincount(doc, impact, n).astype(int)
    order = np.lexsort((docs, -scores))[:20]
    assert len(docs) <= 80 and docs[order].tolist() == np.lexsort((np.arange(n), -whole))[:20].tolist() and scores[order].tolist() == np.sort(whole)[::-1][:20].tolist()


def test_impact_search_awkward(spark):
    docs = [*AWKWARD, (9, "rare"), (None, "rare"), (8, "rare")]
    items = [(1, "RARE rare"), (1, "RARE rare"), (2, None), (3, "..."), (None, "one unknown"), (4, "ünïcode")]
    got = sorted(map(tuple, impact_search.search(frame(spark, docs), frame(spark, items, "item_id long, text string", 2)).collect()), key=str)
    assert got == ranked(docs, items, 20) and [r[2] for r in got if r[0] == 1 and r[1] == 1] == [None, None]
    wide = frame(spark, [(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    assert impact_search.search(wide, frame(spark, [("a", "rare")], "item_id string, text string")).count() == 3
    named = frame(spark, [("b", "rare"), ("a", "rare"), ("c", "rare"), ("d", "other words")], "doc_id string, text string")
    assert [r.doc_id for r in impact_search.search(named, frame(spark, [(1, "rare")], "item_id long, text string")).orderBy("rank").collect()] == ["a", "b", "c"]
    empty = frame(spark, [], DOCS)
    assert impact_search.search(empty, frame(spark, items, "item_id long, text string")).count() == 0
    assert impact_search.search(frame(spark, docs), frame(spark, [], "item_id long, text string")).collect() == []


def test_impact_search_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "CHUNK_TERMS", 4)
    docs = [(i, f"a{i % 3} b{i % 5} c") for i in range(40)]
    items = [(i, f"a{i % 3} b{i % 4} c") for i in range(12)]
    got = impact_search.search(frame(spark, docs), frame(spark, items, "item_id long, text string"), 4).collect()
    assert sorted(map(tuple, got), key=str) == ranked(docs, items, 4)


# 12


def cheapest(rows):
    """Cost, edits and repaired rows of (role, text, wrong, truncated) by a best-first search over whole edit strings."""
    best, queue = {}, [(0, "", 0, "", ())]
    while queue:
        cost, audit, i, roles, kept = heapq.heappop(queue)
        state = roles[-1:]
        if best.setdefault((i, state), (cost, audit)) < (cost, audit):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(kept)
        nexts = []
        if i < len(rows):
            role, text, wrong, cut = rows[i]
            nexts.append((2, "D", i + 1, None, None))
            if not wrong:
                nexts.append((5 * cut, "K", i + 1, role, text))
                nexts += [(1 + 5 * cut, "R", i + 1, r, text) for r in ("user", "assistant")]
        nexts += [(5, "I", i, r, "") for r in ("user", "assistant")]
        for c, letter, j, role, text in nexts:
            more = roles + (role[:1] or "?" if role is not None else "")
            if re.fullmatch("s?(ua)*u?|", more):
                heapq.heappush(queue, (cost + c, audit + letter, j, more, (*kept, (role, text)) if role is not None else kept))
    raise AssertionError


def faults(rows):
    out, seen, counts = [], set(), Counter()
    for role, text in rows:
        last = text.rstrip(conversation_repair.SPACES)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    return out, counts


def test_repair_equals_brute_force():
    rnd = random.Random(5)
    for _ in range(400):
        rows = [(rnd.choice(["system", "user", "assistant", "tool", "", "u"]), rnd.choice(["a.", "b", "c!", "", " ", "d"]) + rnd.choice(["", "x."]) * rnd.randint(0, 3)) for _ in range(rnd.randint(0, 6))]
        known, _ = faults(rows)
        cost, audit, kept = cheapest(known)
        codes, _ = conversation_repair._codes([r for r, _ in rows], [t for _, t in rows])
        costs = conversation_repair.distances(codes, [0, 10, 5, 0])
        letters, end = conversation_repair.walk(codes, costs, 0)
        letters += conversation_repair._rest(end)
        assert (costs[0], letters) == (cost, audit)
        assert [(t["role"], t["text"]) for t in conversation_repair._turns(letters, *zip(*rows, strict=True), 0)] == kept if rows else not letters


def summary(rows):
    """The query's columns for all conversations, from undamaged rows (conv_id, turn, role, text)."""
    out = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)), lambda r: r[0]):
        own = []
        for _, turn, role, text in group:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        known, counts = faults([r[1:] for r in own])
        cost, audit, kept = cheapest(known)
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("length", [4096, 3, 1])
def test_repair_in_segments_equals_brute_force(spark, length):
    rnd = random.Random(7)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", None]), rnd.choice(["Yes.", "No?", "cut", "", None, f"t{t}!"])) for c in [*range(30), None] for t in [*range(rnd.randint(1, 9)), None][: rnd.choice([3, 20])]]
    rows += [(77, t, "user" if t % 2 else "assistant", "again." if t % 5 else f"row {t}.") for t in range(60)]
    rows += rows[:12]
    damaged = conversation_repair.damage(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.summarise(conversation_repair.repair(damaged, length)).collect()}
    assert got == summary(rows)


def test_repair_awkward(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(str(dropped), 0, "user", "Gone."), ("x", 0, "user", "long. " * 200_000), ("x", 1, "assistant", "Yes."), (None, None, None, None)]
    data = [(*r, "k") for r in rows]
    df = frame(spark, data, "conv_id string, turn long, role string, text string, cost string")
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.summarise(conversation_repair.repair(conversation_repair.damage(df))).collect()}
    assert got[str(dropped)] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = summary([(c if c != str(dropped) else dropped, *r) for c, *r in rows])
    assert got["x"] == want["x"] and got[None] == want[None]
    assert conversation_repair.summarise(conversation_repair.repair(conversation_repair.damage(df.limit(0)))).count() == 0


# 13


def slow_components(text, k=order_minhash.K, l=order_minhash.TUPLE, m=order_minhash.COMPONENTS):
    """Order MinHash with a set of numbered k-mers and a sort for each order; the k-mers' hashes are the operator's."""
    hashes = order_minhash.items(text, k).tolist()
    seen, kmers = Counter(), []
    for i in range(max(1, len(text) - k + 1) if text else 0):
        kmers.append((text[i : i + k], seen[text[i : i + k]]))
        seen[text[i : i + k]] += 1
    assert len(set(kmers)) == len(kmers) == len(hashes) == len(set(hashes))
    out = []
    for factor in order_minhash._orders(m)[:, 0].tolist():
        least = sorted(range(len(kmers)), key=lambda i: ((hashes[i] >> 32) * factor % 2**32, i))[:l]
        out.append(tuple(kmers[i] for i in sorted(least)))
    return out


def test_order_minhash_equals_brute_force():
    rnd = random.Random(2)
    texts = ["", "a", "abc", "aaaaaaaaaaaaaaaaaaaaaaaa", *("".join(rnd.choice("ab cdé漢") for _ in range(rnd.choice([5, 9, 10, 60, 400]))) for _ in range(20))]
    texts += [t[:-3] + "xyz" for t in texts] + [t[20:] + t[:20] for t in texts]
    slow = [slow_components(t) for t in texts]
    fast = [order_minhash.signature(order_minhash.items(t)) for t in texts]
    for (a, x), (b, y) in itertools.combinations(zip(slow, fast, strict=True), 2):
        assert [p == q for p, q in zip(a, b, strict=True)] == (x == y).tolist()
    for a, b in zip(texts, texts[::-1], strict=True):
        x, y = order_minhash.pair_signatures(order_minhash.items(a), order_minhash.items(b))
        assert (x == order_minhash.signature(order_minhash.items(a))).all() and (y == order_minhash.signature(order_minhash.items(b))).all()


def test_order_minhash_follows_order(spark):
    """Swapped halves share nearly all k-mers, but few of their orders."""
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(4000))
    a, moved, near = (order_minhash.signature(order_minhash.items(t)) for t in (text, text[2000:] + text[:2000], text[:2000] + "new words" + text[2000:]))
    assert order_minhash.likeness(a, near) > 0.9 > 0.7 > order_minhash.likeness(a, moved) > 0.3
    rows = frame(spark, [(1, text, "k"), (2, None, "l"), (3, text, "m")], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in order_minhash.fingerprints(rows).collect()}
    assert got[1].fingerprint == got[3].fingerprint == a.tobytes().hex() != got[2].fingerprint and len(got[2]) == 3


@pytest.mark.parametrize("intervals", [1, 4, 40])
def test_edited_pairs_equal_brute_force(spark, intervals):
    rnd = random.Random(6)
    docs = [(i if i % 7 else None, rnd.choice([None, "", "abc", "word " * rnd.randint(1, 60), "".join(rnd.choice("abcdé ") for _ in range(300))])) for i in range(60)]
    docs += [(i, t) for i, t in AWKWARD if i != 5] + [(30, "same id " * 9)] * 5 + [(31, "é漢 " * 30_000)]
    got = order_minhash.edited_pairs(frame(spark, docs), intervals=intervals).collect()
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = Counter()
    sign = lambda t: order_minhash.signature(order_minhash.items(t))
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        a, b = sign(text), sign(edited)
        want[i, len(text), text, edited, a.tobytes().hex(), b.tobytes().hex(), order_minhash.likeness(a, b), order_minhash.likeness(a, sign(following))] += 1
    assert Counter(map(tuple, got)) == want


def test_edited_pairs_of_few_rows(spark):
    assert order_minhash.edited_pairs(frame(spark, [], DOCS)).count() == 0
    only = order_minhash.edited_pairs(frame(spark, [("a", "an only text", 1)], "doc_id string, text string, n_chars long")).collect()
    assert [(r.doc_id, r.n_chars, r.edited, r.near_next) for r in only] == [("a", 12, "an only tan ", 1.0)]


# ids of any type


@pytest.mark.parametrize("kind, name", [("string", lambda i: f"doc-{i:03d}"), ("date", lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i))])
def test_ids_of_any_type(spark, kind, name):
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rnd.choices(words, k=80)) for _ in range(8)]
    rows = [(i, base[i % 8] + (" more" if i % 3 == 0 else "")) for i in range(40)] + [(None, base[0]), (40, None), (41, ""), (5, base[5])]
    plain = frame(spark, rows)
    other = frame(spark, [(None if i is None else name(i), t) for i, t in rows], f"doc_id {kind}, text string")
    back = {name(i): i for i, _ in rows if i is not None} | {None: None}
    same = lambda f, columns: Counter(tuple(back[r[c]] if c in ("doc_id", "component_id") else r[c] for c in columns) for r in f(other).collect()) == Counter(tuple(r[c] for c in columns) for r in f(plain).collect())
    assert same(jaccard_join.shingle_components, ["doc_id", "n_shingles", "component_id"])
    assert same(jaccard_join.keep_one, ["doc_id", "text"])
    assert same(substring_dedup.remove_repeats, ["doc_id", "text", "n_words", "n_removed", "kept"])
    packed = packing.pack_tokens(other, public_tokenizers.path("byte_bpe_50k.tiktoken"), 64)
    assert dict(packed.dtypes)["doc_ids"] == f"array<{'bigint' if kind == 'int' else kind}>"
    assert Counter(back[d] for r in packed.collect() for d, p in zip(r.doc_ids, r.parts, strict=True) if p == 0) == Counter(i for i, _ in rows)
    packing.write_packed(packed, f"{spark.conf.get('spark.checkpoint.dir')}/packed-{kind}", 64)
