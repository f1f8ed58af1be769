import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from tablewright.llm import pieces as X
from tablewright.llm import text as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts(seed, n=400):
    rng = random.Random(seed)
    letters = list("ab's  '  \n\n\t1.,'sRElvd m-é\xa0　漢²‍\x1c")
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)] + [None, "", " "]


def test_words_as_a_regular_expression_finds_them():
    every = [*texts(1), "x" * (3 << 20) + " " + "ab cd " * 300_000]
    for lower in (False, True):
        hashes, at = T.word_hashes(pa.array(every), lower)
        words = [WORD.findall((t or "").encode().lower() if lower else (t or "").encode()) for t in every]
        assert np.diff(at).tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        known = {}
        assert all(known.setdefault(h, w) == w for h, w in zip(hashes.tolist(), flat, strict=True))
        assert len(known) == len(set(flat))


def test_windows_are_equal_where_their_words_are():
    rng = np.random.default_rng(0)
    words = T.mix(rng.integers(0, 3, 5000).astype(np.uint64))
    for which in (0, 1):
        h = T.window_hashes(words, 4, which)
        seen = {}
        for k in range(len(h)):
            assert seen.setdefault(int(h[k]), words[k : k + 4].tobytes()) == words[k : k + 4].tobytes()
        assert len(seen) == len({words[k : k + 4].tobytes() for k in range(len(h))})
    assert len(T.window_hashes(words[:3], 4)) == 0


def test_pretokens_as_the_library_splits():
    import regex

    pattern = regex.compile(P.PATTERN)
    every = texts(2, 4000)
    out = [[] for _ in every]
    for points, starts, _, rows, _ in X.pretokens(pa.array(every)):
        for s, r in zip(X.strings(points, starts, np.arange(len(starts))), rows.tolist(), strict=True):
            out[r].append(s)
    assert out == [pattern.findall(t or "") for t in every]


def test_long_rows_are_cut_inside_themselves():
    n = T.PIECE_BYTES
    for long in ("x" * (n + 3), "ab " * (n // 3) + "x" * 9, "漢" * (n // 3 + 2), "x" * (2 * n + 3)):
        every = ["one", long, "two three", long, "four"]
        hashes, at = T.word_hashes(pa.array(every), False)
        alone = [T.word_hashes(pa.array([t]), False)[0].tolist() for t in every]
        assert np.diff(at).tolist() == [len(t.split()) for t in every] and hashes.tolist() == sum(alone, [])
        data, offsets = T.raw(pa.array(every))
        spans = [(lo, hi) for _, _, lo, hi in T.pieces(data, offsets)]
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_pretokens_of_long_rows_are_their_own():
    import regex

    pattern = regex.compile(P.PATTERN)
    every = ["x" * (T.PIECE_BYTES + 3), "two three", "漢" * (T.PIECE_BYTES // 3 + 2), "four"]
    out = [[] for _ in every]
    for points, starts, _, rows, _ in X.pretokens(pa.array(every)):
        for s, r in zip(X.strings(points, starts, np.arange(len(starts))), rows.tolist(), strict=True):
            out[r].append(s)
    assert out == [pattern.findall(t) for t in every]


def test_special_strings_are_cut_out():
    every = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x <|endoftext|> 's", "<|endoftext"]
    path = P.path("byte_bpe_50k.json")
    n = [0] * 4
    for points, starts, _, rows, found in X.pretokens(pa.array(every), tuple(X.added_tokens(path))):
        for r, k in zip(rows.tolist(), X.n_pieces(path, X.strings(points, starts, np.arange(len(starts)))), strict=True):
            n[r] += k
        for r in found:
            n[r] += 1
    assert n == [len(e) for e in X.tokenizer(path).encode_batch(every, add_special_tokens=False)]
