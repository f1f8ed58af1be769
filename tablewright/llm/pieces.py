"""Pre-tokens of byte-level BPE over whole batches, and their pieces.

The split pattern is that of the public byte-level vocabularies:
contractions, then letters, digits or other marks with at most one leading space, then
white space.  It is applied to code points with numpy: boundaries follow from the classes
of neighbouring characters, so no regular expression and no string per pre-token is needed.
"""

from __future__ import annotations

import functools
import json
import os
from array import array

import numpy as np
import pyarrow as pa

from tablewright.llm import text as T

_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and random 64-bit value of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1]) + 1
            kinds[a:b] = kind  # a run across the gap of surrogates holds none of them in valid text
    return kinds, T.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def boundaries(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of several texts; begins: where texts start."""
    n = len(points)
    kinds = _tables()[0][points]
    cut = np.zeros(n + 1, bool)
    cut[begins[begins < n]] = True
    text_start = cut.copy()
    text_start[n] = True
    cut[1:n] |= kinds[1:] != kinds[:-1]
    space = kinds == _SPACE
    # The last of a run of white space before something else: alone, or with what follows if it is a blank.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~text_start[1:n]) if n > 1 else np.zeros(0, np.int64)
    cut[last] = True
    cut[last[points[last] == 32] + 1] = False
    cut[begins[begins < n]] = True
    # Contractions: an apostrophe that starts a pre-token, and s, t, m, d, re, ve or ll.
    quote = np.flatnonzero((points == 39) & cut[:n])
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~text_start[quote + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        long = inside & ~short & ~text_start[np.minimum(quote + 2, n)] & np.isin(one.astype(np.int64) << 8 | np.minimum(two, 255), [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        cut[quote[short | long] + 1] = False
        cut[quote[short] + 2] = True
        cut[quote[long] + 3] = True
    return np.flatnonzero(cut[:n])


def pretokens(column: pa.Array, apart: tuple[str, ...] = ()):
    """For parts of a string column: (code points, starts of pre-tokens, their hashes, rows they are of, row count of apart's strings).

    Strings of apart are cut out first; they are counted, and listed by row, not hashed.
    """
    data, offsets = T.raw(column)
    kinds, random = _tables()
    marks = [s.encode() for s in apart]
    for i, j, lo, hi in T.pieces(data, offsets):
        block = data[lo:hi].tobytes()
        inner = np.clip(offsets[i : j + 1], lo, hi) - lo
        begins_at, found = inner[:-1], []
        if any(m in block for m in marks):
            import re

            cut, keep, was = [], np.ones(hi - lo, bool), 0
            for m in re.finditer(b"|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)), block):
                row = int(np.searchsorted(inner, m.start(), "right")) - 1
                if m.end() <= inner[row + 1]:
                    found.append(i + row)
                    keep[m.start() : m.end()] = False
                    cut.append(m.end())
            begins_at = np.unique(np.concatenate([begins_at, cut]).astype(np.int64))
        else:
            keep = None
        raw = np.frombuffer(block, np.uint8)
        lead = (raw & 0xC0) != 0x80
        if keep is not None:
            lead &= keep
            block = raw[keep].tobytes()
        points = np.frombuffer(block.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(lead)])
        starts = boundaries(points, at[begins_at])
        rows = i + np.searchsorted(at[inner[1:]], starts, "right")
        up, down = T._BYTES.upto(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(random[points] * up[: len(points)], out=sums[1:])
        ends = np.append(starts[1:], len(points))
        yield points, starts, T.mix((sums[ends] - sums[starts]) * down[starts]), rows, found


def strings(points: np.ndarray, starts: np.ndarray, which: np.ndarray) -> list[str]:
    """The pre-tokens with the numbers in which."""
    ends = np.append(starts[1:], len(points))
    whole = points.tobytes().decode("utf-32-le")
    return [whole[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def added_tokens(path: str) -> dict[str, int]:
    """The strings that the tokenizer takes out of texts before it splits them, and their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("only byte-level tokenizers without normalizer and prefix space are supported")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
        raise ValueError("added tokens that strip or need word borders are not supported")
    return {a["content"]: a["id"] for a in spec["added_tokens"]}


def n_pieces(path: str, items: list[str]) -> list[int]:
    """Pieces of each pre-token, as the library gives them."""
    return [len(e) for e in tokenizer(path).encode_batch_fast(items, add_special_tokens=False)]


@functools.cache
def ranks(path: str):
    """An encoder over a file of ranks, without special tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


class Ids:
    """Little-endian ids of pre-tokens by hash, kept in a table of bounded size."""

    def __init__(self, path: str, most: int = 400_000):
        self.encode, self.most, self.known = ranks(path)._core_bpe.encode_single_piece, most, {}
        self.end = ranks(path).max_token_value + 1
        self.code = "H" if self.end < 1 << 16 else "I"

    def joined(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The ids of each pre-token."""
        every = hashes.tolist()
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        new = {h: k for k, h in enumerate(every) if h not in known}
        if new:
            found = strings(points, starts, np.fromiter(new.values(), np.int64, len(new)))
            for h, s in zip(new, found, strict=True):
                known[h] = array(self.code, self.encode(s.encode())).tobytes()
        return [known[h] for h in every]
