"""Benchmark decontamination (operator 6).

The windows of all benchmark items are hashed once and broadcast; each document's word
windows are looked up where the text is read, and every hit is verified word by word.  No
text is shuffled.  The index is arrays: 64-bit hashes, places and the words once.  A
benchmark whose index is above the broadcast bound is taken in parts below it, one pass
over the documents each; the driver reads the items one partition at a time.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tablewright.llm import text as T
from tablewright.llm.store import settle, with_columns

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BROADCAST_BYTES = 32 << 20


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class Windows:
    """Windows of benchmark items: by length, sorted hashes and where the words of each stand.

    Words are held once, as bytes with a blank after each, so a window is a slice of them.
    """

    def __init__(self, runs: list[tuple[str, list[bytes]]], width: int):
        self.names = [name for name, _ in runs]
        at = np.cumsum([0, *(len(own) for _, own in runs)])
        self.first = at[:-1].astype(np.int32)  # the number of a run's first word
        self.data = b"".join(b" ".join(own) + b" " for _, own in runs)
        lengths = np.fromiter((len(w) + 1 for _, own in runs for w in own), np.int32, int(at[-1]))
        self.starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
        hashes, _ = T.word_hashes(pa.array([self.data.decode()]), False, _BETWEEN)
        size = np.minimum(np.diff(at), width)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(size[size > 0]).tolist():
            every = T.window_hashes(hashes, n)
            inside = np.zeros(len(every) + 1, np.int32)
            own = np.flatnonzero(size == n)
            np.add.at(inside, at[own], 1)
            np.add.at(inside, at[own + 1] - n + 1, -1)
            place = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            order = np.argsort(every[place], kind="stable")
            self.tables[n] = (every[place][order], place[order].astype(np.int32))

    @property
    def nbytes(self) -> int:
        """Bytes held, with 64 for each item's name."""
        return len(self.data) + self.starts.nbytes + self.first.nbytes + sum(h.nbytes + p.nbytes for h, p in self.tables.values()) + sum(64 + len(n) for n in self.names)

    def items(self, size: int, key: int, own: bytes) -> set[str]:
        """The items with a window of these words, which have this hash."""
        hashes, places = self.tables[size]
        found = places[np.searchsorted(hashes, key) : np.searchsorted(hashes, key, "right")]
        same = [k for k in found.tolist() if self.data[self.starts[k] : self.starts[k + size] - 1] == own]
        return {self.names[i] for i in np.searchsorted(self.first, same, "right") - 1}


def index_parts(items, width: int, most: int):
    """Windows of all (item, text), each of at most `most` bytes: a long item is cut into runs of words that overlap by a window."""
    held: list[tuple[str, list[bytes]]] = []
    room = most
    # A word takes its bytes and a blank, 4 for its start, and 12 for its hash and place.
    run = max(2 * width, most // 64)
    for name, text in items:
        own, name = words(text), str(name)
        for a in range(0, max(1, len(own) - width + 1) if own else 0, run - width + 1):
            some = own[a : a + run]
            need = sum(map(len, some)) + 17 * len(some) + 72 + 4 * len(name)
            if held and need > room - 64:
                yield Windows(held, width)
                held, room = [], most
            held.append((name, some))
            room -= need
    if held:
        yield Windows(held, width)


def _scan(batch: pa.RecordBatch, windows: Windows) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Words, hit intervals (start, end, start, ...) and hit items of each text of the first column."""
    column = batch.column(0)
    h, at = T.word_hashes(column, True, _BETWEEN)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for size, (known, _) in windows.tables.items():
        own = T.window_hashes(h, size)
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = np.flatnonzero(known[place] == own)
        row = np.searchsorted(at, hit, "right") - 1
        inside = hit + size <= at[row + 1]
        for r, k, key in zip(row[inside].tolist(), (hit - at[row])[inside].tolist(), own[hit[inside]], strict=True):
            found.setdefault(r, []).append((k, size, key))
    spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
    items: list[list[str]] = [[] for _ in range(batch.num_rows)]
    known_items: dict[tuple[int, bytes], set[str]] = {}
    for r, places in found.items():
        own, names, merged = words(column[r].as_py()), set(), []
        for k, size, key in sorted(places):
            same = (size, b" ".join(own[k : k + size]))
            of = known_items.get(same)
            if of is None:
                of = known_items[same] = windows.items(size, key, same[1])
            if of:
                names |= of
                if merged and k <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], k + size)
                else:
                    merged.append([k, k + size])
        spans[r], items[r] = [x for m in merged for x in m], sorted(names)
    return np.diff(at).tolist(), spans, items


def _merge(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 13, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, hit_spans (word intervals: start, end, start, ...) and hit_items.

    docs has a text column; its other columns stay, but for clashing ones, which are
    replaced.  benchmark: item_id, text.  Words are runs of a-z, 0-9 and non-ASCII
    characters after lower-casing A-Z; a window is `width` words, or all words of an item
    with fewer.

    Null or empty texts have no words and no hits; long texts are scanned whole.  Items with null or empty text are
    without windows; items of one id count as one; an item whose id is null has the name
    "None".  Repeated document rows stay, a result each.  An empty benchmark hits nothing, an
    empty table gives no rows.  broadcast_bytes: of the index in memory, however the items are sized.
    """
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").distinct().toLocalIterator()
    schema = with_columns(docs.schema, ("n_words", LongType()), ("hit_spans", ArrayType(IntegerType())), ("hit_items", ArrayType(StringType())))
    out = None
    for windows in chain(index_parts(items, width, broadcast_bytes), [None]):
        if windows is None and out is not None:
            break
        given = spark.sparkContext.broadcast(windows or Windows([], width))

        def scanned(batches, given=given, first=out is None):
            for batch in T.parts(batches, "text"):
                base = batch if first else batch.select(batch.schema.names[:-3])
                n, spans, items = _scan(batch.select(["text"]), given.value)
                if not first:
                    spans = [_merge(a, b) for a, b in zip(batch.column("hit_spans").to_pylist(), spans, strict=True)]
                    items = [sorted({*a, *b}) for a, b in zip(batch.column("hit_items").to_pylist(), items, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*base.columns, pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    [*base.schema.names, "n_words", "hit_spans", "hit_items"],
                )

        if out is not None:
            out = settle(out)
        out = (docs if out is None else out).mapInArrow(scanned, schema)
    return out


def n_hit() -> F.Column:
    """Words inside hit_spans."""
    return F.expr("aggregate(sequence(1, size(hit_spans) div 2), 0L, (s, k) -> s + hit_spans[2 * k - 1] - hit_spans[2 * k - 2])")


def contamination(found: DataFrame, share: int = 20) -> DataFrame:
    """found with n_hit, and contaminated: a hit, and at least one word in `share` is hit."""
    return found.withColumn("n_hit", F.when(F.size("hit_spans") > 0, n_hit()).otherwise(F.lit(0).cast("long"))).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )


def _apart(docs: DataFrame) -> DataFrame:
    """The columns of docs but text as a struct, and the text, so that no column's name clashes."""
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    return docs.select(F.struct(F.lit(0).alias("0"), *others).alias("row"), docs["text"])


def _together(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns))


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever their names.

    A null or empty text holds nothing and stays; long texts are judged whole; equal texts, and repeated rows, are judged
    alike, each by itself.  Without documents the result is empty; without a benchmark all stay.
    """
    found = contamination(find_benchmark(_apart(docs), benchmark))
    return _together(found.where(~F.col("contaminated")), docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, without the words of hits; what stands between words stays before the next kept word.

    Null and empty texts stay as they are, as does every text without a hit; long texts are cut whole.  Equal texts, and repeated rows, lose
    the same words.  Items that share words remove them once.  Without documents the result is empty; without a benchmark all texts stay as they are.
    """

    def cut(text, spans):
        if not spans:
            return text
        data = text.encode()
        places = [m.span() for m in _WORD.finditer(data.lower())]
        out, at = [], 0
        for lo, hi in zip(spans[::2], spans[1::2], strict=True):
            out.append(data[at : places[lo][0]])
            at = places[hi - 1][1]
        return b"".join([*out, data[at:]]).decode()

    def run(batches):
        for batch in batches:
            new = [cut(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("hit_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], ["row", "text"])

    found = find_benchmark(_apart(docs), benchmark)
    schema = StructType([StructField(f.name, f.dataType) for f in found.schema.fields[:2]])
    return _together(found.mapInArrow(run, schema), docs.columns)


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
