"""Fingerprints of whole texts that follow their edit distance: Order MinHash (operator 13).

A text's k-mers (runs of k characters) are numbered by occurrence, so a repeated k-mer is as
many different items.  For each of m orders of items, the l least items are taken, put back
into the order they have in the text, and their hashes are hashed together: one component.
Two texts agree in a component if they share the items and their order, so likeness (the
share of equal components) falls with moved pieces as well as with changed ones.

An item is hashed once; an order compares the product of 32 bits of the hash with an odd factor of
its own (items equal in it go by their places).  Items that a text and its edited text both start with are compared once.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tablewright.llm.text import mix, parts, window_hashes
from tablewright.operators.ranks import cut_points, interval_of

K, TUPLE, COMPONENTS = 9, 2, 64
BATCH_CHARS = 4 << 20
_COLUMNS = 4096
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


@functools.cache
def _orders(m: int) -> np.ndarray:
    """An odd factor for each order of items."""
    return (mix(np.arange(1, m + 1, dtype=_U) * _STEP) >> _U(32)).astype(np.uint32)[:, None] | np.uint32(1)


def items(text: str, k: int = K) -> np.ndarray:
    """Hashes of a text's occurrence-numbered k-mers, in text order; a shorter text is one k-mer, an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, _U)
    hashes = window_hashes(mix(points.astype(_U) + _U(1)), min(k, len(points)))
    n = len(hashes)
    # Sorted by hash and place in one go: the place takes the low bits.
    low = _U((1 << n.bit_length()) - 1)
    keys = (hashes & ~low) | np.arange(n, dtype=_U)
    keys.sort()
    order = (keys & low).astype(np.int64)
    ordered = hashes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if (new[1:] & ((keys[1:] ^ keys[:-1]) <= low)).any():  # different hashes of equal high bits
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.flatnonzero(new)
    number = np.empty(n, _U)
    number[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return mix(hashes + number * _STEP)


def _least(values: np.ndarray, at: int, l: int, m: int) -> list[np.ndarray]:
    """Candidates for the l least items in each order, among them all that are: (rank, place) as one number; values start at place `at`."""
    orders, rows, out = _orders(m), np.arange(m), []
    for a in range(0, len(values), _COLUMNS):
        block = orders * (values[a : a + _COLUMNS] >> _U(32)).astype(np.uint32)
        for _ in range(min(l, block.shape[1])):
            least = block.argmin(1)
            out.append(block[rows, least].astype(_U) << _U(32) | (least + (at + a)).astype(_U))
            block[rows, least] = 0xFFFFFFFF
    return out


def _components(values: np.ndarray, found: list[np.ndarray], l: int, m: int) -> np.ndarray:
    """16 bits for each order: the hash of its l least items, in text order."""
    out = np.full(m, _STEP)
    if found:
        keys = np.array(found)
        if len(found) > l:
            keys.sort(0)
        places = keys[:l] & _U(0xFFFFFFFF)
        places.sort(0)
        for row in places:
            out = mix((out + values[row.astype(np.int64)]) * _STEP)
    return (out >> _U(48)).astype(">u2")


def signature(values: np.ndarray, l: int = TUPLE, m: int = COMPONENTS) -> np.ndarray:
    """The components of a text given by its items."""
    return _components(values, _least(values, 0, l, m), l, m)


def pair_signatures(a: np.ndarray, b: np.ndarray, l: int = TUPLE, m: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The components of two texts; items that both start with are compared once."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    same = int(differ[0]) if len(differ) else n
    both = _least(a[:same], 0, l, m)
    return tuple(_components(x, both + _least(x[same:], same, l, m), l, m) for x in (a, b))


def rows_of(batches):
    """Rows as tuples, from slices of bounded size."""
    for part in parts(batches, 1):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal components."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, k: int = K, l: int = TUPLE, m: int = COMPONENTS) -> DataFrame:
    """Every column of docs and `fingerprint`: m components of 4 hexadecimal digits.

    docs has a column text, read whole.  A null text is empty.  Equal texts have equal fingerprints; empty ones
    too, with that of no items.  Repeated rows stay; a column named fingerprint is replaced; an empty table stays empty.
    """
    others = [f for f in docs.schema.fields if f.name != "fingerprint"]

    def signed(batches):
        for batch in batches:
            texts = batch.column(names.index("text"))
            marks = [signature(items(t.as_py() or "", k), l, m).tobytes().hex() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], [*batch.schema.names, "fingerprint"])

    names = [f.name for f in others]
    return docs.select(*(docs[f"`{n}`"] for n in names)).mapInArrow(signed, StructType([*(StructField(f.name, f.dataType) for f in others), StructField("fingerprint", StringType())]))


def _with_followers(docs: DataFrame, intervals: int | None) -> DataFrame:
    """doc_id, text and guest, in partitions whose rows in order are consecutive documents; the guest that ends one is the document that follows.

    Ids are cut into intervals of about equal numbers.  Rows of the id that an interval starts with are sent to the
    interval before as well.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    starts = cut_points(rows, "doc_id", intervals) or [None]
    n = len(starts)
    placed = rows.withColumn("interval", interval_of(F.col("doc_id"), starts))
    first = F.element_at(F.array(*map(F.lit, starts)), F.col("interval") + 1).cast(rows.schema["doc_id"].dataType)
    own = F.struct(F.col("interval").alias("to"), F.lit(False).alias("guest"))
    guest = F.struct(((F.col("interval") + n - 1) % n).cast("int").alias("to"), F.lit(True).alias("guest"))
    sent = F.explode(F.when(F.col("doc_id").eqNullSafe(first), F.array(own, guest)).otherwise(F.array(own))).alias("sent")
    return placed.select("doc_id", "text", sent).select("doc_id", "text", "sent.*").repartitionById(n, F.col("to")).sortWithinPartitions("guest", "doc_id", "text").select("doc_id", "text", "guest")


def edited_pairs(docs: DataFrame, k: int = K, l: int = TUPLE, m: int = COMPONENTS, intervals: int | None = None) -> DataFrame:
    """Every document with its edited text, whose last quarter gave way to the start of the next document, and their likeness.

    docs: doc_id and text; other columns are left out.  The result has doc_id, n_chars (code points), text, edited, fingerprint,
    edited_fingerprint, near_edited and near_next.  Documents go by doc_id, nulls first, those of one id by text; after the last comes the first.  A null text is empty and
    stays as it is, since a quarter of it is empty; a next document that is shorter than the quarter is taken whole.  Repeated rows are separate documents, each
    the other's next.  An only document is its own next; an empty table gives no rows.  Rows of one id are in one task, whose memory is that of a few texts.

    intervals: into how many tasks the documents are cut, by default the session's shuffle partitions; so many ids come to the driver.
    """
    kind = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind), StructField("n_chars", LongType()), *(StructField(c, StringType()) for c in ("text", "edited", "fingerprint", "edited_fingerprint")), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())])

    def paired(batches):
        out, size = [], 0
        last = waiting = None  # last: the row before, its items; waiting: a row before, whose next one has no fingerprint yet
        for doc_id, text, guest in rows_of(batches):
            own = items(text, k)
            if last is not None:
                was, was_items, was_id = last
                quarter = len(was) // 4
                edited = was[: len(was) - quarter] + text[:quarter]
                a, b = pair_signatures(was_items, items(edited, k), l, m)
                if waiting is not None:
                    out.append((*waiting[0], likeness(waiting[1], a)))
                waiting = (was_id, len(was), was, edited, a.tobytes().hex(), b.tobytes().hex(), likeness(a, b)), a
                size += 2 * len(was)
                if size > BATCH_CHARS:
                    yield emit(out)
                    out, size = [], 0
            last = text, own, doc_id
            if guest:
                if waiting is not None:
                    out.append((*waiting[0], likeness(waiting[1], signature(own, l, m))))
                break
        for _ in batches:  # further guests are not needed
            pass
        if out:
            yield emit(out)

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], arrow.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return _with_followers(docs, intervals).mapInArrow(paired, schema)
