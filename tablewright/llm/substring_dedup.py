"""Removing repeated word windows (operator 9).

Level-wise doubling: windows of a quarter of the length are looked at first; those that
occur more than once alone are extended to half the length, and of these those that occur
more than once to the whole length, until none is left.  Below the whole length a window
is stood for by one start inside it, that of the half-length window with the least hash:
equal windows have the same one at the same place, so nothing repeated is missed, and
about one position in six is shuffled.  At the last level all windows whose start survived
are compared by 96-bit hashes.

Windows that repeat within a batch are settled there: at most one row for each window,
level and batch is shuffled, so that a passage of a third of all documents makes no large
group.  A document whose whole text has a smaller document is settled without its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tablewright.llm import ids
from tablewright.llm import text as T
from tablewright.llm.store import release, settle, with_columns

_LAST, _SHORTEST = (1 << 63) - 1, 5
_TEXT = 0x7FFFFFFF  # bits of a text's hash that tell texts of one doc_id apart


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes, the place of the leftmost least one."""
    n = len(hashes)
    place, span = np.arange(n), 1
    while span * 2 <= width:
        a, b = place[: n - 2 * span + 1], place[span : n - span + 1]
        place, span = np.where(hashes[b] < hashes[a], b, a), span * 2
    if span < width:
        a, b = place[: n - width + 1], place[width - span : n - span + 1]
        place = np.where(hashes[b] < hashes[a], b, a)
    return place


def ladder(window: int) -> list[int]:
    """Lengths below the window's, each about twice the one before; the last is half of it."""
    out = [max(1, window // 2)]
    while out[0] // 2 >= _SHORTEST:
        out.insert(0, out[0] // 2)
    return out


def _anchors(words: np.ndarray, at: np.ndarray, window: int):
    """(starts of all windows inside documents, the place inside each that stands for it)."""
    half = max(1, window // 2)
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none
    hashes = T.window_hashes(words, half)
    inside = np.zeros(len(words) - window + 1, np.int64)
    for edge, step in ((at[:-1], 1), (at[1:] - window + 1, -1)):
        ok = np.diff(at) >= window
        np.add.at(inside, edge[ok][edge[ok] < len(inside)], step)
    starts = np.flatnonzero(np.cumsum(inside) > 0)
    return starts, _least(hashes, window - half + 1)[starts]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the order of documents), the text, its hash t1, t2, and the other columns as a struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    text = F.col("text")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text, F.struct(*others).alias("row"))


def surviving(docs: DataFrame, window: int) -> DataFrame:
    """(doc, text, places): for texts of docs (doc, t1, text) the starts that stand for windows and survive all levels below the whole."""
    lengths = ladder(window)
    n = len(lengths)

    def climbing(batches):
        """Rows (h0, h1, ..., level, doc, place): hashes by level, and the first level that this batch alone does not settle."""
        for batch in T.parts(batches, 2):
            words, at = T.word_hashes(batch.column(2), False)
            place = np.unique(_anchors(words, at, window)[1])
            hashes = [T.window_hashes(words, k)[place] >> np.uint64(16) for k in lengths]  # 48 bits: below the last level a chance hit only costs a later look
            row = np.searchsorted(at, place, "right") - 1
            doc = np.asarray(batch.column(0))[row]
            start = place - at[row] + ((np.asarray(batch.column(1)) & _TEXT)[row] << 32)
            level = np.zeros(len(place), np.int8)
            told = []
            for k, own in enumerate(hashes):
                _, first, group, size = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
                level += (size[group] > 1) & (level == k)
                told.append(first[size > 1])  # one more row, of no document, tells other batches of what repeats here
            tell = np.concatenate(told) if told else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(np.concatenate([h, h[tell]]).view(np.int64)) for h in hashes),
                    pa.array(np.concatenate([level, np.repeat(np.arange(n), [len(t) for t in told])]).astype(np.int8)),
                    pa.array(np.concatenate([doc, doc[tell]])),
                    pa.array(np.concatenate([start, np.full(len(tell), -1)])),
                ],
                [*(f"h{k}" for k in range(n)), "level", "doc", "start"],
            )

    rows = docs.select("doc", "t1", "text").mapInArrow(climbing, ", ".join(f"h{k} long" for k in range(n)) + ", level byte, doc long, start long")
    for k in range(n):
        here = F.col("level") == k
        key = F.when(here, F.col(f"h{k}")).otherwise(F.xxhash64("doc", "start", F.col(f"h{n - 1}")))
        times = F.count("*").over(Window.partitionBy("key", "here"))
        left = rows.withColumn("here", here).withColumn("key", key).withColumn("times", times).where("not here or (times > 1 and start >= 0)")
        left = left.withColumn("level", F.greatest("level", F.lit(k + 1).cast("byte"))).drop("here", "key", "times", f"h{k}" if k < n - 1 else "")
        if k == n - 1:
            rows = left
        else:
            done, rows = rows, settle(left)
            if k:
                release(done)
            if not rows.limit(1).count():
                break  # nothing survives
    return rows.where("start >= 0").groupBy("doc", F.shiftright("start", 32).alias("text")).agg(F.collect_set(F.col("start").bitwiseAND(0xFFFFFFFF).cast("int")).alias("places"))


def repeated_windows(keyed: DataFrame, window: int = 20) -> DataFrame:
    """For texts with windows that start earlier: doc, t1, t2, whole (all of it is an earlier text), starts.

    keyed: from _keyed.  Earlier is a smaller doc, or the same and an earlier start; starts
    are word positions of windows whose words also start earlier.
    """
    docs = keyed.where("text is not null").select("doc", "t1", "t2", "text")
    mine = F.col("t1").bitwiseAND(_TEXT).alias("text")
    alive = surviving(docs, window)
    firsts = docs.groupBy("t1", "t2").agg(F.min("doc").alias("first"))
    texts = docs.select("doc", "t1", "t2").distinct().join(firsts, ["t1", "t2"])
    plan = texts.select("*", mine).join(alive, ["doc", "text"], "left")
    plan = settle(plan.select("doc", "t1", "t2", (F.col("doc") > F.col("first")).alias("whole"), F.when(F.col("doc") == F.col("first"), F.col("places")).alias("places")))

    def wholes(batches):
        for batch in T.parts(batches, "text"):
            words, at = T.word_hashes(batch.column("text"), False)
            starts, place = _anchors(words, at, window)
            lists = batch.column("places")
            row_of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            alive = np.zeros(len(words) + 1, bool)
            alive[np.minimum(at[row_of] + np.asarray(lists.values)[np.asarray(lists.offsets)[0] : np.asarray(lists.offsets)[-1]], len(words))] = True
            starts = starts[alive[place]]
            h1, h2 = (T.window_hashes(words, window, k)[starts] if len(starts) else np.zeros(0, np.uint64) for k in (0, 1))
            h2 &= np.uint64(0xFFFFFFFF00000000)
            row = np.searchsorted(at, starts, "right") - 1
            text = (np.asarray(batch.column("t1")) & _TEXT)[row] << 32
            doc, place = np.asarray(batch.column("doc"))[row], starts - at[row] + text
            order = np.lexsort((place, doc, h2, h1))
            h1, h2, doc, place = h1[order], h2[order], doc[order], place[order]
            fresh = np.ones(len(h1), bool)
            fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), 0)) if len(h1) else np.zeros(0, np.int64)
            same = ~fresh & (doc == doc[lead]) & (place == place[lead])
            free = T.mix(doc.astype(np.uint64) ^ (place.astype(np.uint64) << np.uint64(32)))
            keep = np.flatnonzero(~same)
            keep = keep[np.lexsort((place[keep], doc[keep]))]  # neighbours are alike, and so shuffled in less
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(fresh, h1, free)[keep].view(np.int64)), pa.array((h2[keep] >> np.uint64(32)).astype(np.int64)), pa.array(doc[keep]), pa.array(place[keep]), pa.array(~fresh[keep])],
                ["h1", "h2", "doc", "start", "known"],
            )

    # All columns, in the plan of remove_repeats' last join: one shuffle of the texts serves both.
    texts = keyed.join(plan.where("size(places) > 0").drop("whole"), ["doc", "t1", "t2"])
    spread = texts.mapInArrow(wholes, "h1 long, h2 long, doc long, start long, known boolean")
    earliest = F.min(F.struct("doc", "start")).over(Window.partitionBy("h1", "h2", "known"))
    late = spread.withColumn("earliest", earliest).where(F.col("known") | (F.col("earliest") < F.struct("doc", "start")))
    starts = late.groupBy("doc", F.shiftright("start", 32).alias("text")).agg(F.collect_set(F.col("start").bitwiseAND(0xFFFFFFFF).cast("int")).alias("starts"))
    return plan.select("doc", "t1", "t2", "whole", mine).join(starts, ["doc", "text"], "left").drop("text").where("whole or starts is not null")


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs (doc_id, text, others) with n_words, n_removed and kept: the words left, joined by one blank.

    A word goes if it lies in a window of `window` consecutive words of its document whose
    words also start earlier: in a document with a smaller doc_id, or before in the same
    one.  Windows are those of the input.

    doc_id is of any type that has an order; ids that are no whole numbers are numbered in their order first.  A null text has no words
    (kept is ""), as an empty one.  A null doc_id comes after all others.  Rows with equal
    doc_id and text get equal results, and are not earlier than one another; other texts of
    one doc_id come in the order of their hashes.  Long texts are read whole.  An empty table
    gives no rows.  Columns of docs named like the three added ones are replaced; all others stay.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    if not ids.is_whole(docs):
        names = ids.numbers(docs)
        row = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text")).alias("row")
        named = docs.select(row, "text").join(names, F.col("row.doc_id") == F.col("id"), "left").select(F.col("number").alias("doc_id"), "text", "row")
        own = (F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns)
        return remove_repeats(named, window).select(*own, "n_words", "n_removed", "kept")
    keyed = _keyed(docs)
    marks = repeated_windows(keyed, window)

    def cut(batches):
        for batch in T.parts(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text, whole, starts in zip(batch.column("text"), batch.column("whole").to_pylist(), batch.column("starts"), strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if whole and len(words) >= window:
                    n_removed.append(len(words))
                    words = []
                elif starts.is_valid and len(starts):
                    edge = np.zeros(len(words) + window + 1, np.int64)
                    at = np.unique(np.asarray(starts.values))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    covered = (np.cumsum(edge)[: len(words)] > 0).tolist()
                    n_removed.append(sum(covered))
                    words = [w for w, c in zip(words, covered, strict=True) if not c]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["row", "text", "n_words", "n_removed", "kept"])

    both = keyed.join(marks, ["doc", "t1", "t2"], "left").select("row", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "starts")
    schema = with_columns(StructType(both.schema.fields[:2]), ("n_words", LongType()), ("n_removed", LongType()), ("kept", StringType()))
    own = (F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns)
    return both.mapInArrow(cut, schema).select(*own, "n_words", "n_removed", "kept")


def digest() -> F.Column:
    """Lower-case hex SHA-256 of kept."""
    return F.sha2(F.col("kept"), 256)

