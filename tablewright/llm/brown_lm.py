"""A Brown class-based bigram language model (operator 5).

p(w | v) = p(class of w | class of v) * p(w | class of w).  Exchange clustering assigns
every word of the training texts to a class, in two steps.

1.  The commonest words, and the endings of all others, are exchanged in passes over the
    corpus until the likelihood comes to rest: a pass counts the classes before and after each and moves it to
    the class that raises the likelihood of class bigrams most.  What this step holds is
    bounded; it gives the classes their meaning.
2.  All other words, however many, are exchanged where they lie: their contexts are
    shuffled by word, and each goes to the class under which its contexts are likeliest,
    given the class bigrams.

Class bigrams and masses are then counted anew over all training tokens.  A word's share of its
class is smoothed by one, as in the unigram base, with one unknown word in each class; a
word that training lacks has the class of its ending.  The commonest words are broadcast;
all others are joined by shuffle, so the whole vocabulary never has to fit anywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from tablewright.llm import text as T
from tablewright.llm.store import cleaning, release, settle

CLASSES, COMMON, ENDINGS, ENDING_BYTES, PASSES, RISE = 40, 24_000, 6_000, 3, 40, 1e-3
_OTHER, _END = 0, 1  # ids of a rare word with a rare ending, and of the end of a text
_NONE = 255  # no neighbour in this segment
SEGMENT_BYTES, HELD = 1 << 20, 1 << 20
_COUNTS = (1 << 35) - 1  # a place, a class and a count are one number of 20, 8 and 35 bits
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _segments(text):
    """The words of a text, by pieces of about SEGMENT_BYTES."""
    data = text.as_py().encode().lower() if text.is_valid else b""
    lo = 0
    while True:
        cut = _BLANK.search(data, lo + SEGMENT_BYTES) if len(data) - lo > SEGMENT_BYTES else None
        hi = cut.start() if cut else len(data)
        own = data[lo:hi].split()
        if own or lo == 0 or hi == len(data):
            yield own, hi == len(data)
        lo = hi
        if hi == len(data):
            return


class Vocabulary:
    """Ids of common words and of endings; both are bytes, with their training counts."""

    def __init__(self, common: list[tuple[bytes, int]], endings: list[tuple[bytes, int]], other: int, ends: int, total: int, distinct: int):
        self.words = {w: k for k, (w, _) in enumerate(common, 2)}
        self.endings = {e: k for k, (e, _) in enumerate(endings, 2 + len(common))}
        self.first_ending = 2 + len(common)
        self.size = self.first_ending + len(endings)
        self.counts = np.array([other, ends, *(c for _, c in common), *(c for _, c in endings)], np.float64)
        self.total, self.distinct = total, distinct

    @property
    def kind(self) -> str:
        """The numbers that hold ids."""
        return "<u2" if self.size <= 1 << 16 else "<u4"


def _limit(table: DataFrame, column: str, most: int) -> int | None:
    """The least value from which on at most `most` rows are left, of those above 1 (sizes are tallied, no row is collected)."""
    tally = table.where(F.col(column) > 1).groupBy(column).count().orderBy(F.desc(column)).limit(most).collect()
    total, least = 0, None
    for value, n in tally:
        total += n
        if total > most:
            break
        least = value
    return least


def _count(train: DataFrame) -> DataFrame:
    """word, c: the words of all texts."""

    def counted(batches):
        held: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                for own, _ in _segments(text):
                    held.update(own)
                    if len(held) > 500_000:
                        yield out()
                        held = Counter()
        yield out()

    return train.select("text").mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _vocabulary(train: DataFrame, counts: DataFrame, common: int, endings: int) -> tuple[Vocabulary, int | None]:
    n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    least = _limit(counts, "c", common)
    top = [(bytes(w), c) for w, c in counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").collect()] if least else []
    rest = counts.where(F.col("c") < least) if least else counts
    by_end = rest.groupBy(F.expr(f"substring(word, greatest(length(word) - {ENDING_BYTES - 1}, 1), {ENDING_BYTES})").alias("e")).agg(F.sum("c").alias("c"))
    by_end = settle(by_end)
    enough = _limit(by_end, "c", endings)
    some = [(bytes(e), c) for e, c in by_end.where(F.col("c") >= enough).orderBy(F.desc("c"), "e").collect()] if enough else []
    others = by_end.where(F.col("c") < enough) if enough else by_end
    other = others.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return Vocabulary(top, some, int(other), ends, n + ends, distinct + (1 if ends else 0)), least


def _coded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row for each segment of a text: row, doc (the first segment's row), doc_id, training, lead, ids, rare.

    ids: of the words, and of the end behind the last segment's; where lead holds, the word
    before the segment comes first once more.  rare: those of the words that are not common,
    in order, with blanks between.
    """
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def coded(batches):
        v = given.value
        words, endings = v.words, v.endings
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                of, row, doc, lead, ids, rare = [], [], [], [], [], []
                for k, text in enumerate(part.column(1)):
                    first, before = at, None
                    for own, last in _segments(text):
                        if before is not None:
                            own = [before, *own]
                        found = [words.get(w, 0) for w in own]
                        rest = []
                        if 0 in found:
                            for i, w in enumerate(own):
                                if not found[i]:
                                    found[i] = endings.get(w[-ENDING_BYTES:], _OTHER)
                                    rest.append(w)
                        if last:
                            found.append(_END)
                        of.append(k)
                        row.append(at)
                        doc.append(first)
                        lead.append(before is not None)
                        ids.append(np.array(found, v.kind).tobytes())
                        rare.append(b" ".join(rest))
                        before = own[-1] if own else before
                        at += 1
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row, pa.int64()), pa.array(doc, pa.int64()), part.column(0).take(take), part.column(2).take(take), pa.array(lead, pa.bool_()), pa.array(ids, pa.binary()), pa.array(rare, pa.binary())],
                    ["row", "doc", "doc_id", "training", "lead", "ids", "rare"],
                )

    fields = [("row", LongType()), ("doc", LongType()), ("doc_id", docs.schema["doc_id"].dataType), ("training", BooleanType()), ("lead", BooleanType()), ("ids", BinaryType()), ("rare", BinaryType())]
    return docs.select("doc_id", "text", "training").mapInArrow(coded, StructType([StructField(n, t) for n, t in fields]))


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column's rows one after the other, and where rows begin and end."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    numbers = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return numbers, (off - off[0]) // np.dtype(kind).itemsize


def _before(values: np.ndarray, at: np.ndarray, first) -> np.ndarray:
    """The value before each in its row; `first` before the first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[at[:-1][at[:-1] < len(out)]] = first
    return out


def _rare_words(column: pa.Array) -> pa.Array:
    """All rare words of a column of words with blanks between, in order."""
    data, at = T.raw(column)
    lo, hi = (int(at[0]), int(at[-1])) if len(at) > 1 else (0, 0)
    starts, ends = T.word_spans(data, at, lo, hi)
    own = data[lo:hi]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(own[own != 32]))])


def _contexts(coded: DataFrame, vocabulary: Vocabulary, of: np.ndarray, n_classes: int) -> np.ndarray:
    """For each id, how often each class is before and after it: 2 x size x n_classes, summed on the executors by blocks of ids."""
    given, size, kind = coded.sparkSession.sparkContext.broadcast(of), vocabulary.size, vocabulary.kind
    step = 1000

    def partial(batches):
        classes = given.value
        total = np.zeros((2, size * n_classes), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids, at = _flat(part.column(0), kind)
                ids = ids.astype(np.int64)
                before = _before(ids, at, _END)
                fresh = np.ones(len(ids), bool)
                fresh[at[:-1][np.asarray(part.column(1))]] = False  # a leading word is counted in the segment before
                ids, before = ids[fresh], before[fresh]
                for side, (one, other) in enumerate(((ids, before), (before, ids))):
                    total[side] += np.bincount(one * n_classes + classes[other], minlength=size * n_classes)
        whole = total.reshape(2, size, n_classes)
        for k in range(0, size, step):
            block = whole[:, k : k + step]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block.astype("<u4").tobytes()], pa.binary())], ["k", "counts"])

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(raw.as_py(), "<u4").astype(np.int64)
                held[k] = held[k] + one if k in held else one
        for k, one in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([one.tobytes()], pa.binary())], ["k", "counts"])

    schema = "k int, counts binary"
    with cleaning(coded.sparkSession):
        rows = coded.where("training").select("ids", "lead").mapInArrow(partial, schema).repartition("k").mapInArrow(summed, schema).collect()
    out = np.zeros((2, size, n_classes))
    for k, raw in rows:
        out[:, k : k + step] = np.frombuffer(raw, np.int64).reshape(2, -1, n_classes)
    return out


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _bigrams(contexts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Counts of class bigrams."""
    table = np.zeros((contexts.shape[2],) * 2)
    np.add.at(table, of, contexts[1])
    return table


def likelihood(table: np.ndarray) -> float:
    """The part of the log-likelihood that classes decide."""
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def exchange(contexts: np.ndarray, of: np.ndarray, fixed: int, half: int) -> np.ndarray:
    """One pass of moves over the words of one half (by id): each to the class that raises the likelihood of class bigrams most.

    contexts: counts of classes before (0) and after (1) each word, under the classes `of`.
    Classes below `fixed` neither lose nor get words.  Class sums follow each move at once;
    neighbours' classes are those at the start of the pass, which is why a pass moves one
    half only.
    """
    before, after = contexts
    table, of = _bigrams(contexts, of), of.copy()
    totals = after.sum(1)
    for w in np.argsort(-totals, kind="stable").tolist():
        if of[w] < fixed or w % 2 != half or not totals[w]:
            continue
        a, left, right = of[w], before[w], after[w]
        table[a] -= right
        table[:, a] -= left
        np.maximum(table, 0, out=table)
        rows, columns = table.sum(1), table.sum(0)
        gain = (_f(table + right) - _f(table)).sum(1) + (_f(table.T + left) - _f(table.T)).sum(1)
        gain -= _f(rows + right.sum()) - _f(rows) + _f(columns + left.sum()) - _f(columns)
        gain[:fixed] = -np.inf
        b = int(gain.argmax())
        if gain[b] <= gain[a] + 1e-9:
            b = a
        of[w] = b
        table[b] += right
        table[:, b] += left
    return of


def _moved_tail(coded: DataFrame, vocabulary: Vocabulary, of: np.ndarray, table: np.ndarray) -> DataFrame:
    """word, c, class of all words that are not common, and classes and counts by place (row, found): each word goes to the class under which its contexts are likeliest.

    table: class bigrams.  A word's own counts are few beside them, so what a move adds to
    the likelihood is taken to first order: the logarithms of the bigrams it would join,
    over those of both classes' sums.
    """
    kind, first_ending, n = vocabulary.kind, vocabulary.first_ending, len(table)
    smooth = np.log(table + 0.5)
    right = np.zeros((256, n), np.float32)
    left = np.zeros((256, n), np.float32)
    right[:n] = (smooth - np.log(table.sum(1) + 0.5 * n)[:, None]).T
    left[:n] = smooth - np.log(table.sum(0) + 0.5 * n)[None, :]
    left[:, _END] = -np.inf
    given = coded.sparkSession.sparkContext.broadcast((of.astype(np.uint8), left, right))

    def contexts(batches):
        """A row for each rare word of a segment: word, row, and in one number its place, whether it is of training, and the classes before and after it."""
        classes = given.value[0]
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids, at = _flat(part.column("ids"), kind)
                own = classes[ids]
                lead = at[:-1][np.asarray(part.column("lead"))]
                before = _before(own, at, _END)
                before[lead] = _NONE
                after = np.full_like(own, _NONE)
                after[:-1] = own[1:]
                after[at[1:][at[1:] > at[:-1]] - 1] = _NONE
                some = np.flatnonzero((ids == _OTHER) | (ids >= first_ending))
                row = np.searchsorted(at, some, "right") - 1
                info = (some - at[row]) << 17 | np.asarray(part.column("training")).astype(np.int64)[row] << 16 | before[some].astype(np.int64) << 8 | after[some]
                yield pa.RecordBatch.from_arrays([_rare_words(part.column("rare")), pa.array(np.asarray(part.column("row"))[row]), pa.array(info)], ["word", "row", "info"])

    def chosen(batches):
        """Sorted by word: a word's rows are next to each other, maybe over several batches.

        Gives (word, c, class) of each word of training, and (row, found) of each place of
        one; places of a word with more than HELD of them in turn are (word, row, found)
        without a class, to be joined later.
        """
        _, left, right = given.value
        word, c, total, rows, infos, held = None, 0, None, [], [], 0

        def batch_of(words, counts, best, row, found):
            pad = len(row)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(words, pa.binary()), pa.nulls(pad, pa.binary())]) if words is not None else pa.array([word] * pad, pa.binary()),
                    pa.concat_arrays([pa.array(counts, pa.int64()), pa.nulls(pad, pa.int64())]),
                    pa.concat_arrays([pa.array(best, pa.int32()), pa.nulls(pad, pa.int32())]),
                    pa.concat_arrays([pa.nulls(len(counts), pa.int64()), pa.array(row, pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(counts), pa.int64()), pa.array(found, pa.int64())]),
                ],
                ["word", "c", "class", "row", "found"],
            )

        def closed():
            """The word that is over."""
            row, place = np.concatenate(rows), np.concatenate(infos) >> 17
            if not c:
                return batch_of([], [], [], [], [])
            best = int(total.argmax())
            return batch_of([word], [c], [best], row, place << 43 | best << 35 | min(c, _COUNTS))

        for batch in batches:
            if not batch.num_rows:
                continue
            words, row, info = batch.column(0), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            fresh = np.flatnonzero(np.concatenate([[True], np.asarray(pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False), bool)]))
            training = (info >> 16 & 1).astype(bool)
            each = left[info >> 8 & 255] + right[info & 255]
            each[~training] = 0
            sums = np.add.reduceat(each, fresh, axis=0)
            counts = np.add.reduceat((training & (info >> 8 & 255 != _NONE)).astype(np.int64), fresh)
            edges = np.append(fresh, len(info))
            first, last = words[0].as_py(), words[len(words) - 1].as_py()
            start = 0
            if word is not None and first == word:
                c, total, start = c + int(counts[0]), total + sums[0], 1
                rows.append(row[: edges[1]])
                infos.append(info[: edges[1]])
                held += int(edges[1])
            if word is not None and (start == 0 or len(fresh) > 1):
                yield closed()
                word = None
            if start < len(fresh):
                # All but the last word of the batch are whole.
                lo, hi = edges[start], fresh[-1]
                size = np.diff(edges[start:-1]) if len(fresh) - 1 > start else np.zeros(0, np.int64)
                best, n = sums[start:-1].argmax(1), counts[start:-1]
                known = np.flatnonzero(n > 0)
                if len(known):
                    of, c_of = np.repeat(best, size), np.repeat(n, size)
                    keep = c_of > 0
                    found = (info[lo:hi] >> 17) << 43 | of << 35 | np.minimum(c_of, _COUNTS)
                    yield batch_of(words.take(pa.array(fresh[start:-1][known])).to_pylist(), n[known], best[known].astype(np.int32), row[lo:hi][keep], found[keep])
                word, c, total = last, int(counts[-1]), sums[-1].copy()
                rows, infos, held = [row[hi:]], [info[hi:]], len(row) - int(hi)
            if held > HELD:
                yield batch_of(None, [], [], np.concatenate(rows), np.concatenate(infos) >> 17)
                rows, infos, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        if word is not None:
            yield closed()

    rows = coded.select("row", "training", "lead", "ids", "rare").mapInArrow(contexts, "word binary, row long, info long")
    return settle(rows.repartition("word").sortWithinPartitions("word").mapInArrow(chosen, "word binary, c long, class int, row long, found long"))


def _classed(coded: DataFrame, vocabulary: Vocabulary, of: np.ndarray, moved: DataFrame) -> DataFrame:
    """doc, doc_id, training, lead, classes (a byte for each id), n, known and gain (the sum of log10(count + 1)) of each segment."""
    kind, first_ending = vocabulary.kind, vocabulary.first_ending
    given = coded.sparkSession.sparkContext.broadcast((of.astype(np.uint8), vocabulary.counts))

    classes = moved.where("c is not null").select("word", "c", "class")
    late = moved.where("c is null and word is not null").select("word", "row", "found").join(classes, "word")
    found = moved.where("word is null").select("row", "found").unionByName(late.select("row", F.expr(f"(found << 43) | (cast(class as long) << 35) | least(c, {_COUNTS}L)").alias("found")))
    lists = found.groupBy("row").agg(F.collect_list("found").alias("found"))

    def put(batches):
        of, counts = given.value
        for batch in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            ids, at = _flat(batch.column("ids"), kind)
            lists = batch.column("found")
            edges = np.asarray(lists.offsets)
            x = np.asarray(lists.values)[edges[0] : edges[-1]]
            spot = (x >> 43) + np.repeat(at[:-1], np.diff(edges))
            classes = of[ids]
            classes[spot] = (x >> 35) & 255
            c = np.where((ids == _OTHER) | (ids >= first_ending), 0, counts[ids])
            c[spot] = x & _COUNTS
            lead = np.asarray(batch.column("lead"))
            c[at[:-1][lead]] = 0
            sums = lambda v, at=at: np.diff(np.concatenate([[0], np.cumsum(v)])[at])
            gain = np.array([np.log10(c[i:j] + 1.0).sum() for i, j in zip(at[:-1], at[1:], strict=True)])
            binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(classes))])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("doc", "doc_id", "training", "lead")), binary, pa.array(np.diff(at) - lead), pa.array(sums((c > 0).astype(np.int64))), pa.array(gain)],
                ["doc", "doc_id", "training", "lead", "classes", "n", "known", "gain"],
            )

    both = coded.drop("rare").join(lists, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<long>")))
    fields = [("doc", "long"), ("doc_id", coded.schema["doc_id"].dataType), ("training", "boolean"), ("lead", "boolean"), ("classes", "binary"), ("n", "long"), ("known", "long"), ("gain", "double")]
    schema = StructType()
    for name, kind_ in fields:
        schema = schema.add(name, kind_)
    return settle(both.mapInArrow(put, schema))


@dataclass
class Model:
    """Classes of common words and endings (by id) and of all other words (tail), and log10 of what scores sum."""

    vocabulary: Vocabulary
    of: np.ndarray
    tail: DataFrame
    transition: np.ndarray
    spread: np.ndarray  # what a word's count + 1 is divided by, for each class


def build(docs: DataFrame, classes: int = CLASSES, common: int = COMMON, endings: int = ENDINGS, passes: int = PASSES) -> tuple[Model, DataFrame]:
    """A model of the rows of docs (doc_id, text, training) with training, and the classed segments of all rows."""
    train = docs.where("training")
    counts = settle(_count(train))
    vocabulary, _ = _vocabulary(train, counts, common, endings)
    release(counts)
    coded = settle(_coded(docs, vocabulary))
    n_classes = classes + 2
    of = np.concatenate([[_OTHER, _END], 2 + np.arange(max(vocabulary.size - 2, 0)) % classes]).astype(np.int64)
    reached: list[float] = []
    for step in range(passes + 1):
        contexts = _contexts(coded, vocabulary, of, n_classes)
        table = _bigrams(contexts, of)
        reached.append(likelihood(table))
        # Both halves were moved, and the likelihood rose by less than RISE.
        if step == passes or step > 2 and reached[-1] - reached[-3] <= RISE * abs(reached[-3]):
            break
        of = exchange(contexts, of, 2, step % 2)
    moved = _moved_tail(coded, vocabulary, of, table)
    segments = _classed(coded, vocabulary, of, moved)
    release(coded)
    tail = moved.where("c is not null").select("word", "c", "class")

    def pairs(batches):
        total = np.zeros(n_classes * n_classes, np.int64)
        for batch in batches:
            own, at = _flat(batch.column(0), "u1")
            before = _before(own, at, _END)
            fresh = np.ones(len(own), bool)
            fresh[at[:-1][np.asarray(batch.column(1))]] = False
            total += np.bincount(before[fresh].astype(np.int64) * n_classes + own[fresh], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["k", "n"])

    table = np.zeros(n_classes * n_classes)
    for k, n in segments.where("training").select("classes", "lead").mapInArrow(pairs, "k int, n long").groupBy("k").agg(F.sum("n")).collect():
        table[k] = n
    table = table.reshape(n_classes, n_classes)
    mass = table.sum(0)
    types = np.bincount(of[1 : vocabulary.first_ending], minlength=n_classes).astype(float)
    for k, n in tail.groupBy("class").count().collect():
        types[k] += n
    single = (mass + 1) / (mass.sum() + n_classes)
    kinds = (table > 0).sum(1, keepdims=True)
    # Witten-Bell: as many unseen transitions are expected as kinds were seen.
    transition = np.log10(np.where(kinds > 0, (table + kinds * single) / np.maximum(table.sum(1, keepdims=True) + kinds, 1), single))
    return Model(vocabulary, of, tail, transition, np.log10(mass + types + 1)), segments


def score_texts(docs: DataFrame, classes: int = CLASSES, common: int = COMMON, endings: int = ENDINGS, passes: int = PASSES) -> DataFrame:
    """Scores of each row of docs (doc_id, text, training) by a model of the rows with training.

    Returns doc_id, training, n_tokens, n_known, train_tokens, base_score, score and
    perplexity.  Tokens are the words, with A-Z lower-cased, and an end.  base_score is
    the add-one unigram model's log10 probability, score the class model's; n_known counts
    tokens that training has.  common and endings bound what is held in memory and
    broadcast; every other word of training has a class of its own choice, too.  passes:
    of the first step at most, if it has not come to rest before.  classes: up to 250.

    Null texts count as empty: one token, the end.  Long texts are scored whole, by segments.
    A null `training` counts as false.  doc_id may be of any type, and null.  Repeated rows
    are scored and counted each.  With nothing to learn from, every token is
    unknown to both models.  An empty table gives no rows.  Other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.coalesce("training", F.lit(False)).alias("training"))
    model, segments = build(docs, classes, common, endings, passes)
    given = docs.sparkSession.sparkContext.broadcast((model.transition, model.spread))

    def scored(batches):
        transition, spread = given.value
        for batch in (b.slice(a, 512) for b in batches for a in range(0, b.num_rows, 512)):
            own, at = _flat(batch.column("classes"), "u1")
            each = transition[_before(own, at, _END), own] - spread[own]
            each[at[:-1][np.asarray(batch.column("lead"))]] = 0
            rest = np.array([each[i:j].sum() for i, j in zip(at[:-1], at[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc", "doc_id", "training", "n", "known", "gain")), pa.array(rest, pa.float64())], ["doc", "doc_id", "training", "n", "known", "gain", "rest"])

    schema = StructType([f for f in segments.schema.fields if f.name not in ("lead", "classes")]).add("rest", "double")
    rows = segments.mapInArrow(scored, schema).groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("training").alias("training"), *(F.sum(k).alias(k) for k in ("n", "known", "gain", "rest")))
    below = float(np.log10(model.vocabulary.total + model.vocabulary.distinct + 1))
    out = rows.select(
        "doc_id",
        "training",
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("gain") - F.col("n") * F.lit(below)).alias("base_score"),
        (F.col("gain") + F.col("rest")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
