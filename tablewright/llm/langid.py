"""Language identification by a string kernel (operator 7).

The kernel is the blended spectrum of presence: the number of distinct byte n-grams
(n = 1, 2, 3) that two texts share, divided by the root of the product of their own
numbers.  A bounded sample of each label's texts gives Nystroem landmarks, and another one
the one-versus-rest kernel ridge regressions; both grow with the number of labels.  As a
prediction is linear in the n-grams present, all landmarks fold into one n-gram-by-language
matrix, and batches are scored by products of a presence matrix with it.  Where that matrix
would be large, kernel values are multiplied with the regressions instead: the same sums.
Every label is learnt, and every text is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tablewright.llm import text as T
from tablewright.llm.store import settle, with_columns

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
LANDMARKS, FIT_ROWS = 192, 2048
LEAST_SCORE = 0.4
EACH_LANDMARKS, EACH_FIT_ROWS = 3, 32  # of each label at least
FOLDED, BLOCK = 1 << 22, 2048


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte capitals from U+00C0 on; other ASCII is a blank."""
    out = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def _keys(data: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of a text: bytes, pairs and triples in one range of 24 bits (a leading NUL marks shorter ones)."""
    b = _fold(data).astype(np.int32)
    pair = (b[:-1] << 8) | b[1:]
    return np.concatenate([b, pair, (pair[:-1] << 8) | b[2:]])


def _letters(data: np.ndarray, text) -> bool:
    return bool(_LETTER[data].any()) or any(map(str.isalpha, text()))


class _Distinct:
    """Distinct keys without sorting: the last writer of a key's place is its representative."""

    def __init__(self):
        self.stamp = np.zeros(1 << 24, np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.arange(len(keys), dtype=np.int32)
        self.stamp[keys] = at
        return keys[self.stamp[keys] == at]


class Landmarks:
    """The n-grams of the landmarks' sets, and for each n-gram the landmarks that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.grams, place = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[np.argsort(place, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.grams)))])

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many of some distinct n-grams each landmark has."""
        if not len(self.grams):
            return np.zeros(len(self.sizes), np.int64)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = at[self.grams[at] == own]
        n = self.start[at + 1] - self.start[at]
        return np.bincount(self.ids[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(self.sizes))

    def kernel(self, own: np.ndarray) -> np.ndarray:
        """Kernel values of one text with all landmarks."""
        return self.shared(own) / np.sqrt(self.sizes * max(1, len(own)))

    def folded(self, alpha: np.ndarray) -> np.ndarray:
        """The weight of each n-gram for each language."""
        out = np.zeros((len(self.grams), alpha.shape[1]), np.float32)
        np.add.at(out, np.repeat(np.arange(len(self.grams)), np.diff(self.start)), (alpha / np.sqrt(self.sizes)[:, None]).astype(np.float32)[self.ids])
        return out


class Model:
    """Languages, landmarks, the regressions' values for each landmark and language, and their constants."""

    def __init__(self, languages: list[str], landmarks: Landmarks, alpha: np.ndarray, bias: np.ndarray):
        self.languages, self.landmarks, self.alpha, self.bias = languages, landmarks, alpha, bias


def _sample(docs: DataFrame, each: int) -> DataFrame:
    """text, lang, place: up to `each` different rows of each label, by the hash of id and text: the same rows wherever they lie.

    Hashes and labels alone are ranked, and of those only as many as may be among the first
    by the labels' counts; the chosen rows' texts are fetched afterwards.
    """
    rows = docs.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    keys = rows.select("lang", "key")
    # 0 to 1, evenly: of n rows, each + 8 * sqrt(each) + 20 are expected below the cut, so a label with fewer than `each` there has repeated rows.
    at = F.pmod(F.col("key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    cuts = docs.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(each + 8 * each**0.5 + 20) / F.count("*")).alias("cut"))
    cuts = settle(cuts)
    order = Window.partitionBy("lang").orderBy("at", "key")
    ranked = lambda some: some.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    near = settle(ranked(keys.withColumn("at", at).join(F.broadcast(cuts), "lang").where("at <= cut").select("lang", "key", "at")))
    short = near.groupBy("lang").count().where(F.col("count") >= each).select("lang")
    short = settle(cuts.where("cut < 1").join(short, "lang", "left_anti").select("lang"))
    if short.limit(1).count():
        near = near.join(short, "lang", "left_anti").unionByName(ranked(keys.withColumn("at", at).join(F.broadcast(short), "lang")).select(near.columns))
        near = settle(near)
    fetched = rows.join(F.broadcast(near.select("lang", "key", "place")), ["lang", "key"])
    return settle(fetched.groupBy("lang", "key", "place").agg(F.first("text").alias("text")).select("text", "lang", "place"))


def fit(docs: DataFrame, landmarks: int = LANDMARKS, fit_rows: int = FIT_ROWS, ridge: float = 1e-3) -> Model | None:
    """A model of docs (doc_id, text, lang); rows with null lang, or text without letters, are left out.

    Every label is learnt.  landmarks and fit_rows: sizes of the two samples; both are spread
    evenly over the labels, and each label has EACH_LANDMARKS and EACH_FIT_ROWS at least (if
    it has so many different rows).  A repeated row is sampled once; sampled texts are read
    whole, however long.  lang and doc_id may be of any type that casts to text; a null
    doc_id is an id.  None if there is nothing to learn from, as with an empty table.
    """
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    names = [r[0] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not names:
        return None
    most = max(EACH_FIT_ROWS, fit_rows // len(names))
    first = max(EACH_LANDMARKS, landmarks // len(names))
    sample = _sample(docs, max(most, first))

    def grams(batches):
        distinct = _Distinct()
        for batch in batches:
            data, at = T.raw(batch.column(0))
            found = [distinct(_keys(data[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([T.list_column(np.concatenate(found), [len(f) for f in found], pa.int32()), batch.column(1)], ["grams", "lang"])

    base = sample.where(F.col("place") <= first).select("text", "lang").mapInArrow(grams, "grams array<int>, lang string").orderBy("lang", F.size("grams"), F.hash("grams")).toArrow()
    sets = [np.asarray(x.values) for x in base.column("grams")]
    known = Landmarks(sets)
    given = docs.sparkSession.sparkContext.broadcast(known)

    def kernel(batches):
        distinct = _Distinct()
        known = given.value
        for batch in batches:
            data, at = T.raw(batch.column(0))
            out = [known.kernel(distinct(_keys(data[a:b]))).astype(np.float32) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([T.list_column(np.concatenate(out), [len(known.sizes)] * len(out), pa.float32()), batch.column(1)], ["row", "lang"])

    rows = sample.where(F.col("place") <= most).select("text", "lang").mapInArrow(kernel, "row array<float>, lang string").orderBy("lang", "row").toArrow()
    number = {name: k for k, name in enumerate(names)}
    label = np.array([number[x] for x in rows.column("lang").to_pylist()])
    mean, centre = 2 * np.bincount(label, minlength=len(names)) / len(label) - 1, np.zeros(len(sets))
    k_mm = np.stack([known.kernel(s) for s in sets])
    left, right = ridge * len(label) * k_mm + 1e-6 * np.eye(len(sets)), np.zeros((len(sets), len(names)))
    blocks = [(np.stack([np.asarray(x.values) for x in rows.column("row")[a : a + BLOCK]]), label[a : a + BLOCK]) for a in range(0, len(label), BLOCK)]
    for x, _ in blocks:
        centre += x.sum(0, dtype=float) / len(label)
    for x, own in blocks:
        x = x - centre
        left += x.T @ x
        right += x.T @ (np.where(own[:, None] == np.arange(len(names)), 1.0, -1.0) - mean)
    alpha = np.linalg.solve(left, right)
    return Model(names, known, alpha, (mean - centre @ alpha).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, folded: int = FOLDED) -> DataFrame:
    """docs with lang_pred and score (0 to 1: half of 1 + the winning regression's value, within the bounds).

    Only the text column is looked at, whole; memory grows with the longest text.  Null and
    empty texts and texts without a letter are "und"
    with score 0; so is everything when there is no model.  Repeated rows get a result each; an
    empty table gives no rows.  Ties go to the language that
    comes first by frequency in training.  Columns lang_pred and score of docs are replaced.
    folded: the most values of the n-gram-by-language matrix; above it, it is not made.
    """
    docs = docs.drop("lang_pred", "score")
    given = docs.sparkSession.sparkContext.broadcast(model)
    fold = model is not None and len(model.landmarks.grams) * len(model.languages) <= folded

    def run(batches):
        model = given.value
        distinct = _Distinct()
        if fold:
            place = np.zeros(1 << 24, np.int32)  # 0: no n-gram of a landmark
            place[model.landmarks.grams] = np.arange(1, len(model.landmarks.grams) + 1)
            weights = np.concatenate([np.zeros((1, len(model.languages)), np.float32), model.landmarks.folded(model.alpha)])
        for batch in T.parts(batches, "text"):
            column = batch.column("text")
            data, at = T.raw(column)
            best, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            able = [k for k in range(batch.num_rows) if model is not None and at[k] < at[k + 1] and _letters(data[at[k] : at[k + 1]], lambda k=k: column[k].as_py() or "")]
            for a in range(0, len(able), 64):
                some = able[a : a + 64]
                if fold:
                    present = np.zeros((len(some), len(weights)), np.float32)
                    norms = np.empty((len(some), 1), np.float32)
                    for i, k in enumerate(some):
                        own = distinct(_keys(data[at[k] : at[k + 1]]))
                        norms[i] = np.sqrt(len(own))
                        present[i, place[own]] = 1
                    value = present @ weights / norms + model.bias
                else:
                    value = np.stack([model.landmarks.kernel(distinct(_keys(data[at[k] : at[k + 1]]))) for k in some]) @ model.alpha + model.bias
                top = value.argmax(1)
                for i, k in enumerate(some):
                    best[k] = model.languages[top[i]]
                score[some] = np.clip((1 + value[np.arange(len(some)), top].astype(float)) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, with_columns(docs.schema, ("lang_pred", StringType()), ("score", DoubleType())))


def remainder(column: str = "doc_id", by: int = 4) -> F.Column:
    """crc32 of an id as text, modulo."""
    return F.crc32(F.col(column).cast("string")) % by


def reject(docs: DataFrame, model: Model | None, least: float = LEAST_SCORE, wanted: list[str] | None = None) -> DataFrame:
    """The documents that have a language, with their own columns.

    Rejected are those predicted "und", those whose score is below `least` (from 0.5 down, every
    one-versus-rest regression says "rest"; the default asks for a clear no), and, where `wanted` is given, those of other languages.
    Columns of docs named lang_pred and score stay as they are.
    """
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    scored = predict(docs.select(docs["text"], F.struct(F.lit(0).alias("0"), *others).alias("row")), model)
    keep = (F.col("lang_pred") != "und") & (F.col("score") >= least)
    if wanted is not None:
        keep &= F.col("lang_pred").isin(wanted)
    return scored.where(keep).select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
