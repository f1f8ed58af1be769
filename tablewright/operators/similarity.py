"""Pairs of similar sets by an inverted index of their rarest members, and what is built on that.

A set's members are put in order of how many sets have them, rarest first.  Two sets whose
similarity reaches a bound must share COMMON of the first few members in that order (their
prefixes: what is left when the least overlap that counts is taken off, and COMMON - 1 more), or all they need to share if that is less.
So only prefixes are indexed, and members that nearly all sets have are hardly ever in one.  Candidates that the sizes
or the places of a shared member rule out are dropped in the join; the rest are verified.

Where an index does not help, because one side is small or most sets share their rarest members too, overlaps
of all pairs are counted instead: parts of both sides meet in cells, a product of 0-1 matrices for two blocks of a cell, and only pairs that reach the bound leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tablewright.functions import strings
from tablewright.plans.stages import settle

#: By measure: the least overlap that a set of n members needs with any other, of two sets of n and m members, and the measure itself.
_BOUNDS = {
    "dice": (lambda n, t: n * (t / (2 - t)), lambda n, m, t: (n + m) * (t / 2), lambda o, n, m: 2 * o / (n + m)),
    "jaccard": (lambda n, t: n * t, lambda n, m, t: (n + m) * (t / (1 + t)), lambda o, n, m: o / (n + m - o)),
}


def numbered(items: Column) -> Column:
    """An array's elements in order, each with the number of equal ones before it: the members of a multiset as those of a set."""
    # The array is bound once, as the element of another: a lambda would make it anew for each element.
    number = lambda own: F.transform(own, lambda x, i: F.concat_ws("\x02", x, (i + 1 - F.array_position(own, x)).cast("string")))
    return F.get(F.transform(F.array(F.sort_array(items)), number), 0)


def qgrams(text: Column, q: int = 2) -> Column:
    """The runs of q characters of a text that is padded by q - 1 marks on either side; none of an empty one."""
    padded = F.concat(F.lit("\x01" * (q - 1)), text, F.lit("\x01" * (q - 1)))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substr(padded, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


#: How many members two prefixes must share; each more makes prefixes one longer and candidates much fewer.
COMMON = 3


def prefixes(sets: DataFrame, order: DataFrame, least: float, measure: str) -> DataFrame:
    """side, by, id, n, place (from 1) and member of the members by which a set is indexed.

    sets: side, by, id, members (an array without repeats); order: by, hash of a member and how many sets have it.  Members are
    given as hashes; two of one hash can only make more candidates.
    """
    need, _, _ = _BOUNDS[measure]
    tall = sets.select("side", "by", "id", F.size("members").alias("n"), F.explode("members").alias("m")).select("side", "by", "id", "n", F.xxhash64("m").alias("member"))
    ranked = tall.join(order, ["by", "member"]).groupBy("side", "by", "id", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "member"))).alias("own"))
    # A hair is taken off the bound, so that rounding never drops a pair.
    taken = (F.col("n") - F.ceil(need(F.col("n"), least) - 1e-9) + COMMON).cast("int")
    return ranked.select("side", "by", "id", "n", F.posexplode(F.slice("own", F.lit(1), F.least(taken, F.col("n")))).alias("place", "m")).select("side", "by", "id", "n", (F.col("place") + 1).alias("place"), F.col("m.member").alias("member"))


def candidates(sets: DataFrame, least: float, measure: str = "dice", itself: bool = False) -> DataFrame:
    """Pairs (by, a, b) of ids of the sides "a" and "b" that may reach the bound: sets of one `by` that share a member of their prefixes.

    itself: there is one side, "a", and pairs are those with a < b.
    """
    return _met(_index(sets, least, measure), least, measure, itself)


def _index(sets: DataFrame, least: float, measure: str) -> DataFrame:
    order = sets.select("by", F.explode("members").alias("m")).groupBy("by", F.xxhash64("m").alias("member")).agg(F.count("*").alias("sets"))
    return settle(prefixes(sets, order, least, measure))


def _met(index: DataFrame, least: float, measure: str, itself: bool) -> DataFrame:
    """Pairs of an index that share enough of their prefixes."""
    _, both, _ = _BOUNDS[measure]
    a, b = (index.where(F.col("side") == s).select("by", "member", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "place"))) for s, x in (("a", "a"), ("a" if itself else "b", "b")))
    pairs = a.join(b, ["by", "member"])
    n, m, i, j = (F.col(c) for c in ("a_n", "b_n", "a_place", "b_place"))
    needed = both(n, m, least) - 1e-9
    # Members before the shared one and after it that may be shared as well.
    pairs = pairs.where((F.least(n, m) >= needed) & (F.least(i, j) + F.least(n - i, m - j) >= needed))
    if itself:
        pairs = pairs.where("a_id < b_id")
    shared = pairs.groupBy("by", F.col("a_id").alias("a"), F.col("b_id").alias("b")).agg(F.count("*").alias("k"), F.least(F.lit(COMMON), F.ceil(F.first(needed))).alias("least"))
    return shared.where("k >= least").select("by", "a", "b")


#: Sets of a block; members that a product takes at once; pairs that are given at once.
BLOCK, MEMBERS, PAIRS = 2048, 4096, 1 << 14
#: Sets, and members of sets, that a side of a cell may have.
CELL, CELL_MEMBERS = 1 << 16, 1 << 22
#: All pairs are compared if they are at most so many a set, or so many a pair of the index.
A_SET, A_PAIR = 256, 16


def _places(members: pa.ListArray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in words of each member that is among them, by place."""
    of = np.repeat(np.arange(len(members)), np.diff(np.asarray(members.offsets)))
    at = pa.compute.index_in(members.flatten(), words)
    known = np.asarray(at.is_valid())
    row, place = of[known], np.asarray(at.drop_null())
    order = np.argsort(place, kind="stable")
    return row[order], place[order]


def _overlaps(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """Number of members that each set of one side shares with each of the other; members go in parts, so the matrices are of bounded size."""
    words = left.flatten().unique()
    words = words.filter(pa.compute.is_in(words, right.flatten().unique()))
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(len(x), *_places(x, words)) for x in (left, right)]
    for start in range(0, len(words), MEMBERS):
        parts = []
        for n, row, place in sides:
            a, b = np.searchsorted(place, [start, start + MEMBERS])
            part = np.zeros((n, min(MEMBERS, len(words) - start)), np.float32)
            part[row[a:b], place[a:b] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _cell(rows: pa.Table, least: float, measure: str, strict: bool, same: bool):
    """Batches (a, b, score) of a cell's pairs that reach the bound; same: of its first sets with one another, each once."""
    first = rows.column("first").combine_chunks()
    a, b = (rows.filter(m).combine_chunks() for m in (first, pa.compute.invert(first)))
    b = a if same else b
    for i in range(0, a.num_rows, BLOCK):
        for j in range(i if same else 0, b.num_rows, BLOCK):
            yield from _product(a.slice(i, BLOCK), b.slice(j, BLOCK), least, measure, strict, same and i == j)


def _product(a: pa.Table, b: pa.Table, least: float, measure: str, strict: bool, same: bool):
    """_cell() of two blocks of sets."""
    x, y = (t.column("members").combine_chunks() for t in (a, b))
    overlap = _overlaps(x, y)
    n, m = (np.diff(np.asarray(t.offsets)).astype(np.float64) for t in (x, y))
    for at in range(0, len(n), 256):
        score = _BOUNDS[measure][2](overlap[at : at + 256].astype(np.float64), n[at : at + 256, None], m[None])
        i, j = np.nonzero((score > least) if strict else (score >= least - 1e-12))
        if same:
            i, j = i[keep := j > i + at], j[keep]
        for k in range(0, len(i), PAIRS):
            ii, jj = i[k : k + PAIRS], j[k : k + PAIRS]
            yield pa.RecordBatch.from_arrays([a.column("id").combine_chunks().take(pa.array(ii + at)), b.column("id").combine_chunks().take(pa.array(jj)), pa.array(score[ii, jj])], ["a", "b", "score"])


def _parts(sets: tuple[int, int], members: tuple[int, int], cells: int, itself: bool) -> list[int]:
    """In how many parts each side goes.  A set is shuffled once for each part of the other side, so these are as few as the bounds of a cell allow, and make `cells` cells if there are blocks enough."""
    most = [max(1, -(-n // BLOCK)) for n in sets]
    fewest = [min(m, max(1, -(-n // CELL), -(-k // CELL_MEMBERS))) for m, n, k in zip(most, sets, members, strict=True)]
    if itself:
        return [max(fewest[0], min(most[0], int(np.ceil(np.sqrt(2 * cells)))))] * 2
    a = max(fewest[0], min(most[0], int(np.ceil(np.sqrt(cells)))))
    b = max(fewest[1], min(most[1], -(-cells // a)))
    return [max(a, min(most[0], -(-cells // b))), b]


def all_pairs(sets: DataFrame, n_a: int, n_b: int, least: float, measure: str, strict: bool, itself: bool) -> DataFrame:
    """(a, b, score) of the pairs of sets of one `by` that reach the bound, by comparing all: every part of a side with every one of the other (itself: with those after it).

    sets: as for candidates(); n_a and n_b: how many each side has.  A task holds a cell of two parts at a time.
    """
    shuffled = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = {r["side"]: r["n"] for r in sets.groupBy("side").agg(F.sum(F.size("members")).alias("n")).collect()}
    blocks = _parts((n_a, n_a if itself else n_b), (held.get("a", 0), held.get("a" if itself else "b", 0)), 2 * shuffled, itself)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == "a", blocks[0]).otherwise(blocks[1]))
    other = F.explode(F.when(F.col("side") == "a", F.sequence(F.lit(0), F.lit(blocks[1] - 1))).otherwise(F.sequence(F.lit(0), F.lit(blocks[0] - 1))))
    rows = sets.select("side", "id", "members", own.alias("own")).select("*", other.alias("other"))
    first = (F.col("own") <= F.col("other")) if itself else (F.col("side") == "a")
    cell = F.when(first, F.col("own") * blocks[1] + F.col("other")).otherwise(F.col("other") * blocks[1] + F.col("own"))
    rows = rows.select(cell.alias("cell"), first.alias("first"), "id", "members")
    cells = blocks[0] * (blocks[1] + 1) // 2 if itself else blocks[0] * blocks[1]
    tasks = min(cells, 4 * shuffled)

    def pairs(batches):
        held, at = [], None
        same = lambda: itself and at // blocks[1] == at % blocks[1]
        for batch in batches:
            numbers = np.asarray(batch.column("cell"))
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and numbers[s] != at:
                    yield from _cell(pa.Table.from_batches(held), least, measure, strict, same())
                    held = []
                at = numbers[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from _cell(pa.Table.from_batches(held), least, measure, strict, same())

    kind = sets.schema["id"].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("score", DoubleType())])
    found = rows.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(pairs, schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score") if itself else found


def similar_sets(left: DataFrame, right: DataFrame | None, least: float, measure: str = "dice", strict: bool = False) -> DataFrame:
    """All pairs (by, a, b, score) of sets whose similarity is `least` or more (strict: more).

    left and right: by, id and members, an array without repeats (numbered() makes multisets into such), one row an id; ids of one
    type.  Only sets of equal `by` meet.  Without right the pairs are those of left with itself, each once (a < b).  Empty
    and null sets are similar to none.  What is alike should be put together before: equal sets are as many pairs as there are.

    Ids may be long texts: the index is of numbers of sets and hashes of members, and ids are added to the pairs that are found.
    """
    columns = lambda df, side: df.where(F.size("members") > 0).select(F.lit(side).alias("side"), "by", "id", "members")
    itself = right is None
    sets = settle((columns(left, "a") if itself else columns(left, "a").unionByName(columns(right, "b"))).withColumn("no", F.monotonically_increasing_id()))
    sizes = sets.groupBy("by").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"))
    whole = sizes.agg(F.count("*").alias("kinds"), F.sum("n_a").alias("a"), F.sum("n_b").alias("b"), F.first("by").alias("by")).first()
    pairs_there = (whole["a"] or 0) * (whole["a"] / 2 if itself else whole["b"]) if whole["kinds"] == 1 else None
    every = lambda: all_pairs(sets, whole["a"], whole["b"], least, measure, strict, itself).crossJoin(F.broadcast(sets.select("by").limit(1))).select("by", "a", "b", "score")
    if pairs_there is not None and pairs_there <= A_SET * (whole["a"] + whole["b"]):
        return every()
    index = _index(sets.select("side", "by", F.col("no").alias("id"), "members"), least, measure)
    if pairs_there is not None:
        held = index.groupBy("member").agg(F.count_if(F.col("side") == "a").cast("double").alias("a"), F.count_if(F.col("side") == "b").cast("double").alias("b"))
        met = held.agg(F.sum(F.col("a") * (F.col("a") / 2 if itself else F.col("b")))).first()[0] or 0
        if pairs_there <= A_PAIR * met:
            return every()
    found = _met(index, least, measure, itself)
    side = lambda s, x: sets.where(F.col("side") == s).select("by", F.col("no").alias(x), F.col("id").alias(f"{x}_id"), F.col("members").alias(f"{x}_members"))
    pairs = found.join(side("a", "a"), ["by", "a"]).join(side("a" if itself else "b", "b"), ["by", "b"])
    overlap = F.size(F.array_intersect("a_members", "b_members"))
    score = _BOUNDS[measure][2](overlap, F.size("a_members"), F.size("b_members"))
    ends = (F.least("a_id", "b_id"), F.greatest("a_id", "b_id")) if itself else (F.col("a_id"), F.col("b_id"))
    scored = pairs.select("by", ends[0].alias("a"), ends[1].alias("b"), score.alias("score"))
    return scored.where((F.col("score") > least) if strict else (F.col("score") >= least - 1e-12))


def _members(text: Column) -> Column:
    """The words of a text after H02, as the members of a multiset."""
    return numbered(strings.words(strings.normalize_text(text)))


def _texts(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Distinct texts of df, each the id of its set of words."""
    return df.select(F.struct(*by).alias("by") if by else F.lit(0).alias("by"), F.col(text).alias("id")).dropna().distinct().withColumn("members", _members(F.col("id")))


def similar_names(names: DataFrame, name: str, least: float = 0.8, q: int = 2) -> DataFrame:
    """Pairs (a, b, score) of distinct names, a < b, whose q-grams have a Dice similarity of `least` or more.

    Names are compared in lower case and trimmed, but given as they are; null and blank ones are similar to none.
    """
    rows = names.select(F.lit(0).alias("by"), F.col(name).alias("id")).dropna().distinct()
    return similar_sets(rows.withColumn("members", numbered(qgrams(F.lower(F.trim("id")), q))), None, least).drop("by")


def word_f1_pairs(left: DataFrame, right: DataFrame, by: list[str], text: str, least: float = 0.25) -> DataFrame:
    """Pairs (by..., a, b, score) of distinct texts of either side with a word F1 above `least`."""
    found = similar_sets(_texts(left, by, text), _texts(right, by, text), least, strict=True)
    return found.select(*(F.col(f"by.{c}").alias(c) for c in by), "a", "b", "score")


def closest(wanted: DataFrame, nodes: DataFrame, by: list[str], text: str, order: str, levels: tuple[float, ...] = (0.8, 0.5, 0.25)) -> DataFrame:
    """For every distinct wanted text the node text of the same `by` with the highest word F1: by..., text, node_text, f1.

    Of equal ones the first by `order`; where none reaches the last level node_text is <NULL> and f1 null.  Where at most A_SET texts are
    wanted of one `by`, they are compared with all its nodes.  Where more are, the search goes
    down the levels: at each, all pairs that reach it are found by the index for that bound, and what has one is
    done, since pairs that were not found are below the level.  So the long prefixes of low bounds are only
    indexed for texts that nothing is close to.
    """
    key = F.struct(*by).alias("by") if by else F.lit(0).alias("by")
    texts = nodes.select(key, F.col(text).alias("id"), F.col(order).alias("order")).dropna(subset=["id"])
    asked = wanted.select(key, F.col(text).alias("id")).dropna(subset=["id"])
    # Compared with all, a text that few others of its `by` are wanted with costs no more than to read the nodes.
    many = settle(asked.groupBy("by").agg(F.count_distinct("id").alias("n")).where(F.col("n") > A_SET).select("by"))
    if many.isEmpty():
        out = _closest_of_all(asked, texts, levels[-1])
    else:
        few = [df.join(many, "by", "left_anti") for df in (asked, texts)]
        out = _closest_of_all(*few, levels[-1]).unionByName(_closest_by_index(asked.join(many, "by", "left_semi"), texts.join(many, "by", "left_semi"), levels))
    return out.select(*(F.col(f"by.{c}").alias(c) for c in by), F.col("id").alias(text), "node_text", "f1")


def _closest_of_all(asked: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """closest() by comparing all of one `by`: one shuffle of the texts by that; words are made after it, and texts that are not close are dropped before anything is sorted."""
    members = lambda df, name: df.withColumn(name, _members(F.col("id"))).where(F.size(name) > 0)
    of_a = asked.repartition("by").distinct().withColumn("a", _members(F.col("id")))
    of_b = members(texts.repartition("by").groupBy("by", "id").agg(F.min("order").alias("order")), "b").withColumnRenamed("id", "node_text")
    score = _BOUNDS["dice"][2](F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))
    pairs = of_a.join(of_b, "by", "left").select("by", "id", "order", "node_text", F.when(F.col("b").isNotNull() & (F.size("a") > 0), score).alias("score"))
    close = F.col("score") >= least - 1e-12
    pairs = pairs.select("by", "id", *(F.when(close, F.col(c)).alias(c) for c in ("score", "order", "node_text")))
    rank = F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "order"))
    return pairs.groupBy("by", "id").agg(F.max("score").alias("f1"), F.coalesce(F.min_by("node_text", rank), F.lit("<NULL>")).alias("node_text"))


def _closest_by_index(asked: DataFrame, texts: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    first = texts.groupBy("by", "id").agg(F.min("order").alias("order"))
    places = settle(first.withColumn("members", _members(F.col("id"))))
    left, done = settle(asked.distinct().withColumn("members", _members(F.col("id")))), None
    for level in levels:
        pairs = similar_sets(left, places.drop("order"), level)
        ranked = pairs.join(places.select("by", F.col("id").alias("b"), "order"), ["by", "b"])
        # Scores of equal overlap and sizes are equal to the last digit.
        best = ranked.groupBy("by", "a").agg(F.max("score").alias("f1"), F.min_by("b", F.struct((-F.col("score")).alias("s"), "order")).alias("node_text"))
        best = settle(best.withColumnRenamed("a", "id"))
        done = best if done is None else done.unionByName(best)
        left = settle(left.join(best, ["by", "id"], "left_anti"))
    return done.unionByName(left.select("by", "id", F.lit(None).cast("double").alias("f1"), F.lit("<NULL>").alias("node_text")))
