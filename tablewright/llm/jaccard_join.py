"""N-gram Jaccard join (operator 3).

Documents are sets of word shingles; two are linked if the sets' Jaccard similarity
reaches a threshold.  The product of the document-by-shingle incidence matrix with its
transpose is never made as a whole: overlaps are counted for pairs that pass bounds on the
sets' sizes, block by block.

1.  Of each set the least hashes are taken, a little more than the share by which linked
    sets may differ.  A document that shares too few of them with any other can have no
    link (by the sets' sizes alone) and leaves; so most do.
2.  The others' whole sets are read again, one set for all equal ones.  Shingles are ordered
    by how many sets hold them; sets that are linked share one of the first |A| - a + 1 of
    A's, a being the least overlap.  Columns of the incidence beyond that are left out.
3.  In each column that remains, sets are compared with one pivot, twice, so that a group
    of thousands of near copies becomes one component after as many products as it has
    members.  Then all pairs of a column that are in different components and pass the
    bounds of size and position are compared.

Only links inside a component that is already known are left out, so components are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm import ids
from tablewright.llm import text as T
from tablewright.llm.graph import components
from tablewright.llm.store import release, settle

WIDTH, PERCENT, PIVOTS = 5, 80, 2
#: Words of 64 bits of the filter of ids (8 MB).
FILTER_WORDS = 1 << 20


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole text is one shingle if it has fewer words, none if it has none."""
    words, at = T.word_hashes(column, True)
    every = T.window_hashes(words, width).view(np.int64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(np.array([T.whole_hash(words[a:b])] if b > a else [], np.uint64).view(np.int64))
    return out


def _least(n, percent: int):
    """The least overlap of a set of n with one it is linked to."""
    return -(-n * percent // 100)


def _batch(sets: list[np.ndarray], rows: dict[str, pa.Array], name: str) -> pa.RecordBatch:
    values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    columns = rows | {name: T.list_column(values, [len(s) for s in sets], pa.int64())}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _signature(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    """Size and a 128-bit hash of each set."""
    sums = [(int(T.mix(s).sum()), int(T.mix(s.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).sum())) for s in sets]
    return {
        "n": pa.array([len(s) for s in sets], pa.int64()),
        "s1": pa.array(np.array([a for a, _ in sums], np.uint64).view(np.int64)),
        "s2": pa.array(np.array([b for _, b in sums], np.uint64).view(np.int64)),
    }


def _overlaps(batches):
    """Blocks of the product: (a, b) with the overlap of their sets, where it reaches the bound."""
    for batch in batches:
        left, right = batch.column("set_a"), batch.column("set_b")
        a_at, b_at = np.asarray(left.offsets), np.asarray(right.offsets)
        a_all, b_all = np.asarray(left.values), np.asarray(right.values)
        need = np.asarray(batch.column("need"))
        keep = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            a, b = a_all[a_at[k] : a_at[k + 1]], b_all[b_at[k] : b_at[k + 1]]
            if len(a) > len(b):
                a, b = b, a
            place = np.searchsorted(b, a)
            place[place == len(b)] = 0
            keep[k] = np.count_nonzero(b[place] == a) >= need[k]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked. An overlap of at least percent/(100 + percent) of the sizes' sum is the same bound as the similarity."""
    a = sets.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("set_a"))
    b = sets.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("set_b"))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100 + percent) - F.lit(1e-9)).cast("long")
    both = pairs.distinct().join(a, "a").join(b, "b").withColumn("need", need).where("need <= least(n_a, n_b)")
    return both.select("a", "b", "set_a", "set_b", "need").mapInArrow(_overlaps, "a long, b long")


def _places(doc: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each id in the filter of ids; null is as 0."""
    mixed = T.mix(np.asarray(doc.fill_null(0)).astype(np.uint64))
    return ((mixed >> np.uint64(6)) % np.uint64(FILTER_WORDS)).astype(np.int64), np.uint64(1) << (mixed & np.uint64(63))


def _maybe_in(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs (doc, text) whose doc is in the wanted table, and a few others: a filter of fixed size goes to all tasks, so no text is shuffled for it."""

    def bits(batches):
        for batch in batches:
            word, bit = _places(batch.column(0))
            words, at = np.unique(word, return_inverse=True)
            out = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(out, at, bit)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(out.view(np.int64))], ["word", "bits"])

    found = wanted.select("doc").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_WORDS, np.uint64)
    table[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).view(np.uint64)
    sent = wanted.sparkSession.sparkContext.broadcast(table)

    def some(batches):
        for batch in batches:
            word, bit = _places(batch.column(0))
            yield batch.filter(pa.array((sent.value[word] & bit) != 0))

    return docs.mapInArrow(some, docs.schema)


def shingle_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of each row of docs (doc_id, text).

    A-Z are lower-cased; words are runs of other characters than ASCII white space.  Sets
    are linked if 100 * intersection >= percent * union.  Shingles are compared by 64-bit
    hashes, whole sets by 128-bit hashes; these are polynomials modulo 2**64, which texts made
    for it (words of 2 KB and more in Thue-Morse order) could bring to collide.

    doc_id is of any type that has an order; ids that are no whole numbers are numbered in their order first.  Long texts are read whole,
    by pieces.  Null and empty texts, and texts without words, have no shingles and no links.  Rows
    that share a doc_id are one document; if their texts differ, the one whose set has the
    least hash makes its links.  A row with a null
    doc_id has links to none and a null component_id.  An empty table gives no rows.
    Other columns are ignored.
    """
    if not ids.is_whole(docs):
        names = ids.numbers(docs)
        named = docs.select("doc_id", "text").join(names, F.col("doc_id") == F.col("id"), "left")
        found = shingle_components(named.select(F.col("number").alias("doc_id"), "text"), width, percent)
        first, own = names.select(F.col("number").alias("component_id"), F.col("id").alias("first")), names.select(F.col("number").alias("doc_id"), F.col("id").alias("own"))
        return found.join(own, "doc_id", "left").join(first, "component_id", "left").select(F.col("own").alias("doc_id"), "n_shingles", F.col("first").alias("component_id"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("text"))

    def prefixes(batches):
        for batch in T.parts(batches, 1):
            sets = shingle_sets(batch.column(1), width)
            some = [s[: len(s) - _least(len(s), percent) + 1 + len(s) // 20] for s in sets]
            yield _batch(some, {"doc": batch.column(0)} | _signature(sets), "prefix")

    every = settle(docs.mapInArrow(prefixes, "doc long, n long, s1 long, s2 long, prefix array<long>"))
    kept = every.where("n > 0 and doc is not null")
    sizes = settle(every.drop("prefix"))  # what is left of a set when its prefix is done with
    one = sizes.where("n > 0 and doc is not null").groupBy("doc").agg(F.min(F.struct("s1", "s2", "n")).alias("x")).select("doc", "x.*")
    same = one.groupBy("s1", "s2", "n").agg(F.min("doc").alias("first"))
    copies = one.join(same, ["s1", "s2", "n"]).where("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b"))

    def shared(batches):
        """Rows (h, doc, credit, known): shingles that are in one document of the batch, those known to be in more, and the documents' numbers of the latter."""
        for batch in batches:
            lists = batch.column(1)
            at = np.asarray(lists.offsets)
            h = np.asarray(lists.values)[at[0] : at[-1]]
            doc = np.repeat(np.asarray(batch.column(0)), np.diff(at))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            order = np.argsort(h, kind="stable")
            fresh = np.ones(len(h), bool)
            fresh[1:] = h[order[1:]] != h[order[:-1]]
            size = np.bincount(np.cumsum(fresh) - 1) if len(h) else np.zeros(0, np.int64)
            lead = order[fresh]
            alone = size == 1
            many = np.ones(len(h), bool)
            many[lead[alone]] = False
            credit = np.bincount(row[many], minlength=batch.num_rows)
            some = np.flatnonzero(credit)
            ids = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h[lead], T.mix(ids[some].astype(np.uint64)).view(np.int64)])),
                    pa.array(np.concatenate([doc[lead], ids[some]])),
                    pa.array(np.concatenate([alone, credit[some]]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(lead), bool), np.ones(len(some), bool)])),
                ],
                ["h", "doc", "credit", "known"],
            )

    spread = kept.select("doc", "prefix").mapInArrow(shared, "h long, doc long, credit int, known boolean")
    times = F.count("*").over(Window.partitionBy("h", "known"))
    credits = spread.withColumn("times", times).where("credit > 0 and (known or times > 1)").groupBy("doc").agg(F.sum("credit").alias("credit"))
    # Of the prefix of n - least + 1 + n div 20 hashes, linked sets share n div 20 + 1 or more.
    firsts = same.select(F.col("first").alias("doc"), "n", "s1", "s2")
    able = firsts.join(credits, "doc").where(F.col("credit") > F.floor(F.col("n") / 20)).select("doc", "n", "s1", "s2")

    def whole(batches):
        """The sets of texts that are the wanted ones of their doc_id."""
        for batch in T.parts(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            signs = _signature(sets)
            same = np.logical_and.reduce([np.asarray(batch.column(c)) == np.asarray(signs[c]) for c in ("n", "s1", "s2")])
            yield _batch([s for s, k in zip(sets, same, strict=True) if k], {"doc": batch.column("doc").filter(pa.array(same)), "n": signs["n"].filter(pa.array(same))}, "hashes")

    able = settle(able)
    release(every)
    # Most texts can have no link, and need not be shuffled.
    sets = settle(_maybe_in(docs, able).join(able, "doc").mapInArrow(whole, "doc long, n long, hashes array<long>"))

    def postings(batches):
        """Rows (h, docs): the documents of a batch that hold a shingle."""
        for batch in (b.slice(a, 2000) for b in batches for a in range(0, b.num_rows, 2000)):
            lists = batch.column(1)
            at = np.asarray(lists.offsets)
            h = np.asarray(lists.values)[at[0] : at[-1]]
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            order = np.argsort(h, kind="stable")
            fresh = np.ones(len(h), bool)
            fresh[1:] = h[order[1:]] != h[order[:-1]]
            lead = np.flatnonzero(fresh)
            lengths = np.diff(np.append(lead, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[order[lead]]), T.list_column(np.asarray(batch.column(0))[row[order]], lengths, pa.int64())], ["h", "docs"])

    lists = sets.select("doc", "hashes").mapInArrow(postings, "h long, docs array<long>")
    held = lists.withColumn("df", F.sum(F.size("docs")).over(Window.partitionBy("h"))).where("df > 1")
    # A set is there twice if its row was repeated; the entries are one set all the same.
    ordered = held.select("h", "df", F.explode("docs").alias("doc")).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("held"))
    ordered = ordered.join(sets.select("doc", "n").distinct(), "doc")
    least = F.ceil(F.col("n") * percent / F.lit(100) - F.lit(1e-9)).cast("int")
    # Shingles of this set alone come first in the order, and make no column.
    ordered = ordered.withColumn("alone", F.col("n").cast("int") - F.size("held")).withColumn("take", F.col("n").cast("int") - least + 1 - F.col("alone")).where("take > 0")
    columns = settle(ordered.select("doc", "n", "alone", F.posexplode(F.slice("held", F.lit(1), F.col("take")))).select(F.col("col.h").alias("h"), "doc", "n", (F.col("alone") + F.col("pos")).alias("place"), "alone"))

    links = copies
    for step in range(PIVOTS):
        order = F.struct(F.col("alone") / F.col("n"), F.col("doc")) if step == 0 else F.struct(F.xxhash64(F.lit(step), "doc"), F.col("doc"))
        if step == 0:
            labelled = columns.withColumn("c", F.col("doc"))
        pivots = labelled.groupBy("h").agg(F.min(order).alias("p"), F.min_by(F.struct("doc", "n", "c"), order).alias("pivot"), F.count("*").alias("times")).where("times > 1")
        pairs = labelled.join(pivots, "h").where("c <> pivot.c and 100 * least(n, pivot.n) >= {0} * greatest(n, pivot.n)".format(percent)).select(F.col("doc").alias("a"), F.col("pivot.doc").alias("b"))
        more = settle(links.union(_linked(pairs, sets, percent)))
        if step:
            release(links)
            release(labels)
            release(labelled)
        links = more
        labels = components(links)
        labelled = settle(columns.join(labels.withColumnRenamed("v", "doc"), "doc", "left").withColumn("c", F.coalesce("c", "doc")))
    # Columns with several components: each set outside the most frequent one, with all sets of other components.
    counts = labelled.groupBy("h", "c").count()
    main = counts.groupBy("h").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("h", "main")
    several = labelled.join(main, "h")
    x = several.where("c <> main").select("h", *(F.col(k).alias(f"{k}_x") for k in ("doc", "n", "place", "c")))
    y = several.select("h", *(F.col(k).alias(f"{k}_y") for k in ("doc", "n", "place", "c")))
    need = f"ceil((n_x + n_y) * {percent} / {100 + percent} - 1e-9)"
    close = f"c_x <> c_y and 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y) and least(n_x - place_x, n_y - place_y) >= {need}"
    pairs = x.join(y, "h").where(close).select(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b"))
    # Only the first column that two sets share bounds their overlap so; the others repeat the pair or drop it.
    rest = _linked(pairs, sets, percent)
    joined = labels.select(F.col("v").alias("a"), F.col("c").alias("b"))
    final = components(joined.union(rest))
    for done in (able, sets, columns, links, labelled, labels):
        release(done)
    return (
        sizes.join(final.withColumnRenamed("v", "doc"), "doc", "left")
        .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("c", "doc").alias("component_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least doc_id, with its own columns, whatever their names; rows without a doc_id stay.

    Rows of one doc_id are one document: all of them stay, or none.
    """
    groups = shingle_components(docs)
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["doc_id"].alias("id"))
    kept = rows.where("id is not null").join(keep, "id", "left_semi").unionByName(rows.where("id is null"))
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
