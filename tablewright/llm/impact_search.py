"""Ranked lexical search over impact-ordered postings, score at a time (operator 11).

The impact of a posting (a term in a document) is a whole number that depends on the term's
weight, its occurrences and the document's length.  Postings of a term lie in order of
impact, so those of one exact impact are a group.  For an item, groups of all its terms are
taken from the highest contribution down and added up by document; what a document can
still get is at most the sum of the terms' next contributions.  When that proves that the
first k are among a few documents, the rest is left, and the scores of those few are
completed from the documents' own lists.  If it is never proved, all groups are taken.

Texts are read twice at most: once for the items' terms in each document (written, with no
other terms), which also gives the statistics of all documents.  Documents are then
searched in blocks, a task after another, in memory bounded by the block; each task gives k
rows an item at most.  The items are taken in chunks of bounded numbers of terms.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tablewright.llm.store import settle
from tablewright.llm.text import list_column, parts, word_hashes

K = 20
CHUNK_TERMS, BLOCK_ROWS, BLOCK_POSTINGS = 1 << 18, 8192, 1 << 21
#: Scores are completed when so many documents are left for each of the k.
_LEFT = 4
_U = np.uint64
_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, item_no, terms (their hashes) and counts of every row of items."""
    schema = StructType([StructField("item_id", items.schema["item_id"].dataType), StructField("item_no", LongType()), StructField("terms", ArrayType(LongType())), StructField("counts", ArrayType(LongType()))])

    def counted(batches):
        for batch in parts(batches, 2):
            hashes, at = word_hashes(batch.column(2), True, _BETWEEN)
            own = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
            lengths = [len(t) for t, _ in own]
            columns = [np.concatenate([o[c] for o in own] or [np.zeros(0)]).astype(_U).view(np.int64) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(list_column(c, lengths, pa.int64()) for c in columns)], schema.names)

    return items.select("item_id", F.monotonically_increasing_id().alias("item_no"), "text").mapInArrow(counted, schema)


def term_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (all terms), terms (places in the sorted vocabulary of hashes) and tfs of the documents that have terms."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n", LongType()), StructField("terms", ArrayType(IntegerType())), StructField("tfs", ArrayType(LongType()))])

    def counted(batches):
        size = len(vocabulary)
        for batch in parts(batches, 1):
            hashes, at = word_hashes(batch.column(1), True, _BETWEEN)
            n = np.diff(at)
            place = np.searchsorted(vocabulary, hashes)
            place[place == size] = 0
            known = np.flatnonzero(vocabulary[place] == hashes) if size else np.zeros(0, np.int64)
            rows = np.repeat(np.arange(len(n)), n)[known]
            keys, tfs = np.unique(rows * max(size, 1) + place[known], return_counts=True)
            rows = keys // max(size, 1)
            some = np.flatnonzero(n > 0)
            lengths = np.bincount(rows, minlength=len(n))[some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(n[some], pa.int64()), list_column((keys % max(size, 1)).astype(np.int32), lengths, pa.int32()), list_column(tfs, lengths, pa.int64())],
                schema.names,
            )

    return docs.select("doc_id", "text").mapInArrow(counted, schema)


class Block:
    """Postings of some documents, which are numbered in the order of their ids."""

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        self.n = n_docs
        by_doc = np.argsort(doc, kind="stable")
        self.own_term, self.own_impact = term[by_doc], impact[by_doc]
        self.own_at = np.searchsorted(doc[by_doc], np.arange(n_docs + 1))
        by_term = np.lexsort((-impact, term))
        self.doc, self.falling = doc[by_term], -impact[by_term]
        self.at = np.searchsorted(term[by_term], np.arange(terms + 1))
        self.scores = np.zeros(n_docs, np.int64)

    def complete(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The whole scores of documents; weights: the occurrences of each term in the item."""
        counts = self.own_at[docs + 1] - self.own_at[docs]
        ends = np.cumsum(counts)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.own_at[docs] - (ends - counts), counts)
        sums = np.concatenate([[0], np.cumsum(weights[self.own_term[take]] * self.own_impact[take])])
        return sums[ends] - sums[ends - counts]

    def best(self, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores: the first k and no other than may be of them; floor: a score that k documents elsewhere have (0: none)."""
        lists = [(int(self.at[t]), int(self.at[t + 1]), int(c)) for t, c in zip(terms, counts, strict=True) if self.at[t] < self.at[t + 1]]
        scores, level = self.scores, max((-c * int(self.falling[a]) for a, _, c in lists), default=0)
        scores[:] = 0
        while True:
            # All groups whose contribution is not below the level.
            rest, taken, ahead = [], [], 0
            for a, b, c in lists:
                to = a + int(np.searchsorted(self.falling[a:b], -(-(-level // c)), "right"))
                if to > a:
                    taken.append((self.doc[a:to], self.falling[a:to] * -c))
                if to < b:
                    rest.append((to, b, c))
                    ahead += -c * int(self.falling[to])
            lists = rest
            if taken:
                np.add.at(scores, np.concatenate([d for d, _ in taken]), np.concatenate([v for _, v in taken]))
            least = max(floor, int(np.partition(scores, self.n - k)[self.n - k]) if self.n >= k else 0)
            if not lists:
                docs = np.flatnonzero(scores >= max(1, least))
                return docs, scores[docs]
            if ahead < least:  # no document that was not met yet is of the first k
                docs = np.flatnonzero(scores + ahead >= least)
                if len(docs) <= _LEFT * k:
                    exact = self.complete(docs, weights)
                    keep = exact > 0
                    return docs[keep], exact[keep]
            level = min(level - 1, level * 3 // 4)


def _searched(table: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The first k documents of each task for each query (number, places of terms, counts): item_no, doc_id, score."""
    kind = table.schema["doc_id"].dataType
    schema = StructType([StructField("item_no", LongType()), StructField("doc_id", kind), StructField("score", LongType())])
    vocabulary = len(weight)

    def searched(batches):
        first: list[list[tuple]] = [[] for _ in queries]
        weights = np.zeros(vocabulary, np.int64)

        def search(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.take(pa.compute.sort_indices(rows, [("doc_id", "ascending")], null_placement="at_start"))
            lists = rows.column("terms").combine_chunks()
            term = np.asarray(lists.flatten()).astype(np.int64)
            tf = np.asarray(rows.column("tfs").combine_chunks().flatten())
            lengths = np.asarray(pa.compute.list_value_length(lists))
            doc = np.repeat(np.arange(rows.num_rows), lengths)
            m = 100 - 25 + (25 * rows.column("n").to_numpy() * n_docs) // n_terms
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            some = impact > 0
            block = Block(rows.num_rows, doc[some], term[some], impact[some], vocabulary)
            ids = rows.column("doc_id")
            for own, (_, terms, counts) in zip(first, queries, strict=True):
                weights[terms] = counts
                docs, scores = block.best(terms, counts, weights, k, own[-1][0] if len(own) == k else 0)
                weights[terms] = 0
                order = np.lexsort((docs, -scores))[:k]
                for d, s in zip(docs[order].tolist(), scores[order].tolist(), strict=True):
                    own.append((s, ids[d].as_py()))
                own.sort(key=lambda x: (-x[0], x[1] is not None, x[1]))
                del own[k:]

        held, rows, postings = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                held.append(part)
                rows += part.num_rows
                postings += len(part.column(2).flatten())
                if rows >= BLOCK_ROWS or postings >= BLOCK_POSTINGS:
                    search(held)
                    held, rows, postings = [], 0, 0
        if held:
            search(held)
        found = [(number, d, s) for (number, _, _), own in zip(queries, first, strict=True) for s, d in own]
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for a in range(0, len(found), 1 << 16):
            some = found[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in some], t) for c, t in enumerate(arrow.types)], arrow.names)

    tasks = min(table.rdd.getNumPartitions(), -(-n_docs // BLOCK_ROWS))
    return table.coalesce(max(1, tasks)).mapInArrow(searched, schema)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k documents of highest score above 0 for every row of items: item_id, rank (from 1), doc_id, score.

    docs: doc_id and text; items: item_id and text; other columns are left out.  Of equal scores the least doc_id comes first, null
    before all.  A null text has no terms; documents without terms count nowhere, items without terms, or with none that a document has, give no rows.  Repeated rows are documents and
    items of their own, each item with its own ranks.  Empty tables give no rows.  Texts are read whole, in pieces; a task holds the
    terms of BLOCK_ROWS documents that items have.  Terms are compared by 64-bit hashes.
    """
    kind, of = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    asked = settle(query_terms(items))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_TERMS))
    out = None
    for c in range(chunks):
        rows = asked.where((F.pmod(F.xxhash64("item_no"), F.lit(chunks)) == c) & (F.size("terms") > 0)).select("item_no", "terms", "counts").collect()
        vocabulary = np.unique(np.array([t for r in rows for t in r["terms"]], np.int64).view(_U))
        queries = [(r["item_no"], np.searchsorted(vocabulary, np.array(r["terms"], np.int64).view(_U)), np.array(r["counts"], np.int64)) for r in rows]
        table = settle(term_frequencies(docs, vocabulary))
        n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(vocabulary), np.int64)
        for term, df in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        found = settle(_searched(table, queries, weight, n_docs, n_terms, k)) if n_docs and queries else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        schema = StructType([StructField("item_id", of), StructField("rank", IntegerType()), StructField("doc_id", kind), StructField("score", LongType())])
        return docs.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("item_id", "item_no"), "item_no").select("item_id", "rank", "doc_id", "score")
