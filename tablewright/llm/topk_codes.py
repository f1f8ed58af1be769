"""Exact top-k search over binary codes (operator 1).

Incremental multi-index hashing.  Codes are cut into segments; if two codes differ in r
bits, some segment differs in r // m bits or fewer.  A query looks up its segments with
growing radius, one segment after the other, verifies whole distances, and stops when its
k-th distance is covered: after radius s in segments 0 to j and s - 1 in the others, no
code within m * s + j bits is missing.

The index is blocks of distinct codes, each with its least ids; the stated queries are cut
into chunks.  Every cell of a block and a chunk is a task: it makes the block's tables once
and answers its queries, and answers of the blocks are merged.  Nothing comes to the driver
but counts.  Small tables are one block and many chunks, so that all cores have work.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.store import settle

BLOCK_CODES, QUERY_CHUNK, LEAST_CHUNK = 1 << 20, 1 << 18, 64


def sign_codes(vectors: DataFrame, bits: int) -> DataFrame:
    """id and code (a bit per number: 1 above 0) of rows (id, vector); vectors has these two columns only, of any names.

    Rows without an id, or whose vector is null or of another length, have none.  Null
    numbers and NaN count as 0.  Repeated rows give a row each; an empty table none.
    """

    def packed(batches):
        for batch in batches:
            lists = batch.column(1)
            at = np.asarray(lists.offsets)
            ok = np.flatnonzero((np.diff(at) == bits) & ~np.asarray(lists.is_null()))
            values = lists.values.fill_null(0).to_numpy(zero_copy_only=False)
            rows = values[at[ok][:, None] + np.arange(bits)] if len(ok) else np.zeros((0, bits))
            codes = np.packbits(np.nan_to_num(rows) > 0, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    return vectors.toDF("id", "vector").select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).where("id is not null").mapInArrow(packed, "id long, code binary")


@functools.cache
def _masks(width: int, s: int) -> np.ndarray:
    """All numbers of so many bits that have s set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), s)], np.int64)


class Index:
    """Segment tables of a block of codes."""

    def __init__(self, codes: list[bytes], ids: list[list[int]], width: int = 16):
        raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        self.bits, self.rows = raw.shape[1] * 8, raw
        self.flat = np.array([i for x in ids for i in x], np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        # Segments about as wide as the logarithm of the number of codes, 8 or 16 bits.
        step = 2 if width >= 16 and len(codes) > 4096 and raw.shape[1] % 2 == 0 else 1
        self.width, self.m = 8 * step, raw.shape[1] // step
        self.segments = self._cut(raw)
        self.tables = []
        for j in range(self.m):
            order = np.argsort(self.segments[:, j], kind="stable")
            self.tables.append((order, np.searchsorted(self.segments[order, j], np.arange((1 << self.width) + 1))))

    def _cut(self, raw: np.ndarray) -> np.ndarray:
        raw = raw.astype(np.int64)
        return raw if self.width == 8 else raw[:, ::2] << 8 | raw[:, 1::2]

    def search(self, query: bytes, k: int) -> list[tuple[int, int]]:
        """The k least (distance, id)."""
        q = np.frombuffer(query, np.uint8)
        parts = self._cut(q[None, :])[0]
        seen = np.zeros(len(self.rows), bool)
        best: list[tuple[int, int]] = []
        for s in range(self.width + 1):
            masks = _masks(self.width, s)
            for j in range(self.m):
                order, starts = self.tables[j]
                keys = parts[j] ^ masks
                a, b = starts[keys], starts[keys + 1]
                size = b - a
                if size.any():
                    a, size = a[size > 0], size[size > 0]
                    place = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    new = order[place]
                    new = new[~seen[new]]
                    seen[new] = True
                    away = np.bitwise_count(self.rows[new] ^ q).sum(1)
                    if len(best) >= k:
                        near = away <= best[-1][0]
                        new, away = new[near], away[near]
                    for c, d in zip(new.tolist(), away.tolist(), strict=True):
                        best += [(d, i) for i in self.flat[self.at[c] : self.at[c + 1]].tolist()]
                    best = sorted(best)[:k]
                if len(best) >= k and best[-1][0] <= self.m * s + j:
                    return best
        return best


def _answers(k: int):
    """A function from a cell's codes and queries to the queries' answers."""

    def answered(codes: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if codes.num_rows and queries.num_rows:
            index = Index([bytes(x) for x in codes.column("code").to_pylist()], codes.column("ids").to_pylist())
            out = [(q, d, i) for q in queries.column("code").to_pylist() for d, i in index.search(q, k)]
        return pa.table([pa.array([x[t] for x in out], kind) for t, kind in enumerate((pa.binary(), pa.int32(), pa.int64()))], ["code", "distance", "neighbor_id"])

    return answered


def search(codes: DataFrame, queries: DataFrame, k: int = 10, block_codes: int = BLOCK_CODES, query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """query_id, rank (from 1), neighbor_id and distance: for each query the k rows of codes with the least (distance, id).

    codes and queries: id, code (of one length in bytes); other columns are ignored, so their
    names cannot clash.  A row that is also a query is its own neighbour.  Fewer than k rows
    give fewer neighbours; an empty table none.  Null ids and codes are left out.  Repeated
    rows (one id and code) count once.
    """
    spark = codes.sparkSession
    codes = codes.where("id is not null and code is not null").select("id", "code").distinct()
    order = Window.partitionBy("code").orderBy("id")
    kept = codes.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    distinct = settle(kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    queries = settle(queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), "code").distinct())
    wanted = settle(queries.select("code").distinct())
    blocks, n = max(1, math.ceil(distinct.count() / block_codes)), wanted.count()
    idle = math.ceil(2 * spark.sparkContext.defaultParallelism / blocks)
    chunks = max(1, math.ceil(n / query_chunk), min(idle, math.ceil(n / LEAST_CHUNK)))
    cells = blocks * chunks
    numbers = lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    left = distinct.withColumn("block", F.pmod(F.xxhash64(F.lit(7), F.col("code")), F.lit(blocks)).cast("int")).withColumn("chunk", numbers(chunks))
    right = wanted.withColumn("chunk", F.pmod(F.xxhash64(F.col("code")), F.lit(chunks)).cast("int")).withColumn("block", numbers(blocks))
    # A count of its own, so that cells are not put together in few tasks; three for each, as some get two cells.
    side = lambda df: df.repartition(min(3 * cells, max(cells, 100_000)), "block", "chunk").groupBy("block", "chunk")
    found = side(left).cogroup(side(right)).applyInArrow(_answers(k), "code binary, distance int, neighbor_id long")
    rank = Window.partitionBy("code").orderBy("distance", "neighbor_id")
    top = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    lists = top.groupBy("code").agg(F.collect_list(F.struct("rank", "neighbor_id", "distance")).alias("near"))
    return queries.join(lists, "code").select("query_id", F.explode("near").alias("x")).select("query_id", F.col("x.rank").alias("rank"), F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.distance").alias("distance"))
