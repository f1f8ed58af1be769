"""Token counts without token ids (operator 8).

Each distinct pre-token of the corpus is given to the tokenizer once.  Documents are then
joined to the counts by their own pre-token frequencies: the commonest pre-tokens (a
bounded number) come as a broadcast table and are summed where the text is read, all
others are joined by shuffle, already summed by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tablewright.llm import pieces as X
from tablewright.llm import text as T
from tablewright.llm.store import settle


def count_tokens(docs: DataFrame, path: str, limit: int = 512, head: int = 100_000) -> DataFrame:
    """n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs (doc_id, text).

    path: a tokenizer file of the tokenizers library, of byte-level kind.  No begin, end
    or other token is added; its special strings inside texts count as the library counts
    them by default.  head: how many of the commonest pre-tokens are broadcast at most.

    doc_id may be of any type, and null.  Long texts are split whole, by pieces.  Null and
    empty texts have 0 bytes and 0 tokens.  Repeated rows give a row each.  An
    empty table gives no rows.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    spark, apart = docs.sparkSession, tuple(X.added_tokens(path))

    def seen(batches):
        """Distinct pre-tokens and how often each occurs, summed over up to a million at a time."""
        held: dict[str, int] = {}
        for batch in batches:
            for points, starts, hashes, _, _ in X.pretokens(batch.column(0), apart):
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                for s, k in zip(X.strings(points, starts, first), n.tolist(), strict=True):
                    held[s] = held.get(s, 0) + k
                if len(held) > 400_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["piece", "n"])
                    held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["piece", "n"])

    def sized(batches):
        for batch in batches:
            items = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(X.n_pieces(path, items), pa.int32())], ["piece", "freq", "tokens"])

    distinct = docs.select("text").mapInArrow(seen, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("freq"))
    sizes = settle(distinct.mapInArrow(sized, "piece string, freq long, tokens int"))
    # The frequency from which on at most `head` pre-tokens are left.
    tally = sizes.where("freq > 1").groupBy("freq").count().orderBy(F.desc("freq")).limit(head).collect()
    total, least = 0, None
    for freq, n in tally:
        total += n
        if total > head:
            break
        least = freq
    common = dict(sizes.where(F.col("freq") >= least).select("piece", "tokens").collect()) if least else {}
    given = spark.sparkContext.broadcast(common)

    def joined(batches):
        """A row with bytes and the tokens of common pre-tokens by document, and one for each other distinct pre-token of it."""
        counts = given.value
        shard, at = TaskContext.get().partitionId() << 40, 0
        known: dict[int, int] = {}
        for batch in batches:
            n = batch.num_rows
            _, offsets = T.raw(batch.column(1))
            own = np.zeros(n, np.int64)
            rest_row, rest_piece, rest_n = [], [], []
            for points, starts, hashes, rows, found in X.pretokens(batch.column(1), apart):
                np.add.at(own, np.asarray(found, np.int64), 1)
                if not len(hashes):
                    continue
                every = hashes.tolist()
                if len(known) > 600_000:
                    known = {}
                new = {h: k for k, h in enumerate(every) if h not in known}
                if new:
                    for h, s in zip(new, X.strings(points, starts, np.fromiter(new.values(), np.int64, len(new))), strict=True):
                        known[h] = counts.get(s, -1)
                tokens = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
                np.add.at(own, rows, np.maximum(tokens, 0))
                rare = np.flatnonzero(tokens < 0)
                if len(rare):
                    order = rare[np.lexsort((hashes[rare], rows[rare]))]
                    fresh = np.ones(len(order), bool)
                    fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]])
                    lead = np.flatnonzero(fresh)
                    rest_row.append(rows[order[lead]])
                    rest_piece += X.strings(points, starts, order[lead])
                    rest_n.append(np.diff(np.append(lead, len(order))))
            ids = batch.column(0)
            name = np.arange(at, at + n) + shard
            at += n
            row = np.concatenate([*rest_row, np.arange(n)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(name[row]),
                    pa.array(rest_piece + [f"\0a{k}" for k in name.tolist()], pa.string()),
                    pa.array(np.concatenate([*rest_n, own]).astype(np.int64)),
                    pa.concat_arrays([pa.nulls(len(row) - n, ids.type), ids]),
                    pa.array(np.concatenate([np.full(len(row) - n, -1), np.diff(offsets)]).astype(np.int64)),
                ],
                ["row", "piece", "n", "doc_id", "n_bytes"],
            )

    kind = docs.schema["doc_id"].dataType
    # Written before they are shuffled: rows are named by their place in an input partition, which a task that runs again could deal otherwise.
    rows = settle(docs.mapInArrow(joined, StructType([StructField("row", LongType()), StructField("piece", StringType()), StructField("n", LongType()), StructField("doc_id", kind), StructField("n_bytes", LongType())])))
    rest = sizes.where(F.col("freq") < least) if least else sizes
    # A row with a document's own sum has a key that is no pre-token (a NUL and a letter never share one).
    return (
        rows.join(rest.select("piece", "tokens"), "piece", "left")
        .groupBy("row")
        .agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("tokens", F.lit(1))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
