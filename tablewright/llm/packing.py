"""Token ids packed into rows of one length (operator 10).

Documents are tokenised once, each followed by the end id, and packed block by block with
best-fit-decreasing: the pieces of a block, longest first, each go to the open row with
the least room that still holds them.  Rows are found by a segment tree over room sizes.
A document longer than a row is cut into full rows and a rest; nothing is lost.  A block
is a bounded number of tokens of one input partition, so no shuffle and no group is
needed, and a lost task is simply done again from its input split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType

from tablewright.llm import pieces as X
from tablewright.llm.ids import is_whole
from tablewright.llm.store import with_columns

SCHEMA = "shard int, row_no long, n_tokens int, doc_ids array<{}>, parts array<int>, cu_seqlens array<int>, position_resets array<int>, ids binary"


class RoomTree:
    """For each room from 0 to the row length, the open rows with that room; finds the least room that is enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.most = [-1] * (2 * self.size)  # the largest non-empty room below a node
        self.rows: dict[int, list[int]] = {}

    def _set(self, room: int, value: int) -> None:
        node = self.size + room
        while node and self.most[node] != value:
            self.most[node] = value
            node >>= 1
            if node:
                value = max(self.most[2 * node], self.most[2 * node + 1])

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._set(room, room)

    def take(self, need: int) -> tuple[int, int] | None:
        """Takes a row with the least room of need or more: (room, row)."""
        node = self.size + need
        if self.most[node] < need:
            while node > 1 and (node & 1 or self.most[node + 1] < need):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.most[2 * node] >= need else 2 * node + 1
        room = node - self.size
        rows = self.rows[room]
        row = rows.pop()
        if not rows:
            self._set(room, -1)
        return room, row


def best_fit_decreasing(lengths, length: int) -> list[list[int]]:
    """Rows of item numbers; each row's lengths sum to length at most. Ties go by item number."""
    tree, rows = RoomTree(length), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        got = tree.take(lengths[k])
        room, row = got if got else (length, len(rows))
        if not got:
            rows.append([])
        rows[row].append(k)
        if room > lengths[k]:
            tree.add(room - lengths[k], row)
    return rows


def pack_tokens(docs: DataFrame, path: str, length: int = 2048, block_tokens: int = 1 << 21) -> DataFrame:
    """Packs all texts of docs (doc_id, text).

    path: a file of ranks of a byte-level vocabulary; the id after its largest ends each
    document and fills rows.  A result row has: shard and row_no, which name it; n_tokens
    without filling; doc_ids, and parts (0 for a document's first tokens, then 1, ...) of
    its segments; cu_seqlens, where they begin and end; position_resets, where positions
    start again at 0; ids, length little-endian ids of 2 bytes (4 if the vocabulary needs
    them).

    doc_id is of any type; doc_ids are of the same (whole numbers of 8 bytes).  Null and empty texts are a
    lone end id; a null doc_id stays null.  Long texts are tokenised by pieces.  Repeated rows are
    packed once per row.  An empty table gives no rows.  Other columns are ignored.
    """

    if is_whole(docs):
        docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def packed(batches):
        codes, shard, row_no = X.Ids(path), TaskContext.get().partitionId(), 0
        width, end = (2, np.array([codes.end], "<u2").tobytes()) if codes.code == "H" else (4, np.array([codes.end], "<u4").tobytes())
        names, parts, chunks, held = [], [], [], 0

        def emit():
            nonlocal row_no, names, parts, chunks, held
            lengths = [len(c) // width for c in chunks]
            rows = best_fit_decreasing(lengths, length)
            for a in range(0, len(rows), 512):
                some = rows[a : a + 512]
                sums = [np.cumsum([0, *(lengths[k] for k in r)]).tolist() for r in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(some), pa.int32()),
                        pa.array(range(row_no, row_no + len(some)), pa.int64()),
                        pa.array([s[-1] for s in sums], pa.int32()),
                        pa.array([[names[k] for k in r] for r in some], pa.list_(arrow)),
                        pa.array([[parts[k] for k in r] for r in some], pa.list_(pa.int32())),
                        pa.array(sums, pa.list_(pa.int32())),
                        pa.array([s[:-1] for s in sums], pa.list_(pa.int32())),
                        pa.array([b"".join(chunks[k] for k in r) + end * (length - s[-1]) for r, s in zip(some, sums, strict=True)], pa.binary()),
                    ],
                    ["shard", "row_no", "n_tokens", "doc_ids", "parts", "cu_seqlens", "position_resets", "ids"],
                )
                row_no += len(some)
            names, parts, chunks, held = [], [], [], 0

        for batch in batches:
            ids = batch.column(0).to_pylist()
            open_row, tail, part = 0, [], 0
            tail_size = 0

            def close(row, last):
                """Cuts what the row has so far; its last tokens only when it is over."""
                nonlocal tail, tail_size, part, held
                data = b"".join(tail) + (end if last else b"")
                step = length * width
                cut = len(data) if last else len(data) // step * step
                for k in range(0, cut, step):
                    chunks.append(data[k : min(k + step, cut)])
                    names.append(ids[row])
                    parts.append(part)
                    part += 1
                held += cut // width
                tail, tail_size = ([data[cut:]], len(data) - cut) if not last else ([], 0)
                if last:
                    part = 0

            for points, starts, hashes, rows, _ in X.pretokens(batch.column(1)):
                pieces = codes.joined(hashes, points, starts)
                edges = np.searchsorted(rows, np.arange(open_row, (int(rows[-1]) if len(rows) else open_row) + 2))
                for row in range(open_row, open_row + len(edges) - 1):
                    if row > open_row:
                        close(row - 1, True)
                        if held >= block_tokens:
                            yield from emit()
                    own = pieces[edges[row - open_row] : edges[row - open_row + 1]]
                    tail.append(b"".join(own))
                    tail_size += len(tail[-1])
                    if tail_size > 1 << 22:
                        close(row, False)
                open_row += len(edges) - 2
            for row in range(open_row, batch.num_rows):
                close(row, True)
            if held >= block_tokens:
                yield from emit()
        if chunks:
            yield from emit()

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(packed, SCHEMA.format(kind.simpleString()))


def unpack(row, length: int) -> dict:
    """Segments of a packed row as {(doc_id, part): ids}, with the filling left out."""
    ids = np.frombuffer(row["ids"], "<u2" if len(row["ids"]) == 2 * length else "<u4")
    cu = row["cu_seqlens"]
    return {(d, p): ids[a:b].tolist() for d, p, a, b in zip(row["doc_ids"], row["parts"], cu[:-1], cu[1:], strict=True)}


def write_packed(packed: DataFrame, path: str, length: int) -> None:
    """Writes packed rows as Parquet with the positions filled in: each segment's count from 0, as 4-byte ids."""

    def positioned(batches):
        for batch in batches:
            out = []
            for cu in batch.column("cu_seqlens").to_pylist():
                lengths = np.diff(cu + [length]) if cu[-1] < length else np.diff(cu)
                out.append(np.concatenate([np.arange(n, dtype="<u4") for n in lengths]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "positions"])

    packed.mapInArrow(positioned, with_columns(packed.schema, ("positions", BinaryType()))).write.parquet(path)
