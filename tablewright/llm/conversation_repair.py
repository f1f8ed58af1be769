"""Cheapest repair of a conversation's structure (operator 12).

A conversation is a path through a graph whose nodes are (rows read, state of the wanted
pattern of roles) and whose arcs are edits with small whole costs: keep, change the role,
delete, insert.  Dial's algorithm (an array of buckets by distance in place of a heap)
records every node's distance to the end; a walk from the start along tight arcs, least
letter first, then gives the cheapest edits, and of equally cheap ones the least in order.

Rows are sorted by range of (conversation, turn), so a conversation is a run within one
partition or a few.  Runs are cut into segments of bounded size.  Nearly all conversations
are one whole segment and are repaired where they lie.  Of the others each segment gives the
costs between its ends for all pairs of states; these few numbers are combined backwards to
distances, and the walk's ends forwards to starts, and then all segments are repaired in
parallel, each under its own distances and start.  So a conversation of any length is
neither held nor walked in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tablewright.llm.store import settle

SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SPACES = " \t\n\x0b\x0c\r"

#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role of a changed or inserted row, and the state after it.
_NEW = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
_FAR = 1 << 62
#: After the last row: what each state still costs, and the rows inserted for that.
_REST = [0, 2 * INSERT, INSERT, 0]
SOUND, WRONG, CUT = range(3)


def _arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """By state: (letter, state after, cost) of the edits of a row, least letter first; I does not use the row up."""
    initial, fault = "sua?"[code // 3], code % 3
    more = TRUNCATED if fault == CUT else 0
    out = []
    for state in range(4):
        arcs = [("D", state, DELETE), ("I", _NEW[state][1], INSERT)]
        if fault != WRONG:
            if (state, initial) in _NEXT:
                arcs.append(("K", _NEXT[state, initial], more))
            arcs.append(("R", _NEW[state][1], REROLE + more))
        out.append(arcs)
    return out


_ARCS = [_arcs(code) for code in range(12)]
#: By row code and state after it: (state before, cost); and the same of an insertion.
_BACK = [[[(s, c) for s in range(4) for letter, t, c in arcs[s] if t == to and letter != "I"] for to in range(4)] for arcs in _ARCS]
_INSERTED = [[s for s in range(4) if _NEW[s][1] == to] for to in range(4)]


def row_code(role: str, wrong: bool, truncated: bool) -> int:
    """What the graph has to know of a row."""
    return 3 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + (WRONG if wrong else CUT if truncated else SOUND)


def distances(codes: bytes, ahead: list[int]) -> list[int]:
    """The cost from every node (4 * rows read + state) to the end; ahead: the costs after the last row, by state."""
    n = len(codes)
    out = [_FAR] * (4 * n + 4)
    least = min(ahead)
    buckets: list[list[int]] = [[]]
    for s, d in enumerate(ahead):
        if d < _FAR:
            while len(buckets) <= d - least:
                buckets.append([])
            buckets[d - least].append(4 * n + s)
            out[4 * n + s] = d
    d = 0
    while d < len(buckets):
        at = d + least
        for node in buckets[d]:  # grows by arcs of no cost
            if out[node] != at:
                continue  # reached cheaper since
            i, state = divmod(node, 4)
            near = [(node - state + s, at + INSERT) for s in _INSERTED[state]] if i < n else []
            if i:
                near += [(node - state - 4 + s, at + c) for s, c in _BACK[codes[i - 1]][state]]
            for to, cost in near:
                if cost < out[to]:
                    out[to] = cost
                    while len(buckets) <= cost - least:
                        buckets.append([])
                    buckets[cost - least].append(to)
        buckets[d] = []
        d += 1
    return out


def walk(codes: bytes, costs: list[int], state: int) -> tuple[str, int]:
    """The letters of the cheapest edits from a state, least in order, and the state after the last row."""
    i, letters, n = 0, [], len(codes)
    while i < n:
        for letter, to, cost in _ARCS[codes[i]][state]:
            j = i + (letter != "I")
            if costs[4 * i + state] == cost + costs[4 * j + to]:
                letters.append(letter)
                i, state = j, to
                break
    return "".join(letters), state


def _rest(state: int) -> str:
    """The letters after the last row."""
    return "I" * (_REST[state] // INSERT)


def _turns(letters: str, roles: list[str], texts: list[str], state: int) -> list[dict]:
    """The rows that the edits leave."""
    out, i = [], 0
    for letter in letters:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            role, state = roles[i], _NEXT[state, roles[i][0]]
        else:
            role, state = _NEW[state]
        out.append({"role": role, "text": "" if letter == "I" else texts[i]})
        i += letter != "I"
    return out


def _key(role: str, text: str) -> bytes:
    """Equal for rows of equal role and text (128 bits of BLAKE2b: a clash is not to be expected in any corpus)."""
    body = role.encode()
    return hashlib.blake2b(len(body).to_bytes(8, "little") + body + text.encode(), digest_size=16).digest()


def _codes(roles: list[str], texts: list[str], earlier: list[bytes] | None = None) -> tuple[bytes, dict]:
    """Row codes of a segment and its numbers of faults; earlier: keys of rows that earlier segments have, None if there are none."""
    seen = set(earlier or ())
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    codes, before = bytearray(), None
    for role, text in zip(roles, texts, strict=True):
        rest = text.rstrip(SPACES)
        key = (role, text) if earlier is None else _key(role, text)
        fault = "blank" if not rest else "duplicate" if key in seen else "truncated" if rest[-1] not in ".!?" else None
        seen.add(key)
        if fault:
            counts[fault] += 1
        if before is not None and before + role[:1] not in ("su", "ua", "au"):
            counts["illegal"] += 1
        before = role[:1]
        codes.append(row_code(role, fault in ("blank", "duplicate"), fault == "truncated"))
    return bytes(codes), counts


_TURNS = ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())]))
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_SPAN = ["least_turn", "most_turn", "distinct_turns"]


def _schema(conv: StructField, *more: tuple) -> StructType:
    return StructType([StructField("conv_id", conv.dataType), StructField("part", IntegerType()), StructField("seq", LongType()), *(StructField(n, t) for n, t in more)])


def _batches(rows: Iterable[dict], schema: StructType, size=lambda row: 1, most: int = SEGMENT_BYTES):
    """Rows as Arrow batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held, total = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 64
        if total > most:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _rows(batches, step: int = 512):
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            yield from batch.slice(a, step).to_pylist()


def _map(df: DataFrame, function, schema: StructType, size=lambda row: 1) -> DataFrame:
    """A function over the stream of a partition's rows, as dictionaries."""
    return df.mapInArrow(lambda batches: _batches(function(_rows(batches)), schema, size), schema)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and dropped of rows damaged by crc32("conv_id:turn") modulo 20.

    0 marks the row as dropped (it stays, so that its conversation stays known), 1 empties its
    text, 2 removes . ! and ? from it, 3 gives the row twice, 4 makes its role user.  A null
    counts as one blank in the sum, as a role and as a text; conv_id and turn stay null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("kind")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("dropped"))


def _segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Runs of a conversation's rows, in order: (part, seq) orders all segments; whole: the run is the conversation."""
    conv = rows.schema["conv_id"]
    strings = ArrayType(StringType())
    schema = _schema(conv, ("roles", strings), ("texts", strings), ("whole", BooleanType()), *((c, LongType()) for c in _SPAN))

    def cut(stream):
        part, seq, held, last = TaskContext.get().partitionId(), 0, None, None

        def opened(row, whole):
            return {"conv_id": row["conv_id"], "part": part, "seq": seq, "roles": [], "texts": [], "whole": whole, "least_turn": None, "most_turn": None, "distinct_turns": 0, "size": 0}

        for row in stream:
            if held is None or row["conv_id"] != held["conv_id"]:
                if held is not None:
                    yield held  # ends before the partition does
                    seq += 1
                held, last = opened(row, held is not None), None
            elif len(held["roles"]) >= segment_rows or held["size"] > SEGMENT_BYTES:
                yield held | {"whole": False}
                seq += 1
                held, last = opened(row, False), None
            if not row["dropped"]:
                held["roles"].append(row["role"])
                held["texts"].append(row["text"])
                held["size"] += len(row["text"])
                if (turn := row["turn"]) is not None:
                    if held["least_turn"] is None:
                        held["least_turn"] = turn
                    held["most_turn"] = turn
                    if turn != last:
                        held["distinct_turns"] += 1
                    last = turn
        if held is not None:
            yield held | {"whole": False}  # may go on in the next partition

    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text", "copy")
    return _map(ordered, cut, schema, lambda x: x["size"])


def _stream(df: DataFrame, forward: bool, function, schema: StructType) -> DataFrame:
    """A function over the segments of a conversation in order, or from the last; segments are small rows here, and only a state is carried."""
    order = [F.col("conv_id"), *(F.col(c) if forward else F.col(c).desc() for c in ("part", "seq"))]
    return _map(df.repartition("conv_id").sortWithinPartitions(*order), function, schema)


def _placed(open_segments: DataFrame) -> DataFrame:
    """part, seq, codes, ahead, start and last of segments that are not known to be whole conversations."""
    conv = open_segments.schema["conv_id"]
    longs = ArrayType(LongType())
    keys = _map(open_segments, lambda s: ({**{c: x[c] for c in ("conv_id", "part", "seq")}, "key": k} for x in s for k in {_key(r, t) for r, t in zip(x["roles"], x["texts"], strict=True)}), _schema(conv, ("key", BinaryType())))
    first = keys.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))
    earlier = keys.join(first, same).where(F.struct("part", "seq") > F.col("first")).groupBy("part", "seq").agg(F.collect_list("key").alias("earlier"))

    def measured(stream):
        for x in stream:
            codes, counts = _codes(x["roles"], x["texts"], x["earlier"] or [])
            costs = [distances(codes, [0 if s == e else _FAR for s in range(4)])[:4] for e in range(4)]
            yield {c: x[c] for c in ("conv_id", "part", "seq")} | {"codes": codes, "costs": [costs[e][s] for s in range(4) for e in range(4)]} | {"counts": [counts[c] for c in _COUNTS]}

    schema = _schema(conv, ("codes", BinaryType()), ("costs", longs), ("counts", longs))
    segments = settle(_map(open_segments.join(earlier, ["part", "seq"], "left").select(*open_segments.columns, "earlier"), measured, schema))

    def backwards(stream):
        conv_id, ahead = None, None
        for x in stream:
            last = ahead is None or x["conv_id"] != conv_id
            if last:
                conv_id, ahead = x["conv_id"], _REST
            yield {c: x[c] for c in ("conv_id", "part", "seq", "codes")} | {"ahead": ahead, "last": last}
            ahead = [min(_FAR, *(x["costs"][4 * s + e] + ahead[e] for e in range(4))) for s in range(4)]

    schema = _schema(conv, ("codes", BinaryType()), ("ahead", longs), ("last", BooleanType()))
    after = _stream(segments, False, backwards, schema).repartition("part", "seq")

    def ended(stream):
        for x in stream:
            costs = distances(x["codes"], x["ahead"])
            yield {c: x[c] for c in ("conv_id", "part", "seq", "ahead", "last")} | {"ends": [walk(x["codes"], costs, s)[1] for s in range(4)]}

    schema = _schema(conv, ("ahead", longs), ("last", BooleanType()), ("ends", longs))
    ends = _map(after, ended, schema)

    def forwards(stream):
        conv_id, state = None, None
        for x in stream:
            first = state is None or x["conv_id"] != conv_id
            if first:
                conv_id, state = x["conv_id"], BEGIN
            yield {c: x[c] for c in ("conv_id", "part", "seq", "ahead", "last")} | {"start": state}
            state = x["ends"][state]

    schema = _schema(conv, ("ahead", longs), ("last", BooleanType()), ("start", IntegerType()))
    return segments.join(_stream(ends, True, forwards, schema).drop("conv_id"), ["part", "seq"]).select("part", "seq", "codes", "counts", "ahead", "start", "last")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The repaired turns and the audit of every conversation, in segments.

    rows: conv_id, turn, role, text, and copy and dropped as `damage` gives them.  One row
    for each segment, in the order of part and seq: conv_id, part, seq, n_rows, least_turn, most_turn, distinct_turns (nulls
    left out), first and final initial, whole (no further segments), blank, duplicate, truncated, illegal (within the segment), cost, audit (letters of edits) and turns
    (role and text of what is left).  A conversation of up to `segment_rows` rows is one segment, unless a partition ends in it.

    Null roles and texts are to be filled before (`damage` does).  Turns that are null come first;
    rows of one turn go by role and text, so repeats are adjacent and each but the first is a
    duplicate.  A conversation whose rows are all dropped has one segment without rows; a null conv_id
    is a conversation; ids may be of any type that can be sorted.  A text longer than a segment's bytes is a segment of its own.  An empty table gives
    no rows; further columns are left out.
    """
    segments = settle(_segments(rows.select("conv_id", "turn", "role", "text", "copy", "dropped"), segment_rows))
    conv = segments.schema["conv_id"]
    texts = StringType()
    schema = _schema(
        conv, ("n_rows", LongType()), *((c, LongType()) for c in _SPAN), ("first", texts), ("final", texts), ("whole", BooleanType()), *((c, LongType()) for c in _COUNTS), ("cost", LongType()), ("audit", texts), ("turns", _TURNS)
    )

    def repaired(stream):
        for x in stream:
            if x["codes"] is None:  # a whole conversation
                codes, counts = _codes(x["roles"], x["texts"])
                ahead, state, last = _REST, BEGIN, True
            else:
                codes, counts, ahead, state, last = x["codes"], dict(zip(_COUNTS, x["counts"], strict=True)), x["ahead"], x["start"], x["last"]
            costs = distances(codes, ahead)
            letters, end = walk(codes, costs, state)
            cost = costs[state] - ahead[end]
            if last:
                letters, cost = letters + _rest(end), cost + _REST[end]
            out = {c: x[c] for c in ("conv_id", "part", "seq", "whole", *_SPAN)} | counts
            yield out | {
                "n_rows": len(codes), "first": x["roles"][0][:1] if codes else None, "final": x["roles"][-1][:1] if codes else None, "cost": cost, "audit": letters, "turns": _turns(letters, x["roles"], x["texts"], state),
            }

    size = lambda row: sum(len(t["text"]) + 32 for t in row["turns"])
    none = {"codes": "binary", "counts": "array<long>", "ahead": "array<long>", "start": "int", "last": "boolean"}
    whole = segments.where("whole").select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    parted = segments.where("not whole")
    parted = parted.join(_placed(parted), ["part", "seq"]).select(*whole.columns)
    return _map(whole, repaired, schema, size).unionByName(_map(parted, repaired, schema, size))


def summarise(segments: DataFrame) -> DataFrame:
    """Per conversation of `repair`: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    The digest is that of the repaired "role:text", joined by newlines.  A hash goes over a text
    in order, so a conversation's text streams through one task, held a segment at a time.
    """
    conv = segments.schema["conv_id"]
    schema = StructType([StructField("conv_id", conv.dataType), *(StructField(c, LongType()) for c in ("gaps", *_COUNTS, "cost")), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")

    def merged(stream):
        def row():
            return {"conv_id": conv_id, "gaps": most - least + 1 - distinct if least is not None else 0, **sums, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        conv_id, digest = None, None
        for x in stream:
            if digest is None or x["conv_id"] != conv_id:
                if digest is not None:
                    yield row()
                conv_id, digest, audit, least, most, distinct, final, some = x["conv_id"], hashlib.sha256(), [], None, None, 0, None, False
                sums = dict.fromkeys((*_COUNTS, "cost"), 0)
            for c in sums:
                sums[c] += x[c]
            if x["n_rows"]:
                if final is not None and final + x["first"] not in ("su", "ua", "au"):
                    sums["illegal"] += 1
                final = x["final"]
            if x["least_turn"] is not None:
                distinct += x["distinct_turns"] - (most == x["least_turn"])
                least, most = x["least_turn"] if least is None else least, x["most_turn"]
            audit.append(x["audit"])
            if x["n_turns"]:
                digest.update(("\n" if some else "").encode() + x["body"].encode())
                some = True
        if digest is not None:
            yield row()

    rows = segments.withColumns({"body": line, "n_turns": F.size("turns")}).drop("turns")
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("distinct_turns"), F.lit(0)).cast("long")
    one = rows.where("whole").select("conv_id", gaps.alias("gaps"), *_COUNTS, "cost", "audit", F.sha2("body", 256).alias("repaired_sha256"))
    more = rows.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return one.unionByName(_map(more, merged, schema, lambda r: len(r["audit"])))
