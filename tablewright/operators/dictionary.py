"""Many names in many texts: one scan of the texts by an automaton of the names.

Names are cut into parts of bounded size.  Each part is sent once to every worker, which builds its automaton
once and scans its texts with it, in time that does not depend on the number of names; so texts are read as often
as there are parts, and no text is ever compared with a name.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of names in a part; an automaton takes some fifty times as much.
PART_BYTES = 4 << 20


@functools.lru_cache(maxsize=2)
def _automaton(names):
    """The automaton of a part, made once in each Python worker."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, name in enumerate(names.value):
        out.add_word(name, k)
    out.make_automaton()
    return out


class _Names:
    """A broadcast list of names that is told apart by its number, so that a worker finds its automaton again."""

    def __init__(self, sent):
        self.sent, self.number = sent, sent._jbroadcast.id()

    def __reduce__(self):
        return _names, (self.sent, self.number)

    def __hash__(self):
        return hash(self.number)

    def __eq__(self, other):
        return self.number == other.number

    @property
    def value(self):
        return self.sent.value


def _names(sent, number):
    out = object.__new__(_Names)
    out.sent, out.number = sent, number
    return out


def found_names(texts: DataFrame, keys: list[str], text: str, names: DataFrame, name: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(keys..., name): every name that a text contains anywhere, once a row of texts.

    Names are taken as they are, each once; null and empty ones are in no text, a null text has none.  Texts are scanned whole.  Rows of
    equal keys give a row each; keys should tell texts apart.  A name longer than a part is a part of its own.  Either table may be empty.
    """
    spark = texts.sparkSession
    distinct = names.select(F.col(name).cast("string").alias("name")).where("name <> ''").distinct()
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    parts = -(-total // part_bytes)
    rows = texts.select(*keys, F.col(text).cast("string").alias("__text")).where("__text <> ''")
    schema = StructType([*(StructField(k, rows.schema[k].dataType) for k in keys), StructField("name", StringType())])
    out = spark.createDataFrame([], schema)
    for part in range(parts):
        own = [r["name"] for r in distinct.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).collect()]
        if not own:
            continue
        sent = _Names(spark.sparkContext.broadcast(own))

        def scanned(batches, sent=sent):
            machine = _automaton(sent)
            known = sent.value
            for batch in batches:
                at, hits = [], []
                for row, body in enumerate(batch.column("__text")):
                    found = {k for _, k in machine.iter(body.as_py())}
                    at += [row] * len(found)
                    hits += [known[k] for k in found]
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), pa.array(hits, pa.string())], [*keys, "name"])

        out = out.unionByName(rows.mapInArrow(scanned, schema))
    return out
