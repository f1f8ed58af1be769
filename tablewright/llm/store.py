"""Results written once to the shared folder, and schemas for Arrow functions."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

GROUP_BYTES = 16 << 20
#: Spark's switch to drop an execution's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder where that is unset on one machine, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def cleaning(spark: SparkSession):
    """Executions inside drop their shuffle files when they end."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def write(df: DataFrame, path: str) -> DataFrame:
    """The rows written to path as Parquet and read from there; the shuffle files that made them are dropped."""
    with cleaning(df.sparkSession):
        # Small row groups: a writer holds one in memory.
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """The rows written once to a new table in the shared folder, and read from there: a cut of the lineage that outlives executors."""
    return write(df, f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}")


def release(df: DataFrame) -> None:
    """Empties the table of a settled frame that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("settled-"):
            spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)


def with_columns(schema: StructType, *added: tuple) -> StructType:
    """A schema, all of it nullable, with further (name, type) columns."""
    return StructType([*(StructField(f.name, f.dataType) for f in schema.fields), *(StructField(n, t) for n, t in added)])
