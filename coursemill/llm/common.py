"""Shared pieces of the operators: the scratch folder, staged tables and typed columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType

#: Rows of one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 2000


def scratch(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables: spark.checkpoint.dir, or the checkpoint folder that was set.

    Where both are unset, a session on one machine (tests) gets a folder of our own; on a cluster, whose executors
    could not read it, that is an error.
    """
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: its lineage ends there."""
    path = f"{scratch(df.sparkSession)}/coursemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows for the session's next queries; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Rows of one key that `spread_join` leaves together at least, and its most hot keys.
TOGETHER, HOT_KEYS = 500, 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join (inner, or left by `how`) of `left`, of which one key may hold most rows, with `right`, which has one row a key.

    A key with more than a thousandth of the rows of `left` is hot; there are fewer than HOT_KEYS of them, so they are
    broadcast. Their rows are dealt over several tasks by a hash of `by`, and their row of `right` is sent to each.
    Rows are counted in `left`, or in `counted`, a table with as many rows of each key: give it a staged one.
    """
    counted = left if counted is None else counted
    most = max(TOGETHER, counted.count() // HOT_KEYS)
    hot = F.broadcast(counted.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("__parts")).filter("__parts > 1"))
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    dealt = left.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(by), parts)).drop("__parts")
    sent = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return dealt.join(sent, [*keys, "__salt"], how).drop("__salt")


def filter_bits(keys: DataFrame, bit: Column) -> DataFrame:
    """A table (w, bits) of the 64-bit words of a bit set that holds `bit` of each row."""
    return keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))


def packed(words: DataFrame, size: int) -> np.ndarray:
    """The bit set of `filter_bits` as an array of 64-bit words."""
    got = words.toPandas()
    held = np.zeros(size // 64, dtype=np.int64)
    held[got["w"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return held


def kind(df: DataFrame, column: str) -> str:
    """A column's type as DDL."""
    of: DataType = df.schema[column].dataType
    return of.simpleString()


def binary_column(data: bytes, offsets) -> pa.Array:
    """A binary column from its bytes and the n + 1 offsets of the rows."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(data)])
