"""Incremental jobs over Structured Streaming, equal to the batch operators on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from coursemill.operators.catalog import source_key


def stream_new_entries(entries: DataFrame, path: str, checkpoint: str, watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Each source of a course once, as entries arrive, appended as Parquet. [X1]

    State holds one row per source; with a watermark (column, delay) sources older than it are forgotten.
    """
    keyed = entries.filter(F.coalesce("enabled", F.lit(True))).withColumn("source_key", source_key(F.col("source_path")))
    if watermark:
        once = keyed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["course_id", "source_key"])
    else:
        once = keyed.dropDuplicates(["course_id", "source_key"])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def study_states(sessions: DataFrame, key: list[str]) -> DataFrame:
    """Per key the number of sessions and the latest status, for a stream or a batch alike. [X2] sessions: key, ord, status."""
    return sessions.groupBy(*key).agg(F.count("*").alias("n_sessions"), F.max(F.struct("ord", "status")).alias("x")).select(*key, "n_sessions", F.col("x.status").alias("status"), F.col("x.ord").alias("last"))


def stream_study_sessions(sessions: DataFrame, key: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of study states: each batch writes the changed keys under its number, the newest number wins. [X2]

    A plain table of any keys, whose folders are not put together: `study.stream_study` numbers sessions and compacts.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return study_states(sessions, key).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(table: DataFrame, key: list[str]) -> DataFrame:
    """The newest row of each key of a table that `stream_study_sessions` wrote."""
    rest = [c for c in table.columns if c not in (*key, "batch")]
    return table.groupBy(*key).agg(F.max(F.struct("batch", *rest)).alias("x")).select(*key, *(F.col(f"x.{c}").alias(c) for c in rest))
