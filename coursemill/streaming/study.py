"""Study sessions as a stream: numbered sessions, the state of every topic and of every student, kept between batches.

Each batch reads the state of the keys that it touches, writes its sessions with their numbers and the new state rows as
a folder of its own, and every so many batches the folders are put together, so that their number is bounded. A batch that
is run again reads the state before it and writes the same folder. IDs in brackets are those of the operator inventory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from coursemill.sources.tiles import Tiles

KEY = ["course_id", "unit_slug", "topic_slug"]
#: Sessions that a student's state lists at most, newest first (a parameter of the state, as of its budget of tokens).
RECENT = 10
SESSIONS = "course_id string, unit_slug string, topic_slug string, ord long, status string, date string, next_topic string, session long"
TOPICS = "course_id string, unit_slug string, topic_slug string, status string, n_sessions long, last long"
STUDENTS = "course_id string, active struct<unit_slug:string,topic_slug:string,status:string,sessions:bigint,file:string>, recent array<struct<topic_slug:string,unit_slug:string,date:string>>, next_topic string, updated string"


def numbered(sessions: DataFrame, topics: DataFrame) -> DataFrame:
    """Sessions with their number in their topic, which goes on from what the topics' state holds. [X2]

    sessions: KEY, ord (order of arrival), status, date, next_topic; topics: KEY, n_sessions.
    """
    touched = topics.join(sessions.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "n_sessions")
    n = F.row_number().over(W.partitionBy(*KEY).orderBy("ord", "date", "status", "next_topic"))
    out = sessions.withColumn("__n", n).join(touched, KEY, "left").withColumn("session", (F.coalesce("n_sessions", F.lit(0)) + F.col("__n")).cast("long"))
    return out.select(*KEY, F.col("ord").cast("long").alias("ord"), "status", "date", "next_topic", "session")


def topic_states(found: DataFrame) -> DataFrame:
    """The state of the topics of numbered sessions: status of the newest, number, place in the order of arrival. [X2]"""
    return found.groupBy(*KEY).agg(F.max_by("status", "session").alias("status"), F.max("session").alias("n_sessions"), F.max("ord").alias("last"))


def student_states(found: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The state of the students of numbered sessions: the active topic with its number of sessions and file, the newest
    sessions, the next topic (the newest that one names) and the day; what is older comes from `before`. [X2]"""
    order = F.struct("ord", "unit_slug", "topic_slug", "session")
    file = F.format_string("student/batteries/%s/%s.md", "unit_slug", "topic_slug")
    active = F.struct("unit_slug", "topic_slug", "status", F.col("session").alias("sessions"), file.alias("file"))
    newest = F.struct(order.alias("o"), F.struct("topic_slug", "unit_slug", "date").alias("s"))
    # the newest few of each task's rows are enough: a rank per student before anything is gathered
    rank = F.row_number().over(W.partitionBy("course_id").orderBy(F.desc("ord"), F.desc("unit_slug"), F.desc("topic_slug"), F.desc("session")))
    lists = found.withColumn("__k", rank).filter(F.col("__k") <= RECENT).groupBy("course_id").agg(F.transform(F.reverse(F.array_sort(F.collect_list(newest))), lambda x: x["s"]).alias("recent"))
    named = F.when(F.coalesce("next_topic", F.lit("")) != "", order)
    now = found.groupBy("course_id").agg(F.max_by(active, order).alias("active"), F.max_by("next_topic", named).alias("next_topic"), F.max_by("date", order).alias("updated")).join(lists, "course_id")
    if before is not None:
        old = before.join(now.select("course_id"), "course_id", "left_semi").select("course_id", F.col("recent").alias("__recent"), F.col("next_topic").alias("__next"))
        now = now.join(old, "course_id", "left").withColumns({"recent": F.slice(F.concat("recent", F.coalesce("__recent", F.slice("recent", 1, 0))), 1, RECENT), "next_topic": F.coalesce("next_topic", "__next")})
    return now.select("course_id", "active", "recent", "next_topic", "updated")


def newest(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row of each key in its newest folder."""
    rest = [c for c in rows.columns if c not in (*key, "tile")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "tile").alias("x")).select(*key, *(F.col(f"x.{c}").alias(c) for c in rest))


def read_sessions(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    return Tiles(spark, f"{path}/sessions").read(SESSIONS, upto).drop("tile")


def read_topics(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    return newest(Tiles(spark, f"{path}/topics").read(TOPICS, upto), KEY)


def read_students(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    return newest(Tiles(spark, f"{path}/students").read(STUDENTS, upto), ["course_id"])


def stream_study(sessions: DataFrame, path: str, checkpoint: str, every: int = 8) -> StreamingQuery:
    """Keeps sessions, topics and students below `path`, whatever the batches; every `every` batches their folders become
    one. There are never more than 2 * every + 1 folders of each. [X2]"""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables = {n: Tiles(spark, f"{path}/{n}") for n in ("sessions", "topics", "students")}
        one = f"{number}-{number}"
        tables["sessions"].write(numbered(batch, read_topics(spark, path, number - 1)), one)
        found = spark.read.schema(SESSIONS).parquet(f"{path}/sessions/{one}")
        tables["topics"].write(topic_states(found), one)
        tables["students"].write(student_states(found, read_students(spark, path, number - 1)), one)
        if (number + 1) % every == 0:
            whole = {"sessions": read_sessions, "topics": read_topics, "students": read_students}
            for name, tiles in tables.items():
                tiles.write(whole[name](spark, path, number), f"0-{number}")
                tiles.forget(number - every + 1)  # a batch that is run again finds the folders before it

    return sessions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
