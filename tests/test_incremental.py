"""Incremental builds and study streams: runs in parts give what one run over everything gives."""

import random

from pyspark.sql import functions as F

from coursemill.plans import incremental
from coursemill.sources.tiles import Tiles
from coursemill.streaming import study


def entries(spark, rows):
    return spark.createDataFrame(rows, "course_id string, entry_id int, title string")


def listed(parts):
    named = F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "title"))), lambda x: x["title"])
    return parts["entries"].join(parts["topics"], "course_id", "left").groupBy("course_id", "label").agg(F.array_join(named, ",").alias("titles"))


def test_one_course_is_built_again(spark, tmp_path):
    built = []

    def build(parts):
        built.append(sorted(r.course_id for r in parts["entries"].select("course_id").distinct().collect()))
        return listed(parts)

    topics = spark.createDataFrame([("a", "x"), ("b", "y")], "course_id string, label string")
    rows = [("a", 1, "one"), ("b", 2, "two"), ("c", 3, None), (None, 4, "lost")]
    root = str(tmp_path / "build")
    assert incremental.run(spark, root, {"entries": entries(spark, rows), "topics": topics}, build) == 1
    more = [*rows, ("b", 5, "three")]
    assert incremental.run(spark, root, {"entries": entries(spark, more), "topics": topics}, build) == 2
    assert built == [["a", "b", "c"], ["b"]]
    got = {(r.course_id, r.label, r.titles): r.version for r in incremental.read(spark, root).collect()}
    assert got == {("a", "x", "one"): 1, ("b", "y", "two,three"): 2, ("c", None, ""): 1}
    full = {(r.course_id, r.label, r.titles) for r in listed({"entries": entries(spark, more).filter("course_id is not null"), "topics": topics}).collect()}
    assert set(got) == full
    # the same entries in another order change nothing; a change of topics does; a course without input goes
    assert incremental.run(spark, root, {"entries": entries(spark, more[::-1]), "topics": topics}, build) == 3 and len(built) == 2
    incremental.run(spark, root, {"entries": entries(spark, more[1:]), "topics": topics.withColumn("label", F.upper("label"))}, build)
    assert built[2:] == [["b"]]
    assert {(r.course_id, r.version) for r in incremental.read(spark, root).collect()} == {("b", 4), ("c", 1)}
    incremental.vacuum(spark, root, keep=1)
    assert {(r.course_id, r.version) for r in incremental.read(spark, root).collect()} == {("b", 4), ("c", 1)}


def test_half_a_build_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "build")
    topics = spark.createDataFrame([("a", "x")], "course_id string, label string")
    incremental.run(spark, root, {"entries": entries(spark, [("a", 1, "one")]), "topics": topics}, listed)

    def fails(parts):
        raise RuntimeError("lost")

    try:
        incremental.run(spark, root, {"entries": entries(spark, [("a", 1, "other")]), "topics": topics}, fails)
    except RuntimeError:
        pass
    assert [r.titles for r in incremental.read(spark, root).collect()] == ["one"]
    assert incremental.run(spark, root, {"entries": entries(spark, [("a", 1, "other")]), "topics": topics}, listed) == 2
    assert [r.titles for r in incremental.read(spark, root).collect()] == ["other"]


def test_study_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"u{rng.randint(0, 1)}", f"t{rng.randint(0, 2)}", i, rng.choice(["pendente", "revisao"]), f"2026-03-{i + 1:02d}", rng.choice(["", None, f"n{i}"])) for i in range(28)]
    schema = "course_id string, unit_slug string, topic_slug string, ord long, status string, date string, next_topic string"
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(5):
        spark.createDataFrame(rows[6 * k : 6 * k + 6], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        study.stream_study(stream, path, str(tmp_path / "state"), every=2).awaitTermination()
    whole = study.numbered(spark.createDataFrame(rows, schema), spark.createDataFrame([], study.TOPICS))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(study.read_sessions(spark, path), whole)
    assert same(study.read_topics(spark, path), study.topic_states(whole))
    assert same(study.read_students(spark, path), study.student_states(whole))
    last = {r.course_id: r for r in study.read_students(spark, path).collect()}
    mine = [r for r in rows if r[0] == "a"]
    assert last["a"].active.sessions == sum(r[1:3] == mine[-1][1:3] for r in mine) and last["a"].updated == mine[-1][5]
    assert [(x.topic_slug, x.date) for x in last["a"].recent] == [(r[2], r[5]) for r in mine[::-1]][: study.RECENT]
    assert last["a"].next_topic == [r[6] for r in mine if r[6]][-1]
    for name in ("sessions", "topics", "students"):
        assert len(Tiles(spark, f"{path}/{name}").ranges()) <= 5
