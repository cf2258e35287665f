"""Incremental builds: only courses whose inputs changed are built again, and readers see whole builds only. [X1, J1, job]

A course's inputs have a digest. A run compares it with the one of the version before, builds the courses that differ,
writes them as a folder of its own version, and last the table that tells of each course in which version it lies. Nothing
is overwritten: a reader takes the newest finished table, a run that fails leaves the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemill.sources.staging import staged
from coursemill.sources.tiles import Folder

POINTERS = "course_id string, version int, digest string"


def course_digests(inputs: dict[str, DataFrame]) -> DataFrame:
    """course_id, digest: of each input its number of rows and two sums of 64-bit hashes over its rows, in any order."""
    out = None
    for name, df in sorted(inputs.items()):
        row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        sums = [F.sum(F.xxhash64(row, F.lit(seed)).cast("decimal(38, 0)")) for seed in (1, 2)]
        part = df.filter("course_id is not null").groupBy(F.col("course_id").cast("string").alias("course_id")).agg(F.concat_ws(":", F.lit(name), F.count("*"), *sums).alias("part"))
        out = part if out is None else out.union(part)
    return out.groupBy("course_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), "|"), 256).alias("digest"))


def pointers(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    """The newest finished version and its table: course_id, version, digest; 0 and no rows without any."""
    done = [int(n) for n in Folder(spark, f"{root}/versions").names()]
    if not done:
        return 0, spark.createDataFrame([], POINTERS)
    return max(done), spark.read.schema(POINTERS).parquet(f"{root}/versions/{max(done)}")


def run(spark: SparkSession, root: str, inputs: dict[str, DataFrame], build: Callable[[dict[str, DataFrame]], DataFrame]) -> int:
    """Builds the courses that are new or differ, forgets those without input, and publishes; returns the new version.

    inputs: frames with course_id; build: their frames for some courses to rows with course_id.
    """
    last, before = pointers(spark, root)
    version = last + 1
    digests = staged(course_digests(inputs), "digests")
    touched = staged(digests.join(before.select("course_id", F.col("digest").alias("__old")), "course_id", "left").filter("__old is null or __old <> digest").select("course_id", "digest"), "touched")
    if not touched.isEmpty():
        # a course that is touched meets its rows by its key; the list of courses is the small side
        part = {n: df.join(touched.select("course_id"), "course_id", "left_semi").select(*df.columns) for n, df in inputs.items()}
        Folder(spark, f"{root}/data").write(build(part), f"version={version}")
    kept = before.join(digests.select("course_id"), "course_id", "left_semi").join(touched.select("course_id"), "course_id", "left_anti")
    every = kept.select("course_id", "version", "digest").union(touched.select("course_id", F.lit(version), "digest"))
    Folder(spark, f"{root}/versions").write(every, str(version))
    return version


def read(spark: SparkSession, root: str) -> DataFrame:
    """The newest build: each course's rows from the version that its pointer names, with that version."""
    _, now = pointers(spark, root)
    used = {r.version for r in now.select("version").distinct().collect()}  # versions, not courses: `vacuum` bounds them
    names = [n for n in Folder(spark, f"{root}/data").names() if int(n.partition("=")[2]) in used]
    if not names:
        raise FileNotFoundError(f"no build below {root}")
    rows = spark.read.option("basePath", f"{root}/data").parquet(*(f"{root}/data/{n}" for n in names))
    return rows.join(now.select("course_id", "version"), ["course_id", "version"], "left_semi")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Drops all but the newest `keep` tables of versions, and the data that none of these names."""
    versions, data = Folder(spark, f"{root}/versions"), Folder(spark, f"{root}/data")
    done = sorted(int(n) for n in versions.names())
    used = {r.version for v in done[-keep:] for r in spark.read.schema(POINTERS).parquet(f"{root}/versions/{v}").select("version").distinct().collect()}
    for v in done[:-keep]:
        versions.drop(str(v))
    for n in data.names():
        if int(n.partition("=")[2]) not in used:
            data.drop(n)
