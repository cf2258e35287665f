"""Study progress: imports, boards, summaries, gates, history. IDs in brackets are those of the operator inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from coursemill.functions.text import collapse_ws, fold, frontmatter, slugify, strip, strip_frontmatter
from coursemill.functions.vocab import STATUSES


def status(c: Column) -> Column:
    """A status by its current name; unknown ones are pending. [A14]"""
    s = F.regexp_replace(F.lower(fold(F.trim(F.coalesce(c, F.lit(""))))), r"[\s-]+", "_")
    return F.when(s.isin(STATUSES), s).when(s.rlike("^compreend|^entend|^ok$|^feito"), "compreendido").when(s.rlike("^em_|^parcial|^andamento"), "em_progresso").when(s.rlike("^revis"), "revisao").otherwise("pendente")


def read_imports(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Study sessions from frontmatter blocks: topic, unit, status, date, time, body, and errors. [F30]

    A missing date or time is that of the run.
    """
    df = blocks.withColumn("__m", frontmatter(text))
    value = lambda k: collapse_ws(F.element_at("__m", k))
    out = df.withColumns({
        "topic_slug": value("topic_slug"), "unit_slug": value("unit"), "status": value("status"), "next_topic": value("next_topic"),
        "date": F.coalesce(F.nullif(value("date"), F.lit("")), F.date_format(F.current_timestamp(), "yyyy-MM-dd")), "time": F.coalesce(F.nullif(value("time"), F.lit("")), F.date_format(F.current_timestamp(), "HH:mm")),
        "body": strip(strip_frontmatter(text)),
    }).drop("__m")
    errors = F.array(F.when(F.col("topic_slug") == "", F.lit("topic_slug")), F.when(F.col("unit_slug") == "", F.lit("unit")), F.when(~F.col("status").isin(STATUSES), F.lit("status")))
    return out.withColumn("errors", F.filter(errors, lambda x: x.isNotNull()))


def validate_imports(imports: DataFrame, outline: DataFrame) -> DataFrame:
    """Errors of imports whose unit, or topic in that unit, the outline lacks. [J11]"""
    units = outline.select("course_id", "unit_slug", F.lit(True).alias("__unit")).distinct()
    topics = outline.select("course_id", "unit_slug", "topic_slug", F.lit(True).alias("__topic")).distinct()
    out = imports.join(units, ["course_id", "unit_slug"], "left").join(topics, ["course_id", "unit_slug", "topic_slug"], "left")
    errors = F.filter(F.array(F.when(F.col("__unit").isNull(), F.lit("unit_slug")).when(F.col("__topic").isNull(), F.lit("topic_slug"))), lambda x: x.isNotNull())
    return out.withColumn("errors", errors).drop("__unit", "__topic")


def latest(sessions: DataFrame, key: list[str]) -> DataFrame:
    """Per key the latest status and how many sessions, by partial aggregation. sessions: key, ord, status."""
    return sessions.groupBy(*key).agg(F.max_by("status", "ord").alias("status"), F.count("*").alias("n_sessions"), F.max("ord").alias("last"))


def board(outline: DataFrame, states: DataFrame, key: list[str]) -> DataFrame:
    """Each outline topic with its status, pending by default. [J10]"""
    return outline.join(states, key, "left").withColumns({"status": F.coalesce("status", F.lit("pendente")), "n_sessions": F.coalesce("n_sessions", F.lit(0))})


def unit_gate(progress: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """Whether each unit may close: every topic understood, or forced; with the topics still open. [A11]"""
    done = F.col("status") == "compreendido"
    return progress.groupBy(*key).agg((F.bool_and(done) | F.lit(force)).alias("may_close"), F.sort_array(F.collect_list(F.when(~done, F.col("topic_slug")))).alias("open_topics"))


def bullets(body: Column, heading: str) -> Column:
    """Bullets below a bold or `###` heading of a session's text."""
    part = F.regexp_extract(F.coalesce(body, F.lit("")), rf"(?is)(?:^|\n)(?:#+\s*|\*\*){heading}[^\n]*\n(.*?)(?=\n(?:#+\s|\*\*)|$)", 1)
    return F.transform(F.regexp_extract_all(part, F.lit(r"(?m)^\s*[-*]\s+(.+?)\s*$"), F.lit(1)), collapse_ws)


def unit_summary(sessions: DataFrame, key: list[str]) -> DataFrame:
    """Per unit: sessions, topics in order, doubts resolved and open (without `nenhuma`). [A10]

    sessions: key, topic_slug, topic_ord, resolved and open_doubts (arrays).
    """
    real = lambda a: F.filter(a, lambda x: ~F.lower(x).rlike(r"^nenhuma?\b"))
    topics = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("topic_ord", "topic_slug"))), lambda x: x["topic_slug"]))
    return sessions.groupBy(*key).agg(F.count("*").alias("n_sessions"), topics.alias("topics"), F.sum(F.size(real("resolved"))).alias("n_resolved"), F.sum(F.size(real("open_doubts"))).alias("n_open"))


def migrate_history(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Rows `| date | unit | topic | status |` of an old history table as sessions with numbers and statuses. [A14]"""
    lines = texts.select(*key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("pos", "line"))
    row = r"^\|\s*(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*([^|]*?)\s*\|"
    hit = lines.filter(F.col("line").rlike(row)).select(*key, "pos", *(F.regexp_extract("line", row, i).alias(c) for i, c in ((1, "date"), (2, "unit"), (3, "topic"), (4, "state"))))
    hit = hit.withColumns({"unit_slug": slugify("unit"), "topic_slug": slugify("topic"), "status": status(F.col("state"))})
    return hit.withColumn("session", F.row_number().over(W.partitionBy(*key, "unit_slug", "topic_slug").orderBy("pos")))


def outline_labels(topics: DataFrame, key: list[str]) -> DataFrame:
    """Hierarchical numbers like `2.1.3` by depth, for topics in order. [W16]

    The number at a depth counts rows of that depth since the latest row of a lower depth: a running count, less what it was at
    that row, for the depths that plans have (four). All windows share one order, so an outline is sorted once.
    """
    w = W.partitionBy(*key).orderBy("topic_ord")
    df = topics.withColumns({f"__c{d}": F.sum(F.when(F.col("depth") == d, 1).otherwise(0)).over(w) for d in range(4)})
    df = df.withColumns({f"__n{d}": F.col(f"__c{d}") - F.coalesce(F.last(F.when(F.col("depth") < d, F.col(f"__c{d}")), ignorenulls=True).over(w), F.lit(0)) for d in range(4)})
    parts = F.array(*(F.when(F.lit(d) <= F.col("depth"), F.greatest(F.col(f"__n{d}"), F.lit(1)).cast("string")) for d in range(4)))
    return df.withColumn("label", F.array_join(F.filter(parts, lambda x: x.isNotNull()), ".")).select(*topics.columns, "label")
