"""How the given tables stand for courses, documents, topics and schedules in the registered queries.

documents: source = course, lang = category; benchmark: topics and units, two or more a course; pages: web sources;
conversations: study sessions; events: tasks; orders and lineitem: dated entries with pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemill.functions import vocab

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COURSES = 20


def query(name: str, sql: str | None = None):
    """Registers a query, with SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries: course_id, doc_id, title (first 60 characters), category, markdown."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("course_id"), "doc_id", F.substring("text", 1, 60).alias("title"), F.col("lang").alias("category"), F.coalesce("text", F.lit("")).alias("markdown"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as topics of courses: the first three words are the label, the next two an alias."""
    b = table(spark, sf_dir, "benchmark")
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return b.select(
        F.concat(F.lit("src"), F.pmod("item_id", F.lit(COURSES))).alias("course_id"), F.col("item_id").alias("topic_ord"), F.concat(F.lit("topic-"), "item_id").alias("topic_slug"), F.array_join(F.slice(words, 1, 3), " ").alias("topic_label"),
        F.concat(F.lit("unit-"), F.pmod("item_id", F.lit(3))).alias("unit_slug"), F.pmod("item_id", F.lit(3)).cast("int").alias("unit_ord"), F.when(F.pmod("item_id", F.lit(2)) == 0, "topic").otherwise("subtopic").alias("kind"), F.array(F.array_join(F.slice(words, 4, 2), " ")).alias("aliases"), "text",
    )


# DuckDB fragments of the same frames
SQL_WS = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def sql_norm(x: str) -> str:
    """A match text in DuckDB."""
    return rf"trim(regexp_replace(regexp_replace(replace(lower(strip_accents(coalesce({x}, ''))), 'propocional', 'proposicional'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: length(t) >= 4)"


def sql_slug(x: str) -> str:
    """A slug in DuckDB."""
    t = rf"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(strip_accents(coalesce({x}, '')))), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-')"
    return f"coalesce(nullif({t}, ''), 'untitled')"


def sql_any(x: str, words: list[str], start: str = "", end: str = "") -> str:
    """Whether a text holds one of the words, at its start or end if these are `^` or `$`."""
    return f"regexp_matches({x}, '{start}(?:{'|'.join(w.replace('+', chr(92) + '+') for w in words)}){end}')"


def sql_candidate(x: str) -> str:
    """Whether a text may be a topic, in DuckDB."""
    n, g = sql_norm(x), sql_slug(x)
    return rf"""NOT (list_contains({vocab.GENERIC_SLUGS}, {g}) OR length({g}) < 4 OR list_contains({vocab.WEAK_HEADINGS + vocab.STRUCTURAL_HEADINGS}, {n}) OR {sql_any(n, vocab.WEAK_STARTS + vocab.GOAL_STARTS, '^')} OR len(string_split({n}, ' ')) > 6
    OR {sql_any(n, vocab.KNOWN_TOOLS)} OR {sql_any(n, vocab.BIBLIOGRAPHY_MARKERS)} OR regexp_matches({n}, '\b(?:19|20)\d{{2}}\b') OR len(regexp_extract_all({n}, '\b[a-z]\b')) >= 3 OR ({sql_any(n, vocab.GOAL_ENDS, end='$')} AND len(string_split({n}, ' ')) > 5))"""


def sql_stems(x: str) -> str:
    """Stems of a heading in DuckDB."""
    s = rf"regexp_replace(regexp_replace(regexp_replace({SQL_WS.format(x)}, '^\d+(?:\.\d+)*\.?\s*', ''), '(?i)^(?:unidade|tema|topico)\s+\d+\s*[-—:]?\s*', ''), '(?i)^(?:especificacao|especificação)\s+de\s+', '')"
    return f"list_distinct(list_transform(list_filter({sql_tokens(sql_norm(s))}, lambda t: t NOT IN ('sobre', 'para', 'entre')), lambda t: left(t, 5)))"


SQL_LINES = "string_split_regex({0}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
SQL_TOPICS = rf"""topics AS (SELECT 'src' || (item_id % {COURSES}) AS course_id, item_id AS topic_ord, 'topic-' || item_id AS topic_slug, array_to_string(w[1:3], ' ') AS topic_label,
    'unit-' || (item_id % 3) AS unit_slug, (item_id % 3)::INT AS unit_ord, CASE WHEN item_id % 2 = 0 THEN 'topic' ELSE 'subtopic' END AS kind, array_to_string(w[4:5], ' ') AS alias, text
    FROM (SELECT *, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark))"""
