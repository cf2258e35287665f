"""Queries over plans, glossaries, headings and page marks made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemill.functions import text as X, vocab
from coursemill.operators import catalog as C, documents as D, taxonomy
from coursemill.plans.tables import query, sql_any, sql_norm, table


def _ordered(df: DataFrame, key: str, order: str, line: F.Column) -> DataFrame:
    """One text per key of its lines in order."""
    return df.withColumn("__l", line).groupBy(F.col(key).alias("course_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__l"))), lambda x: x["__l"]), "\n").alias("text"))


@query("plan_topics", """
SELECT c_nationkey AS course_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT AS unit_ord, 'unidade-' || lpad((c_custkey % 20 + 1)::VARCHAR, 2, '0') || '-' || lower(c_mktsegment) AS unit_slug, '1.' || c_custkey AS topic_code, 'Tema ' || lower(c_mktsegment) AS topic_text, 0 AS depth FROM customer""")
def plan_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and topics of teaching plans (a nation's customers as units). F21"""
    c = table(spark, sf_dir, "customer")
    line = F.format_string("### Unidade %d - %s\n1.%d. Tema %s;\nObjetivos: x", F.col("c_custkey") % 20 + 1, "c_mktsegment", "c_custkey", F.lower("c_mktsegment"))
    plans = _ordered(c, "c_nationkey", "c_custkey", line).withColumnRenamed("text", "plan")
    return taxonomy.plan_units(plans).select("course_id", F.col("unit_ord").cast("int").alias("unit_ord"), "unit_slug", "topic_code", "topic_text", "depth")


@query("plan_references", """
WITH k AS (SELECT s_nationkey AS course_id, s_suppkey AS i, s_suppkey % 2 = 0 AS basic, s_suppkey % 3 AS c, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT course_id, CASE WHEN basic THEN 'basic' ELSE 'complementary' END AS section, 'SILVA, J. ' || s_name || '. ' || (1990 + i % 40) || '.' || CASE c WHEN 0 THEN '' WHEN 1 THEN ' parte ' || i ELSE ' parte ' || i || ' e fim de ' || lower(s_name) END AS reference FROM k
UNION ALL SELECT course_id, CASE WHEN basic THEN 'basic' ELSE 'complementary' END, 'COSTA, M.; LIMA ' || i FROM k WHERE i % 4 = 1""")
def plan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic and complementary references of plans, with lines that go on, marks before them and sections between. F22"""
    s = table(spark, sf_dir, "supplier")
    more = F.expr("case s_suppkey % 3 when 0 then '' when 1 then concat('\nparte ', s_suppkey) else concat('\n  parte ', s_suppkey, '\ne fim de ', lower(s_name)) end")
    mark = F.expr("case s_suppkey % 3 when 0 then '- ' when 1 then '1. ' else '[2] ' end")
    first = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Bibliografia Básica:").otherwise("**Bibliografia Complementar"), F.lit("\n"), mark, F.lit("SILVA, J. "), "s_name", F.lit(". "), 1990 + F.col("s_suppkey") % 40, F.lit("."), more)
    line = F.concat(first, F.when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("\n• COSTA, M.; LIMA "), "s_suppkey")).otherwise(""), F.lit("\n## Outra parte\nSOUZA, A. fora"))
    return taxonomy.bibliography(_ordered(s, "s_nationkey", "s_suppkey", line).withColumnRenamed("text", "plan")).select("course_id", "section", "reference")


@query("glossary_terms", """
SELECT p_size AS course_id, p_name AS term, p_brand AS unit_hint, 'alfa ' || p_partkey || '|beta' AS synonyms, 'Um ' || lower(p_type) AS definition FROM part""")
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of Markdown glossaries (parts by size). F24"""
    p = table(spark, sf_dir, "part")
    line = F.format_string("## %s\n- **Unidade:** %s\n**Sinônimos:** alfa %d; beta\nDefinição: Um %s\n", "p_name", "p_brand", "p_partkey", F.lower("p_type"))
    return taxonomy.glossary(_ordered(p, "p_size", "p_partkey", line).withColumnRenamed("text", "glossary")).select("course_id", "term", "unit_hint", F.array_join("synonyms", "|").alias("synonyms"), "definition")


@query("strong_headings", """
WITH h AS (SELECT source AS course_id, doc_id AS ord, i - 1 AS pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS heading
  FROM (SELECT source, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT source, doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')[1:4] AS l FROM documents))),
s AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(strip_accents(heading))), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '-') AS g FROM h)
SELECT course_id, CASE WHEN g = '' THEN 'untitled' ELSE g END AS slug, min(ord) AS ord FROM s GROUP BY ALL""")
def strong_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four headings of every document (whole lines), once per course. T3, F9"""
    lines = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1, 4)
    md = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("# "), X.collapse_ws(x))), "\n")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), F.col("doc_id").alias("ord"), md.alias("markdown"))
    return taxonomy.strong_headings(docs).select("course_id", "slug", "ord")


@query("clamped", """
WITH h AS (SELECT doc_id, coalesce(text, '') AS s, left(coalesce(text, ''), 300) AS h FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 300 THEN s ELSE rtrim(CASE WHEN contains(h, chr(10)) THEN left(h, length(h) - instr(reverse(h), chr(10))) ELSE h END, ' ') || chr(10) || chr(10) || '> ...' END AS clamped FROM h""")
def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at the end of a line. T4"""
    return table(spark, sf_dir, "documents").select("doc_id", X.clamp("text", 300).alias("clamped"))


@query("migrated_pages", """
WITH i AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS k, CASE WHEN l_returnflag = 'N' THEN 'a_page_x.png' ELSE 'b.png' END AS fname FROM lineitem)
SELECT doc_id, CASE WHEN contains(fname, '_page_') THEN k + 1 ELSE k END AS page_key, fname FROM i""")
def migrated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page keys of image curation moved to count from one. P25"""
    li = table(spark, sf_dir, "lineitem")
    i = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_key"), F.when(F.col("l_returnflag") == "N", "a_page_x.png").otherwise("b.png").alias("fname")).distinct()
    return C.migrate_page_keys(i).select("doc_id", "page_key", "fname")


@query("card_titles", r"""
WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[:\n]', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM conversations), w AS (SELECT *, array_to_string(string_split(x, ' ')[1:turn % 3 + 1], ' ') AS a, array_to_string(string_split(x, ' ')[2:3], ' ') AS b FROM t)
SELECT conv_id, turn, array_to_string(list_filter(CASE WHEN turn % 4 = 0 THEN [role] WHEN a = b THEN [role, a] WHEN a = role THEN [role, b] WHEN b = role THEN [role, a] ELSE [role, a, b] END, lambda x: x <> ''), '|') AS cards FROM w""")
def card_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of cards in texts: of words of the text, repeated, and in lines that only speak of cards. F27"""
    c = table(spark, sf_dir, "conversations")
    x = X.collapse_ws(F.regexp_replace(F.coalesce("text", F.lit("")), r"[:\n]", " "))
    words = F.split(x, " ")
    more = F.concat(F.lit("\n- Tópico:  "), F.array_join(F.slice(words, F.lit(1), F.col("turn").cast("int") % 3 + 1), " "), F.lit("  \ntopico: "), F.array_join(F.slice(words, 2, 2), " "))
    t = F.concat(F.lit("Card: "), "role", F.lit("\num card de "), x, F.when(F.col("turn") % 4 == 0, "\nnada").otherwise(more), F.lit("\nCARD: "), "role")
    return c.select("conv_id", "turn", F.array_join(X.card_titles(t), "|").alias("cards"))


@query("image_pages", r"""
WITH d AS (SELECT doc_id, doc_id % 9 + 1 AS p, doc_id % 5 AS k, md5(coalesce(replace(text, chr(10), ' '), '') || ' x![](base/q.png)![](http://e/r.png)') AS m FROM documents),
i AS (SELECT doc_id, m, unnest(CASE k WHEN 0 THEN [{'f': 'a.png', 'p': p + 10}, {'f': 'b.png', 'p': p + 13}] WHEN 1 THEN [{'f': 'b.png', 'p': p + 13}, {'f': 'a.png', 'p': p + 13}] WHEN 2 THEN [] ELSE [{'f': 'a.png', 'p': p + 13}, {'f': 'b.png', 'p': p + 10}] END, recursive := true) FROM d)
SELECT doc_id, f AS fname, p::INT AS page, m AS relinked_md5 FROM i""")
def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of images by page marks, first ones only, and relative references put below a folder. F16, F17"""
    d = table(spark, sf_dir, "documents")
    mark = lambda n: F.concat((F.col("doc_id") % 9 + 1 + n).cast("string"), F.lit("\n" + "-" * 48 + "\n"))
    image = lambda f: F.lit(f"![fig]({f}.png) ")
    k = F.col("doc_id") % 5
    # an image before the first mark has no page; a second reference changes nothing
    head = F.when(k == 0, image("x/a")).when(k == 1, "").when(k == 2, "").otherwise(image("y/b"))
    tail = F.when(k == 0, F.concat(image("x/a"), image("b"))).when(k == 1, F.concat(image("b"), image("z/a"))).when(k == 2, "12\n---\ntexto").otherwise(F.concat(image("a"), image("b")))
    text = F.concat(F.when(k == 1, image("w/c")).otherwise(""), F.lit("texto\n"), mark(0), head, F.lit("\n"), mark(3), tail)
    docs = d.select("doc_id", text.alias("markdown"), F.concat(F.coalesce(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("")), F.lit(" x![](./q.png)![](http://e/r.png)")).alias("t"))
    pages = D.image_page_map(docs, ["doc_id"], offset=10)
    return pages.join(docs, "doc_id").select("doc_id", "fname", "page", F.md5(X.relink_images("t", "base/")).alias("relinked_md5"))


_SAID = "case turn % 4 when 0 then 'Simulado da P2: ' when 1 then 'Revisão ' when 2 then 'Prova 1 com ' else '' end || case when turn % 5 = 0 then 'Isabelle ' else '' end || coalesce(text, '')"


@query("course_flags", rf"""
WITH n AS (SELECT conv_id, turn, {sql_norm(_SAID)} AS n FROM conversations)
SELECT conv_id, turn, {sql_any('n', vocab.REVIEW_CUES)} AND regexp_matches(n, '(?:^|[^a-z0-9])(?:{"|".join(vocab.EXAM_CUES)})(?:$|[^a-z0-9])') AS review, {sql_any('n', vocab.FORMAL_WORDS)} AS formal FROM n""")
def course_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exam review and formal-methods flags of whole texts, some of which begin with cues. F32"""
    n = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.match_text(F.expr(_SAID), "c").alias("n"))
    return n.select("conv_id", "turn", taxonomy.exam_review(F.col("n")).alias("review"), taxonomy.formal_course(F.col("n")).alias("formal"))
